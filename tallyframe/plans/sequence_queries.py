"""Queries over ordered signals, vectors and plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching, sampling, statistics
from ..streaming import stateful
from .fixtures import LEN, SIGNAL, frame_signal, lengths, table
from .named import book
from .observation_queries import KEPT_SQL

QUERIES, ORACLE, query = book()

BASE = f"{SIGNAL}, {LEN}"


@query(f"WITH {BASE} SELECT video_id, unnest(list_distinct(list_transform(range(30), lambda i: CASE WHEN i = 29 THEN total - 1 ELSE floor(i::DOUBLE * ((total - 1)::DOUBLE / 29.0))::BIGINT END))) AS frame_id FROM len")
def uniform_keyframes(spark, sf_dir):
    return sampling.uniform(lengths(frame_signal(spark, sf_dir)), "video_id", "total", 30)


@query(f"WITH {BASE} SELECT video_id, unnest(list_distinct(list_append(range(0, total, 4), total - 1))) AS frame_id FROM len")
def fps_keyframes(spark, sf_dir):
    return sampling.by_rate(lengths(frame_signal(spark, sf_dir)), "video_id", "total", 30.0, 8.0)


@query(f"WITH {BASE} SELECT video_id, unnest(list_distinct(list_transform(range(8), lambda i: round_even(i::DOUBLE * (total - 1) / 7.0, 0)::BIGINT))) AS frame_id FROM len")
def rounded_keyframes(spark, sf_dir):
    return sampling.rounded(lengths(frame_signal(spark, sf_dir)), "video_id", "total", 8)


def _gate_sql(limit: float, cumulative: bool, closing: bool, most: int | None) -> str:
    total = "CASE WHEN g.take THEN 0.0 ELSE g.total END + sig.signal" if cumulative else "sig.signal"
    stop = f"AND g.n < {most}" if most else ""
    end = "" if not closing else f""" UNION ALL SELECT l.video_id, l.total - 1 FROM len l JOIN (SELECT video_id, max(frame_id) AS f, count(*) AS n FROM g WHERE take GROUP BY video_id) x USING (video_id)
      WHERE l.total - 1 - x.f >= 5 {f'AND x.n < {most}' if most else ''}"""
    return f"""WITH RECURSIVE {BASE}, sm AS MATERIALIZED (SELECT * FROM sig), g AS (
      SELECT video_id, frame_id, frame_id AS last, 0.0::DOUBLE AS total, 1 AS n, true AS take FROM sm WHERE frame_id = 0
      UNION ALL SELECT video_id, frame_id, CASE WHEN take THEN frame_id ELSE last END, total, CASE WHEN take THEN n + 1 ELSE n END, take FROM (
        SELECT g.video_id, sig.frame_id, g.last, g.n, {total} AS total,
          sig.frame_id - g.last >= 5 AND (sig.frame_id - g.last >= 15 OR {total} >= {limit}) {stop} AS take
        FROM g JOIN sm sig ON sig.video_id = g.video_id AND sig.frame_id = g.frame_id + 1))
    SELECT video_id, frame_id FROM g WHERE take{end}"""


@query(_gate_sql(600.0, True, True, 60))
def keyframe_gate(spark, sf_dir):
    return sampling.gate(frame_signal(spark, sf_dir), "video_id", 600.0)


@query(_gate_sql(600.0, True, True, 60))
def keyframe_gate_segments(spark, sf_dir):
    """The same keyframes with each video cut into segments of 32 frames, whose state maps are followed."""
    return sampling.gate_by_segments(frame_signal(spark, sf_dir), "video_id", 600.0, each=32)


@query(_gate_sql(150.0, False, False, None))
def scene_gate(spark, sf_dir):
    return sampling.gate(frame_signal(spark, sf_dir), "video_id", 150.0, most=None, closing=False, cumulative=False)


PICKED = "picked AS (SELECT video_id, frame_id FROM sig WHERE frame_id % 11 = 0)"


@query(f"""WITH {BASE}, {PICKED}, need AS (SELECT len.*, 8 - coalesce(n, 0) AS need FROM len LEFT JOIN (SELECT video_id, count(*) AS n FROM picked GROUP BY 1) USING (video_id)),
offered AS (SELECT video_id, need, unnest(range(0, total, greatest(1, total // 9))) AS frame_id FROM need WHERE need > 0),
unseen AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS place FROM offered o WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.video_id = o.video_id AND p.frame_id = o.frame_id))
SELECT * FROM picked UNION ALL SELECT video_id, frame_id FROM unseen WHERE place <= need""")
def min_fill(spark, sf_dir):
    signal = frame_signal(spark, sf_dir)
    return sampling.fill_to(signal.where("frame_id % 11 = 0").select("video_id", "frame_id"), lengths(signal), "video_id", "total", 8)


@query(f"""WITH {BASE}, odd AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS total FROM sig WHERE frame_id % 2 = 1)
SELECT video_id, frame_id FROM odd WHERE total <= 7 OR list_contains(list_transform(range(7), lambda i: CASE WHEN i = 6 THEN total - 1 ELSE floor(i::DOUBLE * ((total - 1)::DOUBLE / 6.0))::BIGINT END), place)""")
def downsample_max(spark, sf_dir):
    return sampling.thin_to(frame_signal(spark, sf_dir).where("frame_id % 2 = 1").select("video_id", "frame_id"), "video_id", 7)


@query(f"""WITH {BASE}, v AS (SELECT *, frame_id - row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS island FROM sig WHERE event_type IN ('click', 'view', 'error'))
SELECT video_id, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS length FROM v GROUP BY video_id, island HAVING count(*) >= 3""")
def invalid_runs(spark, sf_dir):
    signal = frame_signal(spark, sf_dir).withColumn("valid", ~F.col("event_type").isin("click", "view", "error"))
    return sampling.invalid_runs(signal, "video_id")


@query(f"""WITH {SIGNAL} SELECT video_id, frame_id, round(signal - lag(signal) OVER (PARTITION BY video_id ORDER BY frame_id), 6) AS displacement FROM sig""")
def displacement_lag(spark, sf_dir):
    at = Window.partitionBy("video_id").orderBy("frame_id")
    return frame_signal(spark, sf_dir).select("video_id", "frame_id", F.round(F.col("signal") - F.lag("signal").over(at), 6).alias("displacement"))


@query(f"""WITH {SIGNAL}, h AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY signal, frame_id) AS place, count(*) OVER (PARTITION BY video_id) AS n FROM sig),
best AS (SELECT * FROM h WHERE place <= greatest(1, n // 2)), m AS (SELECT video_id, median(signal) AS middle FROM best GROUP BY 1)
SELECT video_id, count(*) AS inliers, round(avg(signal), 6) AS displacement FROM best JOIN m USING (video_id) WHERE signal < greatest(1, 3 * middle) GROUP BY video_id""")
def displacement_inliers(spark, sf_dir):
    return statistics.robust_mean(frame_signal(spark, sf_dir), "video_id", "signal", "frame_id").withColumn("displacement", F.round("displacement", 6))


DIST = "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
QUERY_ROWS = "vec_id % 50 = 0"  # the stated query set of nearest-neighbour searches; the base is every row


def _knn_sql(k: int) -> str:
    return f"""knn AS MATERIALIZED (SELECT * FROM (SELECT q, b, d, row_number() OVER (PARTITION BY q ORDER BY d, b) AS place FROM (
      SELECT q.vec_id AS q, b.vec_id AS b, {DIST} AS d FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.{QUERY_ROWS})) WHERE place <= {k})"""


def _knn(spark, sf_dir, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return matching.neighbours(e.where(QUERY_ROWS), e, k)


@query(f"WITH {_knn_sql(2)} SELECT q, b, round(d, 4) AS squared, place FROM knn")
def knn_two(spark, sf_dir):
    return _knn(spark, sf_dir, 2).withColumn("squared", F.round("squared", 4))


@query(f"WITH {_knn_sql(2)}, t AS (SELECT q, arg_min(b, place) AS b, min(d) AS d1, max(d) AS d2 FROM knn GROUP BY q HAVING count(*) = 2) SELECT q, b FROM t WHERE sqrt(d1) < 0.95 * sqrt(d2)")
def knn_ratio_test(spark, sf_dir):
    return matching.ratio_test(_knn(spark, sf_dir, 2), 0.95)


_HAMMING = """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
d AS (SELECT q.vec_id AS q, b.vec_id AS b, len(list_filter(list_zip(q.bits, b.bits), lambda z: z[1] <> z[2])) AS distance FROM c q JOIN c b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, b) AS place FROM d QUALIFY place <= 2)"""


def _hamming(spark, sf_dir):
    codes = table(spark, sf_dir, "embeddings").select("vec_id", matching.sign_code(F.col("embedding"), 64).alias("code"))
    return matching.hamming_neighbours(codes.where("vec_id % 50 = 0"), codes, 2, words=1)


@query(f"{_HAMMING} SELECT q, b, distance::INT AS distance, place FROM n")
def hamming_knn(spark, sf_dir):
    """The two nearest binary codes, the signs of the vectors, of a query set against all rows."""
    return _hamming(spark, sf_dir)


@query(f"{_HAMMING} SELECT q, arg_min(b, place) AS b FROM n GROUP BY q HAVING count(*) = 2 AND min(distance) < 0.9 * max(distance)")
def hamming_ratio_test(spark, sf_dir):
    return matching.ratio_test(_hamming(spark, sf_dir), 0.9, F.col("distance").cast("double"))


@query(f"""WITH f AS (SELECT q, arg_min(b, (d, b)) AS b FROM (SELECT q.vec_id AS q, b.vec_id AS b, {DIST} AS d FROM embeddings q JOIN embeddings b ON b.vec_id % 50 <> 0 WHERE q.{QUERY_ROWS}) GROUP BY q),
r AS (SELECT b, arg_min(q, (d, q)) AS q FROM (SELECT q.vec_id AS q, b.vec_id AS b, {DIST} AS d FROM embeddings q JOIN embeddings b ON b.vec_id % 50 <> 0 WHERE q.{QUERY_ROWS}) GROUP BY b)
SELECT f.q, f.b FROM f JOIN r ON r.q = f.q AND r.b = f.b""")
def mutual_nn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one, two = e.where(QUERY_ROWS), e.where(f"not ({QUERY_ROWS})")  # two frames' descriptors
    return matching.mutual(matching.neighbours(one, two, 1), matching.neighbours(two, one, 1))


@query(f"""WITH {_knn_sql(1)} SELECT l.label AS truth, {', '.join(f"count(*) FILTER (WHERE p.label = {k}) AS p{k}" for k in range(10))}, round(avg((p.label = l.label)::INT), 6) AS recall
FROM knn JOIN embeddings l ON l.vec_id = knn.q JOIN embeddings p ON p.vec_id = knn.b GROUP BY l.label""")
def confusion_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = _knn(spark, sf_dir, 1).join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("said")), "b")
    return found.groupBy("truth").agg(*(F.count_if(F.col("said") == k).alias(f"p{k}") for k in range(10)), F.round(F.avg((F.col("said") == F.col("truth")).cast("int")), 6).alias("recall"))


@query("""WITH s AS (SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)
SELECT event_type, mean, least, most, deviation, n, round(total / sum(total) OVER (), 6) AS share, CASE WHEN mean <= 40 THEN 3 ELSE greatest(0, 3 - least(3, floor((mean - 40) / 5)::INT + 1)) END AS speed_points FROM s""")
def timing_stats(spark, sf_dir):
    """Seven runs' states, merged."""
    runs = table(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 7)
    s = statistics.summary(statistics.states(runs, ["event_type", "run"], "value"), ["event_type"])
    total = F.col("mean") * F.col("n")
    return s.select(
        "event_type", F.round("mean", 6).alias("mean"), "least", "most", F.round("deviation", 6).alias("deviation"), "n", F.round(total / F.sum(total).over(Window.partitionBy()), 6).alias("share"),
        statistics.late_points(F.round("mean", 6), 40.0).alias("speed_points"),
    )  # five rows


@query("""SELECT video_id, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id AS video_id FROM events) CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)
LEFT JOIN (SELECT user_id AS video_id, event_type, count(*) AS n FROM events GROUP BY ALL) USING (video_id, event_type)""")
def zero_fill_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_type")
    kinds = F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view")))
    every = e.select("video_id").distinct().withColumn("event_type", F.explode(kinds))
    return every.join(e.groupBy("video_id", "event_type").agg(F.count(F.lit(1)).alias("n")), ["video_id", "event_type"], "left").select("video_id", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {BASE}, picked AS (SELECT video_id, frame_id FROM sig WHERE frame_id % 3 = 0), mid AS (SELECT video_id, total // 2 AS frame_id FROM len), loaded AS (SELECT video_id, frame_id FROM sig WHERE frame_id % 2 = 0)
(SELECT 'union' AS op, * FROM (SELECT * FROM picked UNION SELECT * FROM mid)) UNION ALL (SELECT 'intersect', * FROM (SELECT * FROM picked INTERSECT SELECT * FROM loaded)) UNION ALL (SELECT 'except', * FROM (SELECT * FROM picked EXCEPT SELECT * FROM loaded))""")
def set_ops(spark, sf_dir):
    signal = frame_signal(spark, sf_dir)
    picked, loaded = (signal.where(f"frame_id % {k} = 0").select("video_id", "frame_id") for k in (3, 2))
    mid = lengths(signal).select("video_id", F.floor(F.col("total") / 2).cast("long").alias("frame_id"))
    parts = {"union": picked.union(mid).distinct(), "intersect": picked.intersect(loaded), "except": picked.exceptAll(loaded).distinct()}
    named = [df.select(F.lit(op).alias("op"), "video_id", "frame_id") for op, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 20""")
def topk_per_class(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", place.alias("place")).where("place <= 20")


@query(ORACLE["keyframe_gate"].split(" UNION ALL SELECT l.video_id")[0])
def stream_keyframes(spark, sf_dir):
    return stateful.keyframes(spark, sf_dir, 600.0)


@query(ORACLE["keyframe_gate"])
def stream_keyframes_out_of_order(spark, sf_dir):
    """The same with frames out of order over three batches, and the closing frame."""
    return stateful.keyframes_out_of_order(spark, sf_dir, 600.0)


@query(f"""WITH {KEPT_SQL}, o AS (SELECT *, min(ord) OVER (PARTITION BY video_id, obj_id) AS first FROM kept)
SELECT video_id, ord, dense_rank() OVER (PARTITION BY video_id ORDER BY first) - 1 AS cluster_id FROM o""")
def stream_dedup(spark, sf_dir):
    return stateful.sightings(spark, sf_dir, 40.0)
