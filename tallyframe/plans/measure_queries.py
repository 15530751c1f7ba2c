"""Queries over files, settings, scalar measures and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, metrics
from ..operators import filters, scoring
from ..sources import files, reports
from .fixtures import DET, LEN, SIGNAL, detections, frame_signal, lengths, table
from .named import book
from .observation_queries import COUNTED_SQL, PAIRS_SQL, counted, perturbed

QUERIES, ORACLE, query = book()

_TYPES = [f"type{k}" for k in range(1, 6)]
PARTS = "SELECT p_partkey AS part, p_size AS size, p_retailprice AS price FROM part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


@query(f"""WITH p AS ({PARTS}) SELECT part, size * 0.5 / 0.25 AS h1, round(price * 0.5 / 0.25, 4) AS h2, 1.0 / 0.25 AS h3, 2.0 * 0.5 AS h7, 1.0 AS h9 FROM p""")
def rescale_transforms(spark, sf_dir):
    h = [F.col("size").cast("double"), F.col("price"), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(1.0)]
    m = geometry.rescale(h, 0.5, 0.25)
    return _parts(spark, sf_dir).select("part", m[0].alias("h1"), F.round(m[1], 4).alias("h2"), m[2].alias("h3"), m[6].alias("h7"), m[8].alias("h9"))


@query(f"""WITH p AS (SELECT part, size * 37 AS w, 480 AS h FROM ({PARTS})), s AS (SELECT *, 640.0 / greatest(w, h) AS scale FROM p)
SELECT part, round(scale, 6) AS scale, floor((640 - round_even(w * scale, 0)) / 2)::BIGINT AS sx, floor((640 - round_even(h * scale, 0)) / 2)::BIGINT AS sy FROM s""")
def letterbox_places(spark, sf_dir):
    scale, left, top = geometry.letterbox(F.col("size") * 37, F.lit(480), 640)
    return _parts(spark, sf_dir).select("part", F.round(scale, 6).alias("scale"), left.cast("long").alias("sx"), top.cast("long").alias("sy"))


@query(f"""WITH p AS (SELECT part, price::DOUBLE AS a, CASE WHEN part % 10 = 0 THEN 0 ELSE size * 6.0 END::DOUBLE AS o FROM ({PARTS})),
c AS (SELECT *, CASE WHEN o > 0 THEN 4 * 3.141592653589793 * a / (o * o) END AS c FROM p)
SELECT part, round(c, 6) AS circularity, round(least(c, 1.0), 6) AS confidence FROM c WHERE a >= 4.8 * 4.8 AND a <= 120.0 * 120.0 AND coalesce(c, 0) >= 0.35""")
def contour_filter(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("part", F.col("price").cast("double").alias("a"), F.when(F.col("part") % 10 == 0, 0.0).otherwise(F.col("size") * 6.0).alias("o"))
    c = geometry.circularity(F.col("a"), F.col("o"))
    return rows.where(filters.blob(F.col("a"), F.col("o"), F.lit(480.0))).select("part", F.round(c, 6).alias("circularity"), F.round(F.least(c, F.lit(1.0)), 6).alias("confidence"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding[1:3], lambda v: round_even(v::DOUBLE, 2) + 0.0), ' ')::VARCHAR IS NOT NULL AS told, list_sum(list_transform(embedding[1:3], lambda v: round_even(v::DOUBLE, 2)))::DOUBLE AS total FROM embeddings""")
def rounded_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", metrics.rounded_list(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")), 2).alias("v"))
    return rows.select("vec_id", (F.size("v") == 3).alias("told"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"""SELECT part, 2 + (part % 2) AS n, part + 7 AS total, round(list_sum([part * 0.5, 0.25]), 4) AS half FROM ({PARTS})""")
def parsed_lists(spark, sf_dir):
    """Comma lists of a command line as numbers, entries that are none left out."""
    part = F.col("part").cast("string")
    whole = metrics.parsed_list(F.concat(F.lit(" 7, x,"), part, F.when(F.col("part") % 2 == 1, F.lit(", 0 ")).otherwise(F.lit(",,"))), "long")
    real = metrics.parsed_list(F.concat((F.col("part") * 0.5).cast("string"), F.lit(",0.25,high")), "double")
    add = lambda v, zero: F.aggregate(v, F.lit(zero), lambda s, x: s + x)
    return _parts(spark, sf_dir).select("part", F.size(whole).cast("long").alias("n"), F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.round(add(real, 0.0), 4).alias("half"))


@query(f"""WITH {DET}, m AS (SELECT video_id, class_name, max(quantity) AS most FROM det GROUP BY ALL)
SELECT video_id, class_name, k AS place, round(k * 0.05, 6) AS threshold FROM m, (SELECT unnest(range(1, 20)) AS k) WHERE k * 50 <= most * 20""")
def threshold_grid(spark, sf_dir):
    """The candidate thresholds of each video and class: steps up to its highest confidence."""
    most = detections(spark, sf_dir).groupBy("video_id", "class_name").agg(F.max("quantity").alias("most"))
    steps = most.select("video_id", "class_name", "most", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(19).cast("long"))).alias("place"))
    return steps.where(F.col("place") * 50 <= F.col("most") * 20).select("video_id", "class_name", "place", F.round(F.col("place") * 0.05, 6).alias("threshold"))


@query(f"""WITH p AS (SELECT part, size::DOUBLE AS video, CASE WHEN part % 9 = 0 THEN 0 ELSE part % 40 END::DOUBLE AS run FROM ({PARTS}))
SELECT part, round(CASE WHEN run > 0 THEN video / run END, 6) AS speedup, round(CASE WHEN run > 0 THEN 30 / run END, 6) AS fps, run <= video AS on_time,
CASE WHEN run <= video THEN 3 ELSE greatest(0, 3 - least(3, floor((run - video) / 5)::INT + 1)) END AS points FROM p""")
def speed_measures(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("part", F.col("size").cast("double").alias("video"), F.when(F.col("part") % 9 == 0, 0.0).otherwise((F.col("part") % 40).cast("double")).alias("run"))
    video, run = F.col("video"), F.col("run")
    return rows.select("part", F.round(metrics.speedup(video, run), 6).alias("speedup"), F.round(metrics.speedup(F.lit(30.0), run), 6).alias("fps"), (run <= video).alias("on_time"), metrics.speed_points(run, video).alias("points"))


@query(f"""WITH {DET} SELECT video_id, ord, least(greatest(round_even(x1, 0), 0), 1280) AS plain, least(greatest(round_even(x1 - 3.6, 0), 0), 1280) AS wide, least(greatest(trunc(x1 - 1.8), 0), 1280) AS cut FROM det""")
def padded_variants(spark, sf_dir):
    """Left edges of the three padded rectangles: no padding, a tenth, and a twentieth cut off."""
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    edge = lambda ratio, rounded: geometry.padded_rectangle(box, 1280, 720, ratio, rounded)[0]
    return detections(spark, sf_dir).select("video_id", "ord", edge(0.0, True).alias("plain"), edge(0.1, True).alias("wide"), edge(0.05, False).alias("cut"))


@query(f"SELECT part, CASE WHEN part % 6 <> 0 AND size >= 25 THEN 'sharp' ELSE 'blurry' END AS side FROM ({PARTS})")
def sharpness_split(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("part", F.when(F.col("part") % 6 != 0, F.col("size")).alias("sharpness"))
    sharp, rest = filters.split_by_sharpness(rows, 25)
    return sharp.select("part", F.lit("sharp").alias("side")).unionByName(rest.select("part", F.lit("blurry").alias("side")))


@query(f"SELECT part, printf('%.4f', greatest(size - 20, 0)::DOUBLE) AS value FROM ({PARTS})")
def time_lines(spark, sf_dir):
    return _parts(spark, sf_dir).select("part", reports.time_text(F.col("size") - 20).alias("value"))


@query(f"""WITH {COUNTED_SQL} SELECT count(*) FILTER (WHERE video_id % 7 <> 0) AS ok, count(*) FILTER (WHERE video_id % 7 = 0) AS failed,
{', '.join(f"coalesce(sum({t}) FILTER (WHERE video_id % 7 <> 0), 0)::BIGINT AS {t}" for t in _TYPES)} FROM counted""")
def batch_totals(spark, sf_dir):
    return reports.batch_totals(counted(spark, sf_dir).withColumn("failed", F.col("video_id") % 7 == 0))


@query("SELECT replace(event_type || '_x', '_', chr(92) || '_') || ' & ' || count(*) || ' & - ' || chr(92) || chr(92) AS value FROM events GROUP BY event_type")
def latex_table(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return reports.latex_rows(rows.select(F.concat("event_type", F.lit("_x")).alias("name"), "n", F.lit(None).cast("string").alias("none")))


@query("""SELECT chr(34) || event_type || ', "" ' || chr(34) || ',' || count(*) || ',' AS value FROM events GROUP BY event_type""")
def csv_table(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return reports.csv_rows(rows.select(F.concat("event_type", F.lit(', " ')).alias("name"), "n", F.lit(None).cast("string").alias("none")))


@query("""WITH s AS (SELECT event_type AS module, avg(value) AS mean, max(value) AS peak, count(DISTINCT user_id) AS videos, sum(value) AS total FROM events GROUP BY 1)
SELECT module, round(mean, 6) AS mean, floor(mean)::BIGINT AS whole, peak, videos, round(total / sum(total) OVER (), 6) AS share, row_number() OVER (ORDER BY mean DESC, module) AS place FROM s""")
def module_ranking(spark, sf_dir):
    """Run averages and peaks by module, slowest first, with their share of the whole."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("module"), F.col("user_id").alias("video"), F.col("value").alias("seconds"))
    found = reports.modules(rows, "module", "video", "seconds")
    return found.select("module", F.round("mean", 6).alias("mean"), "whole", "peak", "videos", F.round("share", 6).alias("share"), "place")


_CASES = ("mp4", "MP4", "Avi", "txt", "webm", "")
_LIST = f"""SELECT '/in/' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'Clip' ELSE 'clip' END || doc_id || CASE doc_id % 6 WHEN 5 THEN '' ELSE '.' || ['mp4', 'MP4', 'Avi', 'txt', 'webm'][doc_id % 6 + 1] END AS path FROM documents"""


@query(f"""WITH p AS ({_LIST}), n AS (SELECT path, regexp_extract(path, '[^/]+$') AS name FROM p)
SELECT path, regexp_replace(name, '\\.[^.]*$', '') AS stem, row_number() OVER (PARTITION BY left(path, 6) ORDER BY lower(name), path) AS place FROM n WHERE regexp_matches(lower(name), '\\.(mp4|avi|webm)$')""")
def video_listing(spark, sf_dir):
    """Video files by suffix in any letter case, each folder's in order of lower-cased names."""
    k = (F.col("doc_id") % 6).cast("int")
    suffix = F.array(*(F.lit(f".{c}" if c else "") for c in _CASES))[k]
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "Clip").otherwise("clip"), F.col("doc_id").cast("string"), suffix).alias("path"), F.lit(0).alias("size"))
    place = F.row_number().over(Window.partitionBy(F.left("path", F.lit(6))).orderBy(F.lower("name"), "path"))
    return files.of_kind(paths).select("path", "stem", place.alias("place"))


@query("SELECT DISTINCT user_id + 100000 AS video_id FROM events WHERE user_id % 2 = 0")
def missing_videos(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"))
    wanted = users.unionByName(users.where("video_id % 2 = 0").select((F.col("video_id") + 100000).alias("video_id")))
    return files.missing(wanted, users, "video_id")


@query(f"""WITH {COUNTED_SQL} SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 'missing' WHEN video_id % 5 = 1 THEN 'not five counts' WHEN video_id % 5 = 2 THEN 'negative' END AS fault FROM counted WHERE video_id % 5 < 3""")
def verify_outputs(spark, sf_dir):
    """Expected videos without a result, or with one that is not five counts of zero and more."""
    rows = counted(spark, sf_dir)
    v = F.col("video_id") % 5
    counts = F.array(*_TYPES)
    written = rows.where(v != 0).select("video_id", F.when(v == 1, F.slice(counts, 1, 4)).when(v == 2, F.transform(counts, lambda c: -c - 1)).otherwise(counts).alias("counts"))
    return reports.faults(rows.select("video_id"), written)


@query(f"WITH {COUNTED_SQL} SELECT video_id, [type1, type2, type3, type4, type5]::VARCHAR AS counts FROM counted")
def result_roundtrip(spark, sf_dir):
    """Results written and read back, after the check that nothing is missing or negative."""
    from .annotation_queries import _folder

    where = _folder(spark)
    reports.save_results(counted(spark, sf_dir), where)
    return reports.load_results(spark, where).select("video_id", F.concat(F.lit("["), F.array_join("counts", ", "), F.lit("]")).alias("counts"))


@query(f"""SELECT 'run' || part AS name, size AS score, round(size / 7.0, 6)::DOUBLE AS mae FROM ({PARTS}) WHERE part % 4 <> 0""")
def experiment_json(spark, sf_dir):
    """Results of experiments from JSON texts: unknown keys are ignored, texts that do not parse or have no name are left out."""
    part, kind = F.col("part").cast("string"), F.col("part") % 4
    good = F.format_string('{"name": "run%s", "score": %d, "mae": %.9f, "extra": [1]}', part, F.col("size"), F.col("size") / 7.0)
    text = F.when(kind != 0, good).when(F.col("part") % 8 == 0, F.lit('{"name": "broken", ')).otherwise(F.lit('{"score": 3}'))
    return reports.load_experiments(_parts(spark, sf_dir).select(text.alias("value"))).select("name", "score", F.round("mae", 6).alias("mae"))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT type, sum(abs(t - p))::BIGINT AS l1, max(abs(t - p)) AS worst FROM pairs GROUP BY type), o AS (SELECT *, row_number() OVER (ORDER BY l1, worst, type) AS n FROM s)
SELECT n AS place, '{{"l1":' || l1 || ',"worst":' || worst || ',"type":"' || type || '"}}' AS value FROM o WHERE n <= 3""")
def tuning_report(spark, sf_dir):
    """The best settings of a search as JSON lines, best first."""
    truth = counted(spark, sf_dir)
    error = F.abs(F.col("t") - F.col("p"))
    found = scoring.matched(truth, perturbed(truth)).groupBy("type").agg(F.sum(error).alias("l1"), F.max(error).alias("worst"))
    return reports.best_as_json(found.select("l1", "worst", "type"), ["l1", "worst", "type"], 3)


@query(f"""SELECT part, CASE WHEN part % 3 = 0 THEN 30.0 ELSE size END::DOUBLE AS fps, CASE WHEN part % 4 = 0 THEN greatest(1, size - 5) ELSE size END::BIGINT AS frames,
round(CASE WHEN part % 4 = 0 THEN greatest(1, size - 5) ELSE size END / CASE WHEN part % 3 = 0 THEN 30.0 ELSE size END, 6)::DOUBLE AS seconds FROM ({PARTS})""")
def video_meta_defaults(spark, sf_dir):
    """Frame rates that are missing or zero become 30, frame counts below one the estimate, at least one."""
    rows = _parts(spark, sf_dir).select("part", F.when(F.col("part") % 3 != 0, F.col("size").cast("double")).when(F.col("part") % 2 == 0, 0.0).alias("f"), F.when(F.col("part") % 4 == 0, 0).otherwise(F.col("size")).alias("n"), (F.col("size") - 5).alias("estimate"))
    fps, frames = metrics.frame_rate(F.col("f")), metrics.frame_count(F.col("n"), F.col("estimate"))
    return rows.select("part", fps.alias("fps"), frames.alias("frames"), F.round(metrics.duration(frames, fps), 6).alias("seconds"))


@query(f"""WITH {SIGNAL}, {LEN} SELECT s.video_id, s.frame_id, s.signal AS high, round(s.signal / 2, 6) AS low FROM sig s JOIN len USING (video_id) WHERE s.frame_id = greatest(0, total // 2)""")
def middle_frames(spark, sf_dir):
    """The middle frame of every video, whole and shrunken."""
    signal = frame_signal(spark, sf_dir)
    wanted = lengths(signal).select("video_id", metrics.middle_frame(F.col("total")).alias("frame_id"))
    return files.frame_pairs(signal, wanted, "signal", lambda v: v / 2).select("video_id", "frame_id", F.col("high"), F.round("low", 6).alias("low"))


@query(f"""WITH {SIGNAL}, {LEN}, k AS (SELECT video_id, frame_id FROM sig WHERE frame_id % 9 = 0), t AS (SELECT video_id, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS ids, count(*) AS n FROM k GROUP BY 1)
SELECT video_id, '{{"frames":[' || ids || '],"n_frames":' || n || '}}' AS value, (SELECT count(*) FROM t) AS total_videos, (SELECT sum(n) FROM t)::BIGINT AS total_frames FROM t""")
def manifest_json(spark, sf_dir):
    """The keyframe manifest as a JSON entry a video, with the totals of its head."""
    return files.manifest_entries(frame_signal(spark, sf_dir).where("frame_id % 9 = 0"))


@query("""SELECT ['a', 'b', ''][doc_id % 3 + 1] AS video, 'x' || doc_id AS stem, ['/r/a/labels/', '/r/b/', '/r/'][doc_id % 3 + 1] || 'x' || doc_id || '.txt' AS path FROM documents""")
def label_folders(spark, sf_dir):
    """Label files by video: a folder with labels of its own, one without, and the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    folders = {0: ("/r/a/labels/", "/r/a/"), 1: ("/r/b/", "/q/b/"), 2: ("/r/", "/rr/")}
    every = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, folders[0]))).when(F.col("doc_id") % 3 == 1, F.array(*map(F.lit, folders[1]))).otherwise(F.array(*map(F.lit, folders[2])))
    paths = docs.select("name", F.explode(every).alias("folder")).select(F.concat("folder", "name").alias("path"))
    return files.label_files(paths.unionByName(spark.createDataFrame([("/r/classes.txt",), ("/r/b/classes.txt",), ("/r/b/x.jpg",)], "path string")), "/r")


@query("SELECT unnest([0, 1, 7])::BIGINT AS place, unnest(['screw', 'small nut', 'class_7']) AS category")
def class_list(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2 * 7).alias("place"))
    return files.class_names(spark.createDataFrame([("screw\r\nsmall nut \n\n",)], "value string"), used)


@query("""SELECT user_id AS video_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events) WHERE place <= 5""")
def first_matches(spark, sf_dir):
    """The best few matches of each video, for a look at them."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", place.alias("place")).where("place <= 5")
