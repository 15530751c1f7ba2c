"""Queries over detections and transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import naming
from ..operators import clustering, filters, matching, scoring, search, voting
from .fixtures import DET, REG, detections, registrations, table
from .named import book

QUERIES, ORACLE, query = book()

THRESHOLDS_SQL = "thr AS (SELECT * FROM (VALUES ('type1', 0.46), ('type2', 0.80), ('type3', 0.52), ('type4', 0.45), ('type5', 0.67)) t(class_name, least))"
KEPT_SQL = f"{DET}, {THRESHOLDS_SQL}, kept AS (SELECT det.* FROM det JOIN thr USING (class_name) WHERE confidence >= least AND frame_id NOT IN (7, 19))"


def _h() -> list:
    return [F.col("h")[k] for k in range(9)]


def _box() -> tuple:
    return tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))


def _r(c):
    return F.round(c, 6)


def placed(spark: SparkSession, sf_dir: str, policy: str = "skip") -> DataFrame:
    """Detections above their thresholds, with the centre in reference coordinates."""
    kept = filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS)
    both = filters.registered(kept, registrations(spark, sf_dir), policy)
    x, y = g.project(_h(), *g.center(*_box()))
    return both.withColumn("x", x).withColumn("y", y).drop("h")


def objects(spark: SparkSession, sf_dir: str, columns: list[str], eps: float = 40.0, least: int = 4) -> DataFrame:
    """Detections, with these of their columns, and the cluster they belong to."""
    points = placed(spark, sf_dir).select("video_id", "ord", "x", "y", *columns)
    return clustering.density_members(points, "video_id", eps, least)


def tallied(members: DataFrame, reg: DataFrame) -> DataFrame:
    voted = voting.detector_vote(members.withColumn("w", F.col("quantity") * F.col("quantity")), ["video_id", "cluster_id"], "w")
    return voting.dense_counts(voted, reg.select("video_id"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(objects(spark, sf_dir, ["class_name", "quantity"]), registrations(spark, sf_dir))


COUNTED_SQL = f"""{KEPT_SQL},
obj AS (SELECT video_id, obj_id, any_value(class_name) AS class_name FROM kept GROUP BY video_id, obj_id HAVING count(*) >= 4),
counted AS (
  SELECT v.video_id, count(*) FILTER (WHERE class_name = 'type1') AS type1, count(*) FILTER (WHERE class_name = 'type2') AS type2,
         count(*) FILTER (WHERE class_name = 'type3') AS type3, count(*) FILTER (WHERE class_name = 'type4') AS type4, count(*) FILTER (WHERE class_name = 'type5') AS type5
  FROM (SELECT DISTINCT l_suppkey AS video_id FROM lineitem) v LEFT JOIN obj USING (video_id) GROUP BY v.video_id)"""


@query(f"WITH {COUNTED_SQL} SELECT * FROM counted")
def count_by_type(spark, sf_dir):
    return counted(spark, sf_dir)


@query(f"WITH {DET}, {THRESHOLDS_SQL} SELECT video_id, ord, class_name, confidence FROM det JOIN thr USING (class_name) WHERE confidence >= least")
def class_threshold_filter(spark, sf_dir):
    return filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS).select("video_id", "ord", "class_name", "confidence")


@query(f"WITH {DET} SELECT video_id, ord FROM det WHERE confidence >= 0.1")
def default_threshold_filter(spark, sf_dir):
    return filters.above_threshold(detections(spark, sf_dir), None).select("video_id", "ord")


_W = "(1e-6 * frame_id * px + 1)"


@query(f"""WITH {DET}, c AS (SELECT video_id, ord, frame_id, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM det)
SELECT video_id, ord, CASE WHEN frame_id NOT IN (7, 19) THEN round((px + 8 * frame_id) / {_W}, 6) END AS x,
       CASE WHEN frame_id NOT IN (7, 19) THEN round(py / {_W}, 6) END AS y FROM c""")
def project_points(spark, sf_dir):
    both = detections(spark, sf_dir).join(registrations(spark, sf_dir, True), ["video_id", "frame_id"])
    x, y = g.project(_h(), *g.center(*_box()), F.col("valid"))
    return both.select("video_id", "ord", _r(x).alias("x"), _r(y).alias("y"))


def _corner(px: str, py: str, axis: str) -> str:
    w = f"(1e-6 * frame_id * {px} + 1)"
    return f"({px} + 8 * frame_id) / {w}" if axis == "x" else f"{py} / {w}"


_CORNERS = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
_XS, _YS = (", ".join(_corner(px, py, a) for px, py in _CORNERS) for a in "xy")


@query(f"""WITH {DET} SELECT video_id, ord, round(least({_XS}), 6) AS bx1, round(least({_YS}), 6) AS by1,
round(greatest({_XS}), 6) AS bx2, round(greatest({_YS}), 6) AS by2 FROM det WHERE frame_id NOT IN (7, 19)
UNION ALL SELECT video_id, ord, NULL, NULL, NULL, NULL FROM det WHERE frame_id IN (7, 19)""")
def project_bboxes(spark, sf_dir):
    both = detections(spark, sf_dir).join(registrations(spark, sf_dir, True), ["video_id", "frame_id"])
    box = g.project_box(_h(), _box(), F.col("valid"))
    return both.select("video_id", "ord", *(_r(c).alias(n) for c, n in zip(box, ("bx1", "by1", "bx2", "by2"))))


@query(f"""WITH {REG} SELECT a.video_id, a.frame_id, (8 * a.frame_id + 8 * b.frame_id)::DOUBLE AS shift,
round(1e-6 * a.frame_id + 1e-6 * b.frame_id, 9) AS tilt, round(1e-6 * a.frame_id * 8 * b.frame_id + 1, 9) AS scale,
a.valid AND b.valid AS valid, least(a.inlier_ratio, b.inlier_ratio)::DOUBLE AS inlier_ratio
FROM reg a JOIN reg b ON a.video_id = b.video_id AND b.frame_id = a.frame_id + 1""")
def compose_transforms(spark, sf_dir):
    reg = registrations(spark, sf_dir, True)
    child = reg.select("video_id", (F.col("frame_id") - 1).alias("frame_id"), F.col("h").alias("hb"), F.col("valid").alias("vb"), F.col("inlier_ratio").alias("ib"))
    m = g.compose(_h(), [F.col("hb")[k] for k in range(9)])
    both = reg.join(child, ["video_id", "frame_id"])
    return both.select("video_id", "frame_id", m[2].alias("shift"), F.round(m[6], 9).alias("tilt"), F.round(m[8], 9).alias("scale"), (F.col("valid") & F.col("vb")).alias("valid"), F.least("inlier_ratio", "ib").alias("inlier_ratio"))


@query(f"""WITH {DET}, c AS (SELECT *, least(greatest(x1, 0), 1280) AS a1, least(greatest(x2, 0), 1280) AS a2, least(greatest(y1, 0), 720) AS b1, least(greatest(y2, 0), 720) AS b2 FROM det)
SELECT video_id, ord, x2 - x1 AS w, y2 - y1 AS h, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area,
round((a1 + a2) / 2 / 1280, 6) AS cx, round((b1 + b2) / 2 / 720, 6) AS cy, round((a2 - a1) / 1280, 6) AS nw, round((b2 - b1) / 720, 6) AS nh,
least(greatest(round_even(x1 - least(x2 - x1, y2 - y1) * 0.1, 0), 0), 1280) AS px1, least(greatest(trunc(x1 - least(x2 - x1, y2 - y1) * 0.05), 0), 1280) AS tx1
FROM c""")
def bbox_formats(spark, sf_dir):
    box = _box()
    n = g.to_normalised(box, 1280.0, 720.0)
    _, _, w, h = g.to_corner_size(box)
    return detections(spark, sf_dir).select(
        "video_id", "ord", w.alias("w"), h.alias("h"), g.area(*box).alias("area"), *(_r(c).alias(a) for c, a in zip(n, ("cx", "cy", "nw", "nh"))),
        g.padded_rectangle(box, 1280, 720, 0.1)[0].alias("px1"), g.padded_rectangle(box, 1280, 720, 0.05, rounded=False)[0].alias("tx1"),
    )


@query(f"WITH {KEPT_SQL} SELECT video_id, ord, rx AS x, ry AS y FROM kept")
def registration_policy_skip(spark, sf_dir):
    return placed(spark, sf_dir).select("video_id", "ord", "x", "y")


@query(f"""WITH {DET}, {THRESHOLDS_SQL} SELECT video_id, ord, CASE WHEN frame_id IN (7, 19) THEN rx - 8 * frame_id ELSE rx END AS x, ry AS y
FROM det JOIN thr USING (class_name) WHERE confidence >= least""")
def registration_policy_identity(spark, sf_dir):
    return placed(spark, sf_dir, "identity").select("video_id", "ord", "x", "y")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a class that differs within an object: the place of the part's type in name order."""
    part = table(spark, sf_dir, "part")
    kinds = part.select("p_type").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("p_type")) - 1)  # a handful of types
    named = part.join(F.broadcast(kinds), "p_type").select(F.col("p_partkey").alias("part"), F.concat(F.lit("type"), F.col("k").cast("string")).alias("class_noisy"))
    return detections(spark, sf_dir).join(named, "part")


NOISY_SQL = f"""{DET}, noisy AS (SELECT det.*, 'type' || (k - 1) AS class_noisy FROM det
JOIN (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS k FROM part) p ON p.p_partkey = det.part)"""


@query(f"""WITH {NOISY_SQL}, w AS (SELECT video_id, obj_id, right(class_noisy, 1)::INT - 1 AS c, sum(CASE WHEN class_noisy = 'type0' THEN 0 ELSE quantity * quantity END) AS w FROM noisy GROUP BY ALL),
b AS (SELECT video_id, obj_id, sum(w) AS total, arg_max(c, (w, -c)) AS c, max(w) AS top FROM w GROUP BY ALL)
SELECT video_id, obj_id, CASE WHEN total > 0 THEN c ELSE -1 END AS pred_class, CASE WHEN total > 0 THEN round(top / total, 6) END AS share FROM b""")
def detector_vote(spark, sf_dir):
    rows = noisy(spark, sf_dir).withColumn("w", F.col("quantity") * F.col("quantity"))
    return voting.detector_vote(rows, ["video_id", "obj_id"], "w", "class_noisy").withColumn("share", _r(F.col("share")))


@query(f"""WITH {NOISY_SQL}, r AS (SELECT *, row_number() OVER k AS n, row_number() OVER (PARTITION BY video_id, obj_id ORDER BY part * 37 % 101 DESC, ord) AS b, max(quantity) OVER (PARTITION BY video_id, obj_id) AS m
  FROM noisy WINDOW k AS (PARTITION BY video_id, obj_id ORDER BY confidence DESC, ord)),
w AS (SELECT video_id, obj_id, class_noisy AS class, sum(CASE WHEN n <= 10 THEN quantity * quantity ELSE 0 END + CASE WHEN b = 1 THEN 2 * m * m ELSE 0 END) AS w FROM r WHERE n <= 10 OR b = 1 GROUP BY ALL)
SELECT video_id, obj_id, class, round(w / sum(w) OVER (PARTITION BY video_id, obj_id), 6) AS probability FROM w""")
def classifier_vote_top10(spark, sf_dir):
    seen = noisy(spark, sf_dir).withColumn("sharpness", F.col("part") * 37 % 101)
    return voting.weighted_probabilities(seen, ["video_id", "obj_id"], "class_noisy", "quantity", ["ord"]).withColumn("probability", _r(F.col("probability")))


@query(f"""WITH {DET}, c AS (SELECT video_id, class_name, count(*) AS n FROM det GROUP BY ALL)
SELECT video_id, class_name, n, round(n / sum(n) OVER (PARTITION BY video_id), 6) AS share FROM c""")
def class_histogram(spark, sf_dir):
    counts = detections(spark, sf_dir).groupBy("video_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("video_id"))))


@query(f"""WITH {KEPT_SQL}, o AS (SELECT *, count(*) OVER (PARTITION BY video_id, obj_id) AS n, min(ord) OVER (PARTITION BY video_id, obj_id) AS first FROM kept)
SELECT video_id, (dense_rank() OVER (PARTITION BY video_id ORDER BY first)) - 1 AS cluster_id, count(*) AS n_observations, round(avg(rx), 6) AS center_x, round(avg(ry), 6) AS center_y,
arg_max(ord, ((x2 - x1) * (y2 - y1), -ord)) AS largest_ord, arg_max(ord, (confidence, -ord)) AS best_ord, count(DISTINCT frame_id) AS n_frames, min(frame_id) AS first_frame
FROM o WHERE n >= 4 GROUP BY video_id, obj_id, first""")
def cluster_summary(spark, sf_dir):
    rows = voting.cluster_summary(objects(spark, sf_dir, ["frame_id", "confidence", "x1", "y1", "x2", "y2"]), ["video_id", "cluster_id"])
    return rows.withColumn("center_x", _r(F.col("center_x"))).withColumn("center_y", _r(F.col("center_y")))


@query(f"""WITH RECURSIVE {KEPT_SQL}, p AS MATERIALIZED (SELECT a.video_id, a.ord AS a, b.ord AS b FROM kept a JOIN kept b ON a.video_id = b.video_id
  AND a.obj_id = b.obj_id AND (a.rx - b.rx) * (a.rx - b.rx) + (a.ry - b.ry) * (a.ry - b.ry) <= 6.25),
core AS MATERIALIZED (SELECT video_id, a FROM p GROUP BY ALL HAVING count(*) >= 4),
e AS MATERIALIZED (SELECT p.* FROM p JOIN core USING (video_id, a) JOIN core c ON c.video_id = p.video_id AND c.a = p.b),
reach(video_id, a, b) AS (SELECT video_id, a, b FROM e UNION SELECT r.video_id, r.a, e.b FROM reach r JOIN e ON e.video_id = r.video_id AND e.a = r.b),
comp AS (SELECT video_id, a, min(b) AS c FROM reach GROUP BY ALL),
m AS (SELECT video_id, a AS ord, c FROM comp UNION ALL
  SELECT p.video_id, p.b, min(comp.c) FROM p JOIN comp ON comp.video_id = p.video_id AND comp.a = p.a
  WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.video_id = p.video_id AND core.a = p.b) GROUP BY p.video_id, p.b)
SELECT video_id, ord, dense_rank() OVER (PARTITION BY video_id ORDER BY c) - 1 AS cluster_id FROM m""")
def dbscan_small_eps(spark, sf_dir):
    return clustering.density_clusters(placed(spark, sf_dir).select("video_id", "ord", "x", "y"), "video_id", 2.5, 4)


def _running_sql(points: str, keys: str, distance: str) -> str:
    """Running means by object, whose sightings are nearer to one another than to those of others by far: found has each point's cluster by its first ord."""
    same = " AND ".join(f"p.{k} = f.{k}" for k in keys.split(", "))
    return f"""p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys}, obj_id ORDER BY ord) AS k FROM {points}),
f AS (SELECT {keys}, obj_id, k, ord, ord AS own, [{{'first': ord, 'sx': x, 'sy': y, 'n': 1::BIGINT}}] AS state FROM p WHERE k = 1
  UNION ALL SELECT {keys}, obj_id, k, ord, CASE WHEN best IS NULL THEN ord ELSE state[best].first END,
    CASE WHEN best IS NULL THEN list_append(state, {{'first': ord, 'sx': x, 'sy': y, 'n': 1::BIGINT}})
      ELSE list_transform(state, lambda s: CASE WHEN s.first = state[best].first THEN {{'first': s.first, 'sx': s.sx + x, 'sy': s.sy + y, 'n': s.n + 1}} ELSE s END) END FROM (
    SELECT *, CASE WHEN list_min(away) <= {distance} THEN list_position(away, list_min(away)) END AS best FROM (
      SELECT p.*, f.state, list_transform(f.state, lambda s: sqrt((p.x - s.sx / s.n) * (p.x - s.sx / s.n) + (p.y - s.sy / s.n) * (p.y - s.sy / s.n))) AS away
      FROM f JOIN p ON {same} AND p.obj_id = f.obj_id AND p.k = f.k + 1))),
found AS (SELECT *, count(*) OVER (PARTITION BY {keys}, own) AS n FROM f)"""


def _incremental_sql(distance: float) -> str:
    return f"""WITH RECURSIVE {KEPT_SQL}, points AS (SELECT video_id, obj_id, ord, rx AS x, ry AS y FROM kept), {_running_sql('points', 'video_id', str(distance))}
SELECT video_id, ord, cluster_id FROM (SELECT video_id, ord, n, dense_rank() OVER (PARTITION BY video_id ORDER BY own) - 1 AS cluster_id FROM found) WHERE n >= 4"""


@query(_incremental_sql(40.0))
def incremental_clusters(spark, sf_dir):
    return clustering.incremental_clusters(placed(spark, sf_dir).select("video_id", "ord", "x", "y"), "video_id", 40.0, 4)


@query(_incremental_sql(2.5))
def incremental_small_distance(spark, sf_dir):
    """A distance at which an object's sightings fall into several clusters, so their order decides."""
    return clustering.incremental_clusters(placed(spark, sf_dir).select("video_id", "ord", "x", "y"), "video_id", 2.5, 4)


@query()
def nms(spark, sf_dir):
    boxes = detections(spark, sf_dir).select("video_id", "frame_id", "ord", F.col("quantity").alias("score"), (F.col("x1") - 150).alias("x1"), (F.col("y1") - 150).alias("y1"), (F.col("x2") + 150).alias("x2"), (F.col("y2") + 150).alias("y2"))
    return clustering.suppress(boxes, ["video_id", "frame_id"], 0.3)


ORACLE["nms"] = f"""WITH RECURSIVE {DET}, b AS MATERIALIZED (SELECT video_id, frame_id, ord, quantity AS score,
  {{'x1': x1 - 150, 'y1': y1 - 150, 'x2': x2 + 150, 'y2': y2 + 150}} AS box,
  row_number() OVER (PARTITION BY video_id, frame_id ORDER BY quantity DESC, ord DESC) AS k FROM det),
f AS (SELECT video_id, frame_id, k, true AS keep, [box] AS kept FROM b WHERE k = 1
  UNION ALL SELECT n.video_id, n.frame_id, n.k, n.keep, CASE WHEN n.keep THEN list_append(n.kept, n.box) ELSE n.kept END FROM (
    SELECT b.video_id, b.frame_id, b.k, b.box, f.kept,
      len(list_filter(f.kept, lambda q: greatest(0.0, least(q.x2, b.box.x2) - greatest(q.x1, b.box.x1) + 1) * greatest(0.0, least(q.y2, b.box.y2) - greatest(q.y1, b.box.y1) + 1)
        / ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1) + (b.box.x2 - b.box.x1 + 1) * (b.box.y2 - b.box.y1 + 1)
           - greatest(0.0, least(q.x2, b.box.x2) - greatest(q.x1, b.box.x1) + 1) * greatest(0.0, least(q.y2, b.box.y2) - greatest(q.y1, b.box.y1) + 1)) > 0.3)) = 0 AS keep
    FROM f JOIN b ON b.video_id = f.video_id AND b.frame_id = f.frame_id AND b.k = f.k + 1) n)
SELECT b.video_id, b.frame_id, b.ord, b.score FROM f JOIN b USING (video_id, frame_id, k) WHERE keep"""


@query(f"""WITH {REG}, a AS (SELECT video_id, frame_id AS anchor_id FROM reg WHERE valid AND frame_id % 3 = 1)
SELECT r.video_id, r.frame_id, arg_min(anchor_id, (abs(r.frame_id - anchor_id), abs(anchor_id - 13), anchor_id)) AS anchor_id FROM reg r JOIN a USING (video_id) GROUP BY ALL""")
def nearest_anchor(spark, sf_dir):
    reg = registrations(spark, sf_dir)
    return matching.nearest_anchor(reg, reg.where("frame_id % 3 = 1"), "video_id", 13)


@query(f"""WITH {REG}, a AS (SELECT video_id, frame_id AS anchor_id, sign(frame_id - 13) AS side, abs(frame_id - 13) AS away FROM reg WHERE valid AND frame_id % 3 = 1)
SELECT video_id, anchor_id, CASE WHEN side <> 0 THEN coalesce(lag(anchor_id) OVER w, 13) END AS parent_id, CASE WHEN side = 0 THEN 0 ELSE row_number() OVER w END AS depth
FROM a WINDOW w AS (PARTITION BY video_id, side ORDER BY away)""")
def anchor_chain(spark, sf_dir):
    return matching.anchor_chain(registrations(spark, sf_dir).where("frame_id % 3 = 1"), "video_id", 13)


@query(f"WITH {DET} SELECT video_id, obj_id, arg_min(ord, (abs(frame_id - 15), ord)) AS nearest_ord FROM det GROUP BY ALL")
def nearest_observation(spark, sf_dir):
    return matching.nearest_observation(detections(spark, sf_dir), ["video_id", "obj_id"], 15)


def perturbed(truth: DataFrame) -> DataFrame:
    return truth.select("video_id", *(F.greatest(F.lit(0).cast("long"), F.col(f"type{k}") - (F.col("video_id") + k) % 5).alias(f"type{k}") for k in range(1, 6)))


PAIRS_SQL = COUNTED_SQL + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT video_id, 'type{k}' AS type, type{k} AS t, greatest(0, type{k} - (video_id + {k}) % 5) AS p FROM counted" for k in range(1, 6)) + ")"


@query(f"""WITH {PAIRS_SQL} SELECT type, sum(CASE WHEN t = p THEN 4 WHEN abs(t - p) <= 3 THEN 2 ELSE 0 END)::BIGINT AS points, round(avg(abs(t - p)), 6) AS mae,
count(*) FILTER (WHERE t = p) AS exact FROM pairs GROUP BY type""")
def score_counts(spark, sf_dir):
    truth = counted(spark, sf_dir)
    return scoring.score(truth, perturbed(truth)).withColumn("mae", _r(F.col("mae")))


@query(f"""WITH {PAIRS_SQL} SELECT video_id, sum(abs(t - p))::BIGINT AS l1_types, abs(sum(t) - sum(p))::BIGINT AS l1_total, max(abs(t - p)) AS max_error, bool_and(t = p) AS exact FROM pairs GROUP BY video_id""")
def score_l1(spark, sf_dir):
    truth = counted(spark, sf_dir)
    return scoring.distances(truth, perturbed(truth))


@query(f"""WITH RECURSIVE {COUNTED_SQL}, d AS MATERIALIZED (SELECT det.* FROM det JOIN thr USING (class_name) WHERE confidence >= least),
s AS (SELECT * FROM (VALUES (0.25), (0.05)) r(ratio), (VALUES ('skip'), ('identity')) p(policy)),
q AS MATERIALIZED (SELECT ratio, policy, video_id, ord, class_name, quantity * quantity AS w, CASE WHEN frame_id IN (7, 19) AND ratio > 0.1 THEN rx - 8 * frame_id ELSE rx END AS x, ry AS y
  FROM s JOIN d ON policy = 'identity' OR ratio < 0.1 OR frame_id NOT IN (7, 19)),
p AS MATERIALIZED (SELECT a.ratio, a.policy, a.video_id, a.ord AS a, b.ord AS b FROM q a JOIN q b ON a.ratio = b.ratio AND a.policy = b.policy AND a.video_id = b.video_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600),
n AS (SELECT ratio, policy, video_id, a, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT unnest([2, 4, 8]) AS least),
core AS MATERIALIZED (SELECT least, ratio, policy, video_id, a FROM n JOIN m ON n >= least),
e AS MATERIALIZED (SELECT c.least, p.* FROM p JOIN core c USING (ratio, policy, video_id, a) JOIN core o ON o.least = c.least AND o.ratio = p.ratio AND o.policy = p.policy AND o.video_id = p.video_id AND o.a = p.b),
reach(least, ratio, policy, video_id, a, b) AS (SELECT least, ratio, policy, video_id, a, b FROM e UNION
  SELECT r.least, r.ratio, r.policy, r.video_id, r.a, e.b FROM reach r JOIN e ON e.least = r.least AND e.ratio = r.ratio AND e.policy = r.policy AND e.video_id = r.video_id AND e.a = r.b),
comp AS MATERIALIZED (SELECT least, ratio, policy, video_id, a, min(b) AS c FROM reach GROUP BY ALL),
member AS (SELECT * FROM comp UNION ALL SELECT comp.least, p.ratio, p.policy, p.video_id, p.b, min(comp.c) FROM p JOIN comp USING (ratio, policy, video_id, a)
  WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.least = comp.least AND core.ratio = p.ratio AND core.policy = p.policy AND core.video_id = p.video_id AND core.a = p.b) GROUP BY comp.least, p.ratio, p.policy, p.video_id, p.b),
w AS (SELECT least, member.ratio, member.policy, member.video_id, c, class_name, sum(w) AS w FROM member JOIN q ON q.ratio = member.ratio AND q.policy = member.policy AND q.video_id = member.video_id AND q.ord = member.a GROUP BY ALL),
v AS (SELECT least, ratio, policy, video_id, c, arg_max(class_name, (w, 10 - right(class_name, 1)::INT)) AS class_name FROM w GROUP BY ALL),
f AS (SELECT least, ratio, policy, video_id, {', '.join(f"count(*) FILTER (WHERE class_name = 'type{k}') AS p{k}" for k in range(1, 6))} FROM v GROUP BY ALL),
x AS (SELECT m.least, s.ratio, s.policy, {' + '.join(f"abs(type{k} - coalesce(p{k}, 0))" for k in range(1, 6))} AS l1, greatest({', '.join(f"abs(type{k} - coalesce(p{k}, 0))" for k in range(1, 6))}) AS worst
  FROM counted CROSS JOIN s CROSS JOIN m LEFT JOIN f ON f.video_id = counted.video_id AND f.least = m.least AND f.ratio = s.ratio AND f.policy = s.policy)
SELECT ratio::DOUBLE AS ratio, policy, least, sum(l1)::BIGINT AS l1, max(worst) AS worst, count(*) FILTER (WHERE l1 = 0) AS exact FROM x GROUP BY ALL
ORDER BY l1, worst, exact DESC, ratio, policy, least LIMIT 10""")
def param_grid_topk(spark, sf_dir):
    """Settings of the counting path by their errors."""
    det = filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS).withColumn("w", F.col("quantity") * F.col("quantity"))
    reg = registrations(spark, sf_dir).withColumn("ratio", F.explode(F.array(F.lit(0.25), F.lit(0.05)))).withColumn("valid", F.col("inlier_ratio") >= F.col("ratio"))
    found = search.grid(det, reg, counted(spark, sf_dir), ["ratio"], ["skip", "identity"], ["density"], [40.0], [2, 4, 8])
    return found.orderBy("l1", "worst", F.desc("exact"), "ratio", "policy", "least").limit(10).select("ratio", "policy", "least", "l1", "worst", "exact")


_SWEEP = [round(0.1 * k, 1) for k in range(1, 10)]


@query(f"""WITH RECURSIVE {COUNTED_SQL}, cand AS (SELECT unnest({_SWEEP}::DOUBLE[]) AS candidate),
q AS MATERIALIZED (SELECT candidate, video_id, ord, class_name, round(confidence * confidence, 9) AS w, rx AS x, ry AS y FROM det JOIN thr USING (class_name), cand
  WHERE frame_id NOT IN (7, 19) AND confidence >= CASE WHEN class_name = 'type3' THEN candidate ELSE least END),
p AS MATERIALIZED (SELECT a.candidate, a.video_id, a.ord AS a, b.ord AS b FROM q a JOIN q b ON a.candidate = b.candidate AND a.video_id = b.video_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36),
core AS MATERIALIZED (SELECT candidate, video_id, a FROM p GROUP BY ALL HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT p.* FROM p JOIN core USING (candidate, video_id, a) JOIN core c ON c.candidate = p.candidate AND c.video_id = p.video_id AND c.a = p.b),
reach AS (SELECT candidate, video_id, a, b FROM e UNION SELECT r.candidate, r.video_id, r.a, e.b FROM reach r JOIN e ON e.candidate = r.candidate AND e.video_id = r.video_id AND e.a = r.b),
comp AS MATERIALIZED (SELECT candidate, video_id, a, min(b) AS c FROM reach GROUP BY ALL),
m AS (SELECT * FROM comp UNION ALL SELECT p.candidate, p.video_id, p.b, min(c) FROM p JOIN comp USING (candidate, video_id, a)
  WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.candidate = p.candidate AND core.video_id = p.video_id AND core.a = p.b) GROUP BY p.candidate, p.video_id, p.b),
w AS (SELECT m.candidate, m.video_id, c, class_name, sum(w) AS w FROM m JOIN q ON q.candidate = m.candidate AND q.video_id = m.video_id AND q.ord = m.a GROUP BY ALL),
v AS (SELECT candidate, video_id, c, arg_max(class_name, (round(w, 9), 10 - right(class_name, 1)::INT)) AS class_name FROM w GROUP BY ALL),
f AS (SELECT candidate, video_id, {', '.join(f"count(*) FILTER (WHERE class_name = 'type{k}') AS p{k}" for k in range(1, 6))} FROM v GROUP BY ALL)
SELECT cand.candidate, sum({' + '.join(f"abs(type{k} - coalesce(p{k}, 0))" for k in range(1, 6))})::BIGINT AS every, sum(abs(type3 - coalesce(p3, 0)))::BIGINT AS own
FROM cand CROSS JOIN counted LEFT JOIN f ON f.candidate = cand.candidate AND f.video_id = counted.video_id GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    """Errors under every candidate threshold of one class, the others at theirs: one step of the coordinate search."""
    both = filters.registered(detections(spark, sf_dir), registrations(spark, sf_dir))
    x, y = g.project(_h(), *g.center(*_box()))
    points = both.select("video_id", "ord", "class_name", "confidence", x.alias("rx"), y.alias("ry"))
    return search.threshold_sweep(points, counted(spark, sf_dir), 3, _SWEEP, filters.DENSITY_THRESHOLDS, least=3, distance=6.0)


@query()
def coordinate_descent(spark, sf_dir):
    both = filters.registered(detections(spark, sf_dir), registrations(spark, sf_dir))
    x, y = g.project(_h(), *g.center(*_box()))
    points = both.select("video_id", "ord", "class_name", "confidence", x.alias("rx"), y.alias("ry"))
    return search.descend(points, counted(spark, sf_dir), start={f"type{k}": 0.1 for k in range(1, 6)}, step=0.01)


@query(r"""WITH n AS (SELECT DISTINCT l_suppkey AS v, l_orderkey % 30 AS f, l_linenumber AS k FROM lineitem), s AS (SELECT v, f, k, CASE WHEN k = 7 THEN 'screw' ELSE ' Type-_' || k END AS raw FROM n)
SELECT v AS video_id, f AS frame_id, k, lower(regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g')) AS name,
CASE WHEN k BETWEEN 1 AND 5 THEN k - 1 ELSE -1 END AS class_index, CASE WHEN k BETWEEN 1 AND 5 THEN 'Type_' || k ELSE 'Unknown' END AS label,
CASE WHEN k = 7 THEN 999 ELSE k END AS place, format('{}_frame{:06d}', v, f) AS stem, f AS parsed FROM s""")
def name_parse(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 30).alias("frame_id"), F.col("l_linenumber").alias("k")).distinct()
    d = d.withColumn("raw", F.when(F.col("k") == 7, "screw").otherwise(F.concat(F.lit(" Type-_"), F.col("k").cast("string")))).withColumn("stem", naming.frame_name(F.col("video_id"), F.col("frame_id")))
    index = naming.class_index(F.col("raw"))
    return d.select("video_id", "frame_id", "k", naming.normalised(F.col("raw")).alias("name"), index.alias("class_index"), naming.label(index).alias("label"), naming.natural_order(F.col("raw"))[0].alias("place"), "stem", naming.frame_number(F.col("stem")).alias("parsed"))
