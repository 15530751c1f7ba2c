"""Queries over transforms between frames and anchors, votes by vectors, and whole paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, naming
from ..functions.session import by_key, shared_folder
from ..operators import clustering, experiments, filters, matching, models, registration, search, voting
from ..sources import reports
from ..sources.text_files import read_files
from .fixtures import DET, REG, detections, registrations
from .named import book
from .observation_queries import COUNTED_SQL, KEPT_SQL, _running_sql, counted, objects, placed, tallied

QUERIES, ORACLE, query = book()

ROOT = 13


def _shift(by) -> list:
    return F.array(F.lit(1.0), F.lit(0.0), by.cast("double"), F.lit(0.0), F.lit(1.0), *(F.lit(0.0),) * 3, F.lit(1.0))


def anchor_pairs(spark, sf_dir) -> DataFrame:
    """Transforms between every frame and every third frame: shifts, some of them not found."""
    reg = registrations(spark, sf_dir).select("video_id", "frame_id")
    anchors = F.explode(F.array(*(F.lit(a).cast("long") for a in range(1, 30, 3)))).alias("anchor_id")
    f, a = F.col("frame_id"), F.col("anchor_id")
    rows = reg.select("video_id", "frame_id", anchors)
    return rows.select("*", _shift(8 * (f - a) + f * a % 3).alias("h"), ((7 * f + 3 * a + F.col("video_id")) % 5 != 0).alias("valid"), (0.3 + (f + a) % 7 * 0.1).alias("inlier_ratio"))


TREE = """v AS (SELECT DISTINCT l_suppkey AS video_id FROM lineitem),
o AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY abs(a - 13), a) AS k FROM (SELECT unnest([1, 4, 7, 10, 16, 19, 22, 25, 28]) AS a)),
t AS (SELECT video_id, 0::BIGINT AS k, [[13.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE]] AS done FROM v
  UNION ALL SELECT video_id, k, CASE WHEN len(near) = 0 THEN done ELSE list_append(done, [a::DOUBLE, 8.0 * (a - near[1][3]) + (a * near[1][3]::BIGINT) % 3 + near[1][4], least(0.3 + (a + near[1][3]::BIGINT) % 7 * 0.1, near[1][5])::DOUBLE]) END FROM (
    SELECT t.video_id, o.k, o.a, t.done, list_sort(list_transform(list_filter(t.done, lambda x: (7 * o.a + 3 * x[1]::BIGINT + t.video_id) % 5 <> 0),
      lambda x: [abs(x[1] - o.a), abs(x[1] - 13), x[1], x[2], x[3]])) AS near FROM t JOIN o ON o.k = t.k + 1)),
d AS (SELECT video_id, unnest(done) AS x FROM t WHERE k = 9), anchor AS (SELECT video_id, x[1]::BIGINT AS a, x[2] AS s, x[3] AS r FROM d)"""


@query(f"""WITH RECURSIVE {TREE} SELECT v.video_id, f.a AS frame_id, s AS shift, s IS NOT NULL AS valid, round(coalesce(r, 0), 6) AS inlier_ratio
FROM v CROSS JOIN (SELECT a FROM o UNION ALL SELECT 13) f LEFT JOIN anchor ON anchor.video_id = v.video_id AND anchor.a = f.a""")
def anchor_tree(spark, sf_dir):
    pairs = anchor_pairs(spark, sf_dir).where("frame_id % 3 = 1")
    return registration.anchor_transforms(pairs, "video_id", ROOT).select("video_id", "frame_id", F.col("h")[2].alias("shift"), "valid", F.round("inlier_ratio", 6).alias("inlier_ratio"))


@query(f"""WITH RECURSIVE {TREE}, f AS (SELECT video_id, unnest(range(30)) AS frame_id FROM v),
c AS (SELECT f.video_id, f.frame_id, a, CASE WHEN a = frame_id THEN s ELSE 8 * (frame_id - a) + (frame_id * a) % 3 + s END AS shift,
  CASE WHEN a = frame_id THEN r ELSE least(0.3 + (frame_id + a) % 7 * 0.1, r) END AS ratio FROM f JOIN anchor USING (video_id) WHERE a = frame_id OR (7 * frame_id + 3 * a + video_id) % 5 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY abs(frame_id - a), abs(a - 13), a) AS n FROM c)
SELECT f.video_id, f.frame_id, b.a AS anchor_id, shift, b.a IS NOT NULL AS valid, round(coalesce(ratio, 0), 6) AS inlier_ratio FROM f LEFT JOIN b ON b.video_id = f.video_id AND b.frame_id = f.frame_id AND n = 1""")
def register_multi_anchor(spark, sf_dir):
    found = registration.multi_anchor(anchor_pairs(spark, sf_dir), "video_id", ROOT)
    return found.select("video_id", "frame_id", "anchor_id", F.col("h")[2].alias("shift"), "valid", F.round("inlier_ratio", 6).alias("inlier_ratio"))


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS video_id FROM lineitem), f AS (SELECT video_id, unnest(range(30)) AS frame_id, (video_id + 13) % 40 >= 15 AS fit FROM v),
p AS (SELECT *, (7 * frame_id + 39 + video_id) % 5 <> 0 AS ok FROM f)
SELECT video_id, frame_id, CASE WHEN fit AND frame_id = 13 THEN 0.0 WHEN fit AND ok THEN 8.0 * (frame_id - 13) + (frame_id * 13) % 3 END::DOUBLE AS shift, fit AND (frame_id = 13 OR ok) AS valid,
round(CASE WHEN fit AND frame_id = 13 THEN 1.0 WHEN fit THEN 0.3 + (frame_id + 13) % 7 * 0.1 ELSE 0.0 END, 6)::DOUBLE AS inlier_ratio FROM p""")
def register_single_anchor(spark, sf_dir):
    pairs = anchor_pairs(spark, sf_dir).where(F.col("anchor_id") == ROOT).withColumn("features", (F.col("video_id") + F.col("frame_id")) % 40)
    found = registration.single_anchor(pairs, "video_id", ROOT)
    return found.select("video_id", "frame_id", F.col("h")[2].alias("shift"), "valid", F.round("inlier_ratio", 6).alias("inlier_ratio"))


@query(f"""WITH {REG}, t AS (SELECT video_id, (video_id * 3 + frame_id) % 60 AS features, (frame_id * 5) % 50 AS matches, inlier_ratio, (video_id + frame_id) % 11 = 0 AS failed FROM reg)
SELECT video_id, count(*) AS total, count(*) FILTER (WHERE NOT failed AND features >= 15 AND matches >= 15 AND inlier_ratio >= 0.25) AS valid,
count(*) FILTER (WHERE NOT failed AND (features < 15 OR matches < 15)) AS few_matches, count(*) FILTER (WHERE NOT failed AND features >= 15 AND matches >= 15 AND inlier_ratio < 0.25) AS low_inlier,
count(*) FILTER (WHERE failed) AS exceptions, round(avg((NOT failed AND features >= 15 AND matches >= 15 AND inlier_ratio >= 0.25)::INT), 6) AS rate FROM t GROUP BY video_id""")
def registration_outcomes(spark, sf_dir):
    v, f = F.col("video_id"), F.col("frame_id")
    tries = registrations(spark, sf_dir).select("video_id", ((v * 3 + f) % 60).alias("features"), (f * 5 % 50).alias("matches"), "inlier_ratio", F.when((v + f) % 11 == 0, "no homography").alias("error"))
    return registration.outcomes(tries, "video_id")


@query(f"""WITH {DET}, n AS (SELECT video_id, frame_id, count(*) AS n FROM det GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS position FROM n)
SELECT video_id, position, frame_id, n AS n_detections, frame_id NOT IN (7, 19) AS valid FROM p""")
def zip_by_position(spark, sf_dir):
    """Three lists a video -- frames, detections of each, transforms of each -- brought together by place."""
    det = detections(spark, sf_dir).groupBy("video_id", "frame_id").agg(F.collect_list("ord").alias("found"))
    seen = det.join(registrations(spark, sf_dir).select("video_id", "frame_id", "valid"), ["video_id", "frame_id"])
    lists = seen.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "found", "valid"))).alias("l"))
    place = lambda field: lists.select("video_id", F.posexplode(F.col(f"l.{field}")).alias("position", field))
    both = registration.zipped(place("frame_id"), place("found"), place("valid"))
    return both.select("video_id", F.col("position").cast("long").alias("position"), "frame_id", F.size("found").cast("long").alias("n_detections"), "valid")


@query(f"""WITH {DET}, {REG}, h AS (SELECT video_id, frame_id, class_name, count(*) AS n FROM det GROUP BY ALL),
s AS (SELECT video_id, frame_id, sum(n)::BIGINT AS n_detections, string_agg(class_name || '=' || n, ' ' ORDER BY class_name) AS histogram FROM h GROUP BY ALL),
a AS (SELECT video_id, frame_id AS anchor_id FROM reg WHERE valid AND frame_id % 3 = 1),
n AS (SELECT r.video_id, r.frame_id, arg_min(anchor_id, (abs(r.frame_id - anchor_id), abs(anchor_id - 13), anchor_id)) AS anchor_id FROM reg r JOIN a USING (video_id) WHERE r.valid GROUP BY ALL)
SELECT r.video_id, format('{{}}_frame{{:06d}}', r.video_id, r.frame_id) AS frame_name, coalesce(n_detections, 0) AS n_detections, coalesce(histogram, '') AS histogram, r.valid,
CASE WHEN n.anchor_id IS NOT NULL THEN format('{{}}_frame{{:06d}}', r.video_id, n.anchor_id) END AS anchor_name FROM reg r LEFT JOIN s USING (video_id, frame_id) LEFT JOIN n USING (video_id, frame_id)""")
def frame_summary(spark, sf_dir):
    """Each frame with its class histogram, its transform's state and the name of the anchor it used."""
    keys, reg = ["video_id", "frame_id"], registrations(spark, sf_dir)
    counts = detections(spark, sf_dir).groupBy(*keys, "class_name").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_sort(F.collect_list(F.concat("class_name", F.lit("="), F.col("n").cast("string"))))
    seen = counts.groupBy(*keys).agg(F.sum("n").alias("n_detections"), F.array_join(told, " ").alias("histogram"))
    used = matching.nearest_anchor(reg.where("valid"), reg.where("frame_id % 3 = 1"), "video_id", ROOT)
    both = reg.join(seen, keys, "left").join(used, keys, "left")
    return both.select(
        "video_id", naming.frame_name(F.col("video_id"), F.col("frame_id")).alias("frame_name"), F.coalesce("n_detections", F.lit(0).cast("long")).alias("n_detections"),
        F.coalesce("histogram", F.lit("")).alias("histogram"), "valid", F.when(F.col("anchor_id").isNotNull(), naming.frame_name(F.col("video_id"), F.col("anchor_id"))).alias("anchor_name"),
    )


OBJECTS = """o AS (SELECT *, count(*) OVER (PARTITION BY video_id, obj_id) AS n, min(ord) OVER (PARTITION BY video_id, obj_id) AS first FROM kept)"""


@query(f"""WITH {KEPT_SQL}, {OBJECTS}, f AS (SELECT DISTINCT video_id, obj_id, first, frame_id FROM o WHERE n >= 4), c AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY first) - 1 AS cluster_id FROM f)
SELECT video_id, cluster_id, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS frame_ids FROM c GROUP BY ALL""")
def cluster_frames(spark, sf_dir):
    found = voting.frames_of_clusters(objects(spark, sf_dir, ["frame_id"]), ["video_id", "cluster_id"])
    return found.select("video_id", "cluster_id", F.array_join(F.transform("frame_ids", lambda f: f.cast("string")), ",").alias("frame_ids"))


def vectors(rows: DataFrame) -> DataFrame:
    """Sightings with what a classifier would say of their crops, and how sharp these are; null where there is no crop."""
    raw = [(F.col("part") + 7 * k + F.col("ord")) % 11 + 1 for k in range(5)]
    whole = raw[0] + raw[1] + raw[2] + raw[3] + raw[4]
    there = F.col("ord") % 3 != 0
    return rows.withColumn("probs", F.when(there, F.array(*(r / whole for r in raw)))).withColumn("sharpness", F.when(there, F.col("part") * 37 % 101 / 10.0))


def _vector_sql(temperature: float, source: str, keys: str, exponent: int = 2, best_alone: bool = False) -> str:
    raw = [f"((part + {7 * k} + ord) % 11 + 1)" for k in range(5)]
    power = [f"pow({r}, {1 / temperature})" for r in raw]
    whole = " + ".join(power)
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY quantity DESC, ord) AS n, part * 37 % 101 / 10.0 AS sharp FROM {source}),
w AS (SELECT *, CASE WHEN ord % 3 = 0 OR n > 10 OR {best_alone} THEN 0 ELSE pow(quantity, {exponent}) END AS w, [{', '.join(f'{p} / ({whole})' for p in power)}] AS p FROM r),
g AS (SELECT {keys}, sum(w) AS w, [{', '.join(f'sum(p[{k}] * w)' for k in range(1, 6))}] AS s, 2 * pow(max(quantity), {exponent}) AS m, arg_max(p, (sharp, -ord)) FILTER (WHERE ord % 3 <> 0) AS b FROM w GROUP BY {keys}),
s AS (SELECT {keys}, w + CASE WHEN b IS NULL THEN 0 ELSE m END AS w, [{', '.join(f'CASE WHEN b IS NULL THEN s[{k}] ELSE s[{k}] + b[{k}] * m END' for k in range(1, 6))}] AS s FROM g),
q AS (SELECT {keys}, CASE WHEN w > 0 THEN list_transform(s, lambda x: x / w) ELSE [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] END AS q FROM s)"""


@query(f"WITH {DET}, {_vector_sql(2.0, 'det', 'video_id, obj_id')} SELECT video_id, obj_id, round(q[1], 5) AS p0, round(q[5], 5) AS p4, list_position(q, list_max(q)) - 1 AS pred_class FROM q")
def classifier_vote_vectors(spark, sf_dir):
    found = voting.vector_vote(vectors(detections(spark, sf_dir)), ["video_id", "obj_id"], "probs", "quantity", "ord", temperature=2.0)
    return found.select("video_id", "obj_id", F.round(F.col("class_probs")[0], 5).alias("p0"), F.round(F.col("class_probs")[4], 5).alias("p4"), "pred_class")


@query(f"""WITH {KEPT_SQL}, {_vector_sql(1.0, 'kept', 'video_id, obj_id')}, c AS (SELECT video_id, list_position(q, list_max(q)) - 1 AS c FROM q)
SELECT v.video_id, {', '.join(f"count(*) FILTER (WHERE c = {k}) AS type{k + 1}" for k in range(5))} FROM (SELECT DISTINCT l_suppkey AS video_id FROM lineitem) v LEFT JOIN c USING (video_id) GROUP BY v.video_id""")
def classifier_path_counts(spark, sf_dir):
    """The classifier path from end to end: thresholds, transforms, density clusters of one sighting and more, vector votes, dense counts."""
    points = placed(spark, sf_dir)
    found = clustering.density_clusters(points.select("video_id", "ord", "x", "y"), "video_id", 40.0, 1)
    voted = voting.vector_vote(vectors(points.join(found, ["video_id", "ord"])), ["video_id", "cluster_id"], "probs", "quantity", "ord")
    return voting.dense_counts(voted, registrations(spark, sf_dir))


@query(f"""WITH {DET}, s AS (SELECT *, CASE WHEN ord % 5 = 0 THEN NULL ELSE part * 37 % 101 / 10.0 END AS sharpness, ((x2 - x1) * (y2 - y1)) AS area FROM det)
SELECT video_id, obj_id, arg_max(ord, (coalesce(sharpness, -1), -ord)) AS sharpest, arg_max(ord, (area, -ord)) AS largest, arg_max(ord, (confidence, -ord)) AS surest FROM s GROUP BY ALL""")
def best_crop_choices(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("sharpness", F.when(F.col("ord") % 5 != 0, F.col("part") * 37 % 101 / 10.0))
    return voting.best_crops(rows, ["video_id", "obj_id"])


@query(f"""WITH {DET}, c AS (SELECT DISTINCT video_id, obj_id, CASE WHEN obj_id % 7 = 0 THEN -1 ELSE obj_id % 5 END AS c FROM det)
SELECT CASE WHEN c < 0 THEN 'Unknown' ELSE 'Type_' || (c + 1) END AS label, count(*) AS n FROM c GROUP BY 1""")
def cluster_legend(spark, sf_dir):
    clusters = detections(spark, sf_dir).select("video_id", "obj_id").distinct()
    return voting.summary(clusters.withColumn("pred_class", F.when(F.col("obj_id") % 7 == 0, -1).otherwise(F.col("obj_id") % 5)))


@query(f"WITH {DET} SELECT video_id, ord, confidence FROM det WHERE confidence >= 0.1")
def thresholds_without_common_class(spark, sf_dir):
    """Thresholds that name no class of the model are switched off; the detector's own limit is the lower of both."""
    det = detections(spark, sf_dir)
    model = [f"type{k}" for k in range(1, 6)]
    limits = filters.usable({"screw": 0.9, "nut": 0.8}, model)
    coarse = det.where(F.col("confidence") >= filters.coarse_threshold(filters.DENSITY_THRESHOLDS))
    return filters.above_threshold(coarse, limits).select("video_id", "ord", "confidence")


@query(f"""WITH {DET} SELECT video_id, ord, CASE WHEN least(40 - frame_id, 36) < 20 THEN 'size' WHEN confidence < 0.3 THEN 'confidence' END AS skip FROM det""")
def crop_skips(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("x2", F.col("x2") - F.col("frame_id"))
    return filters.crop_rows(rows, 20.0, 0.3).select("video_id", "ord", "skip")


@query(f"""WITH {DET}, s AS (SELECT video_id, class_name, least(40 - frame_id, 36) < 20 AS small, confidence < 0.3 AS unsure FROM det),
k AS (SELECT class_name, count(*) AS n FROM s WHERE NOT small AND NOT unsure GROUP BY 1)
SELECT '{{"exported":' || count(*) FILTER (WHERE NOT small AND NOT unsure) || ',"skipped_size":' || count(*) FILTER (WHERE small) || ',"skipped_confidence":' || count(*) FILTER (WHERE NOT small AND unsure)
|| ',"videos":' || count(DISTINCT video_id) || ',"classes":{{' || (SELECT string_agg('"' || class_name || '":' || n, ',' ORDER BY class_name) FROM k) || '}}}}' AS value FROM s""")
def crop_manifest(spark, sf_dir):
    """Export statistics of all videos as one JSON text; its size goes with the number of classes."""
    rows = filters.crop_rows(detections(spark, sf_dir).withColumn("x2", F.col("x2") - F.col("frame_id")), 20.0, 0.3)
    parts = rows.groupBy("video_id", "class_name").agg(F.count_if(F.col("skip").isNull()).alias("n"), F.count_if(F.col("skip") == "size").alias("size"), F.count_if(F.col("skip") == "confidence").alias("confidence"))
    classes = parts.groupBy("class_name").agg(F.sum("n").alias("n")).where("n > 0").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("classes"))
    whole = parts.agg(F.sum("n").alias("exported"), F.sum("size").alias("skipped_size"), F.sum("confidence").alias("skipped_confidence"), F.count_distinct("video_id").alias("videos"))
    return whole.join(F.broadcast(classes)).select(F.to_json(F.struct("exported", "skipped_size", "skipped_confidence", "videos", "classes")).alias("value"))  # one row each


@query(f"""WITH {DET}, c AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY ord) - 1 AS crop_id, least(x2 - x1, y2 - y1) * 0.1 AS pad, CASE WHEN class_name = 'type0' THEN 'unknown' ELSE class_name END AS name FROM det),
n AS (SELECT *, least(greatest(x1, 0), 1280) AS a1, least(greatest(x2, 0), 1280) AS a2, least(greatest(y1, 0), 720) AS b1, least(greatest(y2, 0), 720) AS b2 FROM c)
SELECT video_id::VARCHAR AS video_name, frame_id, crop_id, greatest(x1 - pad, 0) AS bbox_x1, greatest(y1 - pad, 0) AS bbox_y1, least(x2 + pad, 1280) AS bbox_x2, least(y2 + pad, 720) AS bbox_y2,
round((a1 + a2) / 2 / 1280, 6) AS bbox_cx_norm, round((b1 + b2) / 2 / 720, 6) AS bbox_cy_norm, round((a2 - a1) / 1280, 6) AS bbox_w_norm, round((b2 - b1) / 720, 6) AS bbox_h_norm, round(confidence, 4)::DOUBLE AS confidence,
CASE WHEN name = 'unknown' THEN -1 ELSE right(name, 1)::INT - 1 END AS class_id, name AS class_name, format('{{}}/{{}}_frame{{:06d}}_crop{{:04d}}.jpg', name, video_id, frame_id, crop_id) AS save_path,
round(part * 37 % 101 / 10.0, 2)::DOUBLE AS sharpness, 1280 AS frame_w, 720 AS frame_h FROM n""")
def crop_records(spark, sf_dir):
    """The eighteen columns of every exported crop."""
    return filters.crop_records(detections(spark, sf_dir).withColumn("sharpness", F.col("part") * 37 % 101 / 10.0), 1280, 720)


@query(f"""WITH {DET}, r AS (SELECT video_id, ord, least(greatest(round_even(x1 - 300, 0), 0), 200) AS a1, least(greatest(round_even(x2 - 300, 0), 0), 200) AS a2, least(greatest(round_even(y1, 0), 0), 150) AS b1, least(greatest(round_even(y2, 0), 0), 150) AS b2 FROM det)
SELECT video_id, ord, CASE WHEN a2 > a1 AND b2 > b1 THEN a2 - a1 ELSE 8 END::INT AS w, CASE WHEN a2 > a1 AND b2 > b1 THEN b2 - b1 ELSE 8 END::INT AS h FROM r""")
def crop_sizes(spark, sf_dir):
    """Sizes of crops of a small frame; boxes outside it give an empty image."""
    det = detections(spark, sf_dir)
    box = geometry.padded_rectangle((F.col("x1") - 300, F.col("y1"), F.col("x2") - 300, F.col("y2")), 200, 150, 0.0)
    w, h = geometry.crop_size(box, 8)
    return det.select("video_id", "ord", w.alias("w"), h.alias("h"))


def _votes_sql() -> str:
    parts = []
    for name, (exponent, temperature, alone) in experiments.VOTES.items():
        parts.append(f"""SELECT '{name}' AS experiment, sum(l1)::BIGINT AS l1_types, max(worst) AS max_error, count(*) FILTER (WHERE l1 = 0) AS exact_videos FROM (
WITH {_vector_sql(temperature, 'kept', 'video_id, obj_id', int(exponent), alone)}, c AS (SELECT video_id, list_position(q, list_max(q)) AS c FROM q),
n AS (SELECT t.video_id, {', '.join(f"abs(any_value(t.type{k}) - count(*) FILTER (WHERE c = {k})) AS e{k}" for k in range(1, 6))} FROM counted t LEFT JOIN c USING (video_id) GROUP BY t.video_id)
SELECT e1 + e2 + e3 + e4 + e5 AS l1, greatest(e1, e2, e3, e4, e5) AS worst FROM n)""")
    return f"WITH {COUNTED_SQL} " + " UNION ALL ".join(parts)


@query(_votes_sql())
def ablation_votes(spark, sf_dir):
    """Exponents and temperatures of the vector vote, and the best crop alone, on the objects as clusters."""
    kept = filters.registered(filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS), registrations(spark, sf_dir)).drop("h")
    return experiments.run_votes(vectors(kept), counted(spark, sf_dir), ["video_id", "obj_id"])


@query(f"""WITH {DET}, b AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, x1, y1 ORDER BY quantity DESC, ord DESC) AS n FROM det)
SELECT video_id, frame_id, ord + 100000 AS ord, quantity AS score, x1, y1 FROM b WHERE n = 1""")
def tile_boxes(spark, sf_dir):
    """Every box seen in two tiles, each in its own coordinates, merged into the frame's."""
    det = detections(spark, sf_dir)
    tile = lambda sx, sy, more: det.select("video_id", "frame_id", (F.col("ord") + more).alias("ord"), F.col("quantity").alias("score"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy"), *((F.col(c) - (sx if c[0] == "x" else sy)).alias(c) for c in ("x1", "y1", "x2", "y2")))
    merged = models.merge_tiles(tile(0.0, 0.0, 0).unionByName(tile(512.0, 256.0, 100000)), 0.99)
    return merged.select("video_id", "frame_id", "ord", "score", "x1", "y1")


@query(f"""WITH {COUNTED_SQL}, {REG}, h AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE class_name = 'type4') AS n4 FROM det GROUP BY 1)
SELECT video_id::VARCHAR AS video, 'Type_1: ' || type1 || chr(10) || 'Type_2: ' || type2 || chr(10) || 'Type_3: ' || type3 || chr(10) || 'Type_4: ' || type4 || chr(10) || 'Type_5: ' || type5 || chr(10) || 'Total: ' || (type1 + type2 + type3 + type4 + type5) AS counts,
(type1 + type2 + type3 + type4 + type5)::BIGINT AS total, n AS total_detections, n4 AS type4_seen, 28::BIGINT AS valid_frames, 2::BIGINT AS invalid_frames, 30 AS n_frames,
(SELECT count(*) FROM obj WHERE obj.video_id = counted.video_id)::INT AS n_clusters FROM counted JOIN h USING (video_id)""")
def video_summary_files(spark, sf_dir):
    """Each video's counts.txt and summary.json, written and read back."""
    keys, path = ["video_id", "frame_id"], f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    kinds = detections(spark, sf_dir).groupBy(*keys, "class_name").agg(F.count(F.lit(1)).alias("n"))
    seen = kinds.groupBy(*keys).agg(F.sum("n").alias("n_detections"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "n")))).alias("class_histogram"))
    frames = registrations(spark, sf_dir).join(seen, keys, "left").withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))
    members = objects(spark, sf_dir, ["frame_id", "class_name", "confidence", "quantity", "x1", "y1", "x2", "y2"])  # found once for both
    clusters = voting.cluster_summary(members, ["video_id", "cluster_id"])
    reports.save_summaries(tallied(members, registrations(spark, sf_dir)), frames, clusters, path)
    files = read_files(spark, path).select(F.substring_index("name", "/", 1).alias("video"), F.substring_index("name", "/", -1).alias("file"), "content")
    told = "struct<detection:struct<total_detections:bigint,overall_class_histogram:map<string,bigint>>,registration:struct<valid_frames:bigint,invalid_frames:bigint>,dedup:struct<n_clusters:int>,counting:struct<total:bigint>,frames:array<struct<frame_id:bigint>>>"
    both = files.groupBy("video").agg(F.max(F.when(F.col("file") == "counts.txt", F.col("content"))).alias("counts"), F.from_json(F.max(F.when(F.col("file") == "summary.json", F.col("content"))), told).alias("s"))
    return both.select(
        "video", "counts", "s.counting.total", "s.detection.total_detections", F.coalesce(F.col("s.detection.overall_class_histogram")["type4"], F.lit(0)).alias("type4_seen"),
        "s.registration.valid_frames", "s.registration.invalid_frames", F.size("s.frames").alias("n_frames"), "s.dedup.n_clusters",
    )


@query(_votes_sql())
def ablation_files(spark, sf_dir):
    """The experiments of the vector vote, saved a file each with their settings and read back."""
    kept = filters.registered(filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS), registrations(spark, sf_dir)).drop("h")
    found = experiments.run_votes(vectors(kept), counted(spark, sf_dir), ["video_id", "obj_id"]).withColumnRenamed("experiment", "name")
    setting = F.create_map(*(F.lit(v) for name, (exponent, *_) in experiments.VOTES.items() for v in (name, exponent)))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    reports.save_experiments(found.withColumn("exponent", setting[F.col("name")]), path, ["exponent"])
    back = reports.saved_experiments(spark, path, "struct<config:struct<name:string,exponent:double>,result:struct<l1_types:bigint,max_error:bigint,exact_videos:bigint>>")
    return back.select(F.col("config.name").alias("experiment"), "result.*")


FEATURES, STRATEGIES, ANCHORS, RATIOS, MATCHES = ["orb", "sift"], ["first", "middle"], [4, 6], [0.25, 0.45], [6, 15]
DISTANCES, LEASTS = [6.0, 40.0], [3, 4]


def feature_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Transforms between all frames of a video by feature type, and the features of each frame; the second type's shifts are off by up to four pixels."""
    reg = by_key(registrations(spark, sf_dir).select("video_id", "frame_id"), F.xxhash64("video_id"))  # rows multiply from here on, whatever few bytes they come from
    reg = reg.select("video_id", "frame_id", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(k).alias("t")) for k, n in enumerate(FEATURES)))).alias("s"))
    v, f, a, t = F.col("video_id"), F.col("frame_id"), F.col("anchor_id"), F.col("t")
    reg = reg.select("video_id", "frame_id", "s.feature", "s.t")
    frames = reg.select("feature", "video_id", "frame_id", ((3 * v + 7 * f + 5 * t) % 40).alias("features"))
    pairs = reg.withColumn("anchor_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    shift = _shift(8 * (f - a) + t * 4 * (f * a % 3 - 1))
    return pairs.select("feature", "video_id", "frame_id", "anchor_id", shift.alias("h"), (0.2 + (f + 2 * a + t) % 7 * 0.1).alias("inlier_ratio"), ((5 * f + 3 * a + v + 11 * t) % 40).alias("matches")), frames


_FINE = "((5 * {f} + 3 * {a} + {r}.video_id + 11 * {r}.t) % 40 >= {r}.matches AND 0.2 + ({f} + 2 * {a} + {r}.t) % 7 * 0.1 >= {r}.ratio)"
_STEP = "(8 * ({f} - {a}) + {r}.t * 4 * (({f} * {a}) % 3 - 1))::DOUBLE"
_SETTING = "t, strategy, anchors, ratio, matches, video_id"


def _on(a: str, b: str, names: str) -> str:
    return " AND ".join(f"{a}.{n} = {b}.{n}" for n in names.split(", "))


SEQUENCES_SQL = f"""vid AS (SELECT DISTINCT l_suppkey AS video_id FROM lineitem), fr AS (SELECT unnest(range(30)) AS f),
pl AS (SELECT *, CASE WHEN strategy = 'middle' THEN 15 ELSE 0 END AS preferred, list_distinct(list_transform(range(anchors), lambda i: CASE WHEN i = anchors - 1 THEN 29 ELSE floor(i * (29.0::DOUBLE / (anchors - 1)))::BIGINT END)) AS even
  FROM (VALUES ('first'), ('middle')) a(strategy), (VALUES (4), (6)) b(anchors)),
ev AS (SELECT strategy, anchors, preferred, unnest(even) AS p FROM pl),
ne AS (SELECT strategy, anchors, preferred, arg_min(p, (abs(p - preferred), p)) AS nearest, bool_or(p = preferred) AS has FROM ev GROUP BY ALL),
an AS (SELECT ev.strategy, ev.anchors, ev.preferred, CASE WHEN NOT has AND p = nearest THEN ev.preferred ELSE p END AS a FROM ev JOIN ne USING (strategy, anchors)),
rt AS (SELECT t, strategy, anchors, video_id, coalesce(arg_min(a, (abs(a - preferred), a)) FILTER (WHERE (3 * video_id + 7 * a + 5 * t) % 40 >= 15), min(preferred)) AS root
  FROM an, vid, (VALUES (0), (1)) x(t) GROUP BY t, strategy, anchors, video_id),
sg AS MATERIALIZED (SELECT rt.*, ratio, matches FROM rt, (VALUES (0.25), (0.45)) r(ratio), (VALUES (6), (15)) m(matches)),
oa AS MATERIALIZED (SELECT rt.*, a, row_number() OVER (PARTITION BY t, rt.strategy, rt.anchors, video_id ORDER BY abs(a - root), a) AS k FROM rt JOIN an ON {_on('rt', 'an', 'strategy, anchors')} WHERE a <> root),
tr AS (SELECT {_SETTING}, root, 0::BIGINT AS k, [[root::DOUBLE, 0.0::DOUBLE]] AS done FROM sg
  UNION ALL SELECT {_SETTING}, root, k, CASE WHEN len(near) = 0 THEN done ELSE list_append(done, [a::DOUBLE, {_STEP.format(f='a', a='near[1][3]::BIGINT', r='z')} + near[1][4]]) END FROM (
    SELECT tr.* EXCLUDE (k), oa.k, oa.a, list_sort(list_transform(list_filter(tr.done, lambda x: {_FINE.format(f='oa.a', a='x[1]::BIGINT', r='tr')}), lambda x: [abs(x[1] - oa.a), abs(x[1] - tr.root), x[1], x[2]])) AS near
    FROM tr JOIN oa ON {_on('tr', 'oa', 't, strategy, anchors, video_id')} AND oa.k = tr.k + 1) z),
dn AS MATERIALIZED (SELECT {_SETTING}, root, x[1]::BIGINT AS a, x[2] AS s FROM (SELECT *, unnest(done) AS x FROM tr WHERE k = anchors - 1)),
ca AS (SELECT dn.*, fr.f, CASE WHEN a = fr.f THEN s ELSE {_STEP.format(f='fr.f', a='a', r='dn')} + s END AS shift FROM dn, fr WHERE a = fr.f OR {_FINE.format(f='fr.f', a='a', r='dn')}),
regs AS MATERIALIZED (SELECT {_SETTING}, f, arg_min(a, (abs(f - a), abs(a - root), a)) AS anchor_id, arg_min(shift, (abs(f - a), abs(a - root), a)) AS shift FROM ca GROUP BY {_SETTING}, f)"""


@query(f"""WITH RECURSIVE {SEQUENCES_SQL} SELECT CASE WHEN t = 0 THEN 'orb' ELSE 'sift' END AS feature, strategy, anchors, ratio::DOUBLE AS ratio, matches, sg.video_id, fr.f AS frame_id, shift, shift IS NOT NULL AS valid
FROM sg CROSS JOIN fr LEFT JOIN regs USING (t, strategy, anchors, ratio, matches, video_id, f)""")
def register_settings(spark, sf_dir):
    """Registration under every setting, roots that lack features replaced by another anchor of the video."""
    found = search.sequences(*feature_pairs(spark, sf_dir), STRATEGIES, ANCHORS, RATIOS, MATCHES)
    return found.select("feature", "strategy", "anchors", "ratio", "matches", "video_id", "frame_id", F.col("h")[2].alias("shift"), "valid")


_KEY = "t, strategy, anchors, ratio, matches, distance, video_id"
_LEVEL = "t, strategy, anchors, ratio, matches, distance, least, video_id"
_MATCHES = " + ".join(f"abs(type{k} - coalesce(p{k}, 0))" for k in range(1, 6))


@query(f"""WITH RECURSIVE {COUNTED_SQL}, {SEQUENCES_SQL},
q AS MATERIALIZED (SELECT {_KEY}, obj_id, ord, class_name, quantity * quantity AS w, rx - 8 * frame_id + shift AS x, ry AS y FROM regs JOIN kept_all USING (video_id, f), (VALUES (6.0), (40.0)) d(distance)),
e AS MATERIALIZED (SELECT {', '.join('a.' + k for k in _KEY.split(', '))}, a.ord AS a, b.ord AS b FROM q a JOIN q b ON {_on('a', 'b', _KEY)} AND a.obj_id = b.obj_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.distance * a.distance),
core AS MATERIALIZED (SELECT {_LEVEL}, a FROM (SELECT {_KEY}, a, count(*) AS n FROM e GROUP BY ALL), (VALUES (3), (4)) l(least) WHERE n >= least),
ce AS MATERIALIZED (SELECT c.least, e.* FROM e JOIN core c ON {_on('c', 'e', _KEY)} AND c.a = e.a JOIN core o ON o.least = c.least AND {_on('o', 'e', _KEY)} AND o.a = e.b),
reach AS (SELECT {_LEVEL}, a, b FROM ce UNION SELECT {', '.join('r.' + k for k in _LEVEL.split(', '))}, r.a, ce.b FROM reach r JOIN ce ON {_on('r', 'ce', _LEVEL)} AND ce.a = r.b),
comp AS MATERIALIZED (SELECT {_LEVEL}, a, min(b) AS c FROM reach GROUP BY ALL),
density AS (SELECT * FROM comp UNION ALL SELECT {', '.join('comp.' + k for k in _LEVEL.split(', '))}, e.b, min(c) FROM e JOIN comp ON {_on('comp', 'e', _KEY)} AND comp.a = e.a
  WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.least = comp.least AND {_on('core', 'e', _KEY)} AND core.a = e.b) GROUP BY {', '.join('comp.' + k for k in _LEVEL.split(', '))}, e.b),
{_running_sql('q', _KEY, 'distance')},
m AS (SELECT 'density' AS method, {_LEVEL}, a AS ord, c FROM density UNION ALL SELECT 'incremental', {_LEVEL}, ord, own FROM found, (VALUES (3), (4)) l(least) WHERE n >= least),
w AS (SELECT method, {', '.join('m.' + k for k in _LEVEL.split(', '))}, c, class_name, sum(w) AS w FROM m JOIN q ON {_on('m', 'q', _KEY)} AND m.ord = q.ord GROUP BY ALL),
vo AS (SELECT method, {_LEVEL}, c, arg_max(class_name, (w, 10 - right(class_name, 1)::INT)) AS class_name FROM w GROUP BY ALL),
ct AS (SELECT method, {_LEVEL}, {', '.join(f"count(*) FILTER (WHERE class_name = 'type{k}') AS p{k}" for k in range(1, 6))} FROM vo GROUP BY ALL),
al AS (SELECT DISTINCT t, strategy, anchors, ratio, matches, distance, least, method FROM sg, (VALUES (6.0), (40.0)) d(distance), (VALUES (3), (4)) l(least), (VALUES ('density'), ('incremental')) x(method)),
er AS (SELECT al.*, {_MATCHES} AS l1, greatest({', '.join(f"abs(type{k} - coalesce(p{k}, 0))" for k in range(1, 6))}) AS worst FROM al CROSS JOIN counted LEFT JOIN ct ON {_on('ct', 'al', 'method, t, strategy, anchors, ratio, matches, distance, least')} AND ct.video_id = counted.video_id)
SELECT CASE WHEN t = 0 THEN 'orb' ELSE 'sift' END AS feature, strategy, anchors, ratio::DOUBLE AS ratio, matches, method, distance::DOUBLE AS distance, least, sum(l1)::BIGINT AS l1, max(worst) AS worst, count(*) FILTER (WHERE l1 = 0) AS exact
FROM er GROUP BY ALL""".replace("kept_all USING (video_id, f)", "(SELECT *, frame_id AS f FROM det JOIN thr USING (class_name) WHERE confidence >= least) kept_all USING (video_id, f)"))
def param_grid_all_lists(spark, sf_dir):
    """All eight lists of the search vary: 256 settings, each registered, clustered, voted and scored."""
    det = filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS).withColumn("w", F.col("quantity") * F.col("quantity"))
    return search.grid_of_pairs(det, *feature_pairs(spark, sf_dir), counted(spark, sf_dir), STRATEGIES, ANCHORS, RATIOS, MATCHES, ["density", "incremental"], DISTANCES, LEASTS)
