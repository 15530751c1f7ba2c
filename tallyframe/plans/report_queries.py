"""Queries over files, reports, registration chains, models and experiments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import experiments, models, registration, scoring, voting
from ..sources import files, reports
from .fixtures import DET, LEN, REG, SIGNAL, detections, frame_signal, lengths, registrations, table
from .named import book
from .observation_queries import COUNTED_SQL, PAIRS_SQL, counted, perturbed, placed

QUERIES, ORACLE, query = book()

@query(f"""WITH {REG}, a AS (SELECT video_id, frame_id AS anchor_id FROM reg WHERE valid AND frame_id % 3 = 1),
n AS (SELECT r.video_id, r.frame_id, r.valid, r.inlier_ratio, arg_min(anchor_id, (abs(r.frame_id - anchor_id), abs(anchor_id - 13), anchor_id)) AS anchor_id FROM reg r JOIN a USING (video_id) GROUP BY ALL)
SELECT video_id, frame_id, (8 * (frame_id - 13))::DOUBLE AS shift, frame_id = anchor_id OR valid AS valid, CASE WHEN frame_id = anchor_id THEN 0.9 ELSE least(inlier_ratio, 0.9) END::DOUBLE AS inlier_ratio FROM n""")
def register_through_anchors(spark, sf_dir):
    reg = registrations(spark, sf_dir)
    move = lambda by: F.array(*(F.lit(1.0), F.lit(0.0), by.cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    to_root = reg.where("frame_id % 3 = 1").withColumn("h", move(8 * (F.col("frame_id") - 13)))
    places = to_root.select("video_id", F.col("frame_id").alias("anchor_id"))
    pairs = reg.join(places, "video_id").withColumn("h", move(8 * (F.col("frame_id") - F.col("anchor_id"))))
    found = registration.through_anchors(pairs, to_root, "video_id", 13)
    return found.select("video_id", "frame_id", F.col("h")[2].alias("shift"), "valid", "inlier_ratio")


@query(f"WITH {REG} SELECT video_id, count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE inlier_ratio < 0.25) AS low_inlier, round(avg(valid::INT), 6) AS rate FROM reg GROUP BY video_id")
def registration_status(spark, sf_dir):
    return registration.status(registrations(spark, sf_dir), "video_id")


@query(f"""WITH {SIGNAL}, {LEN}, p AS (SELECT video_id, total // 2 AS root, list_sort(list_distinct(list_transform(range(5), lambda i: CASE WHEN i = 4 THEN total - 1 ELSE floor(i::DOUBLE * ((total - 1)::DOUBLE / 4.0))::BIGINT END))) AS places FROM len),
n AS (SELECT *, list_sort(list_transform(places, lambda x: [abs(x - root), x]))[1][2] AS nearest FROM p)
SELECT video_id, unnest(list_transform(places, lambda x: CASE WHEN NOT list_contains(places, root) AND x = nearest THEN root ELSE x END)) AS place FROM n""")
def anchor_places(spark, sf_dir):
    return registration.anchors(lengths(frame_signal(spark, sf_dir)), "video_id", "total", 5, middle=True)


@query(f"WITH {DET} SELECT video_id, count(*) FILTER (WHERE class_name = 'type1') AS type1, count(*) FILTER (WHERE class_name = 'type2') AS type2, count(*) FILTER (WHERE class_name = 'type3') AS type3, count(*) FILTER (WHERE class_name = 'type4') AS type4, count(*) FILTER (WHERE class_name = 'type5') AS type5 FROM det GROUP BY video_id")
def raw_counts(spark, sf_dir):
    det = detections(spark, sf_dir)
    rows = det.select("video_id", voting.class_index(F.col("class_name")).alias("pred_class"))
    return voting.dense_counts(rows, det)


@query(f"WITH {COUNTED_SQL} SELECT video_id, [type1, type2, type3, type4, type5]::VARCHAR AS counts FROM counted")
def result_rows(spark, sf_dir):
    rows = reports.validated(counted(spark, sf_dir))
    return rows.select("video_id", F.concat(F.lit("["), F.array_join("counts", ", "), F.lit("]")).alias("counts"))


@query(f"""WITH {COUNTED_SQL} SELECT video_id, video_id || ': ' || CASE WHEN video_id % 7 = 0 THEN 'failed' ELSE 'ok type1=' || type1 || ' type2=' || type2 || ' type3=' || type3 || ' type4=' || type4 || ' type5=' || type5
|| ' total=' || (type1 + type2 + type3 + type4 + type5) END AS line FROM counted""")
def batch_report(spark, sf_dir):
    return reports.report_lines(counted(spark, sf_dir).withColumn("failed", F.col("video_id") % 7 == 0))


@query(f"""WITH {PAIRS_SQL} SELECT '| ' || type || ' | ' || sum(abs(t - p))::BIGINT || ' | ' || max(abs(t - p)) || ' |' AS value FROM pairs GROUP BY type""")
def markdown_table(spark, sf_dir):
    truth = counted(spark, sf_dir)
    error = F.abs(F.col("t") - F.col("p"))
    return reports.markdown_rows(scoring.matched(truth, perturbed(truth)).groupBy("type").agg(F.sum(error).alias("sum"), F.max(error).alias("max")))


@query(f"WITH {SIGNAL} SELECT video_id || chr(9) || string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS value FROM sig WHERE frame_id % 9 = 0 GROUP BY video_id")
def manifest_text(spark, sf_dir):
    return files.manifest_lines(frame_signal(spark, sf_dir).where("frame_id % 9 = 0"))


@query(f"WITH {SIGNAL} SELECT video_id::VARCHAR AS video, frame_id FROM sig WHERE frame_id % 9 = 0")
def manifest_roundtrip(spark, sf_dir):
    lines = files.manifest_lines(frame_signal(spark, sf_dir).where("frame_id % 9 = 0"))
    extra = spark.createDataFrame([("# comment\t1,2",), ("bad line",), ("none\tx, ,y1",)], "value string")
    return files.read_manifest(lines.unionByName(extra))


@query(f"WITH {DET} SELECT class_name AS class_key, sum(quantity) / 100000.0::DOUBLE AS threshold FROM det WHERE class_name <> 'type4' GROUP BY video_id, class_name")
def threshold_config(spark, sf_dir):
    """A configuration a video, nested or flat, from its confidences by class; names are written in several ways, one value is no number."""
    sums = detections(spark, sf_dir).groupBy("video_id", "class_name").agg((F.sum("quantity") / F.lit(100000.0)).alias("t"))
    name = F.when(F.col("class_name") == "type2", "Type-2").when(F.col("class_name") == "type3", " TYPE_3").otherwise(F.col("class_name"))
    told = F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.when(F.col("class_name") == "type4", "high").otherwise(F.col("t").cast("string")).alias("v"))))
    maps = sums.groupBy("video_id").agg(told.alias("m"))
    text = F.when(F.col("video_id") % 2 == 0, F.to_json(F.struct(F.col("m").alias("class_conf_thresholds"), F.lit("x").alias("notes")))).otherwise(F.to_json("m"))
    return files.thresholds(maps.select(text.alias("value")))


@query(f"WITH {COUNTED_SQL} SELECT video_id::VARCHAR AS video, type1, type2, type3, type4, type5, type1 + type2 + type3 + type4 + type5 AS total FROM counted")
def truth_json(spark, sf_dir):
    rows = counted(spark, sf_dir)
    names = [f"type{k}" for k in range(1, 6)]
    named = F.to_json(F.create_map(F.col("video_id").cast("string"), F.struct(*names)))
    listed = F.to_json(F.create_map(F.col("video_id").cast("string"), F.array(*names)))
    return files.truth(rows.select(F.when(F.col("video_id") % 2 == 0, named).otherwise(listed).alias("value")))


@query(f"WITH {SIGNAL}, {LEN} SELECT video_id, frame_id FROM sig WHERE frame_id >= 3 AND frame_id < 40 AND (frame_id - 3) % 4 = 0")
def frame_range_scan(spark, sf_dir):
    return files.frames_in(frame_signal(spark, sf_dir), 3, 40, 4).select("video_id", "frame_id")


@query(f"WITH {SIGNAL} SELECT video_id, frame_id, signal FROM sig WHERE frame_id IN (0, 5, 17)")
def frame_point_scan(spark, sf_dir):
    signal = frame_signal(spark, sf_dir)
    wanted = signal.select("video_id").distinct().select("video_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (5, 0, 17, 5, 100000)))).alias("frame_id"))
    return files.frames_at(signal, wanted).select("video_id", "frame_id", "signal")


@query("""SELECT p_partkey AS video_id, greatest(0, p_size // 2)::BIGINT AS middle, round(p_size / 30.0, 6) AS seconds, CASE WHEN p_partkey % 4 IN (1, 3) THEN 1080 ELSE 1920 END AS w,
round(960 / 1920.0, 6) AS scale FROM part""")
def video_meta(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    turn = (F.col("p_partkey") % 4 * 90).cast("int")
    w, h = metrics.upright(F.lit(1920), F.lit(1080), turn)
    return part.select(F.col("p_partkey").alias("video_id"), metrics.middle_frame(F.col("p_size")).alias("middle"), F.round(metrics.duration(F.col("p_size"), F.lit(30)), 6).alias("seconds"), w.alias("w"), F.round(metrics.shrunk(w, h)[0], 6).alias("scale"))


@query("""WITH s AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda v: exp((v::DOUBLE - list_max(embedding[1:5])::DOUBLE) / 0.5)) AS e FROM embeddings)
SELECT vec_id, round(e[1] / list_sum(e), 5) AS p0, round(e[5] / list_sum(e), 5) AS p4 FROM s""")
def softmax_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("v"))
    return rows.withColumn("p", metrics.softmax(F.col("v"), 0.5)).select("vec_id", F.round(F.col("p")[0], 5).alias("p0"), F.round(F.col("p")[4], 5).alias("p4"))


@query("""SELECT event_type, dense_rank() OVER (ORDER BY first) - 1 AS place FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)""")
def first_seen_labels(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return first.select("event_type", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("place"))  # a handful of labels


@query("""SELECT event_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS lap FROM events""")
def lap_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", F.round(seconds - F.lag(seconds).over(at), 3).alias("lap"))


@query()
def model_detections(spark, sf_dir):
    frames = frame_signal(spark, sf_dir).select("video_id", "frame_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    return models.detect(frames, models.GridDetector)


@query()
def model_classes(spark, sf_dir):
    crops = detections(spark, sf_dir).select(F.col("part").alias("crop_id"), "video_id", "ord")
    return models.classify(crops, models.HashClassifier)


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS video_id, 3840 AS width, 2160 AS height FROM lineitem),
x AS (SELECT unnest([0, 1024, 2048, 2560]) AS sx), y AS (SELECT unnest([0, 880]) AS sy) SELECT video_id, sx, sy, sx + 1280 AS ex, least(sy + 1280, 2160) AS ey FROM f, x, y""")
def image_slices(spark, sf_dir):
    frames = registrations(spark, sf_dir).select("video_id").distinct().select("video_id", F.lit(3840).alias("width"), F.lit(2160).alias("height"))
    return models.slices(frames).select("video_id", "sx", "sy", "ex", "ey")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
SELECT source, string_agg('<img src="' || doc_id || '">', '' ORDER BY n) AS html FROM r WHERE n <= 200 GROUP BY source""")
def crop_preview(spark, sf_dir):
    return reports.preview(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id")


_TYPES = [f"type{k}" for k in range(1, 6)]


@query(f"""WITH {COUNTED_SQL}, raw AS (SELECT v.video_id, {', '.join(f"count(*) FILTER (WHERE class_name = '{t}') AS {t}" for t in _TYPES)} FROM (SELECT DISTINCT video_id FROM kept) v LEFT JOIN kept USING (video_id) GROUP BY v.video_id),
d AS (SELECT c.video_id, {' + '.join(f"abs(c.{t} - coalesce(r.{t}, 0))" for t in _TYPES)} AS l1, greatest({', '.join(f"abs(c.{t} - coalesce(r.{t}, 0))" for t in _TYPES)}) AS worst FROM counted c LEFT JOIN raw r USING (video_id))
SELECT 'no_dedup' AS experiment, sum(l1)::BIGINT AS l1_types, max(worst) AS max_error, count(*) FILTER (WHERE l1 = 0) AS exact_videos FROM d
UNION ALL SELECT n, 0, 0, (SELECT count(*) FROM counted) FROM (VALUES ('incremental'), ('density'), ('density_equal_votes')) t(n)""")
def ablation_dedup(spark, sf_dir):
    return experiments.run(placed(spark, sf_dir), counted(spark, sf_dir))
