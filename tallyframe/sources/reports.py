"""What comes out: validated results, reports, table exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text_files import read_files, write_files

TYPES = [f"type{k}" for k in range(1, 6)]


def validated(results: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, counts): five counts a video; a missing key or a negative count stops the job."""
    fine = F.col(key).isNotNull()
    for t in TYPES:
        fine = fine & (F.coalesce(F.col(t), F.lit(-1)) >= 0)
    counts = F.array(*(F.col(t).cast("int") for t in TYPES))
    return results.select(key, F.when(fine, counts).otherwise(F.raise_error(F.lit("counts must be there and not negative")).cast("array<int>")).alias("counts"))


def time_text(seconds: Column) -> Column:
    return F.format_string("%.4f", F.greatest(seconds.cast("double"), F.lit(0.0)))


def report_lines(results: DataFrame, status: str = "failed", key: str = "video_id") -> DataFrame:
    """A line a video: its counts and total, or that it failed."""
    total = sum((F.col(t) for t in TYPES[1:]), F.col(TYPES[0]))
    told = F.concat_ws(" ", F.lit("ok"), *(F.concat(F.lit(f"{t}="), F.col(t).cast("string")) for t in TYPES), F.concat(F.lit("total="), total.cast("string")))
    return results.select(key, F.concat(F.col(key).cast("string"), F.lit(": "), F.when(F.col(status), F.lit("failed")).otherwise(told)).alias("line"))


def batch_totals(results: DataFrame, status: str = "failed") -> DataFrame:
    return results.agg(F.count_if(~F.col(status)).alias("ok"), F.count_if(status).alias("failed"), *(F.coalesce(F.sum(F.when(~F.col(status), F.col(t))), F.lit(0)).alias(t) for t in TYPES))


def markdown_rows(table: DataFrame) -> DataFrame:
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns)), F.lit(" |")).alias("value"))


def latex_rows(table: DataFrame) -> DataFrame:
    cells = (F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("_"), F.lit("\\_")) for c in table.columns)
    return table.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("value"))


def preview(crops: DataFrame, kind: str, sharpness: str, path: str, most: int = 200) -> DataFrame:
    """(kind, html): the sharpest crops of each class as one fragment."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(sharpness), path))
    best = crops.withColumn("place_", place).where(F.col("place_") <= most)
    item = F.struct("place_", F.format_string('<img src="%s">', F.col(path).cast("string")).alias("html"))
    return best.groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["html"]), "").alias("html"))


def csv_rows(table: DataFrame) -> DataFrame:
    """Lines of a CSV file; texts with a comma, a quote or a line break are quoted, null is empty."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return table.select(F.concat_ws(",", *map(cell, table.columns)).alias("value"))


def save_results(results: DataFrame, path: str, key: str = "video_id") -> None:
    validated(results, key).write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def faults(expected: DataFrame, written: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, fault): expected videos whose result (key, counts) is missing, not five counts, or negative."""
    both = expected.select(key).distinct().join(written.select(key, "counts"), key, "left")
    fault = F.when(F.col("counts").isNull(), "missing").when(F.size("counts") != len(TYPES), "not five counts").when(F.exists("counts", lambda c: c < 0), "negative")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def save_time(spark: SparkSession, seconds: float, path: str) -> None:
    """``time.txt`` under ``path``: the seconds with four places, none below 0."""
    rows = spark.createDataFrame([(float(seconds),)], "s double").select(F.lit("time.txt").alias("name"), F.concat(time_text(F.col("s")), F.lit("\n")).alias("content"))
    write_files(rows, path)


def load_time(spark: SparkSession, path: str) -> float:
    """The seconds that :func:`save_time` wrote."""
    found = read_files(spark, path).where("name = 'time.txt'").select(F.trim(F.regexp_replace("content", r"\s", "")).try_cast("double").alias("s")).first()
    if found is None or found["s"] is None:
        raise FileNotFoundError(f"no readable time.txt in {path}")
    return found["s"]


def save_experiments(results: DataFrame, path: str, config: list[str]) -> None:
    """A JSON file an experiment, ``<name>.json``: its settings, the columns ``config``, under that key, everything else under ``result``."""
    rest = [c for c in results.columns if c not in config]
    body = F.to_json(F.struct(F.struct("name", *config).alias("config"), F.struct(*rest).alias("result")))
    write_files(results.select(F.concat(F.col("name"), F.lit(".json")).alias("name"), body.alias("content")), path)


def saved_experiments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The files of :func:`save_experiments`, parsed as ``schema`` says of config and result; files that do not parse are left out."""
    parsed = read_files(spark, path).where("name like '%.json'").select(F.from_json("content", schema).alias("e"))
    return parsed.where("e.config.name is not null").select("e.config", "e.result")


def counts_text(counts: list[Column]) -> Column:
    """A line a type and one for the total."""
    lines = [F.concat(F.lit(f"Type_{k}: "), c.cast("string")) for k, c in enumerate(counts, 1)]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Total: "), sum(counts[1:], counts[0]).cast("string")))


def save_summaries(videos: DataFrame, frames: DataFrame, clusters: DataFrame, path: str, key: str = "video_id") -> None:
    """``<video>/counts.txt`` and ``<video>/summary.json`` of every video (key, type1..type5).

    The summary has the counts and their total, how many registrations are valid, the
    histogram of detected classes, and the records of its ``frames`` (key, frame_id,
    n_detections, class_histogram, valid) and ``clusters`` (key, cluster_id and more) in
    order: a file is one video, so are the rows it is made of.
    """
    def told(df: DataFrame, order: str, name: str) -> DataFrame:
        records = F.collect_list(F.struct(order, *(c for c in df.columns if c not in (key, order))))
        return df.groupBy(key).agg(F.array_sort(records, lambda l, r: F.when(l[order] < r[order], -1).when(l[order] > r[order], 1).otherwise(0)).alias(name))

    facts = frames.groupBy(key).agg(F.count_if("valid").alias("valid_frames"), F.count_if(~F.col("valid")).alias("invalid_frames"), F.sum("n_detections").alias("total_detections"))
    kinds = frames.select(key, F.explode("class_histogram").alias("k", "n")).groupBy(key, "k").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("histogram"))
    both = videos
    for more in (facts, kinds, told(frames.select(key, "frame_id", "n_detections", "class_histogram", "valid"), "frame_id", "frames"), told(clusters, "cluster_id", "clusters")):
        both = both.join(more, key, "left")
    counts = [F.col(t).cast("long") for t in TYPES]
    body = F.struct(
        F.col(key).cast("string").alias("video_name"), F.struct("total_detections", F.col("histogram").alias("overall_class_histogram")).alias("detection"), F.struct("valid_frames", "invalid_frames").alias("registration"),
        F.struct(F.coalesce(F.size("clusters"), F.lit(0)).alias("n_clusters")).alias("dedup"), F.struct(F.array(*counts).alias("counts"), sum(counts[1:], counts[0]).alias("total")).alias("counting"), "frames", "clusters",
    )
    files = F.array(F.struct(F.lit("counts.txt").alias("file"), counts_text(counts).alias("content")), F.struct(F.lit("summary.json").alias("file"), F.to_json(body).alias("content")))
    rows = both.select(key, F.explode(files).alias("f"))
    write_files(rows.select(F.concat_ws("/", F.col(key).cast("string"), "f.file").alias("name"), "f.content"), path)


def load_experiments(texts: DataFrame, column: str = "value") -> DataFrame:
    """(name, score, mae, counts) of experiment results; unknown keys are ignored, texts that do not parse or have no name left out."""
    found = texts.select(F.from_json(column, "struct<name:string,score:long,mae:double,counts:map<string,array<long>>>").alias("e"))
    return found.select("e.*").where("name is not null and (score is not null or mae is not null or counts is not null)")


def best_as_json(found: DataFrame, order: list[str], most: int) -> DataFrame:
    """(place, value): the first ``most`` rows in order, each as a JSON text."""
    best = found.orderBy(*order).limit(most)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("place"), F.to_json(F.struct(*found.columns)).alias("value"))  # a few rows


def modules(rows: DataFrame, module: str, video: str, seconds: str) -> DataFrame:
    """(module, mean, whole, peak, videos, share, place), slowest first; there are few modules."""
    found = rows.groupBy(module).agg(F.avg(seconds).alias("mean"), F.max(seconds).alias("peak"), F.count_distinct(video).alias("videos"), F.sum(seconds).alias("total"))
    place = F.row_number().over(Window.orderBy(F.desc("mean"), module))
    return found.select(module, "mean", F.floor("mean").alias("whole"), "peak", "videos", (F.col("total") / F.sum("total").over(Window.partitionBy())).alias("share"), place.alias("place"))
