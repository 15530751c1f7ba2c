"""Annotation formats: readers into (images, annotations, categories), writers, validators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import stem
from ..functions.session import cut, numbered
from .files import IMAGE_SUFFIXES, class_names, of_kind
from .text_files import read_files, write_files


@dataclass
class Dataset:
    """images (image_id, file_name, width, height); annotations (image_id, category, x1, y1, x2, y2); categories (category, place)."""

    images: DataFrame
    annotations: DataFrame
    categories: DataFrame


def file_stem() -> Column:
    return stem(F.col("_metadata.file_path"))


def parse_yolo(lines: DataFrame, images: DataFrame, categories: DataFrame) -> Dataset:
    """Label lines (stem, value): ``class cx cy w h [confidence]``, normalised.

    Lines of fewer than five fields, centres outside [0, 1], sizes outside (0, 1] and
    stems without an image are dropped; a class without a name is ``class_<id>``, a
    missing or unreadable confidence is 1.
    """
    fields = lines.select("stem", F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 5)
    number = lambda k: F.try_element_at("f", F.lit(k + 1)).try_cast("double")
    rows = fields.select("stem", F.try_element_at("f", F.lit(1)).try_cast("int").alias("place"), *(number(k).alias(c) for k, c in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))), F.coalesce(number(5), F.lit(1.0)).alias("confidence"))
    fine = rows.where("cx between 0 and 1 and cy between 0 and 1 and w > 0 and w <= 1 and h > 0 and h <= 1")
    placed = images.withColumn("stem", stem(F.col("file_name"))).join(fine, "stem").join(categories, "place", "left")
    name = F.coalesce("category", F.concat(F.lit("class_"), F.col("place").cast("string")))
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    boxes = placed.select(
        "image_id", name.alias("category"), ((F.col("cx") - half_w) * F.col("width")).alias("x1"), ((F.col("cy") - half_h) * F.col("height")).alias("y1"),
        ((F.col("cx") + half_w) * F.col("width")).alias("x2"), ((F.col("cy") + half_h) * F.col("height")).alias("y2"), "confidence",
    )
    return Dataset(images, boxes, categories)


def read_yolo(spark: SparkSession, labels: str, images: DataFrame, categories: DataFrame) -> Dataset:
    """A folder of label files, one an image."""
    return parse_yolo(spark.read.text(labels).select(file_stem().alias("stem"), "value"), images, categories)


def yolo_labels(data: Dataset) -> DataFrame:
    """(stem, value): the label text of every image, empty without boxes; centres clamped, sizes outside (0, 1] dropped, six decimals."""
    both = data.annotations.join(data.images, "image_id").join(data.categories, "category")
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    w, h = (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")
    cx, cy = clamp((F.col("x1") + F.col("x2")) / 2 / F.col("width")), clamp((F.col("y1") + F.col("y2")) / 2 / F.col("height"))
    rows = both.select(stem(F.col("file_name")).alias("stem"), "place", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h")).where("w > 0 and w <= 1 and h > 0 and h <= 1")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "place", "cx", "cy", "w", "h")
    told = rows.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))
    return data.images.select(stem(F.col("file_name")).alias("stem")).distinct().join(told, "stem", "left").select("stem", F.coalesce("value", F.lit("")).alias("value"))


def write_yolo(data: Dataset, path: str) -> None:
    """The label texts of all images as one table of as many files as tasks, not a file an image."""
    yolo_labels(data).write.mode("overwrite").parquet(path)


def read_yolo_table(spark: SparkSession, path: str, images: DataFrame, categories: DataFrame) -> Dataset:
    """What :func:`write_yolo` wrote."""
    labels = spark.read.parquet(path).select("stem", F.explode(F.split("value", "\n")).alias("value"))
    return parse_yolo(labels, images, categories)


def first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """(category, place): the categories in the order in which they first occur."""
    first = rows.groupBy("category").agg(F.min(F.struct(*order)).alias("first"))
    return first.select("category", (F.row_number().over(Window.orderBy("first")) - 1).alias("place"))  # a list of class names


COCO = """struct<images:array<struct<id:bigint,file_name:string,width:int,height:int>>,
annotations:array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double>>,categories:array<struct<id:bigint,name:string>>>"""


def coco_tables(text: DataFrame, column: str = "value") -> Dataset:
    """JSON documents of the COCO layout; categories in id order from 0; unknown categories and empty boxes are dropped."""
    doc = text.select(F.from_json(column, COCO).alias("d"))
    images = doc.select(F.explode("d.images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    kinds = doc.select(F.explode("d.categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category")).distinct()
    places = kinds.withColumn("place", F.row_number().over(Window.orderBy("category_id")) - 1)  # a list of class names
    boxes = doc.select(F.explode("d.annotations").alias("a")).select("a.*").where("bbox[2] > 0 and bbox[3] > 0").join(kinds, "category_id")
    corner = boxes.select("image_id", "category", F.col("bbox")[0].alias("x1"), F.col("bbox")[1].alias("y1"), (F.col("bbox")[0] + F.col("bbox")[2]).alias("x2"), (F.col("bbox")[1] + F.col("bbox")[3]).alias("y2"))
    return Dataset(images, corner, places.select("category", "place"))


def to_coco(data: Dataset, each: int = 5000) -> DataFrame:
    """JSON documents of the COCO layout, each of about ``each`` images; boxes and areas rounded to two places.

    Box ids count from 1 within a document and are unique over all: the document's
    number stands above the lower 32 bits.
    """
    parts = max(1, data.images.count() // each)
    deal = F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("int").alias("part")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    images = data.images.select(deal, F.struct(F.col("image_id").alias("id"), "file_name", "width", "height").alias("i")).groupBy("part").agg(F.collect_list("i").alias("images"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("image_id", "x1", "y1", "x2", "y2", "place"))
    boxes = data.annotations.join(data.categories, "category").select(deal, "*").withColumn("n", number)
    box = F.struct((F.col("part").cast("long") * (1 << 32) + F.col("n")).alias("id"), "image_id", (F.col("place") + 1).cast("long").alias("category_id"), F.array(*(F.round(v, 2) for v in (F.col("x1"), F.col("y1"), w, h))).alias("bbox"), F.round(w * h, 2).alias("area"))
    boxes = boxes.select("part", box.alias("a")).groupBy("part").agg(F.collect_list("a").alias("annotations"))
    kinds = data.categories.agg(F.sort_array(F.collect_list(F.struct((F.col("place") + 1).cast("long").alias("id"), F.col("category").alias("name")))).alias("categories"))
    whole = images.join(boxes, "part", "left").crossJoin(F.broadcast(kinds))
    return whole.select("part", F.to_json(F.struct("images", F.coalesce("annotations", F.array()).alias("annotations"), "categories")).alias("value"))


VOC = """struct<filename:string,size:struct<width:int,height:int>,object:array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>"""


def to_voc(data: Dataset, folder: str = "images") -> DataFrame:
    """(image_id, value): one XML text an image, corners rounded to whole pixels, what nobody knows as its usual value."""
    corner = F.struct(*(F.rint(c).cast("int").alias(n) for c, n in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))))
    objects = data.annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("category").alias("name"), F.lit("Unspecified").alias("pose"), F.lit(0).alias("truncated"), F.lit(0).alias("difficult"), corner.alias("bndbox")))).alias("object"))
    both = data.images.join(objects, "image_id", "left")
    where = F.concat(F.lit(f"{folder}/"), "file_name")
    body = F.struct(F.lit(folder).alias("folder"), F.col("file_name").alias("filename"), where.alias("path"), F.struct("width", "height", F.lit(3).alias("depth")).alias("size"), F.lit(0).alias("segmented"), "object")
    return both.select("image_id", F.to_xml(body, {"rowTag": "annotation"}).alias("value"))


def voc_tables(text: DataFrame, column: str = "value", names: list[str] | None = None) -> Dataset:
    """XML texts of one image each; boxes without area are dropped, as are labels other than ``names``.

    A missing size is 0, a missing file name ``<image_id>.jpg``; without ``names``
    the categories are numbered as they are first seen.
    """
    doc = text.select("image_id", F.from_xml(column, VOC, {"rowTag": "annotation"}).alias("d"))
    file_name = F.coalesce("d.filename", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    images = doc.select("image_id", file_name.alias("file_name"), F.coalesce("d.size.width", F.lit(0)).alias("width"), F.coalesce("d.size.height", F.lit(0)).alias("height"))
    found = doc.select("image_id", F.posexplode("d.object").alias("at", "o"))
    boxes = found.select("image_id", "at", F.col("o.name").alias("category"), F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"))
    kinds = _named(boxes, names)
    return Dataset(images, _within(boxes, names).drop("at"), kinds)


def _named(boxes: DataFrame, names: list[str] | None) -> DataFrame:
    if names is None:
        return first_seen(boxes, ["image_id", "at"])
    return boxes.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "category string, place int")


def _within(boxes: DataFrame, names: list[str] | None) -> DataFrame:
    boxes = boxes.where("x2 > x1 and y2 > y1")
    return boxes if names is None else boxes.where(F.col("category").isin(*names))


CVAT = "struct<_name:string,_width:int,_height:int,box:array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<struct<_name:string,_VALUE:string>>>>>"


def cvat_tables(text: DataFrame, column: str = "value", names: list[str] | None = None) -> Dataset:
    """XML ``image`` elements with boxes and attributes; boxes without area and labels other than ``names`` are dropped."""
    doc = text.select("image_id", F.from_xml(column, CVAT, {"rowTag": "image"}).alias("d"))
    images = doc.select("image_id", F.col("d._name").alias("file_name"), F.col("d._width").alias("width"), F.col("d._height").alias("height"))
    boxes = doc.select("image_id", F.posexplode("d.box").alias("at", "b"))
    attributes = F.map_from_entries(F.transform("b.attribute", lambda a: F.struct(a["_name"], a["_VALUE"])))
    rows = boxes.select("image_id", "at", F.col("b._label").alias("category"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"), attributes.alias("attributes"))
    return Dataset(images, _within(rows, names).drop("at"), _named(rows, names))


def label_report(files: DataFrame, images: DataFrame) -> DataFrame:
    """One row of what a validator counts over label files (stem, value): files, empty ones, files without an image, lines that do not parse, boxes out of range, files without any fault.

    ``images`` are paths (path, size) of image files, whatever their folders are.
    """
    there = of_kind(images, IMAGE_SUFFIXES).select("stem", F.lit(True).alias("found")).distinct()
    lines = F.filter(F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), r"\r?\n"), lambda v: F.length(v) > 0)
    number = lambda v, k: F.try_element_at(F.split(F.trim(v), r"\s+"), F.lit(k)).try_cast("double")
    broken = lambda v: F.exists(F.array(*(number(v, k) for k in range(2, 6))), lambda x: x.isNull())
    inside = lambda v: number(v, 2).between(0, 1) & number(v, 3).between(0, 1) & (number(v, 4) > 0) & (number(v, 4) <= 1) & (number(v, 5) > 0) & (number(v, 5) <= 1)
    told = files.select("stem", lines.alias("lines")).join(there, "stem", "left")
    told = told.select(F.coalesce("found", F.lit(False)).alias("found"), F.size("lines").alias("n"), F.size(F.filter("lines", broken)).alias("invalid"), F.size(F.filter("lines", lambda v: ~broken(v) & ~inside(v))).alias("out"))
    fine = F.col("found") & (F.col("n") > 0) & (F.col("invalid") == 0) & (F.col("out") == 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return told.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("n") == 0).alias("empty_files"), F.count_if(~F.col("found")).alias("missing_images"),
        total("invalid").alias("invalid_lines"), total("out").alias("bbox_out_of_range"), F.count_if(fine).alias("ok_files"),
    )


FROM, TO = ("yolo", "coco", "cvat", "voc"), ("yolo", "coco", "voc")


def write(data: Dataset, path: str, kind: str) -> None:
    """Files under ``path`` as tools of that kind expect them.

    ``yolo``: a label file an image, empty without boxes, images without a size left
    out, and ``classes.txt``; ``voc``: an XML file an image; ``coco``: JSON files of some
    thousand images each. What a job that fails has written is not seen.
    """
    if kind == "yolo":
        sized = Dataset(data.images.where("width > 0 and height > 0"), data.annotations, data.categories)
        labels = yolo_labels(sized).select(F.concat("stem", F.lit(".txt")).alias("name"), F.col("value").alias("content"))
        names = data.categories.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category"))), lambda c: c["category"]), "\n").alias("content"))  # a list of class names
        rows = labels.unionByName(names.select(F.lit("classes.txt").alias("name"), "content"))
    elif kind == "voc":
        rows = to_voc(data).join(data.images, "image_id").select(F.concat(stem(F.col("file_name")), F.lit(".xml")).alias("name"), F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), "value").alias("content"))
    elif kind == "coco":
        rows = to_coco(data).select(F.format_string("annotations-%05d.json", "part").alias("name"), F.col("value").alias("content"))
    else:
        raise ValueError(f"one of {', '.join(TO)} can be written, not {kind}")
    write_files(rows, path)


def read(spark: SparkSession, path: str, kind: str, images: DataFrame | None = None, names: list[str] | None = None) -> Dataset:
    """The annotation files of that kind under ``path``.

    ``yolo`` needs the ``images`` with their sizes; its classes are ``names``, or those
    of ``classes.txt``, ids beyond them ``class_<id>``. Images of ``coco`` files are numbered by their ids, those of ``voc`` and ``cvat``
    files by file name; ``names`` are the labels that count there. Each file is opened
    once, whatever is then made of it.
    """
    if kind not in FROM:
        raise ValueError(f"one of {', '.join(FROM)} can be read, not {kind}")
    if kind == "yolo" and images is None:
        raise ValueError("label files say nothing of their images")
    files = cut(read_files(spark, path))
    if kind == "yolo":
        lines = files.where("name like '%.txt' and name not like '%classes.txt'").select(stem(F.col("name")).alias("stem"), F.explode(F.split("content", r"\r?\n")).alias("value"))
        listed = files.where("name like '%classes.txt'").select(F.col("content").alias("value")) if names is None else spark.createDataFrame([("\n".join(names),)], "value string")
        used = lines.select(F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("long").alias("place")).where("place is not null")
        return parse_yolo(lines, images, class_names(listed, used))
    if kind == "coco":
        return renumbered(coco_tables(files.where("name like '%.json'"), "content"))
    if kind == "voc":
        return voc_tables(_numbered(files.where("name like '%.xml'"), "name"), "content", names)
    images_ = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(<image\b(?:[^>]*/>|.*?</image>))"), 1)).alias("content")
    found = files.where("name like '%.xml'").select("name", images_).withColumn("file", F.regexp_extract("content", r'\bname="([^"]*)"', 1))
    return cvat_tables(_numbered(found, "file"), "content", names)


def _numbered(files: DataFrame, order: str) -> DataFrame:
    return numbered(files, [order], "image_id")


def convert(spark: SparkSession, source: str, target: str, from_kind: str, to_kind: str, images: DataFrame | None = None, names: list[str] | None = None) -> Dataset:
    """Annotation files of any of four kinds as files of any of three; returns what was read."""
    if from_kind not in FROM or to_kind not in TO:
        raise ValueError(f"from {', '.join(FROM)} to {', '.join(TO)}, not from {from_kind} to {to_kind}")
    data = read(spark, source, from_kind, images, names)
    write(data, target, to_kind)
    return data


def renumbered(data: Dataset) -> Dataset:
    """The images numbered from 0 in the order of their ids, the boxes along with them; boxes without an image go."""
    numbers = numbered(data.images.select("image_id").distinct(), ["image_id"], "number_")
    other = lambda df: df.join(numbers, "image_id").withColumn("image_id", F.col("number_")).drop("number_").select(*df.columns)
    return Dataset(other(data.images), other(data.annotations), data.categories)


def dangling(annotations: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Annotations whose image is missing."""
    return annotations.join(images.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def statistics(data: Dataset) -> DataFrame:
    """Annotations by category, zeros kept, with their share."""
    counts = data.annotations.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    filled = data.categories.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a class


def report(data: Dataset) -> DataFrame:
    """One row of what a validator counts: images, boxes, images without boxes, boxes without image, boxes of unknown category, repeated image ids."""
    images, boxes = data.images.select("image_id"), data.annotations
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        count(images, "n_images"), count(boxes, "n_boxes"), count(dangling(images.distinct(), boxes), "empty_images"), count(dangling(boxes, images), "lost_boxes"),
        count(boxes.join(data.categories.select("category"), "category", "left_anti"), "unknown_categories"), count(duplicates(images, "image_id"), "repeated_images"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part)  # one row each
    return whole
