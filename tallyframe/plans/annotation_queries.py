"""Queries over annotation sets: documents as images, labels as annotations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.session import numbered, shared_folder
from ..sources import annotations as a
from ..sources.text_files import remove_files, write_files
from .fixtures import table
from .named import book

QUERIES, ORACLE, query = book()


def dataset(spark, sf_dir) -> a.Dataset:
    """Each document an image, each label a box in it; the category from its two marks."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    images = docs.select(F.col("doc_id").alias("image_id"), F.concat(F.lit("img"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    x, y = (F.col("doc_id") % 300).cast("double"), (F.col("doc_id") % 200).cast("double")
    boxes = labels.select(F.col("doc_id").alias("image_id"), name.alias("category"), x.alias("x1"), y.alias("y1"), (x + 64).alias("x2"), (y + 48).alias("y2"))
    kinds = spark.createDataFrame([("q0t0", 0), ("q0t1", 1), ("q1t0", 2), ("q1t1", 3)], "category string, place int")
    return a.Dataset(images, boxes, kinds)


BOXES = """SELECT doc_id AS image_id, 'q' || quality || 't' || toxic AS category, (doc_id % 300)::DOUBLE AS x1, (doc_id % 200)::DOUBLE AS y1,
(doc_id % 300 + 64)::DOUBLE AS x2, (doc_id % 200 + 48)::DOUBLE AS y2 FROM labels"""


def _boxes(data: a.Dataset):
    return data.annotations.select("image_id", "category", *(F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("SELECT d.doc_id AS image_id, count(l.doc_id) AS n_annotations FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def images_left_annotations(spark, sf_dir):
    data = dataset(spark, sf_dir)
    counts = data.annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return data.images.join(counts, "image_id", "left").groupBy("image_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_annotations"))


@query(f"SELECT -1::BIGINT AS image_id, 'q0t0' AS category")
def dangling_annotations(spark, sf_dir):
    data = dataset(spark, sf_dir)
    lost = spark.createDataFrame([(-1, "q0t0", 0.0, 0.0, 1.0, 1.0)], data.annotations.schema)
    return a.dangling(data.annotations.unionByName(lost), data.images).select("image_id", "category")


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def images_without_annotations(spark, sf_dir):
    data = dataset(spark, sf_dir)
    return a.dangling(data.images, data.annotations).select("image_id")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return a.duplicates(table(spark, sf_dir, "conversations"), "conv_id")


@query(f"""WITH b AS ({BOXES}), k AS (SELECT * FROM (VALUES ('q0t0'), ('q0t1'), ('q1t0'), ('q1t1')) t(category))
SELECT category, count(b.image_id) AS n, round(count(b.image_id) / sum(count(b.image_id)) OVER (), 6) AS share FROM k LEFT JOIN b USING (category) GROUP BY category""")
def annotation_statistics(spark, sf_dir):
    return a.statistics(dataset(spark, sf_dir))


def _folder(spark) -> str:
    from ..streaming.stateful import _shared

    return _shared(spark)


@query(BOXES)
def yolo_roundtrip(spark, sf_dir):
    data, where = dataset(spark, sf_dir), _folder(spark)
    a.write_yolo(data, where)
    return _boxes(a.read_yolo_table(spark, where, data.images, data.categories)).select("image_id", "category", *(F.rint(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


#: Label lines, some of them not to be read: too short, out of range, not a number, or of no image.
YOLO_LINES = ("{k} 0.5 0.25 0.125 0.5 0.75", "{k} 0.5 0.25 0.125 0.5", "9 0 1 1 0.25 high", "1 0.5 0.5 0.5", "1 1.5 0.5 0.5 0.5", "1 0.5 0.5 0 0.5", "1 0.5 0.5 0.5 1.01", "x 0.5 0.5 nan? 0.5", "")


@query("""WITH i AS (SELECT doc_id AS image_id, doc_id % 4 AS k FROM documents)
SELECT image_id, CASE k WHEN 0 THEN 'q0t0' WHEN 1 THEN 'q0t1' WHEN 2 THEN 'q1t0' ELSE 'q1t1' END AS category, 280.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, 360.0::DOUBLE AS x2, 240.0::DOUBLE AS y2, unnest([0.75, 1.0])::DOUBLE AS confidence FROM i
UNION ALL SELECT image_id, 'class_9', -320.0, 420.0, 320.0, 540.0, 1.0 FROM i""")
def yolo_scan(spark, sf_dir):
    data = dataset(spark, sf_dir)
    k = (F.col("image_id") % 4).cast("string")
    lines = F.array(*(F.replace(F.lit(line), F.lit("{k}"), k) for line in YOLO_LINES))
    rows = data.images.select(F.concat(F.lit("img"), F.col("image_id").cast("string")).alias("stem"), F.explode(lines).alias("value"))
    lost = spark.createDataFrame([("none", "0 0.5 0.5 0.5 0.5")], "stem string, value string")
    return a.parse_yolo(rows.unionByName(lost), data.images, data.categories).annotations


@query("""SELECT doc_id AS image_id, 'img' || doc_id AS stem, CASE WHEN l.n > 0 THEN l.n ELSE 0 END AS n_lines FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)""")
def yolo_label_texts(spark, sf_dir):
    """Every image has a label text, an empty one without boxes."""
    found = a.yolo_labels(dataset(spark, sf_dir))
    lines = F.when(F.col("value") == "", 0).otherwise(F.size(F.split("value", "\n"))).cast("long")
    return found.select(F.regexp_extract("stem", r"(\d+)$", 1).cast("long").alias("image_id"), "stem", lines.alias("n_lines"))


@query("SELECT 'img' || doc_id AS stem, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'both' ELSE 'image' END AS found FROM documents UNION ALL SELECT 'other', 'label'")
def labels_by_stem(spark, sf_dir):
    """Images and labels brought together by file stem, in both directions."""
    data = dataset(spark, sf_dir)
    images = data.images.select(a.stem(F.col("file_name")).alias("stem"))
    labels = data.annotations.select(F.concat(F.lit("img"), F.col("image_id").cast("string")).alias("stem")).distinct().unionByName(spark.createDataFrame([("other",)], "stem string"))
    both = images.join(labels.select("stem"), "stem", "left_semi").select("stem", F.lit("both").alias("found"))
    return both.unionByName(a.dangling(images, labels, "stem").select("stem", F.lit("image").alias("found"))).unionByName(a.dangling(labels, images, "stem").select("stem", F.lit("label").alias("found")))


@query("""SELECT (SELECT count(*) FROM documents) + 1 AS n_images, (SELECT count(*) FROM labels) + 2 AS n_boxes, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS empty_images,
1::BIGINT AS lost_boxes, 2::BIGINT AS unknown_categories, 1::BIGINT AS repeated_images""")
def validation_report(spark, sf_dir):
    data = dataset(spark, sf_dir)
    first = data.annotations.agg(F.min("image_id").alias("image_id"))
    more = first.select("image_id", F.lit("odd").alias("category"), *(F.lit(v).alias(c) for v, c in ((0.0, "x1"), (0.0, "y1"), (1.0, "x2"), (1.0, "y2"))))
    boxes = data.annotations.unionByName(more).unionByName(more.withColumn("image_id", F.lit(-1).cast("long")))
    return a.report(a.Dataset(data.images.unionByName(data.images.join(first, "image_id", "left_semi")), boxes, data.categories))


DIRTY = "SELECT doc_id AS image_id, unnest(['screw', 'nut']) AS category, unnest([1, 3])::DOUBLE AS x1, unnest([2, 4])::DOUBLE AS y1, unnest([11, 13])::DOUBLE AS x2, unnest([22, 24])::DOUBLE AS y2, unnest([0, 1]) AS place FROM documents"


@query(DIRTY)
def coco_dirty(spark, sf_dir):
    """Boxes of unknown categories and without width or height are dropped; categories are numbered in the order of their ids."""
    box = lambda k, c, w=10.0: F.struct(F.lit(k).alias("id"), F.col("doc_id").alias("image_id"), F.lit(c).alias("category_id"), F.array(F.lit(2.0 * c / 5 - 1), F.lit(2.0 * c / 5), F.lit(w), F.lit(20.0)).alias("bbox"), F.lit(w * 20).alias("area"))
    boxes = F.array(box(1, 5), box(2, 10), box(3, 7), box(4, 5, 0.0))
    kinds = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in ((10, "nut"), (5, "screw"))))
    image = F.struct(F.col("doc_id").alias("id"), F.lit("x.jpg").alias("file_name"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    text = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(image).alias("images"), boxes.alias("annotations"), kinds.alias("categories"))).alias("value"))
    data = a.coco_tables(text)
    return data.annotations.join(data.categories, "category").select("image_id", "category", "x1", "y1", "x2", "y2", "place")


@query(DIRTY)
def cvat_dirty(spark, sf_dir):
    box = lambda label, x, y, w=10: f'<box label="{label}" xtl="{x}" ytl="{y}" xbr="{x + w}" ybr="{y + 20}"><attribute name="k">v</attribute><attribute name="l">w</attribute></box>'
    body = box("screw", 1, 2) + box("odd", 1, 2) + box("nut", 3, 4) + box("nut", 3, 4, 0)
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.concat(F.lit('<image id="0" name="x" width="64" height="48">'), F.lit(body), F.lit("</image>")).alias("value"))
    data = a.cvat_tables(text, names=["screw", "nut"])
    return data.annotations.join(data.categories, "category").select("image_id", "category", "x1", "y1", "x2", "y2", "place")


@query(DIRTY.replace("FROM documents", ", doc_id || '.jpg' AS file_name, 0 AS width FROM documents"))
def voc_dirty(spark, sf_dir):
    """Also a missing size and a missing file name."""
    box = lambda label, x, y, w=10: f"<object><name>{label}</name><bndbox><xmin>{x}</xmin><ymin>{y}</ymin><xmax>{x + w}</xmax><ymax>{y + 20}</ymax></bndbox></object>"
    body = "<annotation>" + box("screw", 1, 2) + box("odd", 1, 2) + box("nut", 3, 4) + box("nut", 3, 4, 0) + "</annotation>"
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(body).alias("value"))
    data = a.voc_tables(text, names=["screw", "nut"])
    return data.annotations.join(data.categories, "category").join(data.images, "image_id").select("image_id", "category", "x1", "y1", "x2", "y2", "place", "file_name", "width")


@query(BOXES)
def coco_roundtrip(spark, sf_dir):
    return _boxes(a.coco_tables(a.to_coco(dataset(spark, sf_dir))))


PLACED = f"""WITH b AS ({BOXES}), p AS (SELECT category, row_number() OVER (ORDER BY min(image_id)) - 1 AS place FROM b GROUP BY category) SELECT b.*, place FROM b JOIN p USING (category)"""


@query(BOXES)
def coco_to_yolo(spark, sf_dir):
    data = a.coco_tables(a.to_coco(dataset(spark, sf_dir)))
    lines = a.yolo_labels(data).select("stem", F.explode(F.split("value", "\n")).alias("value"))
    return _boxes(a.parse_yolo(lines, data.images, data.categories)).select("image_id", "category", *(F.rint(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(BOXES)
def voc_to_coco(spark, sf_dir):
    return _boxes(a.coco_tables(a.to_coco(a.voc_tables(a.to_voc(dataset(spark, sf_dir))))))


@query("SELECT doc_id AS image_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents")
def image_numbers(spark, sf_dir):
    """Images numbered densely over the whole set."""
    return numbered(dataset(spark, sf_dir).images.select("image_id"), ["image_id"])


@query(PLACED)
def voc_roundtrip(spark, sf_dir):
    data = a.voc_tables(a.to_voc(dataset(spark, sf_dir)))
    return _boxes(data).join(data.categories, "category")


@query(BOXES)
def coco_to_voc(spark, sf_dir):
    return _boxes(a.voc_tables(a.to_voc(a.coco_tables(a.to_coco(dataset(spark, sf_dir))))))


@query(PLACED.replace("SELECT b.*,", "SELECT b.*, 'none' AS occluded,"))
def cvat_scan(spark, sf_dir):
    data = dataset(spark, sf_dir)
    box = F.format_string('<image id="%d" name="%s" width="640" height="480"><box label="%s" xtl="%.2f" ytl="%.2f" xbr="%.2f" ybr="%.2f"><attribute name="occluded">none</attribute><attribute name="k">v</attribute></box></image>', "image_id", "file_name", "category", "x1", "y1", "x2", "y2")
    text = data.annotations.join(data.images, "image_id").select("image_id", box.alias("value"))
    found = a.cvat_tables(text)
    return found.annotations.join(found.categories, "category").select("image_id", "category", "x1", "y1", "x2", "y2", F.col("attributes")["occluded"].alias("occluded"), "place")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _cvat_files(data: a.Dataset, path: str) -> None:
    """XML files of some images each, as the labelling tool exports them."""
    box = F.format_string('<box label="%s" xtl="%.2f" ytl="%.2f" xbr="%.2f" ybr="%.2f"></box>', "category", "x1", "y1", "x2", "y2")
    boxes = data.annotations.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(box)), "\n").alias("boxes"))
    image = F.format_string('<image id="%d" name="%s" width="%d" height="%d">%s</image>', "image_id", "file_name", "width", "height", F.coalesce("boxes", F.lit("")))
    parts = max(1, data.images.count() // 100)
    texts = data.images.join(boxes, "image_id", "left").select(F.pmod("image_id", F.lit(parts)).alias("part"), image.alias("value")).groupBy("part").agg(F.array_join(F.collect_list("value"), "\n").alias("content"))
    write_files(texts.select(F.format_string("cvat-%d.xml", "part").alias("name"), F.concat(F.lit("<annotations>"), "content", F.lit("</annotations>")).alias("content")), path)


def _converted(spark, sf_dir, kind: str):
    """The set as files of one kind, converted to each of three, and read back from there; what was read is kept elsewhere, so files go when they are no more needed."""
    data, names = dataset(spark, sf_dir), ["q0t0", "q0t1", "q1t0", "q1t1"]
    source, found = _folder(spark), None
    if kind == "cvat":
        _cvat_files(data, source)
    else:
        a.write(data, source, kind)
    for to in a.TO:
        target = _folder(spark)
        a.convert(spark, source, target, kind, to, data.images, None if kind == "yolo" else names)
        if to == a.TO[-1]:
            remove_files(spark, source)
        back = a.read(spark, target, to, data.images)
        remove_files(spark, target)
        rows = back.annotations.join(back.images, "image_id").select(F.lit(to).alias("target"), "file_name", "category", *(F.rint(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
        found = rows if found is None else found.unionByName(rows)
    return found


_TARGETS = f"SELECT target, 'img' || image_id || '.jpg' AS file_name, category, x1, y1, x2, y2 FROM ({BOXES}), (VALUES ('yolo'), ('coco'), ('voc')) t(target)"


@query(_TARGETS)
def convert_from_yolo(spark, sf_dir):
    return _converted(spark, sf_dir, "yolo")


@query(_TARGETS)
def convert_from_coco(spark, sf_dir):
    return _converted(spark, sf_dir, "coco")


@query(_TARGETS)
def convert_from_cvat(spark, sf_dir):
    return _converted(spark, sf_dir, "cvat")


@query(_TARGETS)
def convert_from_voc(spark, sf_dir):
    return _converted(spark, sf_dir, "voc")


@query("""WITH f AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 7 <> 0 AS found FROM documents)
SELECT count(*) AS total_files, count(*) FILTER (WHERE k = 0) AS empty_files, count(*) FILTER (WHERE NOT found) AS missing_images, (2 * count(*) FILTER (WHERE k = 1))::BIGINT AS invalid_lines,
(count(*) FILTER (WHERE k = 2))::BIGINT AS bbox_out_of_range, count(*) FILTER (WHERE k > 2 AND found) AS ok_files FROM f""")
def label_folder_report(spark, sf_dir):
    """Label files of all documents, some of them empty, unreadable, out of range, or without an image."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    good = F.format_string("%d 0.5 0.5 0.25 0.%d", F.col("k") % 4, F.col("k") % 9 + 1)
    text = F.when(F.col("k") % 5 == 0, " \n").when(F.col("k") % 5 == 1, F.concat(good, F.lit("\n0 0.5 0.5\n1 0.5 x 0.1 0.1"))).when(F.col("k") % 5 == 2, F.concat(good, F.lit("\n0 1.5 0.5 0.1 0.1"))).otherwise(good)
    files = docs.select(F.concat(F.lit("img"), F.col("k").cast("string")).alias("stem"), text.alias("value"))
    kind = F.when(F.col("k") % 2 == 0, ".JPG").otherwise(".png")
    images = docs.where("k % 7 <> 0").select(F.concat(F.lit("a/b/img"), F.col("k").cast("string"), kind).alias("path"), F.lit(1).cast("long").alias("size"))
    return a.label_report(files, images.unionByName(docs.select(F.concat(F.lit("a/img"), F.col("k").cast("string"), F.lit(".txt")).alias("path"), F.lit(1).cast("long").alias("size"))))


@query(f"""WITH n AS (SELECT doc_id AS image_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents)
SELECT number AS image_id, category, x1, y1, x2, y2 FROM ({BOXES}) b JOIN n USING (image_id)""")
def coco_renumbered(spark, sf_dir):
    """COCO documents written, read and numbered anew over all of them."""
    return _boxes(a.renumbered(a.coco_tables(a.to_coco(dataset(spark, sf_dir), each=300))))
