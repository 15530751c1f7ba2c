import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.session import shared_folder
from tallyframe.plans import annotation_queries
from tallyframe.sources import annotations, reports, text_files
from tallyframe.sources.text_files import read_files, write_files


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def there(path):
    base = path.removeprefix("file:")
    return sorted(os.path.relpath(os.path.join(d, f), base) for d, _, names in os.walk(base) for f in names)


def test_files_there_and_back(spark, folder):
    rows = [(f"v{k % 3}/labels/{k}.txt", f"text {k} é\n" if k % 4 else None) for k in range(40)] + [("classes.txt", "a\nb")]
    frame = spark.createDataFrame(rows, "name string, content string").repartition(5)
    write_files(frame, folder)
    assert there(folder) == sorted(n for n, _ in rows)
    assert sorted(map(tuple, read_files(spark, folder).collect())) == sorted((n, t or "") for n, t in rows)
    assert {r.name for r in read_files(spark, folder, ["v1", "v9"]).collect()} == {n for n, _ in rows if n.startswith("v1/")}
    write_files(frame.limit(1).select(F.lit("classes.txt").alias("name"), F.lit("c").alias("content")), folder)
    assert len(there(folder)) == 41 and read_files(spark, folder).where("name = 'classes.txt'").first().content == "c"
    write_files(frame.where("name = 'classes.txt'"), folder, overwrite=True)
    assert there(folder) == ["classes.txt"]
    write_files(frame.limit(0), folder)
    assert read_files(spark, folder).count() == 1


def test_a_job_that_fails_leaves_no_file(spark, folder):
    frame = spark.range(30).repartition(3).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="lost"):
        write_files(frame, folder)
    assert there(folder) == []
    for name in ("../x", "/x", "a//b", "", None, "_hidden"):
        with pytest.raises(Exception, match="no file name"):
            write_files(spark.createDataFrame([(name, "x")], "name string, content string"), folder)
    assert there(folder) == []


def small(spark):
    images = spark.createDataFrame([(1, "a.jpg", 100, 50), (2, "b.jpg", 100, 50), (3, "c.jpg", 0, 0)], "image_id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(1, "nut", 10.0, 5.0, 30.0, 25.0), (1, "screw", 0.0, 0.0, 100.0, 50.0)], "image_id long, category string, x1 double, y1 double, x2 double, y2 double")
    return annotations.Dataset(images, boxes, spark.createDataFrame([("screw", 0), ("nut", 1)], "category string, place int"))


def test_label_files_as_tools_expect_them(spark, folder):
    data = small(spark)
    annotations.write(data, folder, "yolo")
    assert {r.name: r.content for r in read_files(spark, folder).collect()} == {
        "a.txt": "0 0.500000 0.500000 1.000000 1.000000\n1 0.200000 0.300000 0.200000 0.400000", "b.txt": "", "classes.txt": "screw\nnut",
    }
    back = annotations.read(spark, folder, "yolo", data.images)
    assert sorted((r.category, r.x1, r.y2) for r in back.annotations.collect()) == [("nut", 10.0, 25.0), ("screw", 0.0, 50.0)]
    named = annotations.read(spark, folder, "yolo", data.images, ["bolt"])
    assert {r.category for r in named.annotations.collect()} == {"bolt", "class_1"}


def test_xml_files_and_wrong_kinds(spark, folder):
    data = small(spark)
    annotations.write(data, folder, "voc")
    text = {r.name: r.content for r in read_files(spark, folder).collect()}
    assert sorted(text) == ["a.xml", "b.xml", "c.xml"] and all(t in text["a.xml"] for t in ("<?xml", "<folder>images</folder>", "<path>images/a.jpg</path>", "<depth>3</depth>", "<pose>Unspecified</pose>"))
    back = annotations.read(spark, folder, "voc")
    assert sorted(r.file_name for r in back.images.collect()) == ["a.jpg", "b.jpg", "c.jpg"] and back.annotations.count() == 2
    cvat = folder + "-cvat"
    write_files(spark.createDataFrame([("x.xml", '<annotations><image id="0" name="e.jpg" width="9" height="9"/><image id="1" name="d.jpg" width="9" height="9"><box label="nut" xtl="1" ytl="1" xbr="2" ybr="2"></box></image></annotations>')], "name string, content string"), cvat)
    found = annotations.read(spark, cvat, "cvat", names=["nut"])
    assert [(r.image_id, r.file_name) for r in found.images.orderBy("image_id").collect()] == [(0, "d.jpg"), (1, "e.jpg")]
    assert [r.image_id for r in found.annotations.collect()] == [0]
    for wrong in (lambda: annotations.write(data, folder, "cvat"), lambda: annotations.read(spark, folder, "odd"), lambda: annotations.read(spark, folder, "yolo"), lambda: annotations.convert(spark, folder, folder, "voc", "cvat")):
        with pytest.raises(ValueError):
            wrong()


def test_time_file(spark, folder):
    reports.save_time(spark, 12.34567, folder)
    assert read_files(spark, folder).first().content == "12.3457\n" and reports.load_time(spark, folder) == 12.3457
    reports.save_time(spark, -3, folder)
    assert reports.load_time(spark, folder) == 0.0
    with pytest.raises(Exception):
        reports.load_time(spark, folder + "-none")


def test_the_driver_hands_on_folders_and_holds_no_list_of_files(spark, folder, monkeypatch):
    frame = spark.range(300).select(F.concat(F.lit("v"), F.col("id") % 3, F.lit("/"), "id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("content"))
    moved = []
    for each in (8, 1024):
        monkeypatch.setattr(text_files, "FILES_EACH", each)
        monkeypatch.setattr(text_files, "FEW", 0)
        monkeypatch.setattr(text_files, "MOST_PARTITIONS", 5)
        writer = text_files._Writer(folder, False, f"job{each}")
        told = writer.write(iter(frame.toArrow().to_batches(max_chunksize=70)))
        writer.commit([told, None])
        moved.append((told.parts, len(there(folder)) - 301))  # the commit leaves them where they are
        writer.abort([told])
        assert there(folder) == []
    assert moved == [(38, 0), (1, 0)]
    driver, empty = os.getpid(), text_files._emptied
    monkeypatch.setattr(text_files, "_emptied", lambda *a: pytest.fail("by the driver") if os.getpid() == driver else empty(*a))
    write_files(frame.repartition(3), folder)
    assert len(there(folder)) == 300
    reader = text_files._Reader(folder, [])
    monkeypatch.setattr(text_files, "FILES_EACH", 8)
    parts = reader.partitions()
    assert len(parts) == 5 and all(isinstance(n, bytes) for p in parts for n in p.names)
    assert sorted(n for p in parts for n, _ in reader.read(p)) == there(folder)
    twice = text_files._Reader(folder, ["v1", "v1", "none"])
    assert sorted(n for p in twice.partitions() for n, _ in twice.read(p)) == [n for n in there(folder) if n.startswith("v1/")]


def test_a_task_that_still_writes_does_not_bring_a_dropped_job_back(spark, folder):
    writer = text_files._Writer(folder, False, None)

    def rows():
        for k in range(3):
            if k == 1:
                writer.abort([])
            yield pa.RecordBatch.from_pydict({"name": [f"a/{k}.txt"], "content": ["x"]})

    with pytest.raises(OSError):
        writer.write(rows())
    with pytest.raises(OSError):
        writer.write(rows())
    assert there(folder) == []
    again = text_files._Writer(folder, True, None)
    again.commit([again.write(iter([pa.RecordBatch.from_pydict({"name": ["a/b/1.txt"], "content": [None]})]))])
    assert there(folder) == ["a/b/1.txt"]


def test_files_of_a_job_go_when_they_are_read(spark, folder, sf_dir, monkeypatch):
    frame = spark.range(60).select(F.concat(F.lit("v"), F.col("id") % 3, F.lit("/"), "id", F.lit(".txt")).alias("name"), F.lit("x").alias("content"))
    monkeypatch.setattr(text_files, "FILES_EACH", 8)
    driver, delete = os.getpid(), text_files._deleted
    monkeypatch.setattr(text_files, "_deleted", lambda *a: pytest.fail("by the driver") if os.getpid() == driver else delete(*a))
    write_files(frame, folder)
    text_files.remove_files(spark, folder)
    assert not os.path.exists(folder)
    monkeypatch.setattr(annotation_queries, "_folder", lambda _: f"{folder}/{uuid.uuid4().hex}")
    found = annotation_queries.convert_from_yolo(spark, sf_dir)
    assert there(folder) == [] and found.groupBy("target").count().count() == 3
