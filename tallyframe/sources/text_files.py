"""Small text files, one a row, as a Spark data source: what other tools expect to find in a folder.

``write_files`` takes rows (name, content) and writes a file each, from many tasks. A
task writes into a folder of its attempt that readers do not see, some files a
sub-folder; when all tasks are done the sub-folders of the attempts that counted are
emptied to their places, by tasks again, so a job that fails, or a task that is lost
or runs twice, leaves no file behind. ``read_files`` reads them back, only those under
given sub-folders if wanted, many a partition. The driver hands on folders when it
writes and compressed names when it reads, a few bytes a file, and holds no list of files.

Files are reached through Arrow's file systems, so the folder may lie wherever driver
and executors both reach it. A name may have folders in it, but not lead outside.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Files that one sub-folder of an attempt holds, and one partition reads unless there were more than ``MOST_PARTITIONS``.
FILES_EACH, MOST_PARTITIONS = 1024, 1024
#: Sub-folders up to which no job is started to empty them.
FEW = 4
_HIDDEN, _DONE = "_attempt-", "_done"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return system, base.rstrip("/")


def _entries(system: fs.FileSystem, folder: str, missing: bool) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies in a folder; of a local one nothing is held."""
    if not isinstance(system, fs.LocalFileSystem):
        for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=missing)):
            if found.type in (fs.FileType.File, fs.FileType.Directory):
                yield found.base_name, found.type == fs.FileType.Directory
        return
    try:
        with os.scandir(folder or "/") as found:
            yield from ((f.name, f.is_dir()) for f in found if f.is_dir() or f.is_file())
    except FileNotFoundError:
        if not missing:
            raise


def _names(system: fs.FileSystem, base: str, under: list[str]) -> Iterator[str]:
    """The names of the files, in no order; what attempts have written is not seen."""
    folders = {u.strip("/") for u in under} or {""}
    todo = [f for f in folders if not any(f.startswith(f"{other}/") for other in folders)]
    while todo:
        folder = todo.pop()
        for name, inner in _entries(system, f"{base}/{folder}".rstrip("/"), bool(folder)):
            name = f"{folder}/{name}" if folder else name
            if name.startswith(_HIDDEN):
                continue
            if inner:
                todo.append(name)
            else:
                yield name


def _packed(names: Iterator[str]) -> Iterator[bytes]:
    """Names, many compressed into one text."""
    while held := list(itertools.islice(names, FILES_EACH)):
        yield zlib.compress("\0".join(held).encode(), 1)


def _unpacked(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\0")


def _emptied(path: str, folder: str) -> None:
    """The files in a sub-folder of an attempt go to their places; those that another run of the task has moved are there."""
    system, base = _opened(path)
    found = system.get_file_info(fs.FileSelector(f"{base}/{folder}", recursive=True, allow_not_found=True))
    moves = [(f.path, f"{base}/{f.path[len(base) + len(folder) + 2 :]}") for f in found if f.type == fs.FileType.File]
    for inner in {to.rpartition("/")[0] for _, to in moves}:
        system.create_dir(inner, recursive=True)

    def move(pair: tuple[str, str]) -> None:
        try:
            system.move(*pair)
        except FileNotFoundError:
            if system.get_file_info(pair[1]).type != fs.FileType.File:
                raise

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(move, moves))


def _cleared(path: str) -> None:
    """Old files and folders go, but for what attempts have written."""
    system, base = _opened(path)
    for name, inner in _entries(system, base, True):
        if not name.startswith(_HIDDEN):
            (system.delete_dir if inner else system.delete_file)(f"{base}/{name}")


def _dropped(path: str, job: str, tries: int = 100) -> None:
    """The folder of a job goes; a task that still writes into it cannot make it anew."""
    system, base = _opened(path)
    for k in range(tries):
        try:
            if system.get_file_info(f"{base}/{_HIDDEN}{job}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{_HIDDEN}{job}")
            return
        except OSError:  # a file has come meanwhile
            if k + 1 == tries:
                raise
            time.sleep(0.1)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    parts: int


class _Writer(DataSourceArrowWriter):
    """With the name of a job the commit only says which sub-folders count, without one it empties them itself."""

    def __init__(self, path: str, overwrite: bool, job: str | None):
        self.path, self.overwrite, self.job, self.later = path, overwrite, job or uuid.uuid4().hex, job is not None
        system, base = _opened(path)
        system.create_dir(f"{base}/{_HIDDEN}{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _opened(self.path)
        folder = f"{_HIDDEN}{self.job}/{uuid.uuid4().hex}"
        system.create_dir(f"{base}/{folder}", recursive=False)
        count, made = 0, set()
        for batch in iterator:
            names, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "content"))
            for name, text in zip(names, texts):
                parts = (name or "").split("/")
                if not all(parts) or {".", ".."} & set(parts) or parts[0].startswith("_"):
                    raise ValueError(f"no file name: {name!r}")
                if count % FILES_EACH == 0:
                    made, part = set(), f"{base}/{folder}/{count // FILES_EACH}"
                for k in range(len(parts)):
                    if (inner := "/".join([part, *parts[:k]])) not in made:
                        system.create_dir(inner, recursive=False)
                        made.add(inner)
                with system.open_output_stream(f"{part}/{name}", compression=None) as out:
                    out.write((text or "").encode())
                count += 1
        return Written(folder, math.ceil(count / FILES_EACH))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _opened(self.path)
        folders = [f"{m.folder}/{k}" for m in messages if m for k in range(m.parts)]
        if self.later:
            with system.open_output_stream(f"{base}/{_HIDDEN}{self.job}/{_DONE}", compression=None) as out:
                out.write("\n".join(folders).encode())
            return
        if self.overwrite:
            _cleared(self.path)
        for folder in folders:
            _emptied(self.path, folder)
        _dropped(self.path, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        _dropped(self.path, self.job)


@dataclass
class _Files(InputPartition):
    names: list[bytes]


class _Reader(DataSourceReader):
    def __init__(self, path: str, under: list[str]):
        self.path, self.under = path, under

    def partitions(self) -> list[_Files]:
        packed = list(_packed(_names(*_opened(self.path), self.under)))
        each = max(1, math.ceil(len(packed) / MOST_PARTITIONS))
        return [_Files(packed[k : k + each]) for k in range(0, len(packed), each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, str]]:
        system, base = _opened(self.path)
        for packed in partition.names:
            for name in _unpacked(packed):
                with system.open_input_stream(f"{base}/{name}", compression=None) as text:
                    yield name, text.read().decode("utf-8", "replace")


class TextFiles(DataSource):
    """Options: ``path``; reading: ``under``, sub-folders with commas between them, nothing else being opened or listed; writing: ``job``, which leaves the last step to :func:`write_files`."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], [u for u in self.options.get("under", "").split(",") if u])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, self.options.get("job"))


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file a row (name, content) under ``path``; a file that is there is replaced, the others stay unless ``overwrite`` says so."""
    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(TextFiles)
    try:
        rows.select("name", "content").write.format("text_files").option("job", job).mode("append").save(path)
        system, base = _opened(path)
        with system.open_input_stream(f"{base}/{_HIDDEN}{job}/{_DONE}", compression=None) as done:
            folders = done.read().decode().split()
        if overwrite:
            _cleared(path)
        if len(folders) <= FEW:
            for folder in folders:
                _emptied(path, folder)
        else:
            _by_tasks(spark, folders, "string", functools.partial(_emptied, path))
    finally:
        _dropped(path, job)


def _by_tasks(spark: SparkSession, things: list, kind: str, do: Callable) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for thing in batch.column("thing").to_pylist():
                do(thing)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    parts = max(1, min(len(things), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    spark.createDataFrame([(t,) for t in things], f"thing {kind}").repartition(parts).mapInArrow(run, "n int").agg(F.sum("n")).collect()  # one row


def _deleted(path: str, packed: bytes) -> None:
    """The files of these names go; those that another run of the task has deleted are gone."""
    system, base = _opened(path)
    for name in _unpacked(packed):
        try:
            system.delete_file(f"{base}/{name}")
        except FileNotFoundError:
            pass


def remove_files(spark: SparkSession, path: str) -> None:
    """A folder of such files goes with all that is in it, the files by tasks; for what a job has written for itself and read again."""
    system, base = _opened(path)
    packed = list(_packed(_names(system, base, [])))
    if len(packed) > FEW:
        _by_tasks(spark, packed, "binary", functools.partial(_deleted, path))
    system.delete_dir(base)


def read_files(spark: SparkSession, path: str, under: list[str] | None = None) -> DataFrame:
    """(name, content) of the files under ``path``, names from there on."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("text_files").option("under", ",".join(under or [])).load(path)
