"""WARC archives as a Spark data source: one gzip member a record, written by tasks, published by a commit.

``df.write.format("warc")`` takes rows (kind, record_id, fields, block) and writes
records in their order, a new archive beginning where one has reached
``archive_bytes``. A task names its archives after its attempt and reports them; only
the commit writes the list that makes them visible, so an attempt that failed, was
lost with its executor or ran twice leaves nothing that a reader sees.
``spark.read.format("warc")`` reads one archive a partition, a record at a time.

Files are reached through Arrow's file systems, so the folder may lie wherever
driver and executors both reach it.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "archive string, kind string, record_id string, fields map<string,string>, block binary"
#: Bytes of blocks that go to Spark at a time.
BATCH_BYTES = 4 << 20
_BATCH = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("record_id", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_COMMIT = "_committed-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_bytes(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in an archive. Line ends within a field's value would end the field, so they become spaces."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in named)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of an archive, read as far as its Content-Length says."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record must begin with its version, not with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length", -1))
        block = stream.read(length) if length >= 0 else b""
        if length < 0 or len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} ends before its length of {length} bytes")
        yield fields, block


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("archive_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        names, attempt, out, size = [], uuid.uuid4().hex, None, 0
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("kind", "record_id", "fields", "block")]
                for row in range(batch.num_rows):
                    if out is None:
                        names.append(f"{attempt}-{len(names):05d}.warc.gz")
                        out, size = system.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    kind, record_id, fields, block = (c[row].as_py() for c in columns)
                    member = gzip.compress(record_bytes(kind, record_id, fields or [], block or b""), compresslevel=4, mtime=0)
                    out.write(member)
                    size += len(member)
                    if size >= self.most:
                        out.close()
                        out = None
            if out is not None:
                out.close()
        except BaseException:
            self._drop(names)
            raise
        return Archives(names)

    def _drop(self, names: list[str]) -> None:
        system, base = opened(self.path)
        for name in names:
            if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                system.delete_file(f"{base}/{name}")

    def commit(self, messages: list[Archives | None]) -> None:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith(_COMMIT)] if self.overwrite else []
        with system.open_output_stream(f"{base}/{_COMMIT}{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for path in before:
            system.delete_file(path)

    def abort(self, messages: list[Archives | None]) -> None:
        self._drop([n for m in messages if m for n in m.names])


@dataclass
class _Archive(InputPartition):
    name: str | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.segments = options["path"], options.get("segments", "all")

    def partitions(self) -> list[_Archive]:
        system, base = opened(self.path)
        lists = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith(_COMMIT)]
        names: list[str] = []
        for path in lists:
            with system.open_input_stream(path, compression=None) as text:
                names += json.loads(text.read())
        return [_Archive(n) for n in sorted(names)] or [_Archive(None)]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        system, base = opened(self.path)
        held, size = [], 0
        with system.open_input_stream(f"{base}/{partition.name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as text:
            for fields, block in records_in(io.BufferedReader(text, 1 << 20)):
                if self.segments != "all" and ("warc-segment-number" in fields) != (self.segments == "only"):
                    continue
                held.append((partition.name, fields.get("warc-type"), fields.get("warc-record-id"), list(fields.items()), block))
                size += len(block) + 512
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _BATCH.types)], schema=_BATCH)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _BATCH.types)], schema=_BATCH)


class WarcSource(DataSource):
    """Options: ``path``; writing: ``archive_bytes``; reading: ``segments`` -- ``all`` records, ``only`` those of segmented ones, or ``none`` of these."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)
