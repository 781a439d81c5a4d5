"""Arrow IPC files as a data source of Spark: read by parts of a file, written with commit and abort."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_parts"
#: Bytes of a file that one task reads, about; files are cut between record batches. Rows of a batch that is written.
PART_BYTES, BATCH_ROWS = 64 << 20, 65_536


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, file:/a and plain paths among them."""
    plain = path[5:] if path.startswith("file:") else path
    if plain.startswith("/"):
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(plain)


def _files(path: str) -> list[fs.FileInfo]:
    """Arrow files at or below a path by name; hidden ones and unfinished writes are left out."""
    where, root = _place(path)
    info = where.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda x: any(part[:1] in "._" for part in x.path[len(root) :].split("/") if part)
    return sorted((x for x in found if x.type == fs.FileType.File and x.size and not hidden(x)), key=lambda x: x.path)


@dataclass
class Part(InputPartition):
    """The record batches of a file from number * part // parts on, up to those of the next part."""

    path: str
    part: int
    parts: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, part_bytes: int):
        self.path, self.schema, self.part_bytes = path, schema, part_bytes

    def partitions(self) -> list[Part]:
        out = []
        for x in _files(self.path):
            parts = max(1, -(-x.size // self.part_bytes))
            out += [Part(x.path, k, parts) for k in range(parts)]
        return out or [Part("", 0, 1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = _place(self.path)
        wanted = to_arrow_schema(self.schema)
        with where.open_input_file(partition.path) as file:
            if file.read(6) == b"ARROW1":
                found = pa.ipc.open_file(file)  # reads the footer, and then only the batches asked for
                n = found.num_record_batches
                batches = (found.get_batch(k) for k in range(partition.part * n // partition.parts, (partition.part + 1) * n // partition.parts))
            else:  # a stream has no footer: its first part reads it whole, batch by batch
                file.seek(0)
                batches = iter(pa.ipc.open_stream(file)) if partition.part == 0 else iter(())
            for batch in batches:
                columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in wanted]
                for k in range(0, batch.num_rows, BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([c.slice(k, BATCH_ROWS) for c in columns], schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class Writer(DataSourceArrowWriter):
    """Tasks write below _unfinished-ID; a commit moves their files into place, an abort deletes them."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def _unfinished(self) -> tuple[fs.FileSystem, str, str]:
        where, root = _place(self.path)
        return where, root, f"{root}/_unfinished-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, _, below = self._unfinished()
        schema, rows, out, name = to_arrow_schema(self.schema), 0, None, f"part-{uuid.uuid4().hex}.arrow"
        try:
            for batch in iterator:
                if out is None:
                    where.create_dir(below, recursive=True)
                    file = where.open_output_stream(f"{below}/{name}")
                    out = pa.ipc.new_file(file, schema)
                for k in range(0, batch.num_rows, BATCH_ROWS):
                    out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.slice(k, BATCH_ROWS).columns, schema, strict=True)], schema=schema))
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                file.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        where, root, below = self._unfinished()
        old = _files(self.path) if self.overwrite and where.get_file_info(root).type != fs.FileType.NotFound else []
        where.create_dir(root, recursive=True)
        for x in messages:
            if x is not None and x.name:  # attempts that were not counted stay behind, and go with the folder
                where.move(f"{below}/{x.name}", f"{root}/{x.name}")
        for x in old:
            where.delete_file(x.path)
        self._clear(where, below)
        with where.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        where, _, below = self._unfinished()
        self._clear(where, below)

    @staticmethod
    def _clear(where: fs.FileSystem, below: str) -> None:
        if where.get_file_info(below).type != fs.FileType.NotFound:
            where.delete_dir(below)


class ArrowParts(DataSource):
    """format("arrow_parts"): options path; part_bytes, the bytes of a file that a task reads. Without a schema that of the
    first file counts; columns that a file lacks are null."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = _files(self.options["path"])
        if not found:
            raise ValueError(f"no Arrow file at {self.options['path']}, and no schema given")
        where, _ = _place(self.options["path"])
        with where.open_input_file(found[0].path) as file:
            is_file = file.read(6) == b"ARROW1"
            file.seek(0)
            return from_arrow_schema((pa.ipc.open_file(file) if is_file else pa.ipc.open_stream(file)).schema)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("arrow_parts") known to a session; doing so again changes nothing."""
    spark.dataSource.register(ArrowParts)
