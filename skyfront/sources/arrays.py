"""Array files (``.npy``) as a Spark data source: ranges of rows are partitions.

A matrix is one file, or a folder of files whose names sort in the order of their rows. The driver
reads headers only; each task reads the bytes of its own rows. ``id`` is a row's place in the whole
matrix. Writing leaves a file for each task, named by its first id, and nothing if the job fails.
Paths are those of any file system that Arrow opens (local ones, ``file://``, HDFS, object stores).
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id bigint, x array<double>"
#: Bytes of a partition, unless the option ``bytes`` says otherwise, and rows of an Arrow batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 8192
#: Fixed value: how such a file begins.
MAGIC = b"\x93NUMPY"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there. Raises where Arrow knows none."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a file says of itself: where rows begin, how many there are, how wide, and of which type."""

    start: int
    rows: int
    width: int
    kind: str

    @classmethod
    def read(cls, store: fs.FileSystem, path: str) -> Header:
        with store.open_input_file(path) as f:
            head = f.read(10)
            if head[:6] != MAGIC:
                raise ValueError(f"{path} is no array file")
            size, at = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:10] + f.read(2))[0], 12)
            said = ast.literal_eval(f.read(size).decode("utf-8" if head[6] > 2 else "latin-1"))
        if len(said["shape"]) != 2 or said["fortran_order"] and min(said["shape"]) > 1:
            raise ValueError(f"{path} holds no matrix row by row, but {said['shape']}")
        if np.dtype(said["descr"]).kind not in "fiu":
            raise ValueError(f"{path} holds {said['descr']}, not numbers")
        return cls(at + size, *said["shape"], said["descr"])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


def header_of(rows: int, width: int) -> bytes:
    """The first bytes of a file of doubles, padded as its format asks."""
    said = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({rows}, {width}), }}".encode()
    said += b" " * (-(len(MAGIC) + 4 + len(said) + 1) % 64) + b"\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [at]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=False))
    return store, sorted(f.path for f in found if f.is_file and f.base_name.endswith(".npy") and f.base_name[0] not in "_.")


@dataclass
class Rows(InputPartition):
    """Some rows of one file."""

    file: str
    offset: int
    rows: int
    width: int
    kind: str
    first: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Rows]:
        store, files = files_of(self.path)
        out, first, widths = [], 0, set()
        for file in files:
            h = Header.read(store, file)
            widths.add(h.width)
            step = max(1, self.size // max(1, h.row_bytes))
            out += [Rows(file, h.start + k * h.row_bytes, min(step, h.rows - k), h.width, h.kind, first + k) for k in range(0, h.rows, step)]
            first += h.rows
        if len(widths) > 1:
            raise ValueError(f"the files of {self.path} are {sorted(widths)} wide")
        return out or [Rows("", 0, 0, 0, "<f8", 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        store = opened(self.path)[0]
        size = part.width * np.dtype(part.kind).itemsize
        with store.open_input_file(part.file) as f:
            f.seek(part.offset)
            for k in range(0, part.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, part.rows - k)
                raw = f.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{part.file} ends before its rows do")
                values = pa.array(np.frombuffer(raw, part.kind).astype(float))
                x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.first + k), x], ["id", "x"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    last: str | None = None
    first_id: int = 0
    rows: int = 0


class ArrayWriter(DataSourceArrowWriter):
    """Rows come sorted by id, a range of ids to a task (see :func:`write_array`)."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = opened(self.path)
        task = TaskContext.get()
        temporary = f"{at}/_part-{task.partitionId()}-{task.taskAttemptId()}"
        rows, width, first = 0, None, 0
        with store.open_output_stream(temporary) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column("id"), batch.column("x")
                if width is None:
                    width, first = len(x[0]), ids[0].as_py()
                places = ids.to_numpy(zero_copy_only=False)
                if (wrong := np.flatnonzero(places != first + rows + np.arange(len(places)))).size:
                    raise ValueError(f"ids go on with {places[wrong[0]]} where {first + rows + wrong[0]} was due")
                flat = x.flatten().to_numpy(zero_copy_only=False)
                if len(flat) != width * batch.num_rows:
                    raise ValueError(f"rows are not all {width} wide")
                out.write(np.ascontiguousarray(flat, "<f8").tobytes())
                rows += batch.num_rows
        if not rows:
            store.delete_file(temporary)
            return Written(None)
        # the header says how many rows there are, so it is written last, before their bytes
        ready = f"{temporary}.ready"
        with store.open_output_stream(ready) as out, store.open_input_stream(temporary) as body:
            out.write(header_of(rows, width))
            while chunk := body.read(8 << 20):
                out.write(chunk)
        store.delete_file(temporary)
        return Written(ready, f"{at}/part-{first:020d}.npy", first, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        parts = sorted((m for m in messages if m and m.file), key=lambda m: m.first_id)
        following = 0
        for m in parts:
            if m.first_id != following:
                self.abort(messages)
                raise ValueError(f"ids go on with {m.first_id} where {following} was due")
            following += m.rows
        for m in parts:
            store.move(m.file, m.last)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(m.file)


class ArraySource(DataSource):
    """``spark.read.format("npy").load(path)``; option ``bytes``: of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"])


def read_array(spark, path: str, size: int = PARTITION_BYTES):
    """(id, x) of an array file or a folder of such files."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").option("bytes", str(size)).load(path)


def write_array(df, path: str) -> None:
    """``df(id, x)``, its ids 0, 1, 2 and so on, as array files in a new folder: each task writes its range of ids."""
    spark = df.sparkSession
    spark.dataSource.register(ArraySource)
    store, at = opened(path)
    store.create_dir(at, recursive=True)
    if files_of(path)[1]:
        raise FileExistsError(path)
    plain = df.selectExpr("CAST(id AS bigint) AS id", "CAST(x AS array<double>) AS x")
    plain.repartitionByRange("id").sortWithinPartitions("id").write.format("npy").option("path", path).mode("append").save()
