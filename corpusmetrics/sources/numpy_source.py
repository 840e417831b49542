"""NumPy matrices (.npy) and archives (.npz) as Spark data sources: a partition is a range of rows, read by itself.

The planner reads headers only.  Paths are those of any Hadoop file system that Arrow can read too
(local, hdfs, s3a, abfs, gs); mount tables (viewfs) are resolved to what they point at by the session before reading.
Tasks hold one slice of their range at a time, so matrices of any size need little memory.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a matrix that a partition reads, and bytes worked on at once.
RANGE_BYTES, SLICE_BYTES = 64_000_000, 4_000_000
#: Schemes that Hadoop and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def resolved(spark: SparkSession, path: str) -> str:
    """The path that Hadoop's file systems resolve a path to, mount tables included; raises if there is no such file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(place).toString()


def opened(path: str) -> pa.NativeFile:
    scheme, colon, rest = path.partition(":")
    if not colon:
        return pa.fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return pa.fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, place = pa.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    return system.open_input_file(place)


@dataclass(frozen=True)
class Layout:
    """Where the rows of a matrix lie in its file."""

    rows: int
    width: int
    dtype: str
    first: int  # byte of the first row

    @classmethod
    def read(cls, file, base: int = 0) -> Layout:
        major, _ = np.lib.format.read_magic(file)
        header = np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = header(file)
        if len(shape) != 2 or by_column or dtype.hasobject:
            raise ValueError(f"not a matrix of numbers, row by row: shape {shape}, type {dtype}")
        return cls(*shape, dtype.str, base + file.tell())

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize

    def ranges(self, range_bytes: int) -> Iterator[tuple[int, int]]:
        step = max(1, range_bytes // max(1, self.row_bytes))
        for a in range(0, self.rows, step):
            yield a, min(self.rows, a + step)


def _vectors(block: np.ndarray) -> pa.Array:
    values = pa.array(block.ravel().astype(np.float64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]), values)


def _slices(file, layout: Layout, a: int, b: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of consecutive slices of the rows a to b; ``file`` stands at row a."""
    step = max(1, SLICE_BYTES // max(1, layout.row_bytes))
    for i in range(a, b, step):
        n = min(b, i + step) - i
        data = file.read(n * layout.row_bytes)
        if len(data) != n * layout.row_bytes:
            raise OSError(f"the file ends before row {i + n} of {layout.rows}")
        yield i, np.frombuffer(data, layout.dtype).reshape(n, layout.width)


@dataclass
class Rows(InputPartition):
    layout: Layout
    start: int
    end: int
    entry: str | None = None
    packed: bool = False  # a compressed entry of an archive: read in one stream

    def __post_init__(self):
        super().__init__(None)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Rows]:
        with opened(self.path) as f:
            layout = Layout.read(f)
        return [Rows(layout, a, b) for a, b in layout.ranges(self.range_bytes)] or [Rows(layout, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at = partition.layout
        with opened(self.path) as f:
            f.seek(at.first + partition.start * at.row_bytes)
            for i, block in _slices(f, at, partition.start, partition.end):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(block))), _vectors(block)], names=["row_idx", "vec"])


class MatrixSource(DataSource):
    """row_idx, vec of a matrix."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_idx long, vec array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


class ArchiveReader(MatrixReader):
    """Entries that are stored as they are have ranges too; a compressed one is read as a stream."""

    def partitions(self) -> list[Rows]:
        out = []
        with opened(self.path) as f, zipfile.ZipFile(f) as z:
            for info in z.infolist():
                with z.open(info) as entry:
                    head = io.BytesIO(entry.read(min(info.file_size, 65_536)))
                packed = info.compress_type != zipfile.ZIP_STORED
                f.seek(info.header_offset + 26)
                name, extra = np.frombuffer(f.read(4), "<u2").tolist()
                layout = Layout.read(head, 0 if packed else info.header_offset + 30 + name + extra)
                ranges = [(0, layout.rows)] if packed else layout.ranges(self.range_bytes)
                out += [Rows(layout, a, b, info.filename, packed) for a, b in ranges]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        at = partition.layout
        effort, keyword, facet = partition.entry.removesuffix(".npy").split("|")
        with opened(self.path) as f:
            if partition.packed:
                with zipfile.ZipFile(f) as z, z.open(partition.entry) as entry:
                    entry.read(at.first)
                    yield from self._batches(_slices(entry, at, 0, partition.end), facet, keyword, effort)
            else:
                f.seek(at.first + partition.start * at.row_bytes)
                yield from self._batches(_slices(f, at, partition.start, partition.end), facet, keyword, effort)

    def _batches(self, blocks, *names: str) -> Iterator[pa.RecordBatch]:
        for i, block in blocks:
            fixed = [pa.array([n] * len(block), pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(i, i + len(block))), _vectors(block)], names=["facet", "keyword", "effort", "rank", "vec"])


class ArchiveSource(DataSource):
    """facet, keyword, effort, rank, vec of an archive whose entries are named effort|keyword|facet."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "facet string, keyword string, effort string, rank long, vec array<double>"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_numpy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A .npz path as an archive, any other as a matrix."""
    source = ArchiveSource if path.endswith(".npz") else MatrixSource
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("rangeBytes", range_bytes).load(resolved(spark, path))
