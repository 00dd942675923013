"""Spark data sources for vertex files (``ply``) and depth grids (``npy_grid``).

Both split a file by position, so a large file is read by many tasks, and hand Spark Arrow batches.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: scalar names of the format and their numpy codes
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
SPARK_TYPES = {"i1": T.ShortType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
RENAMED = {"red": "r", "green": "g", "blue": "b"}


def _files(options: dict) -> list[str]:
    path = options["path"]
    found = sorted(glob.glob(path, recursive=True)) if any(c in path for c in "*?[") else [path]
    out: list[str] = []
    for p in found:
        out += sorted(os.path.join(p, f) for f in os.listdir(p)) if os.path.isdir(p) else [p]
    if not out:
        raise FileNotFoundError(path)
    return out


def ply_header(path: str) -> tuple[str, int, list[tuple[str, str]], int, bool]:
    """(format, vertex count, vertex properties, byte offset of the data, whether other elements follow)."""
    fmt, count, props, inside, more = "", 0, [], False, False
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is not a ply file")
        for line in f:
            words = line.decode("ascii").split()
            if not words or words[0] == "comment":
                continue
            if words[0] == "end_header":
                return fmt, count, props, f.tell(), more
            if words[0] == "format":
                fmt = words[1]
            elif words[0] == "element":
                inside = words[1] == "vertex"
                if inside:
                    count = int(words[2])
                elif not props:
                    raise ValueError(f"{path}: the vertex element must come first")
                else:
                    more = True
            elif words[0] == "property" and inside:
                if words[1] == "list":
                    raise ValueError(f"{path}: list properties are not vertex columns")
                props.append((words[2], PLY_TYPES[words[1]]))
    raise ValueError(f"{path}: header does not end")


class Slice(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([pa.field(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])


class PlySource(DataSource):
    """``spark.read.format("ply").load(glob)``: file, pid and the vertex properties as named in the header."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        _, _, props, _, _ = ply_header(_files(self.options)[0])
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("pid", T.LongType()), *[T.StructField(RENAMED.get(n, n), SPARK_TYPES[k]) for n, k in props]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PlyReader(self.options, schema)


class PlyReader(DataSourceReader):
    BATCH = 65_536

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.wanted, self.rows = options, schema, int(options.get("rowsPerPartition", 2_000_000))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in _files(self.options):
            fmt, count, props, offset, more = ply_header(path)
            if fmt == "ascii":  # lines vary in length: ranges of bytes, each owning the lines that start in it
                size = os.path.getsize(path)
                step = max(size - offset, 1) if more else self.rows * 32  # where faces follow, one task counts the vertices
                parts += [Slice(path, a, min(a + step, size)) for a in range(offset, size, step)]
            else:
                parts += [Slice(path, a, min(a + self.rows, count)) for a in range(0, count, self.rows)]
        return parts

    def _batch(self, path: str, first: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        schema = _arrow(self.wanted)
        n = len(first)
        data = {"file": pa.array([path] * n, pa.string()), "pid": pa.array(first, pa.int64())}
        arrays = [data[f.name] if f.name in data else pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fmt, count, props, offset, more = ply_header(partition.path)
        names = [RENAMED.get(n, n) for n, _ in props]
        if fmt == "ascii":
            yield from self._ascii(partition, count, names, offset)
            return
        order = "<" if fmt == "binary_little_endian" else ">"
        kind = np.dtype([(n, order + k) for n, (_, k) in zip(names, props)])
        with open(partition.path, "rb") as f:
            f.seek(offset + partition.start * kind.itemsize)
            at = partition.start
            while at < partition.stop:
                block = np.frombuffer(f.read(min(self.BATCH, partition.stop - at) * kind.itemsize), kind)
                if not len(block):
                    break
                yield self._batch(partition.path, np.arange(at, at + len(block)), {n: block[n] for n in names})
                at += len(block)

    def _ascii(self, part: Slice, count: int, names: list[str], offset: int) -> Iterator[pa.RecordBatch]:
        """pid is the byte position of the line: unique in the file and in file order."""
        with open(part.path, "rb") as f:
            f.seek(part.start)
            if part.start > offset:
                f.seek(part.start - 1)
                f.readline()
            rows: list[list[float]] = []
            pos: list[int] = []
            seen = 0
            while f.tell() < part.stop and seen < count:
                at = f.tell()
                words = f.readline().split()
                if len(words) >= len(names):
                    rows.append([float(w) for w in words[: len(names)]])
                    pos.append(at)
                    seen += 1
                if len(rows) == self.BATCH:
                    m = np.asarray(rows)
                    yield self._batch(part.path, np.asarray(pos), {n: m[:, i] for i, n in enumerate(names)})
                    rows, pos = [], []
            if rows:
                m = np.asarray(rows)
                yield self._batch(part.path, np.asarray(pos), {n: m[:, i] for i, n in enumerate(names)})


GRID = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("camera", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("u", T.IntegerType()), T.StructField("z", T.DoubleType())])


def _npy_head(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran:
            raise ValueError(f"{path}: column-major grids are not supported")
        return shape, kind, f.tell()


class GridSource(DataSource):
    """``spark.read.format("npy_grid").load(glob)``: one row per pixel; the camera is the name after the last ``depth_``."""

    @classmethod
    def name(cls) -> str:
        return "npy_grid"

    def schema(self) -> T.StructType:
        return GRID

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GridReader(self.options)


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.rows = options, int(options.get("rowsPerPartition", 1024))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in _files(self.options):
            if path.endswith(".npz"):
                parts.append(Slice(path, 0, -1))
            else:
                height = _npy_head(path)[0][-2]
                parts += [Slice(path, a, min(a + self.rows, height)) for a in range(0, height, self.rows)]
        return parts

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        camera = re.sub(r"\.(npy|npz)$", "", os.path.basename(part.path))
        camera = re.sub(r"^(depth_raw_|depth_|conf_)", "", camera)
        if part.path.endswith(".npz"):
            with zipfile.ZipFile(part.path) as z:
                names = z.namelist()
            with np.load(part.path) as data:
                grid = next((data[n[:-4]] for n in names if data[n[:-4]].ndim >= 2 and data[n[:-4]].dtype.kind == "f"), None)
            if grid is None:
                raise ValueError(f"{part.path}: no floating point grid inside")
            grid, first = np.squeeze(grid), 0
        else:
            shape, kind, offset = _npy_head(part.path)
            whole = np.memmap(part.path, kind, "r", offset, shape).reshape(shape[-2:])
            grid, first = whole[part.start : part.stop], part.start
        h, w = grid.shape
        step = max(1, 65_536 // w)
        for a in range(0, h, step):
            block = np.asarray(grid[a : a + step], float)
            v, u = np.mgrid[first + a : first + a + len(block), 0:w]
            n = block.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path] * n), pa.array([camera] * n), pa.array(v.ravel().astype("int32")), pa.array(u.ravel().astype("int32")), pa.array(block.ravel())], schema=_arrow(GRID))


def register(spark) -> None:
    spark.dataSource.register(PlySource)
    spark.dataSource.register(GridSource)


def read_points(spark, path: str, **options):
    register(spark)
    return spark.read.format("ply").options(**options).load(path)


def read_depth(spark, path: str, **options):
    register(spark)
    return spark.read.format("npy_grid").options(**options).load(path)
