"""Texts as one byte array: words, word hashes and per-document sums without a loop over documents.

The helpers take an Arrow string column and walk it in pieces of about ``PIECE`` bytes (a longer text is
a piece of its own), so memory follows the piece and not the batch. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 18
BATCH_ROWS = 1000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over 64 bits; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, PIECE + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Prefix:
    """Hashes of any byte range of ``data`` from running sums."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power(len(data))
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64))


def pieces(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about ``limit`` bytes."""
    limit = limit or PIECE
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a piece: runs of digits, letters a-z (A-Z count as lower case) and bytes from 0x80."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = LOWER[data]
        self.n_docs = len(off) - 1
        inside = IS_WORD[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[off] = False  # a document starts or ends here
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[off] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.prefix = Prefix(self.low)
        self.hash = self.prefix.of(self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # words of document d: first[d]:first[d+1]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``length`` words inside one document."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = self.hash[:n].copy()
        for j in range(1, length):
            acc *= np.uint64(0xD6E8FEB86659FD93)
            acc += self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return at, mix64(acc[at])

    def normal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end): the words with one space after each, and where each lies."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        start = end - size
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        if len(size):
            shift = np.repeat(start - self.start, size)
            src = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start, size)
            out[src + shift] = self.low[src]
        return out, start, end


def per_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``flag`` between consecutive offsets."""
    total = np.zeros(len(flag) + 1, np.float64 if flag.dtype.kind == "f" else np.int64)
    np.cumsum(flag, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def pool_max(values: np.ndarray, first: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Row-wise maxima of values[first[d]:first[d+1]]; ``empty`` where there are no rows."""
    out = np.full((len(first) - 1, values.shape[1]), empty, values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.maximum.reduceat(values, first[some], axis=0)
    return out


def few_rows_a_batch(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows for the session, if they were larger: whole texts make long rows."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(docs: DataFrame, text: str, keep: list[str], fn: Callable[[pa.Array], pa.StructArray], result: T.StructType) -> DataFrame:
    """doc (a struct of the columns ``keep``) and out (what ``fn`` makes of the text column), batch by batch.

    The kept columns stay inside a struct, so their names may clash with nothing. Arrow batches are set to
    ``BATCH_ROWS`` rows for the session if they were larger: whole texts make long rows.
    """
    few_rows_a_batch(docs.sparkSession)
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    inside = text in keep and docs.schema[text].dataType == T.StringType()
    source = docs.select(doc) if inside else docs.select(doc, F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [keep.index(text)]) if inside else batch.column(1)  # a kept text is sent once
            yield pa.RecordBatch.from_arrays([batch.column(0), fn(texts)], ["doc", "out"])

    return source.mapInArrow(run, T.StructType([source.schema["doc"], T.StructField("out", result)]))


def struct_array(result: T.StructType, columns: list) -> pa.StructArray:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in result.fields]
    arrays = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.StructArray.from_arrays(arrays, [f.name for f in result.fields])
