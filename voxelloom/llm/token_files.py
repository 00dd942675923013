"""Token ids in Simple-8b words: whole tables to numbered segments, and back."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.textbytes import few_rows_a_batch, pieces, struct_array

# A word is a selector (top four bits) over 60 bits. Selector s holds COUNT[s] ids of BITS[s] bits, the first lowest.
# Selector 0 is the escape: its 60 bits are a place in the segment's list of ids that need more than 60 bits.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PAD = int(COUNT.max())
ESCAPED = 16  # the level of an id that no selector holds
BLOCK = 512  # ids of a block; a block starts a word of its own
SEGMENT = 1 << 20  # ids after which a segment is closed
MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQQQ")  # magic, ids of a block, ids, documents, words, escaped ids

_LIMITS = np.array([1 << int(b) for b in BITS[1:]], np.uint64)  # selector s holds ids below _LIMITS[s - 1]


_LOW = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right") + 1).astype(np.uint8)


def _levels(ids: np.ndarray) -> np.ndarray:
    """The smallest selector that holds each id; ids below 65,536 are looked up."""
    if ids.size and int(ids.max()) >= len(_LOW):
        return (np.searchsorted(_LIMITS, ids, "right") + 1).astype(np.uint8)
    return _LOW[ids.astype(np.uint16)]


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, index of each block's first word and the number of words, escaped ids) of unsigned 64-bit ids.

    Each word takes the most ids that fit from where the last one ended; all blocks are walked at once.
    """
    n, blocks = len(ids), -(-len(ids) // block)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, block + PAD), np.uint64)
    whole = np.zeros(blocks * block, np.uint64)
    whole[:n] = ids
    grid[:, :block] = whole.reshape(blocks, block)
    level = _levels(grid)
    level[:, block:] = 1
    level = level.ravel()
    chosen = np.where(level == ESCAPED, 0, 15).astype(np.uint8)
    top, width = level, 1  # largest level of the next ``width`` ids
    for s in range(14, 0, -1):
        while width < COUNT[s]:
            step = min(width, int(COUNT[s]) - width)
            top = np.maximum(top, np.concatenate([top[step:], np.ones(step, np.uint8)]))
            width += step
        chosen[top <= s] = s
    size = block + PAD
    ends = np.arange(blocks) * size + np.minimum(block, n - np.arange(blocks) * block)
    at, starts = np.arange(blocks) * size, np.zeros(blocks * size, bool)
    while len(at):
        starts[at] = True
        at = at + COUNT[chosen[at]]
        more = at < ends
        at, ends = at[more], ends[more]
    first = np.flatnonzero(starts)
    kind, flat = chosen[first], grid.ravel()
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == 0:
            words[mine] = np.arange(len(mine), dtype=np.uint64)
        elif BITS[s]:
            shift = (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(flat[first[mine][:, None] + np.arange(COUNT[s])] << shift, axis=1)
    offsets = np.searchsorted(first, np.arange(blocks + 1) * size).astype(np.uint64)
    return words, offsets, flat[first[kind == 0]]


def unpack(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of whole blocks, as unsigned 64-bit integers, without a loop over words."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, block + PAD), np.uint64)
    if not blocks:
        return out.ravel()
    kind = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNT[kind]) - COUNT[kind]
    first = offsets[:-1].astype(np.int64)
    per_block = np.diff(offsets).astype(np.int64)
    place = before + np.repeat(np.arange(blocks) * (block + PAD) - before[first], per_block)
    flat = out.ravel()
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == 0:
            flat[place[mine]] = escaped[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            shift, mask = (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64), np.uint64((1 << int(BITS[s])) - 1)
            flat[place[mine][:, None] + np.arange(COUNT[s])] = (words[mine][:, None] >> shift) & mask
    return out[:, :block].ravel()[:n]


@dataclass
class Segment:
    """One segment: the ids of consecutive documents and the number of each."""

    data: bytes

    def __post_init__(self):
        magic, self.block, self.n_ids, self.n_docs, n_words, n_escaped = _HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = _HEAD.size
        blocks = -(-self.n_ids // self.block)
        parts = []
        for many in (self.n_docs, blocks + 1, n_words, n_escaped):
            parts.append(np.frombuffer(self.data, "<u8", many, at))
            at += 8 * many
        self.lengths, self.offsets, self.words, self.escaped = parts
        if struct.unpack_from("<I", self.data, at)[0] != zlib.crc32(self.data[:at]):
            raise ValueError("segment of token ids is damaged")

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start:stop of the segment; only their blocks are decoded."""
        start, stop = min(start, self.n_ids), self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, -(-stop // self.block)
        offsets = self.offsets[a : b + 1]
        got = unpack(self.words[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0], self.escaped, min(self.n_ids, b * self.block) - a * self.block, self.block)
        return got[start - a * self.block : stop - a * self.block]

    @staticmethod
    def of(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
        words, offsets, escaped = pack(ids, block)
        body = b"".join([_HEAD.pack(MAGIC, block, len(ids), len(lengths), len(words), len(escaped)), *[np.asarray(x, "<u8").tobytes() for x in (lengths, offsets, words, escaped)]])
        return body + struct.pack("<I", zlib.crc32(body))


_CODED = T.StructType([T.StructField("ids", T.BinaryType())])
_KEPT = 300_000  # chunks after which a worker starts to forget those it met longest ago
_LONG = 64  # bytes; longer chunks are not remembered
_MARK = b"\x01"  # stands between new chunks that are encoded as one text
_TOGETHER = 1000


# Where a tokenizer says this, a chunk of letters below U+0250 and then ASCII signs is two pieces, lower-cased: its
# ids come from the library's merges alone. Letters there have one form and no marks that follow them.
_PLAIN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next beyond U+00FF."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class ChunkEncoder:
    """Ids of whole texts by the tokenizer library, which sees each chunk between white space once.

    Right for a tokenizer that drops white space and joins nothing across it, as a pre-tokenizer that keeps matches
    without white space does. Strings of special tokens inside a text are ordinary text.
    """

    _loaded: ClassVar[dict[tuple[str, int | None], ChunkEncoder]] = {}  # a Python worker runs many tasks

    def __init__(self, path: str, end_id: int | None):
        self.path, self.end_id, self.known, self.older = path, end_id, {}, {}

    @classmethod
    def here(cls, path: str, end_id: int | None) -> ChunkEncoder:
        """This process's encoder, with what it remembers."""
        if (path, end_id) not in cls._loaded:
            cls._loaded[path, end_id] = one = cls(path, end_id)
            one.load()
        return cls._loaded[path, end_id]

    def load(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        largest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, self.end_id or 0)
        self.kind = "<u2" if largest < 1 << 16 else "<u4"
        rules = json.loads(self.tokenizer.to_str())
        self.plain = all(rules[k] == v for k, v in _PLAIN_RULES.items())
        self.pieces = {"": b""}
        letters = byte_letters()
        self.letter = {ord(bytes([b]).decode("latin-1")): c for b, c in enumerate(letters)}  # of a byte read as Latin-1

    def piece(self, text: str) -> bytes:
        mapped = text if text.isascii() else text.encode().decode("latin-1").translate(self.letter)
        return array("H" if self.kind == "<u2" else "I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def learn(self, fresh: list[bytes]) -> None:
        """Remembers the ids of new chunks. Many go to the library as one text, parted by a mark whose only id no other chunk has."""
        rest = []
        if self.plain:
            for c in fresh:
                m = _PLAIN.fullmatch(c.decode("utf-8", "replace"))
                if m:
                    sign = m[2]
                    if sign not in self.pieces:
                        self.pieces[sign] = self.piece(sign)
                    self.known[c] = self.piece(m[1].lower()) + self.pieces[sign]
                else:
                    rest.append(c)
            fresh = rest
            if len(self.pieces) > _KEPT:
                self.pieces = {"": b""}
        mark = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        plain = [c for c in fresh if _MARK not in c] if len(mark) == 1 else []
        groups = [plain[k : k + _TOGETHER] for k in range(0, len(plain), _TOGETHER)]
        joined = [(b" " + _MARK + b" ").join(g).decode("utf-8", "replace") for g in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(coded.ids, self.kind)
            cuts = np.flatnonzero(ids == mark[0])
            size, data = ids.itemsize, ids.tobytes()
            first, end = np.concatenate([[0], cuts + 1]) * size, np.concatenate([cuts, [len(ids)]]) * size
            self.known.update((c, data[a:b]) for c, a, b in zip(group, first.tolist(), end.tolist(), strict=True))
        alone = fresh if not plain else [c for c in fresh if _MARK in c]
        for c, coded in zip(alone, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in alone], add_special_tokens=False)):
            self.known[c] = np.array(coded.ids, self.kind).tobytes()

    def encode(self, column: pa.Array) -> pa.StructArray:
        end = b"" if self.end_id is None else np.array([self.end_id], self.kind).tobytes()
        out: list[bytes] = []
        for i, j, data, off in pieces(column):
            raw = data.tobytes()
            texts = [raw[off[d] : off[d + 1]].split() for d in range(j - i)]
            known, older = self.known, self.older
            new = [c for c in set().union(*texts) if c not in known]
            fresh = [c for c in new if c not in older]
            if len(fresh) < len(new):
                known.update((c, older[c]) for c in new if c in older)
            self.learn(fresh)
            out += [b"".join(map(known.__getitem__, t)) + end for t in texts]
            for c in fresh:
                if len(c) > _LONG:
                    del known[c]
            if len(known) > _KEPT:
                self.known, self.older = {}, known
        return struct_array(_CODED, [out])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: str, text: str = "text", keep: list[str] | None = None, end_id: int | None = None, segment: int = SEGMENT) -> None:
    """Writes the ids of every text as segments under ``path``, documents in ascending ``order``.

    A row of the written table is one segment: ``part`` and ``seq`` give its place, ``first`` the ids before it in its
    part, ``docs`` the columns ``keep`` of its documents, ``data`` the bytes of a ``Segment``. The table is Parquet, so
    Spark's committer leaves one copy of each segment whatever executors are lost, in any store that Spark writes to.

    A null text is an empty text and has only the end id, if there is one. A null in ``order`` comes after all others.
    Rows of equal ``order`` come by a hash of their text; rows alike in both are interchangeable unless other kept
    columns differ, and then come as they were read. They may all be one value: the range is then cut between them.
    An empty table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    kind = ChunkEncoder.here(tokenizer, end_id).kind
    few_rows_a_batch(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{order}`").alias("at")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    by = [F.col("at").asc_nulls_last(), F.col("tie").asc(), F.col("row").asc()]
    result = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("seq", T.IntegerType()), ("first", T.LongType()), ("n_ids", T.LongType()), ("docs", T.ArrayType(source.schema["doc"].dataType)), ("data", T.BinaryType()))])

    def write(batches):
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, bytes, np.ndarray]] = []
        size = 0

        def close():
            nonlocal held, size, seq, first
            ids = np.frombuffer(b"".join(x[1] for x in held), kind)
            lengths = np.concatenate([x[2] for x in held])
            rows = pa.concat_arrays([x[0] for x in held])
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([Segment.of(ids.astype(np.uint64), lengths)], pa.binary())], result.names)
            held, size, seq, first = [], 0, seq + 1, first + len(ids)
            return row

        for batch in batches:
            coded = ChunkEncoder.here(tokenizer, end_id).encode(batch.column(1)).field(0)
            counts = np.array([len(b) for b in (x.as_buffer() for x in coded)], np.int64) // np.dtype(kind).itemsize
            a = 0
            while a < len(counts):
                room = np.searchsorted(np.cumsum(counts[a:]), segment - size, "left") + 1  # a document stays whole
                b = min(a + int(room), len(counts))
                held.append((batch.column(0).slice(a, b - a), b"".join(x.as_py() for x in coded.slice(a, b - a)), counts[a:b]))
                size += int(counts[a:b].sum())
                if size >= segment:
                    yield close()
                a = b
        if held:
            yield close()

    ordered = source.repartitionByRange(*by).sortWithinPartitions(*by).select("doc", "text")
    ordered.mapInArrow(write, result).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32, ids) of every document written under ``path``.

    ``start`` is the number of ids before the document in the whole table, ``ids`` its ids as little-endian unsigned
    32-bit integers (null without ``with_ids``), ``ids_crc32`` their checksum. Ids beyond 32 bits are an error here;
    ``Segment`` reads them.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    running = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row of two numbers for each partition of the writer, so segments need not be shuffled to meet it
    placed = stored.join(F.broadcast(totals.select(F.col("part").alias("of"), running.alias("before"))), F.col("part") == F.col("of"))
    result = T.StructType([T.StructField("doc", stored.schema["docs"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = Segment(batch.column(2)[k].as_py())
                ids = part.ids()
                if len(ids) and ids.max() >> np.uint64(32):
                    raise ValueError("an id needs more than 32 bits")
                raw = memoryview(ids.astype("<u4").tobytes())
                lengths = part.lengths.astype(np.int64)
                end = np.cumsum(lengths)
                cuts = [raw[4 * a : 4 * b] for a, b in zip(end - lengths, end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[k].values, pa.array(end - lengths + batch.column(0)[k].as_py(), pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([c.tobytes() if with_ids else None for c in cuts], pa.binary())], result.names)

    return placed.select((F.col("first") + F.col("before")).alias("at"), "docs", "data").mapInArrow(read, result)
