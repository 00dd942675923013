"""Byte-level BPE: a segment tree over byte positions holds the leftmost pair of least rank.

Every piece that the split pattern gives is merged on its own. A tree leaf is a byte position; it holds the rank
of the pair that starts there, with the position below it, so that the root is the leftmost minimum. A merge
writes three leaves (the merged pair, its live left neighbour, the position that died) and their paths.
Short pieces are merged many at a time, one tree per row of an array; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.textbytes import map_texts, struct_array

NONE = np.int64(1) << 62
WIDE = 64  # bytes up to which pieces are merged in rows of one array
CELLS = 1 << 18  # byte positions merged at once
KEPT = 80_000  # pieces a worker remembers
TEXT = 1 << 20  # characters split before their pieces are encoded

_CODES = T.StructType([T.StructField("ids", T.BinaryType())])
_CODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
_TEXT = T.StructType([T.StructField("text", T.StringType())])


class Vocabulary:
    """Ranks of byte strings, and the rank that every pair of known strings merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        # open addressing with linear steps: a lookup is a few gathers
        bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        slot, left = self._slot(pairs[:, 0]), np.arange(len(pairs))
        while len(left):
            free = self.keys[slot] < 0
            put = np.flatnonzero(free)
            self.keys[slot[put]] = pairs[left[put], 0]
            self.values[slot[put]] = pairs[left[put], 1]
            again = self.keys[slot] != pairs[left, 0]
            slot, left = (slot[again] + 1) & self.mask, left[again]
        self.merge = dict(found)
        flat = [b""] * self.size
        for t, r in ranks.items():
            flat[r] = t
        self.length = np.fromiter(map(len, flat), np.int64, self.size)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it merges to nothing or ``right`` is -1."""
        key = left * self.size + right
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], NONE)
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        out[right < 0] = NONE
        return out

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (2, 4, 8, 16, 32, WIDE):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(rows), CELLS // width):
                part = rows[at : at + CELLS // width]
                self._merge_rows([words[r] for r in part], sizes[part], width, part, out)
            low = width
        for r in np.flatnonzero(sizes > WIDE):
            out[r] = self._merge_long(words[r])
        for r in np.flatnonzero(sizes == 0):
            out[r] = np.zeros(0, np.int64)
        return out

    def _merge_rows(self, words: list[bytes], size: np.ndarray, width: int, place: np.ndarray, out: list) -> None:
        n = len(words)
        token = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        inside = np.arange(width)[None, :] < size[:, None]
        token[:, :width][inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        after[np.arange(width + 1)[None, :] >= (size - 1)[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        leaf = self.rank(token[:, :width].ravel(), token[:, 1:].ravel()).reshape(n, width)
        leaf[token[:, :width] < 0] = NONE
        tree[:, width:] = np.where(leaf < NONE, leaf * width + np.arange(width), NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        flat_token, flat_after, flat_before, flat_tree = token.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            base, root = live * (width + 1), live * (2 * width)
            value = flat_tree[root + 1]
            p = value % width
            q = flat_after[base + p]
            r = flat_after[base + q]
            flat_token[base + p] = value // width
            flat_token[base + q] = -1
            flat_after[base + p] = r
            flat_before[base + r] = p
            left = flat_before[base + p]
            has = left >= 0
            left = np.where(has, left, width)  # column `width` has token -1
            mine = self.rank(flat_token[base + p], flat_token[base + r])
            theirs = self.rank(flat_token[base + left], np.where(has, flat_token[base + p], -1))
            flat_tree[root + width + q] = NONE
            flat_tree[root + width + p] = np.where(mine < NONE, mine * width + p, NONE)
            put = np.flatnonzero(has)
            flat_tree[root[put] + width + left[put]] = np.where(theirs[put] < NONE, theirs[put] * width + left[put], NONE)
            for node, base_of in ((q, root), (p, root), (left[put], root[put])):
                node = (node + width) >> 1
                while node.size and node[0] > 0:
                    flat_tree[base_of + node] = np.minimum(flat_tree[base_of + 2 * node], flat_tree[base_of + 2 * node + 1])
                    node = node >> 1
            live = live[flat_tree[root + 1] < NONE]
        kept = token[:, :width] >= 0
        ids, count = token[:, :width][kept], kept.sum(1)
        for k, part in zip(place, np.split(ids, np.cumsum(count)[:-1])):
            out[k] = part

    def _merge_long(self, word: bytes) -> np.ndarray:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        token = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        none, merge, size = int(NONE), self.merge, self.size
        ranks = self.rank(np.array(token[:-1]), np.array(token[1:])) if n > 1 else np.zeros(0, np.int64)
        leaf = np.full(width, NONE, np.int64)
        leaf[: n - 1] = np.where(ranks < NONE, ranks * width + np.arange(n - 1), NONE)
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none] + np.concatenate(levels[::-1]).tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def put(at: int, value: int) -> None:
            at += width
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                at >>= 1
                low = a if a < b else b
                if tree[at] == low:
                    return
                tree[at] = low

        while tree[1] < none:
            rank, p = divmod(tree[1], width)
            q = after[p]
            r, left = after[q], before[p]
            token[p], token[q], after[p] = rank, -1, r
            put(q, none)
            got = none
            if r >= 0:
                before[r] = p
                got = merge.get(rank * size + token[r], none)
            put(p, got * width + p if got < none else none)
            if left >= 0:
                got = merge.get(token[left] * size + rank, none)
                put(left, got * width + left if got < none else none)
        return np.array([t for t in token if t >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        size, first = self.length[ids], self.begin[ids]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)
        return self.bytes[at].tobytes()


class Encoder:
    """Splits texts, remembers a bounded number of pieces, and merges the new ones together."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.begin, self.count, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        for w in words:
            self.slot[w] = len(self.slot)
        made = self.vocabulary.encode_many([w.encode() for w in words])
        count = np.fromiter(map(len, made), np.int64, len(made))
        total = int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, len(self.ids)), np.int32)])
        self.ids[self.used : self.used + total] = np.concatenate(made)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            split: list[list[str]] = []
            while j < len(texts) and (j == i or size + len(texts[j]) <= TEXT):
                split.append(self.split.findall(texts[j]))
                size += len(texts[j])
                j += 1
            words = [w for part in split for w in part]
            new = set(words).difference(self.slot)
            if new:
                if len(self.slot) + len(new) > KEPT:
                    self._forget()
                    new = set(words)
                self._learn(list(new))
            at = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
            count = self.count[at]
            end = np.cumsum(count)
            ids = self.ids[np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - count - self.begin[at], count)]
            end = np.concatenate([[0], end])
            bound = np.concatenate([[0], np.cumsum([len(p) for p in split])])
            out += [ids[end[a] : end[b]] for a, b in zip(bound[:-1], bound[1:])]
            i = j
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """The worker's encoder; pieces stay known from one task to the next."""
    key = (shared.value[0], pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(shared.value[1]), pattern)
    return _encoders[key]


def _share(docs: DataFrame, ranks: str | dict[bytes, int]):
    """The rank table, one vocabulary file, to every executor."""
    table = read_ranks(ranks) if isinstance(ranks, str) else ranks
    digest = hashlib.sha256(repr(sorted(table.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((digest, table))


def _texts(column: pa.Array, batch: int = 256):
    for i in range(0, len(column), batch):
        yield [t or "" for t in column[i : i + batch].to_pylist()]


def encode(docs: DataFrame, ranks: str | dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``) and out.ids (little-endian unsigned 32-bit integers) for each row of ``docs``.

    ``ranks`` is the path of a rank file on the driver, or the table itself; its bytes are all known. Null and empty
    texts have no ids. Strings that name special tokens are ordinary text. Text of any length is one document.
    """
    shared = _share(docs, ranks)

    def ids(column: pa.Array) -> pa.StructArray:
        coder = _encoder(shared, pattern)
        return struct_array(_CODES, [[x.astype("<u4").tobytes() for part in _texts(column) for x in coder.encode(part)]])

    return map_texts(docs, text, docs.columns if keep is None else keep, ids, _CODES)


def decode(coded: DataFrame, ranks: str | dict[bytes, int], ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """doc and out.text for each row with a binary column of ids, as ``encode`` makes it; null ids give an empty text."""
    shared = _share(coded, ranks)
    keep = [c for c in coded.columns if c != ids] if keep is None else keep
    source = coded.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc") if keep else F.struct(F.lit(0).alias("_")).alias("doc"), F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        for batch in batches:
            table = _encoder(shared, "").vocabulary
            texts = [table.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), struct_array(_TEXT, [texts])], ["doc", "out"])

    return source.mapInArrow(run, T.StructType([source.schema["doc"], T.StructField("out", _TEXT)]))


def round_trip(docs: DataFrame, ranks: str | dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc and out (n_tokens, ids_sha256, decoded_sha256): the ids of each text, and the bytes that they decode to."""
    shared = _share(docs, ranks)

    def digests(column: pa.Array) -> pa.StructArray:
        coder = _encoder(shared, pattern)
        n, ids_sha, back_sha = [], [], []
        for part in _texts(column):
            for ids in coder.encode(part):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(coder.vocabulary.decode(ids)).hexdigest())
        return struct_array(_CODED, [n, ids_sha, back_sha])

    return map_texts(docs, text, docs.columns if keep is None else keep, digests, _CODED)
