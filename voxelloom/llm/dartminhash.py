"""MinHash near-duplicates: DartMinHash signatures of word shingles, joined by bands and verified on the sets.

Darts are thrown into unit-area regions of each element's weight x rank plane by a hash of the element alone, so two
documents meet the same darts where they share an element. A dart counts for a document if it lies below the element's
weight; of the darts that fall on one coordinate the document keeps the one of least rank. About k ln k darts fill k
coordinates, whatever the number of elements.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.textbytes import Words, map_texts, mix64, pieces, struct_array
from voxelloom.operators.spatial import connected_components
from voxelloom.session import materialise

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
_SKETCH = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_SET = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("members", T.BinaryType())])


@dataclass(frozen=True)
class Settings:
    """36 bands of 6: two sets of similarity 0.8 share no band with a chance of 2 in 100,000, sets of 0.3 share one with 3 in 100."""

    words: int = 5
    similarity: float = 0.8
    rows: int = 6
    bands: int = 36
    weighted: bool = False  # repeated shingles count as often as they occur (in the signature), or once
    direct: int = 16  # members of a band value that are paired directly; more go by rare shingles


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_minhash(element: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Documents x k least ranks; elements of document d are first[d]:first[d+1]. Rows without elements stay infinite."""
    n_docs = len(first) - 1
    out = np.full(n_docs * k, np.inf)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    total = np.bincount(doc, weight, n_docs)
    todo, reach = np.flatnonzero(total > 0), k * np.log(k) + 3 * k
    while len(todo):
        limit = np.zeros(n_docs)
        limit[todo] = reach / total[todo]
        mine = np.flatnonzero(limit[doc] > 0)
        level = 0
        while len(mine):  # weights from 2^level - 1 to 2^(level+1) - 1, ranks in steps of 2^-level
            low, size = 2.0**level - 1, 2.0**level
            mine = mine[weight[mine] > low]
            cells = np.ceil(limit[doc[mine]] * size).astype(np.int64)
            at = np.repeat(mine, cells)
            cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
            h = mix64(element[at] ^ mix64(cell.astype(np.uint64) * np.uint64(64) + np.uint64(level)))
            count = np.searchsorted(_POISSON, _uniform(h), "right")
            dart = np.repeat(np.arange(len(at)), count)
            turn = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            g = mix64(h[dart] + (turn + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank = (cell[dart] + _uniform(g)) / size
            who = at[dart]
            good = rank <= limit[doc[who]]
            part = weight[who] < 2 * size - 1
            if part.any():
                good &= ~part | (low + size * _uniform(mix64(g + np.uint64(1))) <= weight[who])
            keep = np.flatnonzero(good)
            column = (mix64(g[keep] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out, doc[who[keep]] * k + column, rank[keep])
            level += 1
        rows = out.reshape(n_docs, k)
        todo = todo[np.isinf(rows[todo]).any(1)]
        reach *= 2
    return out.reshape(n_docs, k)


def _shingles(w: Words, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, first): different shingles of each document in order of hash; a shorter text is one shingle."""
    at, hashes = w.windows(words)
    docs, found = [w.doc[at]], [hashes]
    few = np.diff(w.first)
    for size in range(1, words):
        short = np.flatnonzero(few == size)
        if len(short):
            at, hashes = w.windows(size)
            own = few[w.doc[at]] == size
            docs.append(w.doc[at[own]])
            found.append(hashes[own])
    doc, h = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[edge], np.diff(np.append(edge, len(h))), np.searchsorted(doc[edge], np.arange(w.n_docs + 1))


def _keys(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each set and its size: equal sets have equal keys."""
    sums = []
    for salt in (1, 2):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h + np.uint64(salt)), out=run[1:])
        sums.append(mix64(run[first[1:]] - run[first[:-1]]))
    both = np.column_stack([*sums]).astype(">u8").view(np.uint8).reshape(-1, 16)
    size = np.diff(first).astype(">u4").view(np.uint8).reshape(-1, 4)
    return [r.tobytes() for r in np.concatenate([both, size], 1)]


def _sketch(column: pa.Array, s: Settings) -> pa.StructArray:
    keys, bands = [], []
    k = s.rows * s.bands
    for i, j, data, off in pieces(column):
        h, times, first = _shingles(Words(data, off), s.words)
        keys += _keys(h, first)
        for a in range(0, j - i, 128):  # short texts have as many darts as long ones
            b = min(a + 128, j - i)
            own = slice(first[a], first[b])
            weight = (times[own] if s.weighted else np.ones(first[b] - first[a])).astype(float)
            ranks = dart_minhash(h[own], weight, first[a : b + 1] - first[a], k)
            none = np.isinf(ranks[:, 0])
            bits = mix64(ranks.view(np.uint64))
            acc = np.full((b - a, s.bands), 0, np.uint64) + np.arange(s.bands, dtype=np.uint64)
            for r in range(s.rows):
                acc = mix64(acc * np.uint64(31) + bits[:, r :: s.rows])
            values = acc.view(np.int64)
            bands += [[] if gone else v for gone, v in zip(none, values.tolist())]
    return struct_array(_SKETCH, [keys, bands])


def _sets(column: pa.Array, s: Settings) -> pa.StructArray:
    keys, members = [], []
    for i, j, data, off in pieces(column):
        h, _, first = _shingles(Words(data, off), s.words)
        keys += _keys(h, first)
        short = (h >> np.uint64(32)).astype(np.uint32)  # hashes ascend in a document, so these do
        members += [short[first[d] : first[d + 1]].tobytes() for d in range(j - i)]
    return struct_array(_SET, [keys, members])


def _alike(batches, least: float):
    for batch in batches:
        keep = []
        for row, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            shared = len(np.intersect1d(x, y))
            if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                keep.append(row)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _size(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 17, 4)), 16, 10).cast("long")


def _compatible(a: str, b: str, s: Settings) -> Column:
    x, y = _size(F.col(a)), _size(F.col(b))
    return F.least(x, y) >= s.similarity * F.greatest(x, y)


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, value of a, value of b); a hot side of a key is for adaptive execution to split."""
    one = pairs.join(table.select(F.col("key").alias("a"), F.col(value).alias("_a")), "a")
    return one.join(table.select(F.col("key").alias("b"), F.col(value).alias("_b")), "b").select("a", "b", "_a", "_b")


def near_duplicates(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, cluster_id, kept) for each row of ``docs(doc_id, text)``.

    Documents are sets of hashed shingles of five words (A-Z count as lower case; a shorter text is one shingle).
    Equal sets are a class; ``class_id`` is its smallest doc_id. Classes of Jaccard similarity 0.8 or more are
    linked, and ``cluster_id`` is the smallest doc_id of a component of links. ``kept`` marks the row with that id
    (the smaller text_hash if several rows have it). text_hash is xxhash64 of the text as given.

    Only classes meet. First each class meets the leader of each of its band values and components of those links are
    formed; then band values that still hold several components are paired inside: directly up to
    ``settings.direct`` members, beyond that by the sets' rarest shingles, one of which any two sets of that
    similarity share. So a passage or group that fills a band value never makes all its pairs, and no link is cut.
    Sets are compared on 32-bit hashes.

    Null and empty texts and texts without words are never linked: each is its own class and cluster, and kept. A null
    doc_id sorts after all others. Rows that repeat both id and text share one fate. An empty table gives no rows.
    """
    s = settings
    source = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"))
    made = map_texts(source, "text", ["doc_id", "text_hash"], partial(_sketch, s=s), _SKETCH).select("doc.*", "out.*")
    sketch = materialise(made, "sketch")
    some = sketch.filter(F.size("bands") > 0)
    # one place of each set, to fetch its text from; the smallest id names the class
    classes = materialise(some.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")), "classes")

    def banded() -> DataFrame:
        return some.select(F.explode("bands").alias("band"), "key")

    drawn = F.struct(F.xxhash64("band", "key").alias("h"), "key")  # another leader for each band value, whoever shares several of them
    shared = banded().groupBy("band").agg(F.min(drawn).alias("leader"), F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most")
    members = materialise(banded().join(shared.select("band", F.col("leader.key").alias("leader")), "band").distinct(), "members")
    led = members.filter(F.col("key") != F.col("leader")).filter(_compatible("key", "leader", s))
    pairs = materialise(led.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct(), "led")

    needed = members.select("key").distinct().join(classes, "key").select("at", "key")
    wanted = needed.select("at.doc_id", "at.text_hash", F.col("key").alias("want"))
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]) & source["text_hash"].eqNullSafe(wanted["text_hash"])).select("text", "want")
    sets = materialise(map_texts(texts, "text", ["want"], partial(_sets, s=s), _SET).filter("doc.want = out.key").select("out.*").dropDuplicates(["key"]), "sets")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        return materialise(_with_both(pairs, sets, "members").mapInArrow(partial(_alike, least=s.similarity), "a binary, b binary"), tag)

    links = verified(pairs, "links")
    part = _components(links)
    # what is left to compare: members of a band value in different components
    labelled = members.select("band", "key").join(part, "key", "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    open_ = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x < y").select("band", "n")
    left = materialise(labelled.join(open_, "band"), "left")
    small = left.filter(F.col("n") <= s.direct).select("band", "key", "label")
    direct = _cross(small, "band", s)
    hot = left.filter(F.col("n") > s.direct).select("key", "label").distinct()
    rare = _cross(_rare_shingles(hot, sets, s), "shingle", s, F.least("ra", "rb") >= s.similarity / (1 + s.similarity) * (F.col("na") + F.col("nb")) - 1e-9)
    more = materialise(direct.union(rare).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    links = links.union(verified(more, "links"))

    part = _components(links)
    named = classes.select("key", F.col("at.doc_id").alias("class_id"), "at").join(part, "key", "left").withColumn("label", F.coalesce("label", "key"))
    best = named.groupBy("label").agg(F.min("at").alias("best"))
    named = named.join(best, "label").select("key", "class_id", "best")
    kept = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash")))
    return sketch.join(named, "key", "left").select(
        "doc_id", "text_hash", _size(F.col("key")).alias("n_shingles"), F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("cluster_id"), kept.alias("kept"))


def _components(links: DataFrame) -> DataFrame:
    """(key, label) of every linked key."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id"))
    return materialise(connected_components(ends, links, []).select(F.col("id").alias("key"), "label"), "components")


def _cross(members: DataFrame, by: str, s: Settings, reach: Column | None = None) -> DataFrame:
    """Pairs (a, b) of one ``by`` value whose components differ and whose sizes allow the similarity."""
    more = [c for c in members.columns if c not in (by, "key", "label")]
    a, b = (members.select(by, F.col("key").alias(x), F.col("label").alias("l" + x), *[F.col(c).alias(c + x) for c in more]) for x in "ab")
    good = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (_compatible("a", "b", s) if reach is None else reach)
    return a.join(b, by).filter(good).select("a", "b").distinct()


def _rare_shingles(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(shingle, key, label, n, r) of each set's rarest shingles: two sets of the similarity share one of these.

    A set of n shares at least ``similarity`` n shingles with any partner, so among its n - ceil(similarity n) + 1
    rarest, in one order for all sets, is one that the partner has among its own. r counts the set's shingles from
    this one on: if it is the first that two sets share, they share no more than the smaller r, and the similarity
    asks for ``similarity`` / (1 + ``similarity``) of both sizes together.
    """
    def unpack(batches):
        for batch in batches:
            for key, label, members in zip(*(batch.column(c).to_pylist() for c in range(3))):
                values = np.frombuffer(members, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array([key] * len(values), pa.binary()), pa.array([label] * len(values), pa.binary())], ["shingle", "key", "label"])

    rows = members.join(sets, "key").select("key", "label", "members").mapInArrow(unpack, "shingle long, key binary, label binary")
    often = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = rows.join(often, "shingle").groupBy("key", "label").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))  # one document's shingles
    size = F.size("s")
    first = F.slice("s", 1, size - F.ceil(s.similarity * size - 1e-9).cast("int") + 1)
    return ranked.select(F.posexplode(first).alias("at", "s"), "key", "label", size.alias("n")).filter("s.n > 1").select("s.shingle", "key", "label", "n", (F.col("n") - F.col("at")).alias("r"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of each cluster."""
    gone = near_duplicates(docs, text, settings).filter(~F.col("kept")).select("doc_id", "text_hash").distinct().alias("gone")
    same = F.col("gone.doc_id").eqNullSafe(F.col("own.doc_id")) & F.col("gone.text_hash").eqNullSafe(F.xxhash64(F.col(f"own.`{text}`").cast("string")))
    return docs.alias("own").join(gone, same, "left_anti")
