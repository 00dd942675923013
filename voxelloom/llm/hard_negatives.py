"""Hard-negative mining on exact inner products: residue-number-system GEMM and windowed selection."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.session import materialise

PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)  # their product is above 2^69
DEPTH = 64  # columns of one float32 product: 64 * 510^2 < 2^24, so sums of balanced residues are exact
ROWS, ANCHORS, TILE = 4096, 8192, 512  # rows and anchors of a block, anchors scored at once
SHARD = 64  # blocks of rows that meet a block of anchors in one group
LIMIT = 2.0**31  # largest length of a vector: scores stay below 2^62


def primes_for(bound: float) -> tuple[int, ...]:
    """As many primes as tell all whole numbers of size up to ``bound`` apart."""
    product, k = 1, 0
    while product <= 2 * bound + 2:
        product *= PRIMES[k]
        k += 1
    return PRIMES[:k]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p-1)/2 and (p-1)/2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


class Residues:
    """A matrix of whole numbers as one float32 matrix of balanced residues for each prime."""

    def __init__(self, values: np.ndarray, primes: tuple[int, ...]):
        self.primes = primes
        self.parts = [balanced(values, p).astype(np.float32) for p in primes]

    def rows(self, at: slice) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [m[at] for m in self.parts]
        return out

    def dot(self, other: Residues) -> np.ndarray:
        """Exact inner products of all rows of both, as 64-bit integers; columns that only one side has count as zero.

        Each prime's product is taken in float32 over ``DEPTH`` columns at a time. The balanced mixed-radix digits of the
        Chinese remainder are then put together; the sum may wrap on the way, but the score itself fits.
        """
        width = min(self.parts[0].shape[1], other.parts[0].shape[1])
        residues = []
        for p, a, b in zip(self.primes, self.parts, other.parts):
            total = np.zeros((len(a), len(b)), np.int32)
            for c in range(0, width, DEPTH):
                part = (a[:, c : min(c + DEPTH, width)] @ b[:, c : min(c + DEPTH, width)].T).astype(np.int32)
                total = part if width <= DEPTH else balanced(total + balanced(part, p), p)
            residues.append(balanced(total, p))
        score, radix, digits = np.zeros(residues[0].shape, np.int64), 1, []
        for k, p in enumerate(self.primes):
            digit, scale = residues[k].astype(np.int64), 1
            for d, q in zip(digits, self.primes):
                digit = digit - scale * d
                scale = scale * q % p
            digit = balanced(digit * pow(scale, -1, p), p)
            digits.append(digit)
            score += digit * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
            radix *= p
        return score


def _floors(batches, scale: float):
    """id, label, floor(scale x) of each component as float64, length of the vector; rows without use are left out."""
    for batch in batches:
        ids, labels, vectors = batch.column(0), batch.column(1), batch.column(2)
        flat = vectors.flatten()
        size = np.diff(vectors.offsets.to_numpy())
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component comes as NaN
        owner = np.repeat(np.arange(len(size)), size)
        whole = np.floor(values * scale)
        bad = np.bincount(owner, ~np.isfinite(whole), len(size)) > 0
        with np.errstate(all="ignore"):
            length = np.sqrt(np.bincount(owner, np.where(np.isfinite(whole), whole, 0.0) ** 2, len(size)))
        good = np.flatnonzero(~bad & (length < LIMIT))
        ends = np.cumsum(size)
        packed = [whole[ends[k] - size[k] : ends[k]].astype("<i4").tobytes() for k in good]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), labels.take(pa.array(good)), pa.array(packed, pa.binary()), pa.array(length[good], pa.float64())], ["id", "label", "v", "length"])


def _pack(batches, most: int, windows: bool):
    """One row for each ``most`` rows of a partition: their number in it, ids, labels and matrix (and windows)."""
    held, number, part = [], 0, TaskContext.get().partitionId()

    def close(rows):
        rows.sort(key=lambda r: r[0])  # places in a block stand for ids among equal scores
        width = max((len(r[2]) for r in rows), default=0)
        matrix = b"".join(r[2].ljust(width, b"\0") for r in rows)
        columns = [pa.array([(part << 32) + number], pa.int64()), pa.array([np.array([r[0] for r in rows], "<i8").tobytes()], pa.binary()), pa.array([np.array([r[1] for r in rows], "<i8").tobytes()], pa.binary()), pa.array([width // 4], pa.int32()), pa.array([matrix], pa.binary())]
        names = ["block", "ids", "labels", "width", "matrix"]
        if windows:
            columns.append(pa.array([np.array([w for r in rows for w in r[3]], "<i8").tobytes()], pa.binary()))
            names.append("windows")
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        held += zip(*columns)
        while len(held) >= most:
            yield close(held[:most])
            held, number = held[most:], number + 1
    if held:
        yield close(held)


class _Best:
    """The first ``most`` candidates of each slot by score, then id, of all blocks seen so far."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, slot, ids, score):
        self.parts.append((slot, ids, score))
        self.size += len(slot)
        if self.size > 4_000_000:
            self.parts = [self.first()]
            self.size = len(self.parts[0][0])

    def first(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep = rank < self.most
        return slot[keep], ids[keep], score[keep]


def _best_positives(scores, anchor_ids, anchor_labels, ids, labels, most):
    """(anchor, place) of the first ``most`` rows of the anchor's label, other than the anchor, in each block row."""
    same = (anchor_labels[:, None] == labels[None, :]) & (anchor_ids[:, None] != ids[None, :])
    order = np.argsort(np.where(same, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :most]
    anchor, column = np.nonzero(np.take_along_axis(same, order, 1))
    return anchor, order[anchor, column]


def _windowed(scores, anchor_labels, labels, low, high, most):
    """(anchor, window, place): the first ``most`` rows of other labels whose score lies in each window of the anchor.

    A block's scores are ordered once for each anchor; a window is then a run of that order.
    """
    other = anchor_labels[:, None] != labels[None, :]
    key = np.where(other, -scores, np.iinfo(np.int64).max)  # places ascend with ids, so a stable sort settles ties
    order = np.argsort(key, axis=1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    out = []
    for a in range(len(scores)):
        first, end = np.searchsorted(key[a], -high[a], "left"), np.searchsorted(key[a], -low[a], "right")
        n = np.clip(np.where(low[a] <= high[a], end - first, 0), 0, most)
        window = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        out.append((np.full(len(window), a), window, order[a, at]))
    return [np.concatenate(x) for x in zip(*out)]


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent/100 of whole numbers, rounded up or down, without leaving 64 bits."""
    whole, rest = score // 100, score % 100
    return whole * percent + (-((-rest * percent) // 100) if up else rest * percent // 100)


def _numbers(value: pa.BinaryScalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _meet(batches, primes: tuple[int, ...], most: int, slots: int, low: int, high: int, windows: bool):
    """Joins of one block of anchors with one of rows to candidates; consecutive joins of one block of anchors share them."""
    now, best = None, _Best(most)

    def hand_on():
        slot, ids, score = best.first()
        anchor, window = slot // slots, slot % slots
        columns = [a_ids[anchor], ids, score] if not windows else [a_ids[anchor], positive[anchor, window, 0], positive[anchor, window, 1], ids, score]
        for at in range(0, len(slot), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in columns], [f"c{k}" for k in range(len(columns))])

    for batch in batches:
        for k in range(batch.num_rows):
            if batch["a_block"][k].as_py() != now:
                if now is not None:
                    yield from hand_on()
                now, best = batch["a_block"][k].as_py(), _Best(most)
                a_ids, a_labels, a_matrix = (_numbers(batch[c][k], kind) for c, kind in (("a_ids", "<i8"), ("a_labels", "<i8"), ("a_matrix", "<i4")))
                a = Residues(a_matrix.reshape(len(a_ids), batch["a_width"][k].as_py()), primes)
                if windows:
                    positive = _numbers(batch["a_windows"][k], "<i8").reshape(len(a_ids), slots, 2)
                    there = positive[:, :, 0] != np.iinfo(np.int64).min
                    bottom, top = _share(positive[:, :, 1], low, True), np.where(there, _share(positive[:, :, 1], high, False), np.iinfo(np.int64).min + 2)
                    bottom = np.where(there, bottom, np.iinfo(np.int64).max)
            ids, labels, matrix = (_numbers(batch[c][k], kind) for c, kind in (("ids", "<i8"), ("labels", "<i8"), ("matrix", "<i4")))
            b = Residues(matrix.reshape(len(ids), batch["width"][k].as_py()), primes)
            for t in range(0, len(a_ids), TILE):
                part = slice(t, t + TILE)
                scores = a.rows(part).dot(b)
                if windows:
                    anchor, window, place = _windowed(scores, a_labels[part], labels, bottom[part], top[part], most)
                else:
                    anchor, place = _best_positives(scores, a_ids[part], a_labels[part], ids, labels, most)
                    window = 0
                best.add((anchor + t) * slots + window, ids[place], scores[anchor, place])
    if now is not None:
        yield from hand_on()


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Every block of anchors with every block of rows, over keys (shard of rows, block of anchors).

    Rows travel once for each block of anchors and anchors once for each shard, so a group of the join is one block of
    anchors and the blocks of one shard.
    """
    spark = rows.sparkSession
    shards = max(1, math.ceil(n_rows / SHARD), min(n_rows, 2 * spark.sparkContext.defaultParallelism))
    left = rows.select("ids", "labels", "width", "matrix", F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(max(n_anchors, 1) - 1))).alias("number"))
    numbered = anchors.select(*[F.col(c).alias("a_" + c) for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    numbered = numbered.withColumnRenamed("a_number", "number").withColumn("shard", F.col("shard").cast("long"))
    return left.join(numbered, ["shard", "number"]).sortWithinPartitions("shard", "number")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
                        positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(``scale`` x); a score is the exact integer inner product with the anchor. An anchor (a row for
    which ``is_anchor``, on columns ``id`` and ``label``, holds) has the ``positives`` best other rows of its label. For each
    of them the ``negatives`` best rows of other labels are returned whose score is between ``low`` and ``high`` percent of
    the positive's. Higher scores come first, then smaller ids. A positive of negative score has an empty window.

    Left out: rows without id, label or vector, or with a null or non-finite component, and vectors of length 2^31 or more
    after scaling, whose scores need not fit 64 bits. Rows that repeat an id count once, with the smallest label and vector.
    Vectors of other sizes are filled up with zeros; an empty one scores 0 with all. Fewer candidates than asked for give
    fewer rows; an anchor alone with its label gives none. Other columns are not read. An empty table gives no rows.

    All rows meet all anchors twice, in blocks: for the positives, then for the windows.
    """
    thin = rows.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    whole = thin.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").mapInArrow(partial(_floors, scale=scale), "id long, label long, v binary, length double")
    items = materialise(whole.groupBy("id").agg(F.min(F.struct("label", "v", "length")).alias("one")).select("id", "one.*"), "vectors")
    chosen = items.filter(is_anchor)
    size = items.agg(F.max("length").alias("length"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    primes = primes_for((math.ceil(size["length"] or 0.0) + 1) ** 2)
    packed = materialise(items.select("id", "label", "v").mapInArrow(partial(_pack, most=ROWS, windows=False), "block long, ids binary, labels binary, width int, matrix binary"), "row-blocks")
    n_rows, spread = packed.count(), max(1, math.ceil(size["anchors"] / ANCHORS))

    def meeting(anchors: DataFrame, most: int, windows: bool, columns: str) -> DataFrame:
        kind = "block long, ids binary, labels binary, width int, matrix binary" + (", windows binary" if windows else "")
        blocks = materialise(anchors.repartition(spread).mapInArrow(partial(_pack, most=ANCHORS, windows=windows), kind), "anchor-blocks")
        n_anchors = blocks.count()
        order = blocks.select("block", F.row_number().over(Window.orderBy("block")).alias("n"))  # one thin row for each block
        numbered = blocks.join(order, "block").withColumn("number", F.col("n") - 1).drop("n")
        run = partial(_meet, primes=primes, most=most, slots=positives if windows else 1, low=low, high=high, windows=windows)
        return _grid(packed, numbered, n_rows, n_anchors).mapInArrow(run, columns)

    near = meeting(chosen.select("id", "label", "v"), positives, False, "c0 long, c1 long, c2 long")
    best = F.row_number().over(Window.partitionBy("c0").orderBy(F.desc("c2"), "c1"))
    near = near.withColumn("rank", best).filter(F.col("rank") <= positives)
    none = F.lit(-(1 << 63)).cast("long")
    slots = near.groupBy("c0").agg(F.array_sort(F.collect_list(F.struct("rank", "c1", "c2"))).alias("near"))  # ``positives`` at most
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.array(F.coalesce(F.get("near", k)["c1"], none), F.coalesce(F.get("near", k)["c2"], F.lit(0).cast("long")))))
    windowed = chosen.join(slots, F.col("id") == F.col("c0")).select("id", "label", "v", flat.alias("windows"))
    found = meeting(windowed, negatives, True, "c0 long, c1 long, c2 long, c3 long, c4 long")
    rank = F.row_number().over(Window.partitionBy("c0", "c1").orderBy(F.desc("c4"), "c3"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return found.select(F.col("c0").alias("anchor_id"), F.col("c1").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("c3").alias("negative_id"), F.col("c2").alias("positive_score"), F.col("c4").alias("negative_score"))
