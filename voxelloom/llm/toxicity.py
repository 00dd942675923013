"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.sampling import labelled
from voxelloom.llm.textbytes import Words, map_texts, pieces, pool_max, struct_array
from voxelloom.session import materialise

BUCKETS = 1 << 19
BINS = 1000  # steps of a score where thresholds are set
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
STEMS = (4, 5, 6)  # a word counts with its first bytes too, so that unseen inflections are known by their stems

_WORDS = T.StructType([T.StructField("words", T.BinaryType())])
_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def word_buckets(w: Words) -> np.ndarray:
    """Words x (whole word, stems), as rows of the embedding table."""
    parts = [w.hash] + [w.prefix.of(w.start, np.minimum(w.start + k, w.end)) * np.uint64(2 * k + 1) for k in STEMS]
    return np.column_stack([(p >> np.uint64(20)) % np.uint64(BUCKETS) for p in parts]).astype(np.int32)


def dense(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    table = np.zeros((BUCKETS, DIM), np.float32)
    table[rows] = values
    return table


@dataclass
class ConvNet:
    table: np.ndarray  # buckets x dim
    kernels: list[np.ndarray]  # width x dim x filters each
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def __getstate__(self):
        rows = np.flatnonzero(self.table.any(1))  # the table is mostly zero: only its other rows travel
        return {**self.__dict__, "table": (rows.astype(np.int32), self.table[rows])}

    def __setstate__(self, state):
        self.__dict__ = {**state, "table": dense(*state["table"])}

    def convolve(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Responses of every filter at every word; words past the document's end count as zero vectors."""
        parts = []
        for k in self.kernels:
            z = e @ k[0]
            for j in range(1, len(k)):
                same = (doc[j:] == doc[:-j])[:, None]
                z[:-j] += np.where(same, e[j:] @ k[j], 0)
            parts.append(z)
        return np.concatenate(parts, 1)

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        e = self.table[buckets[:, 0]].copy()
        for k in range(1, buckets.shape[1]):
            e += self.table[buckets[:, k]]
        return e

    def score(self, buckets: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = pool_max(self.convolve(self.embed(buckets), doc), first) if len(doc) else np.zeros((len(first) - 1, len(self.out)), np.float32)
        return 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ self.out + self.bias).astype(float)))

    def score_texts(self, column: pa.Array) -> np.ndarray:
        done = [np.zeros(0)]
        for _, _, data, off in pieces(column):
            w = Words(data, off)
            done.append(self.score(word_buckets(w), w.doc, w.first))
        return np.concatenate(done)


def batches_of(order: np.ndarray, sizes: np.ndarray, batch: int, words: int):
    """Runs of ``order`` of at most ``batch`` documents and ``words`` words; a longer document is a run of its own."""
    at = 0
    while at < len(order):
        total = np.cumsum(sizes[order[at : at + batch]])
        n = max(1, int(np.searchsorted(total, words, "right")))
        yield order[at : at + n]
        at += n


def fit_net(bags: list[np.ndarray], y: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.03, prior: float = 60.0, seed: int = 11, batch_words: int = 1 << 16) -> ConvNet:
    """Trains on documents given as bucket rows.

    The table's first dimension starts from smoothed log-odds of a bucket's presence in toxic documents, which
    gives the pooled maxima something to find; everything is then trained by gradient (Adagrad). Buckets of a single
    document teach nothing about another: their rows, as those never seen, are and stay zero. No rows or one
    class give a constant score, the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    kernels = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    net = ConvNet(table, kernels, np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        table[:] = 0
        return net
    seen = np.zeros((2, BUCKETS))
    for bag, label in zip(bags, y):
        seen[int(label), np.unique(bag)] += 1
    share, total = y.mean(), seen.sum(0)
    table[:, 0] = np.log((seen[1] + prior * share) / (total + prior) / share).clip(-1, None)
    alive = total >= 2
    table[~alive] = 0
    kernels[0][0][:, 0] = 0
    kernels[0][0][0, 0] = 1
    net.out[:] = rng.normal(0, 0.1, len(net.out))
    net.out[0], net.bias = 1.0, -4.0
    table_sum = np.full_like(table, 1e-3)
    sums = [np.full_like(p, 1e-3) for p in (*kernels, net.out)]
    bias_sum = 1e-3
    sizes = np.array([len(b) for b in bags])
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(sizes > 0))
        for part in batches_of(order, sizes, batch, batch_words):
            x, first = np.concatenate([bags[k] for k in part]), np.concatenate([[0], np.cumsum(sizes[part])])
            doc = np.repeat(np.arange(len(part)), sizes[part])
            e = net.embed(x)
            z = net.convolve(e, doc)
            top = pool_max(z, first)
            p = 1 / (1 + np.exp(-(np.maximum(top, 0) @ net.out + net.bias)))
            error = ((p - y[part]) / len(part)).astype(np.float32)
            d_out, d_bias = np.maximum(top, 0).T @ error, float(error.sum())
            d_top = error[:, None] * net.out * (top > 0)
            row, column = np.nonzero(z == top[doc])
            where = np.zeros(top.shape, np.int64)
            where[doc[row], column] = row  # one place of each maximum
            touched, flows, d_kernels = [], [], []
            for n, k in enumerate(kernels):
                own = slice(n * FILTERS, (n + 1) * FILTERS)
                g, pos, dk = d_top[:, own], where[:, own], np.zeros_like(k)
                for j in range(len(k)):
                    to = np.minimum(pos + j, len(doc) - 1)
                    gj = np.where((pos + j < len(doc)) & (doc[to] == np.arange(len(part))[:, None]), g, 0)
                    dk[j] = np.einsum("dfe,df->ef", e[to], gj)
                    flow = gj[:, :, None] * k[j].T[None]
                    touched += [x[to, c].ravel() for c in range(x.shape[1])]
                    flows += [flow.reshape(-1, DIM)] * x.shape[1]
                d_kernels.append(dk)
            rows, at_row = np.unique(np.concatenate(touched), return_inverse=True)
            d_table = np.zeros((len(rows), DIM), np.float32)
            np.add.at(d_table, at_row, np.concatenate(flows))
            rows, d_table = rows[alive[rows]], d_table[alive[rows]]
            table_sum[rows] += d_table**2
            table[rows] -= rate * d_table / np.sqrt(table_sum[rows])
            for p_, s, d in zip((*kernels, net.out), sums, (*d_kernels, d_out)):
                s += d * d
                p_ -= rate * d / np.sqrt(s)
            bias_sum += d_bias**2
            net.bias -= rate * d_bias / bias_sum**0.5
    return net


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1: halfway to the next lower score; the middle of equally good cuts."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut can't fall between equal scores
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[len(best) // 2])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


_NET = T.StructType([T.StructField("net", T.BinaryType())])


def _train(batches):
    """One net from all rows of the partition, taken in order of the id."""
    rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
    rows.sort(key=lambda r: str(r[0]))
    net = fit_net([np.frombuffer(r[2], np.int32).reshape(-1, 1 + len(STEMS)) for r in rows], np.array([r[1] for r in rows], float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], _NET.names)


def _thresholds(bins: pd.DataFrame, least: int) -> pd.DataFrame:
    """The best cut from counts of (score bin, label): of all rows, or of a language; NaN without ``least`` rows of both labels."""
    order = bins.sort_values("bin")
    score, y = np.repeat(order["bin"], order["n"]).to_numpy() / BINS, np.repeat(order["label"], order["n"]).to_numpy(float)
    every = bool(bins["every"].iloc[0])
    enough = min(y.sum(), (1 - y).sum()) >= (1 if every else least)
    return pd.DataFrame({"every": [every], "lang": [bins["lang"].iloc[0]], "cut": [best_threshold(score, y) if enough else np.nan]})


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = 6_000, words: int = 4_000_000, calibrate: float = 1 / 3, least: int = 20) -> ConvNet:
    """A net fitted on a bounded sample of labelled rows outside the held-out fold, with a threshold for each language.

    A share ``calibrate`` of all labelled ids, by hash, is kept from the training. Of the others about ``sample`` times the
    rest's share are taken, and of these as many, in order of a hash, as hold ``words`` words at most (a row's words are
    taken whole; the first row always): that bounds the one task that trains. All labelled rows that were not taken, however
    many, are scored where they lie and counted by language, score to 1/``BINS`` and label; a language with ``least`` toxic
    and ``least`` clean rows among them takes its own best cut, any other the best cut of all. Only the net and the cuts
    reach the driver.
    """

    def buckets(column: pa.Array) -> pa.StructArray:
        out: list[bytes] = []
        for i, j, data, off in pieces(column):
            w = Words(data, off)
            b = word_buckets(w)
            out += [b[w.first[d] : w.first[d + 1]].tobytes() for d in range(j - i)]
        return struct_array(_WORDS, [out])

    texts = docs.select("doc_id", "text", "lang")
    aside = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(calibrate * (1 << 30))
    chosen = labelled(texts.select("doc_id", "text"), labels, "toxic", folds, held, int(sample * (1 - calibrate)), ~aside)
    rows = map_texts(chosen, "text", ["doc_id", "label"], buckets, _WORDS).select("doc.doc_id", "doc.label", "out.words")
    rows = materialise(rows, "toxicity-sample")
    size = (F.octet_length("words") / (4 * (1 + len(STEMS)))).cast("long")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # ids of the sample only
    inside = rows.select("doc_id", F.sum(size).over(before).alias("n"), size.alias("own")).filter((F.col("n") <= words) | (F.col("n") == F.col("own"))).select("doc_id")
    got = rows.join(inside, "doc_id", "left_semi").select("doc_id", "label", "words").repartition(1).mapInArrow(_train, _NET).collect()
    if got:
        net = pickle.loads(got[0]["net"])
    else:
        net = fit_net([], np.zeros(0))
    rest = labelled(texts, labels, "toxic", folds, held, None).join(F.broadcast(rows.select("doc_id")), "doc_id", "left_anti")  # at most the sample's ids
    scored = map_texts(rest, "text", ["lang", "label"], lambda c: struct_array(_SCORE, [net.score_texts(c)]), _SCORE)
    bins = scored.groupBy("doc.lang", "doc.label", F.round(F.col("out.score") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    both = bins.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("every"), "lang", "label", "bin", "n").filter("every OR lang IS NOT NULL")
    groups = both.select("every", F.when(F.col("every"), "").otherwise(F.col("lang")).alias("lang"), "label", "bin", "n").groupBy("every", "lang")
    for r in groups.applyInPandas(lambda x: _thresholds(x, least), "every boolean, lang string, cut double").filter("NOT isnan(cut)").collect():
        if r["every"]:
            net.threshold = r["cut"]
        else:
            net.thresholds[r["lang"]] = r["cut"]
    return net


def score_toxicity(docs: DataFrame, net: ConvNet, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``) and out.score, the chance that a text is toxic; only the text is read.

    Null and empty texts, and texts without words, get the score of no words. Equal texts get equal scores. A net from
    no labels, or labels of one kind, gives its smoothed share to every row.
    """
    return map_texts(docs, text, docs.columns if keep is None else keep, lambda c: struct_array(_SCORE, [net.score_texts(c)]), _SCORE)


def is_toxic(net: ConvNet, score: Column, lang: Column) -> Column:
    """The decision: the score against the threshold of the row's language, or of all where the language is null or unknown."""
    if not net.thresholds:
        return score >= net.threshold
    known = F.create_map(*[F.lit(x) for pair in net.thresholds.items() for x in pair])
    return score >= F.coalesce(F.try_element_at(known, lang), F.lit(net.threshold))
