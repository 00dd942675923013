"""Quality classifier: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.sampling import labelled
from voxelloom.llm.textbytes import IS_WORD, Prefix, Words, map_texts, per_doc, pieces, struct_array

_STATS = T.StructType([T.StructField("stats", T.ArrayType(T.FloatType()))])
_SCORE = T.StructType([T.StructField("score", T.DoubleType())])
_UPPER, _DIGIT = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((65, 91), (48, 58)))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".,;:'\"-()"))
_ODD = ~IS_WORD & ~_SPACE & ~_STOP & (np.arange(256) < 128)


def _top_share(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of different values, and how often the most frequent one occurs."""
    different, most = np.zeros(n_docs), np.zeros(n_docs)
    if len(doc):
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        np.add.at(different, d[edge], 1)
        np.maximum.at(most, d[edge], np.diff(np.append(edge, len(d))))
    return different, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text: sizes, shares of kinds of characters, repeats of words, pairs and lines."""
    rows = []
    for i, j, data, off in pieces(column):
        w, n = Words(data, off), j - i
        size = np.diff(off)
        n_words = np.diff(w.first)
        one, some = np.maximum(size, 1), np.maximum(n_words, 1)
        length = (w.end - w.start).astype(float)
        mean = per_doc(length, w.first) / some
        kinds, most = _top_share(w.doc, w.hash, n)
        at, pair = w.windows(2)
        pair_kinds, pair_most = _top_share(w.doc[at], pair, n)
        pairs = np.maximum(n_words - 1, 1)
        twice = np.zeros(len(w.hash), np.int64)
        if len(at):
            twice[at] = w.hash[at] == w.hash[at + 1]
        # lines: from each start to the next line feed or the end of the text
        end = np.unique(np.concatenate([np.flatnonzero(data == 10), off[1:][size > 0] - 1]))
        begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        line_doc = np.searchsorted(off, begin, "right") - 1
        n_lines = np.bincount(line_doc, minlength=n) if len(end) else np.zeros(n)
        line_kinds, _ = _top_share(line_doc, Prefix(data).of(begin, end + (data[end] != 10)), n)
        lines = np.maximum(n_lines, 1)
        share = [per_doc(flag, off) / one for flag in (_UPPER[data], _DIGIT[data], _SPACE[data], _STOP[data], _ODD[data], data >= 128, data == 33, data == 124, data == 10)]
        capital = per_doc(_UPPER[data[w.start]] if len(w.start) else np.zeros(0, bool), w.first) / some
        rows.append(np.column_stack([
            np.log1p(size), np.log1p(n_words), mean, np.sqrt(np.maximum(per_doc(length**2, w.first) / some - mean**2, 0)), per_doc(length > 15, w.first) / some,
            kinds / some, most / some, np.log1p(most), pair_kinds / pairs, pair_most / pairs, per_doc(twice, w.first) / some,
            np.log1p(n_lines), line_kinds / lines, np.log1p(size / lines), capital, n_words / one, *share]).astype(np.float32))
    return np.concatenate(rows) if rows else np.zeros((0, 25), np.float32)


@dataclass
class Forest:
    """Complete binary trees in arrays: node k of a tree has its children at 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right above it
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1; all trees step down together."""
        trees, depth = np.arange(len(self.feature))[None, :], int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[trees, node]] > self.cut[trees, node])
        total = self.start + (self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(self.feature) else 0.0)
        return 1 / (1 + np.exp(-total)) * np.ones(len(x))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Forest:
    """Boosted trees on binned features, logistic loss. One class or no rows give the smoothed share of label 1."""
    n, width = x.shape
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])  # bin b: edge[b-1] < x <= edge[b]
    flat = binned + np.arange(width) * bins
    raw = np.full(n, start)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * bins) + flat).ravel()
            g, h = (np.bincount(key, np.repeat(v, width), many * width * bins).reshape(many, width, bins).cumsum(2) for v in (grad, curve))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6:
                    out.feature[t, first + k], out.cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, curve))
        out.leaf[t] = rate * g / (h + ridge)
        raw += out.leaf[t][node - inner]
    return out


def document_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``) and out.stats for each row."""
    return map_texts(docs, text, docs.columns if keep is None else keep, lambda c: struct_array(_STATS, [statistics(c).tolist()]), _STATS)


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 10_000) -> Forest:
    """Trees fitted on about ``sample`` labelled rows outside the held-out fold; only those rows' statistics reach the driver.

    Without such rows (no documents, no labels, or all ids in the held-out fold) the model is a constant, one half.
    """
    rows = document_statistics(labelled(docs.select("doc_id", "text"), labels, "quality", folds, held, sample), keep=["doc_id", "label"])
    got = rows.select("doc.doc_id", "doc.label", "out.stats").orderBy("doc_id").toPandas()
    x = np.array(got["stats"].tolist(), np.float32).reshape(len(got), statistics(pa.array([""])).shape[1])
    return fit_forest(x, got["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Forest, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``) and out.score, the chance that a text is of label 1.

    Only the text is read. Null and empty texts are scored by the statistics of an empty text, equal texts alike.
    A model from no labels, or labels of one kind, gives its smoothed share to every row.
    """
    return map_texts(docs, text, docs.columns if keep is None else keep, lambda c: struct_array(_SCORE, [model.score(statistics(c))]), _SCORE)
