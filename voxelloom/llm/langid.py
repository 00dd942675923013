"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.sampling import _STEPS, fold
from voxelloom.llm.textbytes import LOWER, map_texts, pieces, struct_array
from voxelloom.session import materialise

SPAN = 256  # bytes of a window
DIM, FILTERS, WIDTHS = 8, 8, (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
_ROWS = T.StructType([T.StructField("rows", T.BinaryType())])
_FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x SPAN bytes, zero past the end of a text; document; bytes in use). Every byte is in one window."""
    size = np.diff(off)
    count = -(-size // SPAN)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[doc] + k * SPAN
    used = np.minimum(SPAN, off[doc + 1] - begin)
    at = begin[:, None] + np.arange(SPAN)
    inside = np.arange(SPAN) < used[:, None]
    return np.where(inside, LOWER[data][np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(doc) else np.zeros((0, SPAN), np.uint8), doc, used


@dataclass
class ByteNet:
    langs: list[str]
    table: np.ndarray  # 256 x dim; byte 0 is the zero vector
    kernels: list[np.ndarray]  # width x dim x filters each
    out: np.ndarray
    bias: np.ndarray

    def lookups(self) -> list[list[tuple[int, np.ndarray]]]:
        """The filters as tables: what a pair of bytes (or the last byte of an odd width) adds, by place in the filter."""
        found = []
        for k in self.kernels:
            single = [self.table @ k[j] for j in range(len(k))]
            parts = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)) for j in range(0, len(k) - 1, 2)]
            found.append(parts + ([(len(k) - 1, single[-1])] if len(k) % 2 else []))
        return found

    def log_chances(self, rows: np.ndarray, lookups: list) -> np.ndarray:
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        pooled = []
        for k, parts in zip(self.kernels, lookups):
            n = SPAN - len(k) + 1
            z = 0
            for j, values in parts:
                z = z + values[(pair if len(values) > 256 else rows)[:, j : j + n]]
            pooled.append(z.max(1))
        return log_softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias)

    def detect(self, column: pa.Array) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        lookups = self.lookups() if self.langs else []
        for i, j, data, off in pieces(column):
            letter = [bool(_LETTER.search(t or "")) for t in column[i:j].to_pylist()]
            if not self.langs:
                langs += ["und"] * (j - i)
                scores += [0.0] * (j - i)
                continue
            rows, doc, used = windows(data, off)
            logs = np.zeros((j - i, len(self.langs)))
            for at in range(0, len(rows), 512):
                part = slice(at, at + 512)
                np.add.at(logs, doc[part], self.log_chances(rows[part], lookups) * used[part, None])
            chance = np.exp(log_softmax(logs / np.maximum(np.diff(off), 1)[:, None]))
            best = chance.argmax(1)  # the first of equals, in the order of the names
            langs += [self.langs[b] if ok else "und" for b, ok in zip(best, letter)]
            scores += [float(chance[d, b]) if ok else 0.0 for d, (b, ok) in enumerate(zip(best, letter))]
        return langs, scores


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def spread_windows(column: pa.Array, per_text: int) -> pa.StructArray:
    """Up to ``per_text`` windows of each text, evenly spread over all of it."""
    out: list[bytes] = []
    for i, j, data, off in pieces(column):
        rows, doc, _ = windows(data, off)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        for a, b in zip(first[:-1], first[1:]):
            m = min(per_text, b - a)
            out.append(rows[a + ((np.arange(m) + 0.5) * (b - a) / max(m, 1)).astype(np.int64)].tobytes())
    return struct_array(_ROWS, [out])


def fit_bytes(samples: list[bytes], langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.05, seed: int = 3) -> ByteNet:
    """Trains on the windows of each sample. One language gets all texts; none gives ``und``."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
    table[0] = 0
    kernels = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    net = ByteNet(names, table, kernels, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    parts, labels = [], []
    for sample, lang in zip(samples, langs):
        if sample:
            parts.append(np.frombuffer(sample, np.uint8).reshape(-1, SPAN))
            labels += [names.index(lang)] * len(parts[-1])
    if len(names) < 2 or not parts:
        return net
    rows, y = np.concatenate(parts), np.array(labels)
    sums = [np.full_like(p, 1e-3) for p in (table, *kernels, net.out, net.bias)]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            b = rows[pick]
            e = table[b]
            tops, places = [], []
            for k in kernels:
                n = SPAN - len(k) + 1
                z = sum(e[:, j : j + n] @ k[j] for j in range(len(k)))
                where = z.argmax(1)
                places.append(where)
                tops.append(np.take_along_axis(z, where[:, None], 1)[:, 0])
            top = np.concatenate(tops, 1)
            hidden = np.maximum(top, 0)
            chance = np.exp(log_softmax(hidden @ net.out + net.bias))
            chance[np.arange(len(pick)), y[pick]] -= 1
            error = (chance / len(pick)).astype(np.float32)
            d_top = (error @ net.out.T) * (top > 0)
            d_table, d_kernels, mine = np.zeros_like(table), [], np.arange(len(pick))[:, None]
            for n, (k, where) in enumerate(zip(kernels, places)):
                g, dk = d_top[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(k)
                for j in range(len(k)):
                    dk[j] = np.einsum("dfe,df->ef", e[mine, where + j], g)
                    np.add.at(d_table, b[mine, where + j].ravel(), (g[:, :, None] * k[j].T[None]).reshape(-1, DIM))
                d_kernels.append(dk)
            d_table[0] = 0
            for p, s, d in zip((table, *kernels, net.out, net.bias), sums, (d_table, *d_kernels, hidden.T @ error, error.sum(0))):
                s += d * d
                p -= rate * d / np.sqrt(s)
    return net


def fit_languages(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = 500, per_text: int = 4, most: int = 200) -> ByteNet:
    """A net fitted on about ``sample`` texts of each language outside the held-out fold, ``per_text`` windows of each.

    Rows without a text, language or id teach nothing. At most about ``sample`` x ``most`` texts are taken: more than
    ``most`` languages share them evenly, and of very many some may have none. An id that occurs more than once teaches
    with its smallest text of a language.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return fit_bytes([], [])
    each = min(sample, sample * most / languages)
    share = counts.select("lang", (F.least(F.lit(1.0), each / F.greatest("n", F.lit(1))) * _STEPS).cast("long").alias("share"))
    got = known.join(share, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(_STEPS)) < F.col("share")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sent = map_texts(got, "text", ["doc_id", "lang"], lambda c: spread_windows(c, per_text), _ROWS).select("doc.doc_id", "doc.lang", "out.rows")
    rows = sorted(sent.collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["rows"])))
    return fit_bytes([bytes(r["rows"]) for r in rows], [r["lang"] for r in rows])


def detect_languages(docs: DataFrame, net: ByteNet, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc (struct of the columns ``keep``) and out (lang, score) for each row, from all windows of its text.

    A text that is null or has no letter is ``und`` with score 0; so is every text when nothing was learned. The
    windows' log chances are averaged by the bytes in use; score is the chance of the language that wins, the first
    by name of equals.
    """
    return map_texts(docs, text, docs.columns if keep is None else keep, lambda c: struct_array(_FOUND, list(net.detect(c))), _FOUND)
