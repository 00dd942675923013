"""Benchmark decontamination: normalised word windows of test items, found again in training text."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.textbytes import Words, map_texts, pieces, struct_array
from voxelloom.session import materialise

BLOCK = 200_000  # (window, item) pairs broadcast at once; more pairs go in further passes

_WINDOWS = T.StructType([T.StructField("windows", T.ArrayType(T.BinaryType()))])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("items_sha256", T.StringType()), T.StructField("clean", T.StringType())])


def _item_windows(column: pa.Array, length: int) -> pa.StructArray:
    out: list[list[bytes]] = []
    for i, j, data, off in pieces(column):
        w = Words(data, off)
        text, start, end = w.normal()
        text = text.tobytes()
        for d in range(j - i):
            a, b = w.first[d], w.first[d + 1]
            size = min(length, b - a)
            out.append(list({text[start[k] : end[k + size - 1]] for k in range(a, b - size + 1)}) if size else [])
    return struct_array(_WINDOWS, [out])


class Gram:
    """Windows of one block, sorted hashes first: a bitmap and a search answer almost all misses in numpy."""

    BITS = 21

    def __init__(self, pairs: list[tuple[bytes, int | None]]):
        self.items: dict[bytes, list[int]] = {}
        for window, item in pairs:
            self.items.setdefault(window, []).append(item)
        self.hashes: dict[int, np.ndarray] = {}
        self.bitmap: dict[int, np.ndarray] = {}
        for window in self.items:
            self.hashes.setdefault(window.count(b" ") + 1, []).append(window)
        for size, windows in self.hashes.items():
            joined = np.frombuffer(b"\n".join(windows), np.uint8)
            lengths = np.fromiter(map(len, windows), np.int64, len(windows)) + 1
            off = np.concatenate([[0], np.cumsum(lengths)])
            off[-1] -= 1
            _, hashes = Words(joined, off).windows(size)
            self.hashes[size] = np.unique(hashes)
            self.bitmap[size] = np.zeros(1 << self.BITS, bool)
            self.bitmap[size][(self.hashes[size] & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True


def _scan(gram: Gram, w: Words):
    """(document, first word, words, items) of every verified window."""
    normal = None
    for size, known in gram.hashes.items():
        at, hashes = w.windows(size)
        near = np.flatnonzero(gram.bitmap[size][(hashes & np.uint64((1 << gram.BITS) - 1)).astype(np.int64)])
        near = near[np.isin(hashes[near], known)]
        if not len(near):
            continue
        if normal is None:
            text, start, end = w.normal()
            normal = text.tobytes()
        for k in at[near]:
            items = gram.items.get(normal[start[k] : end[k + size - 1]])  # the words themselves, not their hash
            if items is not None:
                yield int(w.doc[k]), int(k - w.first[w.doc[k]]), size, items


def _find(column: pa.Array, gram) -> pa.StructArray:
    gram = gram.value
    n_words, runs, items = [], [], []
    for i, j, data, off in pieces(column):
        w = Words(data, off)
        n_words.append(np.diff(w.first))
        run: dict[int, list[int]] = {}
        found: dict[int, set] = {}
        for d, k, size, ids in _scan(gram, w):
            run.setdefault(d, []).extend((k, k + size))
            found.setdefault(d, set()).update(ids)
        runs += [np.array(run[d], np.int32).tobytes() if d in run else b"" for d in range(j - i)]
        items += [sorted(x for x in found.get(d, ()) if x is not None) for d in range(j - i)]
    return struct_array(_FOUND, [np.concatenate(n_words) if n_words else [], runs, items])


def _summed(batches, length_of_doc: bool):
    for batch in batches:
        doc, text = batch.column(0), batch.column(1)
        n_words, runs, items = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        n_hit, digest, clean, kept_items = [], [], [], []
        for row, (run, found) in enumerate(zip(runs, items)):
            found = sorted(set(found), key=str)
            kept_items.append(found)
            digest.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
            pairs = np.frombuffer(b"".join(run), np.int32).reshape(-1, 2)
            if not len(pairs):
                n_hit.append(0)
                clean.append(text[row].as_py() if length_of_doc else None)
                continue
            step = np.zeros(n_words[row] + 1, np.int32)
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 1], -1)
            hit = np.cumsum(step[:-1]) > 0
            n_hit.append(int(hit.sum()))
            clean.append(_without(text[row].as_py(), hit) if length_of_doc else None)
        yield pa.RecordBatch.from_arrays([doc, struct_array(_RESULT, [n_words, n_hit, kept_items, digest, clean])], ["doc", "out"])


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, last = [], 0
    for a, b in edge.reshape(-1, 2):
        out.append(data[last : w.start[a]].tobytes())
        last = int(w.end[b - 1])
    return b"".join([*out, data[last:].tobytes()]).decode()


def benchmark_windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(window, item_id), distinct: every run of ``length`` words of an item, or all its words if there are fewer."""
    found = map_texts(benchmark, "text", ["item_id"], partial(_item_windows, length=length), _WINDOWS)
    return found.select(F.explode("out.windows").alias("window"), F.col("doc.item_id").cast("long").alias("item_id")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", length: int = 10, block: int = BLOCK, clean: bool = False) -> DataFrame:
    """doc (struct of the columns ``keep``) and out (n_words, n_hit, items, items_sha256, clean) for each row of ``docs``.

    Words are runs of digits, letters and characters from U+0080, with A-Z lower-cased. A document word is hit if it
    lies in an occurrence of a benchmark window. The windows are broadcast in blocks of at most ``block`` pairs; one
    block is one pass over the texts, and passes after the first start from a written table. A hash hit counts only
    if the words agree.

    Null and empty texts have no words and are not hit. Items without words have no window; an item with a null id
    hits words but is not listed. Repeated rows and ids are judged row by row. An empty benchmark hits nothing.
    ``clean`` asks for the text without hit words (null otherwise).
    """
    keep = docs.columns if keep is None else keep
    state = _found(docs, benchmark, keep, text, length, block, clean)
    if not clean:
        state = state.withColumn("text", F.lit(None).cast("string"))
    return state.select("doc", "text", "n_words", "runs", "items").mapInArrow(partial(_summed, length_of_doc=clean), T.StructType([state.schema["doc"], T.StructField("out", _RESULT)]))


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str, length: int, block: int, with_text: bool) -> DataFrame:
    """doc, text (if asked for or if there are more passes), n_words, and what each pass found: runs of hit words, items."""
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(benchmark, length), "windows")
    passes = max(1, -(-windows.count() // block))
    part = F.pmod(F.xxhash64("window", "item_id"), F.lit(passes))
    carried = ["doc", "text"] if with_text or passes > 1 else ["doc"]
    state = None
    for k in range(passes):
        pairs = [(bytes(r["window"]), r["item_id"]) for r in windows.filter(part == k).collect()]  # at most about `block` rows
        find = partial(_find, gram=spark.sparkContext.broadcast(Gram(pairs)))
        if k:
            state = materialise(state, "contamination")
            found = map_texts(state, "text", state.columns, find, _FOUND)
            state = found.select(*[f"doc.{c}" for c in carried], "doc.n_words", F.concat("doc.runs", F.array("out.runs")).alias("runs"), F.concat("doc.items", "out.items").alias("items"))
        elif len(carried) > 1:
            both = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
            state = map_texts(both, "text", carried, find, _FOUND).select("doc.doc", "doc.text", "out.n_words", F.array("out.runs").alias("runs"), "out.items")
        else:
            state = map_texts(docs, text, keep, find, _FOUND).select("doc", "out.n_words", F.array("out.runs").alias("runs"), "out.items")
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", length: int = 10) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``) or with the hit words cut out of their text ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    if remove == "documents":
        return _found(docs, benchmark, docs.columns, text, length, BLOCK, False).filter(F.forall("runs", lambda r: F.length(r) == 0)).select("doc.*")
    found = find_contamination(docs, benchmark, text=text, length=length, clean=True)
    cut = F.when(F.col("out.n_hit") > 0, F.col("out.clean")).otherwise(F.col(f"doc.`{text}`"))
    return found.select(*[cut.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
