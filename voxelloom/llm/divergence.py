"""Source divergence audit: how far each source's words lie from its language's and from other sources'."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.textbytes import BATCH_ROWS
from voxelloom.session import materialise

TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
PRIOR = 5  # added to every count
HELD = 400_000  # (group, term) entries a task holds before it hands them on
TILE, BUCKET = 256, 1024  # sources and terms of one block of the pair evaluation, on average


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, copies) for each distinct text of a language; copies is one (source, n) for each source that has it.

    Null values are empty ones. Texts are the same when their SHA-256 is. Copies are counted and dropped before the
    shuffle, so a text that fills a third of the table crosses it once for each map task.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]).withColumn("digest", F.unhex(F.sha2("text", 256)))
    counted = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = counted.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _count_terms(batches):
    """Occurrences and documents of each term by (lang, source): a text is cut into terms once and weighed by its copies."""
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def hand_on():
        for (lang, source), found in seen.items():
            terms = list(found)
            inside = docs[lang, source]
            for a in range(0, len(terms), 50_000):
                part = terms[a : a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array([t.decode() for t in part], pa.string()),
                     pa.array([inside[t] for t in part], pa.int64()), pa.array([found[t] for t in part], pa.int64())], ["lang", "source", "term", "docs", "count"])
        seen.clear()
        docs.clear()

    for batch in batches:
        langs, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for k, (lang, held) in enumerate(zip(langs, copies)):
            terms = TERM.findall(batch.column(1)[k].as_buffer().to_pybytes().lower())  # bytes: only A-Z are lowered
            some = None
            for copy in held:
                key = lang, copy["source"]
                if copy["n"] == 1:
                    seen[key].update(terms)
                    docs[key].update(set(terms))
                else:
                    some = some or Counter(terms)
                    a, b = seen[key], docs[key]
                    for t, n in some.items():
                        a[t] += n * copy["n"]
                        b[t] += copy["n"]
        if sum(map(len, seen.values())) > HELD:
            yield from hand_on()
    yield from hand_on()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, docs, count): documents of the source that hold the term, and its occurrences there."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found = collapse(docs, text, lang, source).mapInArrow(_count_terms, "lang string, source string, term string, docs long, count long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), in whole numbers."""
    above = (count + PRIOR).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (1 + F.call_function("div", above, (total + PRIOR * terms).cast("decimal(28,0)"))).cast("long")


def _pair_sums(block: pd.DataFrame) -> pd.DataFrame:
    """Sums over the block's terms of abs(p - q) less abs(p0 - q0), for each source of one tile with each of the other."""
    term, names = pd.factorize(block["term"])  # -1 for the row by which each source of a tile is known
    sides = []
    for side in (0, 1):
        mine = (block["side"] == side).to_numpy()
        source, sources = pd.factorize(block["source"][mine])
        p0 = np.zeros(len(sources), np.int64)
        p0[source] = block["p0"][mine]
        p = np.repeat(p0[:, None], len(names), 1)
        cell = mine & (term >= 0)
        p[source[term[mine] >= 0], term[cell]] = block["p"][cell]
        sides.append((np.asarray(sources, object), p0, p))
    (a, a0, pa_), (b, b0, pb) = sides
    value = np.zeros((len(a), len(b)), np.int64)
    for i in range(len(a)):
        value[i] = np.abs(pa_[i] - pb).sum(1) - len(names) * np.abs(a0[i] - b0)
    return pd.DataFrame({"lang": block["lang"].iloc[0] if len(block) else "", "a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "part": value.ravel()})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs in ``docs``.

    A language keeps the terms (runs of A-Z, which count as a-z, a-z and characters beyond ASCII) that at least
    ``least_docs`` of its documents hold. Every group, and every language, gives each kept term a smoothed share p of
    its kept occurrences, in units of 1e-9, floored. Part ``pair``: the sum of abs(p - q) over all kept terms, for every
    other source of the language. Part ``term``: the ``top`` kept terms of the group that it uses more than its
    language, by how much. Ranks go by value, then item.

    Pairs are evaluated in blocks of about ``TILE`` by ``TILE`` sources and ``BUCKET`` terms. A block holds
    its sources and the cells that occur; a term that neither source has adds abs(p0 - q0), whatever the term, which is added once for all of them.

    Nulls in the three columns are empty strings, so documents without a language are a language and documents without
    a source are a source. Texts without terms, and groups without kept terms, still make their group, whose shares are
    the smoothed ones; without kept terms in the language every pair is 0. Repeated rows count as often as they occur.
    Other columns are not read. An empty table gives no rows.
    """
    cells = materialise(term_counts(docs, text, lang, source), "term-counts")
    kept_terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).filter(F.col("docs") >= least_docs)
    kept_terms = materialise(kept_terms.select("lang", "term", "all"), "kept-terms")
    languages = kept_terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    kept = cells.join(kept_terms, ["lang", "term"]).select("lang", "source", "term", "count", "all")
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), empty).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), empty).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    wide = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    zero = F.lit(0).cast("long")
    groups = groups.join(wide, "lang").join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").select(
        "lang", "source", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), F.coalesce("terms", zero).alias("terms"), F.coalesce("total", zero).alias("total"), F.coalesce("size", zero).alias("size"))
    groups = materialise(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(zero, F.col("size"), F.col("terms")))), "sources")
    count, terms = F.col("count"), F.col("terms")
    shares = materialise(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "tiles", "tile", "p0", F.pmod(F.xxhash64("term"), F.ceil(terms / BUCKET)).cast("int").alias("bucket"),
        _share(count, F.col("size"), terms).alias("p"), _share(F.col("all"), F.col("total"), terms).alias("q")), "shares")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    own = ranked(shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).filter(F.col("rank") <= top)

    def on_tiles(rows: DataFrame, side: int) -> DataFrame:
        """Each row once for every tile that its own meets on this side."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        spread = rows.select("*", other)
        first, second = ("tile", "other") if side == 0 else ("other", "tile")
        return spread.withColumn("i", F.col(first)).withColumn("j", F.col(second))

    thin = shares.select("lang", "source", "term", "tiles", "tile", "bucket", "p0", "p")
    last = F.greatest(F.ceil(terms / BUCKET), F.lit(1)).cast("int") - 1
    names = groups.filter(terms > 0).select("lang", "source", F.lit(None).cast("string").alias("term"), "tiles", "tile", F.explode(F.sequence(F.lit(0), last)).alias("bucket"), "p0", F.col("p0").alias("p"))
    thin = thin.union(names)
    blocks = on_tiles(thin, 0).withColumn("side", F.lit(0)).union(on_tiles(thin, 1).withColumn("side", F.lit(1)))
    sums = blocks.select("lang", "bucket", "i", "j", "side", "source", "term", "p0", "p").groupBy("lang", "bucket", "i", "j").applyInPandas(_pair_sums, "lang string, a string, b string, part long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    a = on_tiles(groups, 0).select("lang", "i", "j", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    b = on_tiles(groups, 1).select("lang", "i", "j", F.col("source").alias("b"), F.col("p0").alias("b0"))
    met = a.join(b, ["lang", "i", "j"]).filter(F.col("a") != F.col("b")).join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("part", zero) + F.coalesce(F.col("terms") * F.abs(F.col("a0") - F.col("b0")), zero)
    pairs = ranked(met.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value")))
    return pairs.union(own)
