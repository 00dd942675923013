"""Decontamination, BPE, near copies, classifiers and the pipeline against plain Python or held-out labels."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from tests.llm import brute
from voxelloom.llm import bpe, dartminhash, decontamination, langid, quality, queries, textbytes, toxicity

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
ODD = [None, "", "!!!", "a", "é" * 3, "x" * 4000, "A b C d E f G h I j K l", "\x00 \n", "words " * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "z", 1) for k, t in enumerate(texts)], "doc_id long, text string, out string, key int")


def test_words_and_windows_in_small_pieces():
    texts = [*(t or "" for t in ODD), "Ab,cd-é1 X", "tail"]
    for limit in (1, 7, 1 << 20):
        got = []
        for i, j, data, off in textbytes.pieces(pa.array(texts).slice(0), limit):
            w = textbytes.Words(data, off)
            text, start, end = w.normal()
            got += [[text[start[k] : end[k]].tobytes().decode() for k in range(w.first[d], w.first[d + 1])] for d in range(j - i)]
        assert got == [brute.words(t) for t in texts]


@pytest.mark.parametrize("block", [200_000, 3])
def test_contamination(spark, block):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ß9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([0, 1, 4, 9, 10, 11, 25, 40])] + [(None, "null item words here"), (3, "same id again"), (10, None)]
    texts = [*ODD, "w1, W2! w3"] + [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(40)] + ["start " + items[rng.randrange(1, 8)][1].upper().replace(" ", "; ") + " end" for _ in range(30)] + ["x null item words here y"]
    df, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(list(enumerate(texts)), items)
    got = decontamination.find_contamination(df.repartition(3), bench, block=block).collect()
    assert {r["doc"]["doc_id"]: (r["out"]["n_words"], r["out"]["n_hit"], r["out"]["items"]) for r in got} == want
    assert all(r["out"]["items_sha256"] == brute.sha(",".join(map(str, r["out"]["items"]))) for r in got)
    kept = decontamination.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in want.items() if not v[1]) and kept.columns == df.columns
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(df, bench, remove="spans").collect()}
    assert all(len(brute.words(cut[k])) == v[0] - v[1] for k, v in want.items()) and all(cut[k] == texts[k] for k, v in want.items() if not v[1])
    assert decontamination.decontaminate(df, bench.filter("false")).count() == len(texts) and decontamination.decontaminate(df.filter("false"), bench).count() == 0


def test_bpe_is_that_of_the_library(spark):
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ODD + ["<|endoftext|> it's 12 😀", " " * 900, "ab" * 900] + ["".join(chr(rng.randrange(32, 0x2FF)) for _ in range(300)) for _ in range(20)]
    df = frame(spark, texts)
    got = {r["doc"]["doc_id"]: r["out"] for r in bpe.round_trip(df, ranks, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), brute.sha(t or ""))
    coded = bpe.encode(df, ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select("doc.doc_id", "out.ids")
    assert {r["doc"]["doc_id"]: r["out"]["text"] for r in bpe.decode(coded, ranks).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.encode(df.filter("false"), ranks, public_tokenizers.PATTERN).count() == 0


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    coder = bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(queries.RANKS))), public_tokenizers.PATTERN)
    texts = ["one two three four", "two three five six seven eight", ""]
    assert [coder.vocabulary.decode(x).decode() for x in coder.encode(texts) + coder.encode(texts)] == texts * 2


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    element = textbytes.mix64(np.arange(400, dtype=np.uint64))
    for weights in (np.ones((2, 400)), rng.integers(1, 9, (2, 400)).astype(float), rng.random((2, 400)) * 3):
        weights[0, :60] = 0
        weights[1, 340:] = 0
        a, b = (dartminhash.dart_minhash(element[w > 0], w[w > 0], np.array([0, (w > 0).sum()]), 4096)[0] for w in weights)
        assert abs((a == b).mean() - np.minimum(*weights).sum() / np.maximum(*weights).sum()) < 0.04


def edited(rng, words, share):
    return [rng.choice("qwertz") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("direct", [16, 2])
def test_near_copies_are_those_of_all_pairs(spark, direct):
    rng = random.Random(6)
    base = [[f"t{rng.randrange(10**5)}" for _ in range(rng.choice([30, 80, 200]))] for _ in range(12)]
    passage = [f"p{k}" for k in range(60)]
    texts = [*ODD, "a", "A!", "one two three", "One, two; three"]
    texts += [" ".join(edited(rng, base[k % 12], 0.012)) for k in range(90)] + [" ".join(edited(rng, base[0], 0.025)) for _ in range(60)]
    texts += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(14 + k % 30)]) for k in range(60)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in dartminhash.near_duplicates(frame(spark, texts).repartition(4), settings=dartminhash.Settings(direct=direct)).collect()}
    want = brute.clusters(rows)
    assert {k: r["cluster_id"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == set(want.values())
    sets = {k: brute.shingles(t) for k, t in rows}
    assert all(got[k]["class_id"] == min([j for j, s in sets.items() if s == sets[k]] if sets[k] else [k]) for k in got)


def test_near_copies_with_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (None, "a b c d e f", 2), (7, None, 3), (7, None, 3), (None, "", 4), (8, "a b c d e f!", 5)], "doc_id long, text string, label int")
    kept = dartminhash.drop_near_duplicates(df)
    assert sorted(r["label"] for r in kept.collect()) == [1, 3, 3, 4] and kept.columns == df.columns
    assert dartminhash.near_duplicates(df.filter("false")).count() == 0


def test_forest_and_statistics():
    rng = np.random.default_rng(7)
    x = rng.random((600, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = quality.fit_forest(x[:400], y[:400])
    assert ((forest.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.93

    def walk(row):
        total = forest.start
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[400:430]], forest.score(x[400:430]))
    assert np.allclose(quality.fit_forest(x[:0], y[:0]).score(x[:3]), 0.5) and quality.fit_forest(x[:9], np.ones(9)).score(x[:2])[0] > 0.8
    texts = pa.array([*ODD, "one two\ntwo two\none two"])
    many = quality.statistics(texts)
    assert np.isfinite(many).all() and np.allclose(many, np.concatenate([quality.statistics(texts.slice(k, 1)) for k in range(len(texts))]))
    last = many[-1]
    assert np.allclose(last[[1, 5, 6, 10, 12]], [np.log1p(6), 2 / 6, 4 / 6, 2 / 6, 2 / 3])


def held(ids, folds, k):
    return np.array([zlib.crc32(str(i).encode()) % folds == k for i in ids])


def scored(spark, name, label):
    got = queries.QUERIES[name](spark, SMALL).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().groupby("doc_id")[label].max()
    both = got.join(truth, how="inner")
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    return both[both["held_out"]], got


@needs_data
def test_quality_of_held_out_rows(spark):
    rows, got = scored(spark, "op2_quality", "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95 and (got["held_out"].to_numpy() == held(got.index, 5, 0)).all()


@needs_data
def test_toxicity_of_held_out_rows(spark):
    rows, got = scored(spark, "op5_toxicity", "toxic")
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.9 and (got["held_out"].to_numpy() == held(got.index, 4, 2)).all()


def test_toxicity_learns_words_and_thresholds(spark):
    rng = random.Random(8)
    texts, langs, marks = [], [], []
    for k in range(900):
        w = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60)]
        toxic = k % 5 == 0
        for at in rng.sample(range(60), 3) if toxic else ():
            w[at] = rng.choice(["vilest", "scumbag"]) + rng.choice(["", "s", "ish"])
        texts.append(" ".join(w)), langs.append("de" if k % 2 else "en"), marks.append(int(toxic))
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)] + [(1, None)], "doc_id long, toxic int")
    net = toxicity.fit_toxicity(df, labels)
    assert set(net.thresholds) == {"de", "en"}
    got = {r["doc"]["doc_id"]: r["out"]["score"] for r in toxicity.score_toxicity(df, net, keep=["doc_id"]).collect()}
    test = [k for k in range(900) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.3) == marks[k] for k in test]) > 0.97
    flat = toxicity.fit_toxicity(df, labels.filter("false"))
    assert {r["out"]["score"] for r in toxicity.score_toxicity(frame(spark, ODD), flat).collect()} == {0.5}
    assert toxicity.score_toxicity(df.filter("false"), net).count() == 0
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5


@needs_data
def test_language_of_held_out_rows(spark):
    got = queries.QUERIES["op10_language"](spark, SMALL).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    rows = got[got["held_out"]].join(truth).dropna(subset=["lang"])
    assert len(got) == 1000 and (rows["lang_pred"] == rows["lang"]).mean() > 0.93 and (got["held_out"].to_numpy() == held(got.index, 5, 0)).all()


def test_language_windows_cover_all_bytes(spark):
    data = np.frombuffer(("abc" * 300).encode(), np.uint8)
    rows, doc, used = langid.windows(data, np.array([0, 0, 5, len(data)]))
    assert b"".join(r[:u].tobytes() for r, u in zip(rows, used)) == data.tobytes() and doc.tolist() == [1] + [2] * 4
    nothing = langid.fit_bytes([], [])
    assert nothing.detect(pa.array(["abc", None])) == (["und", "und"], [0.0, 0.0])
    df = spark.createDataFrame([(k, t, g) for k in range(60) for t, g in ((f"the cat {k}" * 20, "en"), (f"der Hund {k}" * 20, "de"))] + [(None, "x", "fr"), (3, None, "fr")], "doc_id long, text string, lang string")
    net = langid.fit_languages(df)
    got = {r["doc"]["doc_id"]: r["out"] for r in langid.detect_languages(frame(spark, ["the cat " * 900, "der Hund", "123", "", None]), net).collect()}
    assert [got[k]["lang"] for k in range(5)] == ["en", "de", "und", "und", "und"] and net.langs == ["de", "en"]
    assert langid.detect_languages(df.filter("false"), net).count() == 0 and langid.fit_languages(df.filter("false")).langs == []


@needs_data
def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    tame = corpus_pipeline.STAGES[0][1](spark, docs, TINY)
    assert tame.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in tame.collect()]
    stays = {i for i, (keep, _, _) in brute.copies(rows).items() if i == keep}
    rows = [x for x in rows if x[0] in stays]
    stays = {i for i, root in brute.clusters(rows).items() if i == root}
    rows = [x for x in rows if x[0] in stays]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    found = brute.contamination(rows, items)
    rows = [x for x in rows if not found[x[0]][1]]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    want = {i: (len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t or "")) for i, t in rows}
    got = corpus_pipeline.run(spark, TINY)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want
