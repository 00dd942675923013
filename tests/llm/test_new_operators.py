"""Hard negatives, source divergence and token files against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelloom.llm import divergence, hard_negatives, queries, token_files

# ---- hard negatives


def plain_negatives(rows, scale=256.0, positives=5, negatives=10, low=30, high=90):
    """By comparing every anchor with every row, in Python's whole numbers."""
    items = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (label, [int(np.floor(scale * float(x))) for x in v])
        items[i] = min(items.get(i, one), one)
    out = set()
    for a, (label, v) in items.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in items.items() if i != a}
        best = sorted((i for i in score if items[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            inside = [i for i in score if items[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(sorted(inside, key=lambda i: (-score[i], i))[:negatives])}
    return out


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, score int")
    got = hard_negatives.mine_hard_negatives(df.repartition(parts), F.col("id") % 100 == 0, **more).collect()
    found = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got}
    assert len(found) == len(got)
    return found


def test_residues_give_exact_products():
    rng = np.random.default_rng(1)
    for width, size in ((0, 5), (1, 2**31 - 1), (3, 10**6), (64, 300), (65, 700), (200, 10**4), (130, 10**7)):
        a, b = (rng.integers(-size, size + 1, (7, width)) for _ in range(2))
        bound = float(np.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max())) if width else 0.0
        primes = hard_negatives.primes_for(bound)
        got = hard_negatives.Residues(a, primes).dot(hard_negatives.Residues(b, primes))
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert len(hard_negatives.primes_for(2.0**62)) == len(hard_negatives.PRIMES)


@pytest.mark.parametrize("rows_of,anchors_of,tile", [(4096, 8192, 512), (7, 2, 1)])
def test_hard_negatives(spark, monkeypatch, rows_of, anchors_of, tile):
    for name, value in (("ROWS", rows_of), ("ANCHORS", anchors_of), ("TILE", tile), ("SHARD", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(2)
    rows = [(100 * k if k < 6 else 100 * k + rng.randrange(1, 99), rng.choice([0, 0, 0, 1, 2]), [rng.randrange(-8, 9) / 8 for _ in range(5)]) for k in range(60)]
    rows += [(7001 + k, k % 2, [0.5, 0.25, 0.0, 0.0, 0.0]) for k in range(12)]  # equal scores
    rows += [(None, 1, [1.0] * 5), (9100, None, [1.0] * 5), (9101, 1, None), (9102, 1, [1.0, None]), (9103, 0, [float("nan")] * 5), (9104, 0, [float("inf")] * 5), (9200, 9, [1.0] * 5), (9300, 1, []), (9301, 0, [3.0]), (9302, 1, [1.0] * 8)]
    rows += [(200, 5, [9.0] * 5), rows[0], rows[0], (-100, 0, [1e4, -1e4, 0.3, 0.0, 1.0])]
    assert mined(spark, rows) == plain_negatives(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, [], 1) == set() and mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == set()
    rows = [(100, 0, [1.0]), (1, 0, [1.0]), (2, 1, [0.5]), (3, 0, [-1.0])]
    assert mined(spark, rows) == plain_negatives(rows) and len(mined(spark, rows)) == 1
    assert mined(spark, rows, positives=1, negatives=1, low=0, high=100) == plain_negatives(rows, positives=1, negatives=1, low=0, high=100)
    assert mined(spark, [(0, 0, [1e300]), (1, 0, [1.0]), (2, 1, [0.5])]) == set()  # its scores need not fit


# ---- divergence


def plain_audit(rows, least=30, top=50):
    docs, count, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.decode() for t in divergence.TERM.findall((text or "").encode().lower())]
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    out = set()

    def shares(get, terms):
        total = sum(get(t) for t in terms)
        return {t: 1 + (10**9 * (get(t) + 5)) // (total + 5 * len(terms)) for t in terms}

    for lang in {g[0] for g in groups}:
        own = sorted(s for x, s in groups if x == lang)
        p = {s: shares(lambda t: count[lang, s, t], kept[lang]) for s in own}
        q = shares(lambda t: sum(count[lang, s, t] for s in own), kept[lang])
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept[lang]), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((q[t] - p[s][t], t) for t in kept[lang] if count[lang, s, t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out |= {(lang, s, part, item, -v, k + 1) for part, rows_ in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(rows_)}
    return out


@pytest.mark.parametrize("tile,bucket,held", [(256, 1024, 400_000), (2, 3, 1)])
def test_divergence(spark, monkeypatch, tile, bucket, held):
    for name, value in (("TILE", tile), ("BUCKET", bucket), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = [f"w{chr(97 + k)}x" for k in range(14)] + ["É", "ß", "Grün", "漢字", "a1b", "X-y"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None]), " ".join(rng.choices(words[: rng.randrange(2, 20)], k=rng.randrange(30)))) for _ in range(160)]
    rows += [("en", s, "same text of all WAX wax") for s in ("s1", "s1", "s1", "s2", "s9")] + [("fr", "only", None), ("fr", "two", "!!!"), ("en", "mute", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "lang string, source string, text string, digest string")
    got = divergence.audit(df.repartition(4), least_docs=8, top=5).collect()
    found = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got}
    assert len(found) == len(got) and found == plain_audit(rows, 8, 5)
    assert divergence.audit(df.filter("false")).count() == 0
    assert {(r["source"], r["item"], r["value"]) for r in got if r["lang"] == "fr"} == {("only", "two", 0), ("two", "only", 0)}


def test_a_text_is_cut_once(spark):
    df = spark.createDataFrame([("en", s, "a b a") for s in "xxxyy"] + [("de", "x", "a b a")], "lang string, source string, text string")
    assert sorted((r["lang"], sorted(map(tuple, r["copies"]))) for r in divergence.collapse(df).collect()) == [("de", [("x", 1)]), ("en", [("x", 3), ("y", 2)])]
    assert {tuple(r) for r in divergence.term_counts(df).filter("lang = 'en'").collect()} == {("en", "x", "a", 3, 6), ("en", "x", "b", 3, 3), ("en", "y", "a", 2, 4), ("en", "y", "b", 2, 2)}


# ---- token files


def test_words_hold_any_ids():
    rng = np.random.default_rng(4)
    cases = [np.zeros(n, np.uint64) for n in (0, 1, 119, 120, 121, 5000)]
    cases += [np.array([2**64 - 1, 0, 2**60, 2**60 - 1] * k, np.uint64) for k in (1, 200)]
    cases += [rng.integers(0, 2 ** int(b), int(n)).astype(np.uint64) for b in range(1, 62, 3) for n in (1, 513, 3000)]
    cases += [np.where(rng.random(9000) < 0.1, rng.integers(0, 2**63, 9000), rng.integers(0, 3, 9000)).astype(np.uint64)]
    for ids in cases:
        for block in (512, 5):
            lengths = np.array([len(ids)], np.uint64)
            part = token_files.Segment(token_files.Segment.of(ids, lengths, block))
            assert (part.ids() == ids).all() and len(part.ids()) == len(ids) and part.lengths.tolist() == [len(ids)]
            a, b = sorted(rng.integers(0, len(ids) + 2, 2))
            assert (part.ids(a, b) == ids[a:b]).all()
    words, offsets, _ = token_files.pack(np.full(4 * 512, 20_000, np.uint64))
    assert len(words) == 4 * 128 and offsets.tolist() == [0, 128, 256, 384, 512]  # four ids of 15 bits a word
    broken = bytearray(token_files.Segment.of(np.arange(9, dtype=np.uint64), np.array([9])))
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Segment(bytes(broken))


def coded(texts, end=2):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    library.encode_special_tokens = True
    return [e.ids + [end] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_token_files(spark, scratch, monkeypatch, segment):
    monkeypatch.setattr(token_files, "_KEPT", 40)
    rng = random.Random(5)
    texts = [None, "", " \t\n", "It's 12 ÉcOLE’s x y\x1cz", "é ́a", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΟΔΟΣ", "x" * 70, "word " * 400, "漢字 かな　🙂", "İI ﬁ Ǆ", "a\x0bb\x0cc\rd"]
    texts += ["".join(chr(rng.choice([32, 32, rng.randrange(33, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x4E00, 0x4E20)])) for _ in range(60)) for _ in range(60)]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in zip(ids, texts)] + [(None, "last of all", "z", 1)], "doc_id long, text string, start string, ids int")
    token_files.write_tokens(df.repartition(3), f"{scratch}/t", public_tokenizers.path(queries.WORD_BPE), "doc_id", end_id=2, segment=segment)
    got = token_files.read_tokens(spark, f"{scratch}/t").collect()
    assert len(got) == len(texts) + 1 and got[0]["doc"].asDict().keys() == {"doc_id", "text", "start", "ids"}
    start, want = 0, dict(zip(ids, coded(texts))) | {None: coded(["last of all"])[0]}
    for r in sorted(got, key=lambda r: r["start"]):
        one = want[r["doc"]["doc_id"]]
        raw = np.array(one, "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"]), r["ids_crc32"]) == (start, len(one), raw, zlib.crc32(raw)), r["doc"]["text"]
        start += len(one)
    order = [r["doc"]["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [*sorted(ids), None]


def test_token_files_of_odd_tables(spark, scratch):
    tokenizer = public_tokenizers.path(queries.WORD_BPE)
    same = spark.createDataFrame([(7, "one two")] * 50 + [(7, None)], "doc_id long, text string")
    token_files.write_tokens(same.repartition(4), f"{scratch}/same", tokenizer, "doc_id", end_id=2, segment=8)
    got = sorted((r["start"], r["n_tokens"]) for r in token_files.read_tokens(spark, f"{scratch}/same", with_ids=False).collect())
    assert [s for s, _ in got] == [sum(n for _, n in got[:k]) for k in range(51)] and sorted(n for _, n in got) == [1] + [3] * 50
    token_files.write_tokens(same.filter("false"), f"{scratch}/none", tokenizer, "doc_id")
    assert token_files.read_tokens(spark, f"{scratch}/none").count() == 0
    long = spark.createDataFrame([(1, "Wort " * 2_000_000), (2, "x")], "doc_id long, text string")  # 10 MB
    token_files.write_tokens(long, f"{scratch}/long", tokenizer, "doc_id")
    assert sorted((r["start"], r["n_tokens"]) for r in token_files.read_tokens(spark, f"{scratch}/long").collect()) == [(0, 2_000_000 * len(coded(["Wort"], 2)[0][:-1])), (2_000_000 * len(coded(["Wort"], 2)[0][:-1]), 1)]


def test_query_of_token_files(spark):
    got = queries.QUERIES["op13_token_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    start = 0
    for r, one in zip(got, coded(texts), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(one), zlib.crc32(np.array(one, "<u4").tobytes()))
        start += len(one)
