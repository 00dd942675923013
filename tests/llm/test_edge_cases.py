"""Empty and clashing inputs of the classifiers and of the near-duplicate filter."""

from voxelloom.llm import dartminhash, langid, quality, sampling, toxicity

ODD = "doc_id long, text string, lang string, out string, label int, _gone int, _hash string, gone int, own int, doc int, every int"


def odd(spark, texts):
    return spark.createDataFrame([(k, t, "en", "z", 1, 7, "h", 1, 2, 3, 4) for k, t in enumerate(texts)], ODD)


def test_near_duplicates_with_clashing_columns(spark):
    one = " ".join(f"w{k}" for k in range(60))
    df = odd(spark, [one, one + " end", "something else entirely", None, ""])
    kept = dartminhash.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == df.columns


def test_classifiers_without_anything_to_learn(spark):
    df = odd(spark, ["a b", None, "c"])
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    held = [k for k in range(50) if __import__("zlib").crc32(str(k).encode()) % 5 == 0][:2]
    for docs, marks in ((df, labels.filter("false")), (df.filter("false"), labels), (odd(spark, ["x"] * 50), spark.createDataFrame([(k, 1, 1) for k in held], "doc_id long, quality int, toxic int"))):
        got = quality.score_quality(df, quality.fit_quality(docs, marks)).collect()
        assert len(got) == 3 and {r["out"]["score"] for r in got} == {0.5} and got[0]["doc"].asDict().keys() == set(df.columns)
    net = toxicity.fit_toxicity(df.filter("false"), labels)
    assert {r["out"]["score"] for r in toxicity.score_toxicity(df, net).collect()} == {0.5} and net.thresholds == {}


def test_a_sample_holds_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (9, 1)] * 3, "doc_id long, quality int")
    got = sampling.labelled(docs, labels, "quality", 1, 7, 10)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (2, 0, "c")]


def test_more_languages_than_the_sample_has_room_for(spark):
    df = spark.createDataFrame([(k, f"text number {k} of {k % 30}", f"l{k % 30}") for k in range(240)], "doc_id long, text string, lang string")
    net = langid.fit_languages(df, sample=4, most=5)
    assert 0 < len(net.langs) <= 30
    assert langid.detect_languages(df, net).count() == 240
