"""One query for each operator, with its production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import bpe, chat, dartminhash, decontamination, divergence, exact_dedup, hard_negatives, langid, pii, quality, token_files, toxicity, urls
from voxelloom.llm.sampling import fold
from voxelloom.session import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE, END_ID = "word_bpe_49k.json", 2
CUT = 0.3  # a score from which a label is predicted


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(folds: int, held: int):
    return F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
g AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    _, decided = exact_dedup.find_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return decided.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"), folds=5, held=0)
    out = quality.score_quality(docs, model, keep=["doc_id"])
    return out.select("doc.doc_id", "out.score").select("doc_id", held_out(5, 0), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


@query("op3_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS g FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM bi)),
sizes AS (SELECT DISTINCT size FROM bi),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, size, s FROM dw JOIN bw USING (size, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return out.select("doc.doc_id", "out.n_words", "out.n_hit", F.size("out.items").cast("long").alias("n_items"), "out.items_sha256", (F.col("out.n_hit") > 0).alias("contaminated"))


def is_kind(kind: str, span):
    return span["kind"] == kind


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(F.filter("pii", partial(is_kind, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    more = [F.size("pii").cast("long").alias("n_spans"), F.size(F.filter("pii", lambda s: s["kind"].isin(*pii.SECRETS))).cast("long").alias("n_secret"),
            F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score")]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"), *more)


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), folds=4, held=2)
    out = toxicity.score_toxicity(docs, net, keep=["doc_id", "lang"]).select("doc.*", "out.score")
    return out.select("doc_id", held_out(4, 2), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), toxicity.is_toxic(net, F.col("score"), F.col("lang")).alias("rejected"))


@query("op6_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + 33 + length(regexp_replace(role || text, '[^\\]', '', 'g'))
  + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    written = materialise(chat.format_turns(chat.canonical(rows.union(trap), ["conv_id", "turn"])), "chats")
    return chat.digests(chat.read_turns(written))


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select("doc.doc_id", "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")


@query("op8_minhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "cluster_id", "n_shingles", "kept")


RULES = [urls.site_rule(v, s) for v, s in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]


@query("op9_url_filter", r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (SELECT *, '.' || host AS h FROM p),
r AS (SELECT *, CASE WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(h, '\.(adult|casino|porn|spam|torrent|malware|phishing|tracker)-') THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rules = RULES + [urls.pattern_rule("block", p) for p in urls.DEFAULT_RULES]
    return urls.judge_urls(table(spark, folder, "pages"), rules, keep=["page_id"]).select("doc.page_id", "host", "path", "rule", "verdict")


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = langid.detect_languages(docs, langid.fit_languages(docs, folds=5, held=0), keep=["doc_id"])
    return out.select("doc.doc_id", F.col("out.lang").alias("lang_pred"), "out.score").select("doc_id", held_out(5, 0), "lang_pred", "score")


@query("op11_hard_negatives", """
WITH q AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
i AS (SELECT id, label, v FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, v) = 1),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score FROM i a JOIN i r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", changed.alias("label"), "embedding")
    return hard_negatives.mine_hard_negatives(rows, F.col("id") % 100 == 0)


@query("op12_divergence", r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN k USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS total FROM g LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
l AS (SELECT lang, t, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (any_value(ln.total) + 5 * any_value(v.v)) AS BIGINT) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, t),
f AS (SELECT lang, source, t, coalesce(n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS BIGINT) AS p FROM gn JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
ps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM f JOIN l USING (lang, t) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_token_files")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path(WORD_BPE), "doc_id", keep=["doc_id"], end_id=END_ID)
    return token_files.read_tokens(spark, path, with_ids=False).select("doc.doc_id", "start", "n_tokens", "ids_crc32")
