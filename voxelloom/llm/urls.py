"""URL filters: pattern rules indexed by their rarest literal token; only fetched rules run their expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the method: hosts of kinds that training text does without. ``*`` is any run of characters of a host name
#: or path, ``^`` the end of a host name, ``||`` the start of a host label.
DEFAULT_RULES = ("||adult-*^", "||casino-*^", "||porn-*^", "||spam-*^", "||torrent-*^", "||malware-*^", "||phishing-*^", "||tracker-*^")

SMALL = 20_000  # rules, or tokens of rules, up to which they are broadcast


@dataclass(frozen=True)
class Rule:
    """``name`` decides as ``verdict``; ``regex`` runs on host and path written together; longer ``weight`` wins."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int
    stated: bool  # a rule that is reported by name


def tokens_of(literal: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[^a-z0-9]+", literal.lower()) if t)


def site_rule(verdict: str, site: str) -> Rule:
    """A host with a path (``example.com/en/``): fits the host and its subdomains where the path starts with the rule's."""
    host, _, path = site.partition("/")
    regex = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)
    tail = path if path.endswith("/") or not path else path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    return Rule(site, verdict, regex, tokens_of(host + "/" + tail), len(site), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A pattern with ``||``, ``*`` and ``^``; a token counts only if the pattern shows both its ends."""
    body = pattern.removeprefix("||")
    regex = (r"^(?:[^/]*\.)?" if pattern.startswith("||") else "") + "".join({"*": "[^/]*", "^": "(?=/|$)"}.get(c, re.escape(c)) for c in body)
    at_label = pattern.startswith("||")
    whole = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = at_label if m.start() == 0 else body[m.start() - 1] != "*"
        right = body[m.end() : m.end() + 1] not in ("", "*")
        if left and right:
            whole.append(m[0].lower())
    if not whole:
        raise ValueError(f"{pattern} has no whole literal token")
    return Rule(pattern, verdict, regex, tuple(whole), len(body), False)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(place), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, rules: list[Rule], often: dict[str, int]) -> DataFrame:
    """(token, rule ...) of each rule under the token that occurs least in the URLs, the longest of equals."""
    rows = [(min(r.tokens, key=lambda t: (often.get(t, 0), -len(t), t)), r.name, r.verdict, r.regex, r.weight, r.stated) for r in rules]
    return spark.createDataFrame(rows, "token string, name string, verdict string, regex string, weight int, stated boolean")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, otherwise: str = "allow") -> DataFrame:
    """doc (struct of the columns ``keep``), host, path, rule and verdict of each row.

    Stated rules come before patterns, then the longer one, then the first name; a pattern decides without being
    reported in ``rule``, and a URL that nothing fits is ``otherwise``. A null URL, or one without ``://``, has an empty
    host and path and fits nothing. Rows are judged one by one: repeated rows and ids stay. No rules: all ``otherwise``.
    Only tokens that rules use are counted and fetched; the index has a row for each rule.
    """
    spark = pages.sparkSession
    keep = pages.columns if keep is None else keep
    host, path = split_url(F.col(f"`{url}`").cast("string"))
    sites = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), host.alias("host"), path.alias("path"))
    used = sorted({t for r in rules for t in r.tokens})
    if not rules:
        return sites.select("doc", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    wanted = spark.createDataFrame([(t,) for t in used], "token string")
    wanted = F.broadcast(wanted) if len(used) <= SMALL else wanted
    seen = sites.select(F.explode(_tokens(F.concat("host", "path"))).alias("token")).join(wanted, "token", "left_semi")
    often = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most the rules' tokens
    index = rule_index(spark, rules, often)
    rows = sites.withColumn("row_id", F.monotonically_increasing_id()).withColumn("token", F.explode_outer(_tokens(F.concat("host", "path"))))
    fits = F.col("name").isNotNull() & F.regexp_like(F.concat("host", "path"), F.col("regex"))
    order = F.struct((~F.col("stated")).alias("a"), (-F.col("weight")).alias("b"), F.col("name").alias("name"), F.col("verdict").alias("verdict"))
    index = F.broadcast(index) if len(rules) <= SMALL else index
    best = rows.join(index, "token", "left").groupBy("row_id").agg(F.first("doc").alias("doc"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(F.when(fits, order)).alias("best"))
    return best.select("doc", "host", "path", F.when(~F.col("best.a"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
