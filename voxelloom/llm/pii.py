"""Personal data: patterns propose spans, checksums confirm them, words before a span adjust its score. SQL functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # matches whose lengths are summed one by one; blocks of them are summed once
NEAR = 40  # characters before a span that are read for context


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = F.transform(F.split(F.reverse(number), ""), lambda d, i: (d.cast("int") * (1 + i % 2)).cast("int"))
    return F.aggregate(value, F.lit(0), lambda acc, v: (acc + F.when(v > 9, v - 9).otherwise(v)).cast("int")) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits) leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda acc, v: ((acc * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")) == 1


@dataclass(frozen=True)
class Kind:
    """A proposal: its pattern, a cheap condition without which it can't match, what confirms it, and its scores.

    Patterns start at the first character of a run (or where the last match ended) and take runs without backtracking,
    so that a long run costs its length.
    """

    name: str
    pattern: str
    needs: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    context: str
    bonus: float = 0.2
    least: float = 0.0  # proposals that score less go


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _holds(text: Column, *parts: str) -> Column:
    """Whether a text holds one of some strings."""
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def _mixed(value: Column) -> Column:
    """Whether a value looks drawn rather than written: a letter, a digit and at least five different characters."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 5)


_NAMES = (r"(?i:pass(?:word|wd|phrase|code)?|pwd|passwort|kennwort|contraseña|mot de passe|(?:client[ _-]?)?secret|token|"
          r"(?:api|access|auth|secret|private)[ _-]?key)")
_SET = r"""[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"""


# The patterns of the four base kinds and the words that speak for a kind.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), lambda m: F.lit(True), 0.8, r"mail|contact|write|correo|schreib|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255), 0.6, r"\bip\b|address|server|host|adresse|direcci"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++",
         lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), lambda m: let(digits(m), lambda d: F.when(_between(F.length(d), 14, 19), luhn(d)).otherwise(False)), 0.7, r"card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         lambda t: t.contains("+"), lambda m: _between(F.length(digits(m)), 10, 15), 0.6, r"phone|tel|call|mobile|fax|anruf|llam|appel"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), lambda m: mod97(F.replace(m, F.lit(" "))), 0.8, r"iban|account|konto|cuenta|compte"),
    Kind("local_phone", r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,4}\)?[ /-][0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9A-Za-z-])",
         lambda t: t.rlike(r"0[0-9]{1,4}\)?[ /-]"), lambda m: _between(F.length(digits(m)), 8, 12), 0.3, r"phone|tel|call|mobile|fax|anruf|llam|appel", 0.3, 0.5),
    Kind("american_phone", r"(?<![0-9A-Za-z+.)-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
         lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"), lambda m: F.lit(True), 0.3, r"phone|tel|call|mobile|fax|llam|appel", 0.3, 0.5),
    Kind("social_security", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
         lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike(r"^(?:000|666|9..)|-00-|0000$"), 0.3, r"\bssn\b|social security|seguro social", 0.4, 0.5),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
         lambda t: _holds(t, "AKIA", "ASIA", "AIza", "xox", "sk_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), lambda m: m.rlike("[0-9]"), 0.8, r"key|secret|token|credential"),
    Kind("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
         lambda t: t.contains("eyJ"), lambda m: F.lit(True), 0.8, r"token|bearer|authorization|jwt"),
    Kind("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----(?:[^-]++(?:-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----)?+)?+",
         lambda t: t.contains("PRIVATE KEY-----"), lambda m: F.lit(True), 0.8, r"key|pem|ssh|certificate"),
    Kind("secret", rf"(?<![A-Za-z0-9])(?:(?:[A-Za-z]{{2,12}}[_-])?(?i:token)|{_NAMES}){_SET}[^\s\"',;]{{8,}}+",
         lambda t: _holds(t, ":", "=") & t.rlike(rf"[A-Za-z]{_SET}[^\s\"',;]{{8}}") & t.rlike(rf"(?:{_NAMES}){_SET}"), lambda m: let(F.regexp_extract(m, rf"{_SET}(.+)$", 1), _mixed), 0.6, r"login|user|config|credential|export|connect|account"),
)
BASE = ("email", "ip", "card", "phone")
SECRETS = ("access_key", "web_token", "private_key", "secret")
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind. Where a match lies follows from the lengths of the pieces between matches."""
    def placed(v: Column) -> Column:
        steps = F.transform(v["m"], lambda m, i: F.length(v["p"][i]) + F.length(m))
        return let(F.struct(v["m"].alias("m"), v["p"].alias("p"), steps.alias("s")), blocked)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def blocked(v: Column) -> Column:
        count = F.ceil(F.size(v["s"]) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(v["s"], b * BLOCK + 1, F.lit(BLOCK))))
        return let(sums, lambda sums: let(
            F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))),
            lambda before: F.transform(v["m"], lambda m, i: one(v, m, i, before))))

    def one(v: Column, m: Column, i: Column, before: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = before[block] + total(F.slice(v["s"], block * BLOCK + 1, i - block * BLOCK)) + F.length(v["p"][i])
        near = F.lower(F.substring(v["p"][i], -NEAR, NEAR)).rlike(kind.context)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m)).alias("end"),
                        F.when(near, kind.score + kind.bonus).otherwise(kind.score).alias("score"), kind.confirm(m).alias("ok"))

    pattern = F.lit(kind.pattern)
    found = let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p")),
                lambda v: F.when(F.size(v["m"]) > 0, placed(v)))
    good = F.filter(found, lambda s: s["ok"] & (s["score"] >= kind.least - 1e-9))
    plain = F.transform(good, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end", "score")]))
    return F.coalesce(F.when(kind.needs(text), plain).cast(_SPANS), F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column of spans (start, rank, kind, end, score), by start and then kind; code points, end exclusive.

    Beyond the base kinds it finds account codes, local phone and social security numbers (these two only beside a word
    that speaks for them) and secrets: access keys by their prefix, signed web tokens, private key blocks, and values of
    eight or more characters assigned to a name such as password or api_key, from the name to the end of the value.
    Matches of a kind are leftmost and do not overlap; matches that fail their check are dropped and not tried again
    inside. Spans of different kinds may overlap. A null or empty text has no spans; rows are read one by one, so
    repeated rows, null ids and other columns change nothing. A column of the name ``into`` is replaced.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(into, let(t, lambda t: F.array_sort(F.concat(*[spans_of(t, k, n) for n, k in enumerate(KINDS)]))))


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first in angle brackets."""
    t = F.col(f"`{text}`").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        cut = F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], cut)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
