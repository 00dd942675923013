"""Run registers, benchmark rows, acquisition logs and metadata inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.groups import _beside, lag_in_group, nearest, order_statistics, quantiles, rank_in_group, truncated
from voxelloom.session import materialise

# fixed values: camera names in canonical order
CAMERAS = ["left", "center", "right", "top"]


def parse_run(name: Column, cameras: list[str] | None = None) -> Column:
    """struct(subset, n_cams, res) of a name like ``center+left_res504``; NULL when a camera is unknown."""
    known = F.array(*[F.lit(c) for c in (cameras or CAMERAS)])
    base = F.regexp_replace(name, r"_res\d+$", "")
    parts = F.filter(F.split(F.regexp_replace(base, ",", "+"), r"\+"), lambda c: c != "")
    res = F.nullif(F.regexp_extract(name, r"_res(\d+)", 1), F.lit("")).cast("long")
    ok = (F.size(F.array_except(parts, known)) == 0) & (F.size(parts) > 0)
    canonical = F.filter(known, lambda c: F.array_contains(parts, c))
    return F.when(ok, F.struct(F.array_join(canonical, "+").alias("subset"), F.size(canonical).cast("long").alias("n_cams"), res.alias("res")))


def parse_time(text: Column) -> Column:
    """Seconds since the epoch from ISO with or without T, fraction and offset, ``yyyyMMdd_HHmmss``, or a plain number.

    An offset (Z, +02, +0200 or +02:00) counts; without one the session's zone holds. Digits of the fraction beyond
    the sixth are dropped.
    """
    t = F.regexp_replace(F.trim(text), r"(\.[0-9]{6})[0-9]+", "$1")
    t = F.regexp_replace(t, r"(:[0-9]{2}(?:\.[0-9]+)?)([+-][0-9]{2})(?::?([0-9]{2}))?$", "$1$2:$3")
    t = F.regexp_replace(t, ":$", ":00")
    part = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]"
    stamps = [F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss" + part, "yyyy-MM-dd HH:mm:ss" + part, "yyyyMMdd_HHmmss")]
    return F.coalesce(F.unix_micros(F.coalesce(*stamps)) / 1e6, F.expr("1D") * text.try_cast("double"))


def run_register(runs: DataFrame, scale: str = "scale", tol: float = 0.10) -> DataFrame:
    off = F.abs(F.col(scale) - 1.0)
    return runs.withColumn("admitted", F.coalesce(off < tol, F.lit(False))).withColumn(
        "reason", F.when(F.col(scale).isNull(), "no scale").when(off >= tol, "scale outside the accepted range"))


def register_counts(register: DataFrame, by: list[str]) -> DataFrame:
    return register.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("excluded"))


def holdout_register(rows: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Uncorrected against deployed over all hold-outs: count, worsened, and the ranges of both."""
    d = F.col(after) - F.col(before)
    return rows.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("holdouts"), F.count_if(d > 0).alias("worsened"), F.min(before).alias("before_min"), F.max(before).alias("before_max"),
        F.min(d).alias("change_min"), F.max(d).alias("change_max"))


def stage_stats(rows: DataFrame, by: list[str], value: str, **kw) -> DataFrame:
    """n, mean, median, nearest-rank p95, min and max."""
    base = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    med = quantiles(rows, by, value, {"median": 0.5}, **kw)
    p95 = order_statistics(rows, by, value, {"p95": nearest(0.95)}, **kw).drop("n")
    return med.join(base, by).join(p95, by)


def bench_summary(rows: DataFrame, by: list[str], stages: list[str], repeat: str, warmup: int = 1, failed: str | None = None) -> DataFrame:
    """Stage means without warm-up rows, shares of the total, rate, dominant stage; failed rows counted."""
    ok = F.col(repeat) >= warmup
    if failed:
        ok = ok & ~F.col(failed)
    agg = rows.groupBy(*by).agg(
        F.count_if(ok).alias("repeats"), *([F.count_if(F.col(failed)).alias("failures")] if failed else []), *[F.avg(F.when(ok, F.col(s))).alias(s) for s in stages])
    total = F.col(stages[0])
    for s in stages[1:]:
        total = total + F.col(s)
    out = agg.withColumn("total", total).withColumn("rate", 1000.0 / F.col("total"))
    out = out.withColumns({s + "_pct": 100.0 * F.col(s) / F.col("total") for s in stages})
    ranked = F.array_max(F.array(*[F.struct(F.col(s).alias("v"), F.lit(s).alias("s")) for s in stages]))
    return out.withColumn("dominant", ranked["s"])


def bench_pivot(summary: DataFrame, row: str, column: str, values: list, value: str = "total") -> DataFrame:
    return summary.groupBy(row).pivot(column, values).agg(F.avg(value))


def acquisition_rate(sets: DataFrame, by: list[str], ts: str, payload_mb: float, bound: float, complete: str | None = None, **kw) -> DataFrame:
    """Mean set rate, instantaneous median and p5/p95 (truncated index), payload, shortfall, incomplete sets."""
    gaps = lag_in_group(sets, by, [(ts, "asc")], ts, 1, "_prev", **kw)
    seconds = (F.unix_micros(ts) - F.unix_micros("_prev")) / 1e6
    rate = gaps.withColumn("_rate", F.when(seconds > 0, 1.0 / seconds))
    inst = order_statistics(rate, by, "_rate", {"rate_p5": truncated(0.05), "rate_p95": truncated(0.95)}, **kw).drop("n")
    med = quantiles(rate, by, "_rate", {"rate_median": 0.5}, **kw).drop("n")
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    base = sets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sets"), span.alias("elapsed_s"), *([F.count_if(~F.col(complete)).alias("incomplete")] if complete else []))
    base = base.withColumn("rate", F.col("sets") / F.col("elapsed_s"))
    return base.withColumn("payload_mb_s", F.col("rate") * payload_mb).withColumn("shortfall", 1.0 - F.col("rate") / bound).join(med, by).join(inst, by)


def rolling_rate(frames: DataFrame, by: list[str], ts: str, order: list[tuple[str, str]], rows: int = 120, **kw) -> DataFrame:
    """(n - 1) / (last - first) over the last ``rows`` stamps of each group; NULL is a group key like any other."""
    cols = frames.columns
    ranked = rank_in_group(frames, by, order, "_i", **kw)
    back = ranked.select(*by, (F.col("_i") + (rows - 1)).alias("_i"), F.col(ts).alias("_first"))
    start = ranked.groupBy(*by).agg(F.min(ts).alias("_start"))
    j = _beside(_beside(ranked, back, [*by, "_i"], "left"), start, by, "left")
    n = F.least(F.col("_i") + 1, F.lit(rows))
    span = (F.unix_micros(ts) - F.unix_micros(F.coalesce("_first", "_start"))) / 1e6
    return j.withColumn("rate", F.when(span > 0, (n - 1) / span)).select(*cols, "rate")


LEVELS = 12  # levels of nesting taken in one job

# fixed values: the limits of an inventory that is to be read by eye
FOR_READING = {"max_depth": 12, "longest_numbers": 24, "longest_list": 64, "longest_value": 300}


def metadata_inventory(files: DataFrame, text: str = "value", path: str = "path", max_depth: int | None = None, keep: list[str] | None = None,
                       longest_numbers: int | None = None, longest_list: int | None = None, longest_value: int | None = None) -> DataFrame:
    """Flattens one JSON document per row to (path, keypath, value), whole unless limits are given (``FOR_READING``).

    Lists of more than ``longest_numbers`` numbers become their length, min, max and first eight; other lists stop at
    ``longest_list`` items and say how many there are; values stop at ``longest_value`` characters, marked by three dots;
    nesting stops at ``max_depth``. Without ``max_depth`` jobs run while this is called, one for each twelve levels.
    Text that is not JSON, and empty objects and lists, give no rows.
    """
    no_limit = 2**31 - 1
    numbers, items = longest_numbers or no_limit, longest_list or no_limit
    cols = [path, *(keep or [])]
    rows = files.select(*cols, F.lit("").alias("keypath"), F.try_parse_json(F.col(text)).alias("v"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("leaf")).filter("v is not null")
    joined = "if(keypath = '', k.key, concat(keypath, '.', k.key))"
    numeric = r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$"
    none = "cast(null as variant)"
    step = f"""case
      when leaf then array(named_struct('keypath', keypath, 'v', {none}, 'value', value, 'leaf', true))
      when kind like 'OBJECT%' then transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), k -> named_struct('keypath', {joined}, 'v', k.value, 'value', cast(null as string), 'leaf', false))
      when kind rlike '{numeric}' and size(try_variant_get(v, '$', 'array<variant>')) > {numbers} then array(
        named_struct('keypath', concat(keypath, '[len]'), 'v', {none}, 'value', cast(size(try_variant_get(v, '$', 'array<variant>')) as string), 'leaf', true),
        named_struct('keypath', concat(keypath, '[min]'), 'v', {none}, 'value', cast(array_min(try_variant_get(v, '$', 'array<double>')) as string), 'leaf', true),
        named_struct('keypath', concat(keypath, '[max]'), 'v', {none}, 'value', cast(array_max(try_variant_get(v, '$', 'array<double>')) as string), 'leaf', true),
        named_struct('keypath', concat(keypath, '[first8]'), 'v', {none}, 'value', array_join(transform(slice(try_variant_get(v, '$', 'array<variant>'), 1, 8), x -> cast(x as string)), ', '), 'leaf', true))
      when kind like 'ARRAY%' then concat(
        transform(slice(try_variant_get(v, '$', 'array<variant>'), 1, {items}), (x, i) -> named_struct('keypath', concat(keypath, '[', i, ']'), 'v', x, 'value', cast(null as string), 'leaf', false)),
        if(size(try_variant_get(v, '$', 'array<variant>')) > {items}, array(named_struct('keypath', concat(keypath, '[truncated]'), 'v', {none}, 'value', cast(size(try_variant_get(v, '$', 'array<variant>')) as string), 'leaf', true)), array()))
      else array(named_struct('keypath', keypath, 'v', {none}, 'value', try_variant_get(v, '$', 'string'), 'leaf', true)) end"""


    def deeper(rows: DataFrame, levels: int) -> DataFrame:
        for _ in range(levels):
            rows = rows.withColumn("kind", F.expr("if(leaf, '', schema_of_variant(v))")).select(*cols, F.explode(F.expr(step.replace("\\", "\\\\"))).alias("_e")).select(*cols, "_e.*")
        return rows

    shown = F.col("value") if longest_value is None else F.when(F.length("value") > longest_value, F.concat(F.substring("value", 1, longest_value), F.lit("..."))).otherwise(F.col("value"))
    if max_depth is None:
        done = None
        while True:
            rows = materialise(deeper(rows, LEVELS), "inventory")
            ended = rows.filter("leaf").select(*cols, "keypath", shown.alias("value"))
            done = ended if done is None else done.unionByName(ended)
            rows = rows.filter("not leaf")
            if rows.isEmpty():
                return done
    rows = deeper(rows, max_depth)
    last = F.expr("if(leaf, value, case when schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%' then '<max depth>' else try_variant_get(v, '$', 'string') end)")
    return rows.select(*cols, "keypath", last.alias("value")).select(*cols, "keypath", shown.alias("value"))


def csv_inventory(files: DataFrame, text: str = "value", path: str = "path", first_rows: int = 3) -> DataFrame:
    """The header of one CSV file per row as (path, keypath, value): ``[columns]``, ``[n_columns]`` and for each column
    that occurs in the first rows ``col.<name>`` with its values there, joined by " | ".

    The separator is whichever of comma, semicolon and tab the header has most of outside quotes (the earlier of equals;
    in ``.tsv`` files tab comes first). Quoted fields may hold separators, line ends and doubled quotes. A column name
    that repeats gives a row each time. NULL and empty files give no rows; an empty header line is a header of no columns.
    """
    quoted = r'"[^"]*+(?:""[^"]*+)*+(?:"|$)'
    record = rf'(?:[^"\n]++|{quoted})*+'
    whole = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n"))
    head = F.regexp_extract(whole, rf"^(?:\n{record}){{1,{first_rows + 1}}}", 0)
    found = F.regexp_extract_all(head, F.lit(rf"\n({record})"), F.lit(1))
    bare = F.regexp_replace(F.col("_r")[0], quoted, "")
    count = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    comma, semicolon, tab = count(","), count(";"), count("\t")
    most = F.greatest(comma, semicolon, tab)
    tabbed = F.lower(F.col(path).cast("string")).endswith(".tsv")
    mark = F.when(tabbed & (tab == most), "\t").when(comma == most, ",").when(semicolon == most, ";").otherwise("\t")

    def fields(line: Column) -> Column:
        def split(d: str) -> Column:
            return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf"{d}({quoted}[^{d}]*+|[^{d}]*+)"), F.lit(1))

        parts = F.when(F.col("_d") == ",", split(",")).when(F.col("_d") == ";", split(";")).otherwise(split("\t"))
        plain = F.transform(parts, lambda p: F.when(p.startswith('"'), F.replace(F.regexp_replace(p, r'^"|"(?=[^"]*$)', ""), F.lit('""'), F.lit('"'))).otherwise(p))
        return F.when(line == "", F.array().cast("array<string>")).otherwise(plain)

    rows = files.filter(F.length(text) > 0).select(path, found.alias("_r")).withColumn("_d", mark)
    # a last line end does not start another row
    body = F.when((F.size("_r") > 1) & (F.element_at("_r", -1) == ""), F.slice("_r", 2, F.size("_r") - 2)).otherwise(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))))
    rows = rows.select(path, fields(F.col("_r")[0]).alias("_h"), F.transform(body, fields).alias("_b"))

    def named(name: Column, j: Column) -> Column:
        had = F.filter("_b", lambda r: F.size(r) > j)
        return F.when(F.size(had) > 0, F.struct(F.concat(F.lit("col."), name).alias("keypath"), F.array_join(F.transform(had, lambda r: r[j]), " | ").alias("value")))

    both = [F.struct(F.lit("[columns]").alias("keypath"), F.array_join("_h", ", ").alias("value")), F.struct(F.lit("[n_columns]").alias("keypath"), F.size("_h").cast("string").alias("value"))]
    return rows.select(path, F.inline(F.concat(F.array(*both), F.array_compact(F.transform("_h", named)))))


def check_targets(inventory: DataFrame, targets: list[dict], path: str = "path") -> DataFrame:
    """Per target (``name hints needs``): hits by substring of path and key path, strong hits, and a status."""
    blob = F.lower(F.concat_ws(" ", F.col(path), F.col("keypath")))

    def any_of(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(blob, F.lit(w.lower()))
        return out

    tags = F.array_compact(F.array(*[
        F.when(any_of(t["hints"]), F.struct(F.lit(t["name"]).alias("target"), any_of(t["needs"]).alias("strong"))) for t in targets]))
    hits = inventory.select(F.explode(tags).alias("_t")).select("_t.*").groupBy("target").agg(F.count(F.lit(1)).alias("hits"), F.count_if("strong").alias("strong"))
    names = inventory.sparkSession.createDataFrame([(t["name"],) for t in targets], "target string")
    out = names.join(hits, "target", "left").na.fill(0, ["hits", "strong"])
    return out.withColumn("status", F.when(F.col("strong") > 0, "LIKELY PRESENT").when(F.col("hits") > 0, "PARTIAL").otherwise("NOT FOUND"))


def classify_layering(below: Column, bias_spread: Column, pair_median: Column, amplitude: Column, agreeing: Column) -> Column:
    """Actions a layering report calls for, in order; 'none dominates' when no threshold is passed."""
    actions = F.array_compact(F.array(
        F.when(below > 0.01, "clip below the deck"),
        F.when(bias_spread > 5.0, "per-view shift"),
        F.when((pair_median > 15.0) & (pair_median > 2.0 * F.greatest(bias_spread, F.lit(1e-6))), "inverse-depth correction"),
        F.when(amplitude > 10.0, "spatially varying correction"),
        F.when(agreeing < 0.5, "fuse by consensus")))
    return F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("none dominates")))


def classify_surface(rms: Column, skew: Column, peak: Column, pitch: Column, relief: Column, fill: Column, min_relief: float = 0.025, min_peak: float = 0.40,
                     pitches: tuple[float, float] = (0.045, 0.250), min_skew: float = 0.50, max_rms: float = 0.006, min_fill: float = 0.60, max_relief: float = 0.080) -> Column:
    """Granular, planar, film or rough, tested in that order.

    Granular tops repeat at a pitch within ``pitches`` and stand out on one side of their mean; planar ones are smooth
    and densely filled; film stays within ``max_relief``. A skew that is NULL or NaN counts as none.
    """
    lean = F.abs(F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0)))
    repeats = (peak >= min_peak) & pitch.between(*pitches)
    return (
        F.when(repeats & (relief >= min_relief) & (lean >= min_skew), "granular")
        .when((rms <= max_rms) & (fill >= min_fill), "planar")
        .when(relief <= max_relief, "film")
        .otherwise("rough"))
