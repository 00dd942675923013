"""Searches for the motion or scale between two clouds: phase correlation, footprint slide, slide and scale, depth scale."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.geometry import cam_to_rig, dot, vec
from voxelloom.operators.groups import median
from voxelloom.operators.spatial import k_nearest, target_cells
from voxelloom.session import materialise

NOISE = 1e-9  # waves that one raster does not carry
SPAN = 64  # rows or columns of a raster that are transformed together

# ---- phase correlation


def _dense(block: pd.DataFrame, by: list[str], head: list[str], span: int) -> pd.DataFrame:
    """Both rasters' rows of one block, transformed along v, cut into blocks of columns."""
    nu, nv, first = int(block["nu"].iloc[0]), int(block["nv"].iloc[0]), int(block["ub"].iloc[0]) * span
    rows = np.zeros((2, min(span, nu - first), nv))
    rows[block["side"], block["iu"] - first, block["iv"]] = block["value"]
    wave = np.fft.fft(rows, axis=2)
    return pd.DataFrame([(*block[by].iloc[0], nu, nv, first // span, k, wave[:, :, k * span : (k + 1) * span].tobytes()) for k in range(-(-nv // span))], columns=[*head, "ub", "vb", "data"])


def _cross(block: pd.DataFrame, by: list[str], head: list[str], span: int) -> pd.DataFrame:
    """Columns transformed along u, their cross-power spectrum, and that transformed back along u, cut into blocks of rows."""
    nu, nv, k = int(block["nu"].iloc[0]), int(block["nv"].iloc[0]), int(block["vb"].iloc[0])
    width = min(span, nv - k * span)
    full = np.zeros((2, nu, width), complex)  # blocks without cells are zero
    for ub, data in zip(block["ub"], block["data"]):
        part = np.frombuffer(data, complex).reshape(2, -1, width)
        full[:, ub * span : ub * span + part.shape[1]] = part
    a, b = np.fft.fft(full, axis=1)
    cross = a * np.conj(b)
    size = np.abs(cross)
    back = np.fft.ifft(np.where(size < NOISE, 0, cross / np.maximum(size, NOISE)), axis=0)
    return pd.DataFrame([(*block[by].iloc[0], nu, nv, u, k, back[u * span : (u + 1) * span].tobytes()) for u in range(-(-nu // span))], columns=[*head, "ub", "vb", "data"])


def _peak(block: pd.DataFrame, by: list[str], head: list[str], span: int) -> pd.DataFrame:
    """Rows transformed back along v: the block's largest value and where it is."""
    nu, nv, first = int(block["nu"].iloc[0]), int(block["nv"].iloc[0]), int(block["ub"].iloc[0]) * span
    rows = np.concatenate([np.frombuffer(d, complex).reshape(min(span, nu - first), -1) for _, d in sorted(zip(block["vb"], block["data"]))], 1)
    r = np.fft.ifft(rows, axis=1).real
    at = np.unravel_index(int(np.argmax(r)), r.shape)
    return pd.DataFrame([(*block[by].iloc[0], nu, nv, first + int(at[0]), int(at[1]), float(r[at]))], columns=[*head, "u", "v", "score"])


def phase_correlation(cells: DataFrame, by: list[str]) -> DataFrame:
    """Shift in cells that lays raster ``b`` on raster ``a``, per group: by..., du, dv, score.

    ``cells``: by..., side ('a' or 'b'), iu, iv, value, nu, nv: the occupied cells (0 <= iu < nu, 0 <= iv < nv) of both
    rasters of a group, one row a cell, with the size they share. A two-dimensional transform is one along rows and one
    along columns, so a task holds ``SPAN`` rows or columns of one group at a time and groups run together; a raster
    crosses two shuffles in blocks. Shifts above half the size count as negative. Of equal peaks the first in row order
    wins. A side without cells gives score 0 at no shift.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    head, span = [*by, "nu", "nv"], SPAN
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", nu long, nv long"
    rows = cells.select(*by, (F.col("side") == "b").cast("int").alias("side"), F.col("iu").cast("long").alias("iu"), F.col("iv").cast("long").alias("iv"), F.col("value").cast("double").alias("value"), F.col("nu").cast("long").alias("nu"), F.col("nv").cast("long").alias("nv"))
    ub = F.floor(F.col("iu") / span).cast("long").alias("ub")
    waves = rows.select("*", ub).groupBy(*by, "ub").applyInPandas(lambda block: _dense(block, by, head, span), schema + ", ub long, vb long, data binary")
    crossed = waves.groupBy(*by, "vb").applyInPandas(lambda block: _cross(block, by, head, span), schema + ", ub long, vb long, data binary")
    peaks = crossed.groupBy(*by, "ub").applyInPandas(lambda block: _peak(block, by, head, span), schema + ", u long, v long, score double")
    best = peaks.groupBy(*by).agg(F.max_by(F.struct("u", "v", "nu", "nv", "score"), F.struct(F.col("score"), -F.col("u"), -F.col("v"))).alias("_b"))

    def signed(k: str, n: str) -> Column:
        at, size = F.col(f"_b.{k}"), F.col(f"_b.{n}")
        return F.when(at > size / 2, at - size).otherwise(at)

    return best.select(*by, signed("u", "nu").alias("du"), signed("v", "nv").alias("dv"), F.col("_b.score").alias("score"))


def inplane_offset(points: DataFrame, by: list[str], reference: str, cell: float, yaws_deg: list[float], margin: float = 0.5, min_points: int = 200) -> DataFrame:
    """In-plane shift and yaw of every camera against the reference camera: by..., camera, yaw_deg, du, dv, score, at_edge.

    ``points``: by..., camera, u, v of what stands above the deck. Each camera is turned about the reference's centroid by
    every yaw; cells, not points, meet the transform. The raster of a group covers all its points and ``margin`` on each
    side; turned points outside are left out. Cameras with fewer than ``min_points`` take no part, nor do groups whose
    reference has fewer. Of equal scores the first yaw wins.
    """
    keys = [*by, "camera"]
    enough = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("u").alias("cu"), F.avg("v").alias("cv"), *[f(c).alias(f"{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))]).filter(F.col("_n") >= min_points)
    enough = materialise(enough, "inplane-cameras")
    box = enough.groupBy(*by).agg(*[(F.min(f"lo{c}") - margin).alias(f"lo{c}") for c in "uv"], *[F.ceil((F.max(f"hi{c}") + margin - (F.min(f"lo{c}") - margin)) / cell).alias(f"n{c}") for c in "uv"])
    centre = enough.filter(F.col("camera") == reference).select(*by, "cu", "cv")
    frame = materialise(box.join(centre, by), "inplane-frames")
    rows = points.join(enough.select(*keys), keys, "left_semi").join(frame, by)
    iu, iv = (F.floor((F.col(c) - F.col(f"lo{c}")) / cell).cast("long") for c in "uv")

    def inside(df: DataFrame) -> DataFrame:
        return df.filter((F.col("iu") >= 0) & (F.col("iu") < F.col("nu")) & (F.col("iv") >= 0) & (F.col("iv") < F.col("nv")))

    turn = F.explode(F.array(*[F.struct(F.lit(k).alias("yaw_no"), F.lit(math.cos(math.radians(y))).alias("co"), F.lit(math.sin(math.radians(y))).alias("si")) for k, y in enumerate(yaws_deg)]))
    ru, rv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
    turned = rows.filter(F.col("camera") != reference).withColumn("_t", turn).withColumns({"u": F.col("_t.co") * ru - F.col("_t.si") * rv + F.col("cu"), "v": F.col("_t.si") * ru + F.col("_t.co") * rv + F.col("cv")})
    moved = inside(turned.select(*keys, F.col("_t.yaw_no").alias("yaw_no"), iu.alias("iu"), iv.alias("iv"), "nu", "nv")).distinct()
    fixed = inside(rows.filter(F.col("camera") == reference).select(*by, iu.alias("iu"), iv.alias("iv"), "nu", "nv")).distinct()
    hypotheses = enough.filter(F.col("camera") != reference).select(*keys).withColumn("yaw_no", F.explode(F.sequence(F.lit(0), F.lit(len(yaws_deg) - 1))))
    sides = moved.withColumn("side", F.lit("b")).unionByName(hypotheses.join(fixed, by).withColumn("side", F.lit("a"))).withColumn("value", F.lit(1.0))
    found = phase_correlation(sides, [*keys, "yaw_no"])
    best = found.groupBy(*keys).agg(F.max_by(F.struct("yaw_no", "du", "dv", "score"), F.struct(F.col("score"), -F.col("yaw_no"))).alias("_b"))
    yaw = F.element_at(F.array(*[F.lit(float(y)) for y in yaws_deg]), F.col("_b.yaw_no").cast("int") + 1)
    return best.select(*keys, yaw.alias("yaw_deg"), (F.col("_b.du") * cell).alias("du"), (F.col("_b.dv") * cell).alias("dv"), F.col("_b.score").alias("score"), F.col("_b.yaw_no").isin(0, len(yaws_deg) - 1).alias("at_edge"))


# ---- slide of footprints along the belt


def runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Runs of occupied cells along u: by..., iv, first, end (one past the last)."""
    w = Window.partitionBy(*by, "iv").orderBy("iu")
    island = F.col("iu") - F.row_number().over(w)
    return cells.select(*by, "iv", "iu").distinct().withColumn("_i", island).groupBy(*by, "iv", "_i").agg(F.min("iu").alias("first"), (F.max("iu") + 1).alias("end")).drop("_i")


def shared_cells_by_shift(a: DataFrame, b: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Cells that ``b`` moved by k cells along u shares with ``a``, for every whole k within ``reach``: by..., k, shared.

    Two runs of lengths m and n share a trapezoid of k, whose second difference is four impulses; so pairs of runs, not of
    cells, meet, and two running sums over the impulses of a group give the count at every shift. ``a`` and ``b`` carry
    by..., iu, iv.
    """
    ra = runs(a, by).select(*by, "iv", F.col("first").alias("a0"), F.col("end").alias("a1"))
    rb = runs(b, by).select(*by, "iv", F.col("first").alias("b0"), F.col("end").alias("b1"))
    a0, a1, b0, b1 = (F.col(c) for c in ("a0", "a1", "b0", "b1"))
    corners = F.explode(F.array(*[F.struct(at.alias("k"), F.lit(d).alias("d")) for at, d in ((a0 - b1, 1), (a0 - b0, -1), (a1 - b1, -1), (a1 - b0, 1))]))
    impulses = ra.join(rb, [*by, "iv"]).select(*by, corners.alias("_c")).groupBy(*by, F.col("_c.k").cast("long").alias("k")).agg(F.sum("_c.d").alias("d"))
    asked = b.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))))
    every = impulses.withColumn("asked", F.lit(False)).unionByName(asked.withColumns({"d": F.lit(0).cast("long"), "asked": F.lit(True)}))
    upto = Window.partitionBy(*by).orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    value = F.col("k") * F.sum("d").over(upto) - F.sum(F.col("k") * F.col("d")).over(upto)
    return every.withColumn("shared", value).filter("asked").select(*by, "k", "shared")


def footprint_slide(reference: DataFrame, moving: DataFrame, by: list[str], span: float, cross: float, cell: float, reach: float, top: tuple[float, float], yaws: dict[str, int] | None = None, min_points: int = 200) -> DataFrame:
    """Shift along the belt that lays the footprints of ``moving`` on those of ``reference``: by..., yaw, slide, score.

    Points carry by..., u (along), v (across), h. Occupied cells of what lies between the heights ``top`` and within
    ``cross`` of the axis and ``span`` along it are compared inside the stretch that ``moving`` occupies: shared cells
    over cells of either. ``yaws`` names the ways the belt may lie, 1 or -1 for (u, v) or (-u, -v); the best of both is
    returned. Shifts that would leave the raster are not tried. Of equal scores the first way and the smallest shift win.
    Too few points on one side give slide 0 and score 0.
    """
    yaws = {"0": 1, "180": -1} if yaws is None else yaws
    nu, nv, steps = int(2 * span / cell) + 1, int(2 * cross / cell) + 1, int(reach / cell)

    def mask(points: DataFrame, keys: list[str]) -> DataFrame:
        band = points.filter((F.col("h") > top[0]) & (F.col("h") < top[1]))
        full = band.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points).select(*keys)
        iu, iv = F.floor((F.col("u") + span) / cell).cast("long"), F.floor((F.col("v") + cross) / cell).cast("long")
        at = band.join(full, keys, "left_semi").filter(F.abs("v") <= cross).select(*keys, iu.alias("iu"), iv.alias("iv"))
        return at.filter((F.col("iu") >= 0) & (F.col("iu") < nu) & (F.col("iv") >= 0) & (F.col("iv") < nv)).distinct()

    way = F.explode(F.array(*[F.struct(F.lit(k).alias("no"), F.lit(name).alias("yaw"), F.lit(float(s)).alias("sign")) for k, (name, s) in enumerate(yaws.items())]))
    keys = [*by, "no", "yaw"]
    a = materialise(mask(reference, by), "slide-reference")
    turned = moving.select(*by, "u", "v", "h", way.alias("_w")).select(*by, "_w.no", "_w.yaw", (F.col("_w.sign") * F.col("u")).alias("u"), (F.col("_w.sign") * F.col("v")).alias("v"), "h")
    b = materialise(mask(turned, keys), "slide-moving")
    hypotheses = moving.select(*by).distinct().select(*by, way.alias("_w")).select(*by, "_w.no", "_w.yaw")
    both = hypotheses.join(a, by)
    shared = shared_cells_by_shift(both, b, keys, steps)
    stretch = b.groupBy(*keys).agg(F.min("iu").alias("c0"), (F.max("iu") + 1).alias("c1"), F.count(F.lit(1)).alias("nb"))
    columns = a.groupBy(*by, "iu").agg(F.count(F.lit(1)).alias("c"))
    places = a.select(*by).distinct().withColumn("iu", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nu).cast("long")))).withColumn("c", F.lit(0).cast("long"))
    running = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("iu").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = places.unionByName(columns).withColumn("before", running).select(*by, "iu", "before").distinct()
    tried = shared.join(stretch, keys).withColumns({"lo": F.col("c0") + F.col("k"), "hi": F.col("c1") + F.col("k")}).filter((F.col("lo") >= 0) & (F.col("hi") <= nu))
    inside = tried.join(before.select(*by, F.col("iu").alias("lo"), F.col("before").alias("p0")), [*by, "lo"]).join(before.select(*by, F.col("iu").alias("hi"), F.col("before").alias("p1")), [*by, "hi"])
    scored = inside.withColumn("score", F.col("shared") / F.greatest(F.col("p1") - F.col("p0") + F.col("nb") - F.col("shared"), F.lit(1)))
    best = scored.groupBy(*by).agg(F.max_by(F.struct("yaw", "k", "score"), F.struct(F.col("score"), -F.col("no"), -F.col("k"))).alias("_b"))
    first = next(iter(yaws))
    return moving.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce("_b.yaw", F.lit(first)).alias("yaw"), F.coalesce(F.col("_b.k") * cell, F.lit(0.0)).alias("slide"), F.coalesce("_b.score", F.lit(0.0)).alias("score"))


# ---- slide and scale together


def _grid(lo: float, hi: float, step: float) -> list[float]:
    return [float(x) for x in np.arange(lo, hi, step)]


def _neighbourhood(points: DataFrame, by: list[str], size: float, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Cells of edge ``size`` that hold a point or touch a cell that does."""
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((a, b, c), "abc")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    cells = points.select(*by, *[F.floor(F.col(n) / size).cast("long").alias("g" + n) for n in names]).distinct().withColumn("_s", step)
    return cells.select(*by, *[(F.col("g" + n) + F.col(f"_s.{d}")).alias("g" + n) for n, d in zip(names, "abc")]).distinct()


def _supported(moved: DataFrame, target: DataFrame, by: list[str], tol: float) -> DataFrame:
    """Rows of ``moved`` (by..., x, y, z) with a target point within ``tol``: each meets the targets of 27 cells, until one is near."""
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((a, b, c), "abc")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    near = target.select(*by, "x", "y", "z", step.alias("_s")).select(*by, *[F.col(n).alias("t" + n) for n in "xyz"], *[(F.floor(F.col(n) / tol).cast("long") + F.col(f"_s.{d}")).alias("g" + n) for n, d in zip("xyz", "abc")])
    at = moved.withColumns({"g" + n: F.floor(F.col(n) / tol).cast("long") for n in "xyz"}).alias("m")
    same = F.lit(True)
    for c in [*by, "gx", "gy", "gz"]:
        same = same & (F.col(f"m.{c}") == F.col(f"t.{c}"))
    gap = sum((F.pow(F.col(f"m.{n}") - F.col(f"t.t{n}"), 2) for n in "yz"), F.pow(F.col("m.x") - F.col("t.tx"), 2))
    return at.join(near.alias("t"), same & (gap <= tol * tol), "left_semi")


def _search(rows: DataFrame, target: DataFrame, by: list[str], grids: DataFrame, tol: float, min_points: int, max_deck_off: float, top_min: float, tile: int) -> DataFrame:
    """Best (s, d) of each group's candidates ``grids`` (by..., si, s, di, d): by..., s, d, score, n.

    Candidates are bound in boxes of ``tile`` x ``tile``: a point of the box can only be supported if a target lies
    within ``tol`` and the way it moves inside the box, which an occupied-cell test answers for all candidates at once.
    The box's middle candidate is scored exactly. Boxes whose bound is below the best middle are left, the candidates of
    the others are scored.
    """
    grids = materialise(grids, "search-grid")
    s_only = grids.select(*by, "si", "s").distinct()
    h = s_only.join(rows, by).withColumn("h", F.col("s") * F.col("hp") - F.col("hc"))
    off = median(h, [*by, "si"], "h", "off").drop("n")
    sound = h.groupBy(*by, "si", "s").agg(F.count_if(F.col("h") > top_min).alias("n")).join(off, [*by, "si"]).filter((F.abs("off") <= max_deck_off) & (F.col("n") >= min_points))
    sound = materialise(sound, "search-scales")
    cand = materialise(grids.join(sound.select(*by, "si", "n", "off"), [*by, "si"]), "search-candidates")

    def moved(at: DataFrame) -> DataFrame:
        j = at.join(rows, by).filter(F.col("s") * F.col("hp") - F.col("hc") > top_min)
        return j.select(*at.columns, *[(F.col("s") * F.col(c) + F.col("d") * F.col("e" + c)).alias(c) for c in "xyz"])

    def exact(at: DataFrame) -> DataFrame:
        hits = _supported(moved(at), target, by, tol).groupBy(*by, "si", "di").agg(F.count(F.lit(1)).alias("hits"))
        return at.join(hits, [*by, "si", "di"], "left").withColumn("score", F.coalesce("hits", F.lit(0)) / F.col("n"))

    box = [*by, F.floor(F.col("si") / tile).alias("sb"), F.floor(F.col("di") / tile).alias("db")]
    boxed = cand.withColumns({"sb": F.floor(F.col("si") / tile), "db": F.floor(F.col("di") / tile)})
    edges = cand.groupBy(*box).agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("n").alias("least"))
    middle = boxed.withColumn("_e", F.abs(F.col("si") - F.col("sb") * tile - tile // 2) + F.abs(F.col("di") - F.col("db") * tile - tile // 2))
    middle = middle.groupBy(*by, "sb", "db").agg(F.min_by(F.struct("si", "s", "di", "d", "n", "off"), F.struct("_e", "si", "di")).alias("_m")).select(*by, "_m.*")
    known = materialise(exact(middle), "search-middles")
    floor_ = known.groupBy(*by).agg(F.max("score").alias("best"))
    # the way from the box's middle: half its scale step times the point's size, and half its slide
    j = materialise(edges, "search-boxes").join(rows, by)
    mid_s, mid_d = (F.col("s0") + F.col("s1")) / 2, (F.col("d0") + F.col("d1")) / 2
    way = (F.col("s1") - F.col("s0")) / 2 * F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) + (F.col("d1") - F.col("d0")) / 2
    level = F.greatest(F.ceil(F.log2((way + tol) / tol)), F.lit(0)).cast("int")  # cells of tol times a power of two
    tall = F.greatest(F.col("s0") * F.col("hp"), F.col("s1") * F.col("hp")) - F.col("hc") > top_min
    cells = j.filter(tall).select(*by, "sb", "db", level.alias("level"), *[(mid_s * F.col(c) + mid_d * F.col("e" + c)).alias(c) for c in "xyz"])
    top = cells.agg(F.max("level")).first()[0]
    hits = None
    for k in range((top or 0) + 1):
        size = tol * 2.0**k
        at = cells.filter(F.col("level") == k).select(*by, "sb", "db", *[F.floor(F.col(c) / size).cast("long").alias("g" + c) for c in "xyz"])
        got = at.join(_neighbourhood(target, by, size), [*by, "gx", "gy", "gz"], "left_semi").groupBy(*by, "sb", "db").agg(F.count(F.lit(1)).alias("hits"))
        hits = got if hits is None else hits.unionByName(got)
    bound = hits.groupBy(*by, "sb", "db").agg(F.sum("hits").alias("hits")).join(edges.select(*by, "sb", "db", "least"), [*by, "sb", "db"]).join(floor_, by)
    open_ = bound.filter(F.col("hits") / F.col("least") >= F.col("best") - 1e-12).select(*by, "sb", "db")
    left = boxed.join(open_, [*by, "sb", "db"], "left_semi").select(*by, "si", "s", "di", "d", "n", "off")
    scored = materialise(exact(left).select(*by, "si", "s", "di", "d", "n", "off", "score").unionByName(known.select(*by, "si", "s", "di", "d", "n", "off", "score")), "search-scores")
    best = F.max_by(F.struct("s", "d", "score", "n", "off"), F.struct(F.col("score"), -F.col("si"), -F.col("di")))
    return scored.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def slide_and_scale(moving: DataFrame, reference: DataFrame, frames: DataFrame, by: list[str], scales: tuple[float, float, float], slides: tuple[float, float, float], tol: float, top_min: float, max_deck_off: float, min_points: int = 500, fine: int = 8, tile: int = 8) -> DataFrame:
    """Scale about the origin and shift along the belt with most support: by..., scale, slide, support, deck_off.

    ``moving`` and ``reference`` carry by..., x, y, z; ``frames`` by..., centre, ex, n (arrays of three: a point of the
    deck, the belt's direction, the deck's unit normal). Support of (s, d) is the share of moved points s P + d ex higher
    than ``top_min`` above the deck that have a reference point within ``tol``. A scale counts if the median height stays
    within ``max_deck_off`` of the deck and ``min_points`` are that high. ``scales`` and ``slides`` are (first, end, step);
    a second search about the winner uses a step ``fine`` times smaller. The first of equal candidates, by scale and then
    slide, wins, and a finer one must be better. Groups without a sound candidate return scale 1, slide 0, support 0.
    """
    f = frames.select(*by, *[F.col("ex")[i].alias("e" + "xyz"[i]) for i in range(3)], *[F.col("n")[i].alias("n" + "xyz"[i]) for i in range(3)], dot([F.col("centre")[i] for i in range(3)], [F.col("n")[i] for i in range(3)]).alias("hc"))
    rows = materialise(moving.select(*by, *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(f, by).select(*by, "x", "y", "z", "ex", "ey", "ez", dot(vec("x", "y", "z"), vec("nx", "ny", "nz")).alias("hp"), "hc"), "search-points")
    target = materialise(reference.select(*by, *[F.col(c).cast("double").alias(c) for c in "xyz"]), "search-target")

    def grid(values: list[float], i: str, v: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(k).alias(i), F.lit(x).alias(v)) for k, x in enumerate(values)]))

    groups = materialise(rows.select(*by).distinct(), "search-groups")
    coarse = groups.withColumn("_s", grid(_grid(*scales), "si", "s")).withColumn("_d", grid(_grid(slides[0], slides[1] + 1e-9, slides[2]), "di", "d")).select(*by, "_s.*", "_d.*")
    args = (tol, min_points, max_deck_off, top_min, tile)
    first = materialise(_search(rows, target, by, coarse, *args), "search-coarse")

    def around(step: float, i: str, v: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(k).alias(i), (F.col("_" + v) - step + k * step / fine).alias(v)) for k in range(2 * fine)]))

    near = first.select(*by, F.col("s").alias("_s"), F.col("d").alias("_d")).withColumn("_a", around(scales[2], "si", "s")).withColumn("_b", around(slides[2], "di", "d")).select(*by, "_a.*", "_b.*")
    second = _search(rows, target, by, near, *args)
    better = first.join(second.select(*by, *[F.col(c).alias("f" + c) for c in ("s", "d", "score", "off")]), by, "left").withColumn("_f", F.coalesce(F.col("fscore") > F.col("score"), F.lit(False)))
    picked = better.select(*by, *[F.when(F.col("_f"), F.col("f" + c)).otherwise(F.col(c)).alias(n) for c, n in (("s", "scale"), ("d", "slide"), ("score", "support"), ("off", "deck_off"))])
    return groups.join(picked, by, "left").select(*by, F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("slide", F.lit(0.0)).alias("slide"), F.coalesce("support", F.lit(0.0)).alias("support"), "deck_off")


# ---- depth scale


def depth_scale(points: DataFrame, cameras: DataFrame, by: list[str], reference: str, lo: float, hi: float, steps: int, cap: float, refine: int = 12, min_points: int = 100, min_contrast: float = 0.15, levels: int = 3, pid: str = "pid") -> tuple[DataFrame, DataFrame]:
    """Depth scale at which the cameras of a group agree best: (best, probes).

    ``points``: by..., camera, ``pid``, x, y, z in the camera's own frame; the reference camera's also nx, ny, nz.
    ``cameras``: camera, R, t (rig to camera, the reference camera's frame being the rig's). At scale k every cloud is
    scaled about its own camera. A side camera's score is the median distance of its points to the plane of their nearest
    reference point within ``cap`` k, over the median distance of the reference cloud; a scale's score is the mean of
    the sides' that have ``min_points`` such pairs. Scaling does not turn normals, so those given are used at every scale.

    ``probes``: by..., k, score at ``steps`` scales from lo to hi (NULL where no side can be scored). ``best``: by...,
    scale, score (the best probe's), contrast (how far the best lies below the median probe), degenerate, at_edge. The
    scale is the middle of ``refine`` golden sections about the best probe, all groups narrowing in the same passes.
    """
    cams = cameras.select("camera", "R", "t")
    rows = materialise(points.select(*by, "camera", pid, *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz")]).join(cams, "camera"), "scale-points")
    ref = rows.filter(F.col("camera") == reference)
    length = median(ref, by, F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), "length").filter((F.col("n") >= min_points) & (F.col("length") >= 1e-6)).select(*by, "length")
    length = materialise(length, "scale-lengths")
    index = target_cells(ref, by, cap, 1, pid, levels=levels)

    def scores(ks: DataFrame) -> DataFrame:
        """by..., probe, k, score for rows of by..., probe, k; clouds are met in units of k, so one search radius serves all."""
        keys = [*by, "probe", "camera"]
        at = rows.join(ks.join(length, by, "left_semi"), by)
        side = at.filter(F.col("camera") != reference)
        x, y, z = cam_to_rig((F.col("k") * F.col("x"), F.col("k") * F.col("y"), F.col("k") * F.col("z")))
        side = materialise(side.select(*keys, "k", pid, (x / F.col("k")).alias("_x"), (y / F.col("k")).alias("_y"), (z / F.col("k")).alias("_z")).withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"}), "scale-sides")
        searched = side.withColumn("_sid", F.struct("probe", "camera", pid))  # one reference cloud serves every scale and camera
        near = k_nearest(searched, ref, by, cap, 1, "_sid", pid, levels=levels, index=index).select(*by, "_sid.probe", "_sid.camera", F.col("_sid." + pid).alias(pid), "nn")
        r = ref.select(*by, F.col(pid).alias("nn"), *[F.col(c).alias("r" + c) for c in "xyz"], "nx", "ny", "nz")
        gap = F.abs(sum(((F.col(c) - F.col("r" + c)) * F.col("n" + c) for c in "yz"), (F.col("x") - F.col("rx")) * F.col("nx")))
        pairs = materialise(side.join(near, [*keys, pid]).join(r, [*by, "nn"]).select(*keys, gap.alias("_gap")), "scale-gaps")
        per = median(pairs, keys, "_gap", "gap").filter(F.col("n") >= min_points).join(length, by)
        got = per.groupBy(*by, "probe").agg(F.avg(F.col("gap") / F.col("length")).alias("score"))
        return materialise(ks.join(got, [*by, "probe"], "left").select(*by, "probe", "k", "score"), "scale-scores")

    groups = materialise(rows.select(*by).distinct(), "scale-groups")
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("probe"), F.lit(float(k)).alias("k")) for i, k in enumerate(np.linspace(lo, hi, steps))]))
    probes = scores(groups.withColumn("_g", grid).select(*by, "_g.*"))
    middle = median(probes, by, "score", "_mid").select(*by, "_mid", F.col("n").alias("_n"))
    best = probes.filter("score IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct("probe", "k", "score"), F.struct("score", "probe")).alias("_b")).select(*by, "_b.*").join(middle, by)
    contrast = F.when((F.col("_n") >= 3) & (F.col("_mid") > 0), (F.col("_mid") - F.col("score")) / F.col("_mid")).otherwise(0.0)
    width = (hi - lo) / max(steps - 1, 1)
    best = materialise(best.withColumn("contrast", contrast).withColumns({"a": F.greatest(F.col("k") - width, F.lit(lo)), "b": F.least(F.col("k") + width, F.lit(hi))}), "scale-best")
    golden = (math.sqrt(5) - 1) / 2
    state = best.select(*by, "a", "b").withColumns({"c": F.col("b") - golden * (F.col("b") - F.col("a")), "d": F.col("a") + golden * (F.col("b") - F.col("a"))})
    ends = scores(state.withColumn("_e", F.explode(F.array(*[F.struct(F.lit(i).alias("probe"), F.col(n).alias("k")) for i, n in enumerate("cd")]))).select(*by, "_e.*")) if refine else None
    if refine:
        value = F.coalesce("score", F.lit(float("inf")))
        wide = ends.groupBy(*by).agg(F.max(F.when(F.col("probe") == 0, value)).alias("fc"), F.max(F.when(F.col("probe") == 1, value)).alias("fd"))
        state = materialise(state.join(wide, by), "scale-state")
    for _ in range(refine):
        left = F.col("fc") < F.col("fd")
        na, nb = F.when(left, F.col("a")).otherwise(F.col("c")), F.when(left, F.col("d")).otherwise(F.col("b"))
        moved = state.select(*by, left.alias("_l"), na.alias("a"), nb.alias("b"), "c", "d", "fc", "fd")
        fresh = F.when(F.col("_l"), F.col("b") - golden * (F.col("b") - F.col("a"))).otherwise(F.col("a") + golden * (F.col("b") - F.col("a")))
        moved = materialise(moved.withColumn("k", fresh), "scale-state")
        new = scores(moved.select(*by, F.lit(0).alias("probe"), "k")).select(*by, F.coalesce("score", F.lit(float("inf"))).alias("f"))
        j = moved.join(new, by)
        state = materialise(j.select(
            *by, "a", "b", F.when(F.col("_l"), F.col("k")).otherwise(F.col("d")).alias("c"), F.when(F.col("_l"), F.col("c")).otherwise(F.col("k")).alias("d"),
            F.when(F.col("_l"), F.col("f")).otherwise(F.col("fd")).alias("fc"), F.when(F.col("_l"), F.col("fc")).otherwise(F.col("f")).alias("fd")), "scale-state")
    out = best.join(state.select(*by, ((F.col("a") + F.col("b")) / 2).alias("scale")), by)
    edge = F.col("probe").isin(0, steps - 1)
    return groups.join(out, by, "left").select(*by, "scale", "score", "contrast", (F.col("contrast") < min_contrast).alias("degenerate"), edge.alias("at_edge")), probes.select(*by, "k", "score")
