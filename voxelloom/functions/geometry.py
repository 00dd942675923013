"""Camera, pose and plane geometry as Column expressions.

A camera row carries ``fx fy cx cy``, ``dist array<double>`` (k1 k2 p1 p2 k3), ``width height``,
``R array<double>`` (3x3, row major, world to camera) and ``t array<double>``.
A plane is ``n.x + d = 0``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def item3(array: str) -> Vec:
    return tuple(F.col(array)[i] for i in range(3))  # type: ignore[return-value]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))  # type: ignore[return-value]


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def scale_intrinsics(src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> dict[str, Column]:
    """Intrinsics after a resize; the principal point moves with pixel centres."""
    sx, sy = dst_w / src_w, dst_h / src_h
    return {
        "fx": F.col("fx") * sx,
        "fy": F.col("fy") * sy,
        "cx": (F.col("cx") + 0.5) * sx - 0.5,
        "cy": (F.col("cy") + 0.5) * sy - 0.5,
    }


def pixel_ray(u: Column, v: Column) -> Vec:
    return ((u - F.col("cx")) / F.col("fx"), (v - F.col("cy")) / F.col("fy"), F.lit(1.0))


def unproject(z: Column, u: Column, v: Column, mode: str = "z") -> Vec:
    """Camera-frame point of a pixel; NULL where the depth is not finite and positive."""
    rx, ry, _ = pixel_ray(u, v)
    depth = z / F.sqrt(1.0 + rx * rx + ry * ry) if mode == "range" else z
    depth = F.when((z > 0) & ~F.isnan(z) & (z < float("inf")), depth)
    return rx * depth, ry * depth, depth


def cam_to_rig(p: Vec) -> Vec:
    """Transpose of R applied to (p - t)."""
    q = minus(p, item3("t"))
    return tuple(  # type: ignore[return-value]
        sum((F.col("R")[3 * i + j] * q[i] for i in range(1, 3)), F.col("R")[j] * q[0])
        for j in range(3)
    )


def rig_to_cam(p: Vec) -> Vec:
    return tuple(  # type: ignore[return-value]
        dot([F.col("R")[3 * i + j] for j in range(3)], p) + F.col("t")[i] for i in range(3)
    )


def project_pinhole(p: Vec) -> tuple[Column, Column, Column]:
    """(u, v, z) in the image; u and v NULL when not in front of the camera."""
    x, y, z = rig_to_cam(p)
    front = z > 1e-6
    return (
        F.when(front, F.col("fx") * x / z + F.col("cx")),
        F.when(front, F.col("fy") * y / z + F.col("cy")),
        z,
    )


def project_brown(p: Vec) -> tuple[Column, Column, Column]:
    """Pinhole with radial k1 k2 k3 and tangential p1 p2 distortion."""
    xc, yc, z = rig_to_cam(p)
    front = z > 1e-6
    x, y = xc / z, yc / z
    k1, k2, p1, p2, k3 = (F.coalesce(F.get(F.col("dist"), F.lit(i)), F.lit(0.0)) for i in range(5))
    r2 = x * x + y * y
    radial = 1.0 + r2 * (k1 + r2 * (k2 + r2 * k3))
    xd = x * radial + 2.0 * p1 * x * y + p2 * (r2 + 2.0 * x * x)
    yd = y * radial + p1 * (r2 + 2.0 * y * y) + 2.0 * p2 * x * y
    return (
        F.when(front, F.col("fx") * xd + F.col("cx")),
        F.when(front, F.col("fy") * yd + F.col("cy")),
        z,
    )


def visible(u: Column, v: Column, margin: float = 0.0) -> Column:
    inside = (
        (u >= margin)
        & (v >= margin)
        & (u < F.col("width") - margin)
        & (v < F.col("height") - margin)
    )
    return F.coalesce(inside, F.lit(False))


def camera_centre() -> Vec:
    return cam_to_rig((F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def baselines(cameras: DataFrame, by: list[str], camera: str = "camera") -> DataFrame:
    """One row per camera pair of a rig: length, lateral and axial parts of the baseline.

    A rig has a handful of cameras, so the pair table stays a small multiple of the camera table.
    """
    cx, cy, cz = camera_centre()
    c = cameras.select(*by, camera, cx.alias("x"), cy.alias("y"), cz.alias("z"))
    a = c.select(*by, F.col(camera).alias("cam_a"), *[F.col(k).alias("a" + k) for k in "xyz"])
    b = c.select(*by, F.col(camera).alias("cam_b"), *[F.col(k).alias("b" + k) for k in "xyz"])
    d = minus(vec("bx", "by", "bz"), vec("ax", "ay", "az"))
    return (
        a.join(b, by)
        .filter("cam_a < cam_b")
        .select(
            *by,
            "cam_a",
            "cam_b",
            norm(d).alias("baseline"),
            F.hypot(d[0], d[1]).alias("lateral"),
            F.abs(d[2]).alias("axial"),
        )
    )


def belt_axes(belts: DataFrame) -> DataFrame:
    """Orthonormal belt frame from ``centre x_axis y_axis`` arrays; normal towards the origin camera."""
    ex0, ey0, c = item3("x_axis"), item3("y_axis"), item3("centre")
    lx = norm(ex0)
    step1 = belts.withColumns({f"_x{i}": ex0[i] / lx for i in range(3)})
    x = vec("_x0", "_x1", "_x2")
    along = dot(ey0, x)
    step2 = step1.withColumns({f"_y{i}": ey0[i] - x[i] * along for i in range(3)})
    y = vec("_y0", "_y1", "_y2")
    ly = norm(y)
    step3 = step2.withColumns({f"_y{i}": y[i] / ly for i in range(3)})
    n = cross(x, y)
    flip = F.when(-dot(n, c) < 0, -1.0).otherwise(1.0)
    return step3.select(
        *belts.columns,
        F.array(*x).alias("ex"),
        F.array(*[v * flip for v in y]).alias("ey"),
        F.array(*[v * flip for v in n]).alias("n"),
    )


def to_belt_frame(p: Vec) -> dict[str, Column]:
    rel = minus(p, item3("centre"))
    return {"u": dot(rel, item3("ex")), "v": dot(rel, item3("ey")), "h": dot(rel, item3("n"))}


def from_belt_frame(u: Column, v: Column, h: Column) -> Vec:
    return tuple(  # type: ignore[return-value]
        F.col("centre")[i] + u * F.col("ex")[i] + v * F.col("ey")[i] + h * F.col("n")[i] for i in range(3)
    )


def apply_rigid(p: Vec, m: Column) -> Vec:
    """Apply a row-major 4x4 transform held as array<double>(16)."""
    return tuple(dot([m[4 * i + j] for j in range(3)], p) + m[4 * i + 3] for i in range(3))  # type: ignore[return-value]


def compose(a: Column, b: Column) -> Column:
    """Row-major 4x4 product a.b as an array expression."""
    cells = []
    for i in range(4):
        for j in range(4):
            term = a[4 * i] * b[j]
            for k in range(1, 4):
                term = term + a[4 * i + k] * b[4 * k + j]
            cells.append(term)
    return F.array(*cells)


def scale_depth_along_ray(p: Vec, a: Column, b: Column) -> Vec:
    z2 = a * p[2] + b
    f = F.when(F.abs(p[2]) > 1e-6, z2 / p[2]).otherwise(1.0)
    return p[0] * f, p[1] * f, z2


def scale_about_camera(p: Vec, c: Vec, s: Column, slide: Column | None = None, along: Vec | None = None) -> Vec:
    out = tuple(c[i] + (p[i] - c[i]) * s for i in range(3))
    if slide is not None and along is not None:
        out = tuple(out[i] + slide * along[i] for i in range(3))
    return out  # type: ignore[return-value]


def height_from_depth(z: Column, ray: Vec, n: Vec, d: Column) -> Column:
    return z * dot(n, ray) - d


def height_correct(z: Column, ray: Vec, n: Vec, d: Column, alpha: Column, beta: Column) -> Column:
    """Depth whose height over the plane is alpha*h + beta; NULL where no such depth lies ahead."""
    slope = dot(n, ray)
    corrected = (alpha * (z * slope - d) + beta + d) / slope
    return F.when((F.abs(slope) > 1e-9) & (corrected > 0), corrected)


def field_correct(z: Column, rx: Column, ry: Column, s: Column, a: Column, b: Column, c: Column) -> Column:
    return F.when(z > 0, z * (s + a * rx + b * ry) + c).otherwise(z)


def inverse_depth_affine(z: Column, a: Column, b: Column) -> Column:
    inv = a / z + b
    return F.when(inv > 0, 1.0 / inv)


def inverse_depth_polynomial(z: Column, u: Column, v: Column, a: list[Column], b: list[Column]) -> Column:
    """1/z' = A(u,v)/z + B(u,v), terms in the order 1, u, v, u^2, uv, v^2 up to the order given."""
    terms = [F.lit(1.0), u, v, u * u, u * v, v * v]

    def poly(coef: list[Column]) -> Column:
        total = coef[0] * terms[0]
        for k in range(1, len(coef)):
            total = total + coef[k] * terms[k]
        return total

    inv = poly(a) / z + poly(b)
    return F.when(inv > 0, 1.0 / inv)


def plane_target_depth(ray: Vec, n: Vec, d: Column) -> Column:
    """Depth along the ray at which n.x = d; NULL unless in front."""
    slope = dot(n, ray)
    depth = d / slope
    return F.when((F.abs(slope) > 1e-9) & (depth > 0), depth)


def plane_to_camera(n: Vec, d: Column) -> tuple[Vec, Column]:
    """World plane n.x = d seen from the camera: (R n, d + n_c.t)."""
    nc = tuple(dot([F.col("R")[3 * i + j] for j in range(3)], n) for i in range(3))
    return nc, d + dot(nc, item3("t"))  # type: ignore[return-value]


def plane_to_world(nc: Vec, dc: Column) -> tuple[Vec, Column]:
    n = tuple(dot([F.col("R")[3 * i + j] for i in range(3)], nc) for j in range(3))
    return n, dc - dot(nc, item3("t"))  # type: ignore[return-value]


def incidence_deg(n: Vec, p: Vec, c: Vec) -> Column:
    ray = minus(c, p)
    length = norm(ray) * norm(n)
    return F.when(length > 1e-12, F.degrees(F.acos(clamp(F.abs(dot(n, ray)) / length, 0.0, 1.0)))).otherwise(90.0)


def rotation_angle_deg(ra: Column, rb: Column) -> Column:
    """Angle of Ra.Rb^T; its trace is the elementwise product sum."""
    trace = ra[0] * rb[0]
    for i in range(1, 9):
        trace = trace + ra[i] * rb[i]
    return F.degrees(F.acos(clamp((trace - 1.0) / 2.0, -1.0, 1.0)))


def roll_deg(r: Column) -> Column:
    return F.degrees(F.atan2(r[1], r[0]))


def pose_columns(r: Column) -> dict[str, Column]:
    """Unit quaternion (w x y z) and ZYX Euler angles of a row-major rotation.

    Where the pitch is a right angle, roll and yaw turn about the same axis: the roll then takes all of it and the yaw is 0.
    """
    m = [[r[3 * i + j] for j in range(3)] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    by_x = (m[0][0] > m[1][1]) & (m[0][0] > m[2][2])
    by_y = m[1][1] > m[2][2]
    # four times the dominant component squared, for each branch
    sw = 2.0 * F.sqrt(F.greatest(trace + 1.0, F.lit(1e-18)))
    sx = 2.0 * F.sqrt(F.greatest(1.0 + m[0][0] - m[1][1] - m[2][2], F.lit(1e-18)))
    sy = 2.0 * F.sqrt(F.greatest(1.0 + m[1][1] - m[0][0] - m[2][2], F.lit(1e-18)))
    sz = 2.0 * F.sqrt(F.greatest(1.0 + m[2][2] - m[0][0] - m[1][1], F.lit(1e-18)))
    d21, d02, d10 = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    p01, p02, p12 = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]

    def branch(w: Column, x: Column, y: Column, z: Column) -> Column:
        return F.when(trace > 0, w).when(by_x, x).when(by_y, y).otherwise(z)

    locked = F.abs(m[2][0]) >= 0.999999

    return {
        "qw": branch(sw / 4, d21 / sx, d02 / sy, d10 / sz),
        "qx": branch(d21 / sw, sx / 4, p01 / sy, p02 / sz),
        "qy": branch(d02 / sw, p01 / sx, sy / 4, p12 / sz),
        "qz": branch(d10 / sw, p02 / sx, p12 / sy, sz / 4),
        "roll_deg": F.degrees(F.when(locked, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2]))),
        "pitch_deg": F.degrees(F.atan2(-m[2][0], F.hypot(m[0][0], m[1][0]))),
        "yaw_deg": F.degrees(F.when(locked, 0.0).otherwise(F.atan2(m[1][0], m[0][0]))),
    }


def wrap_yaw(deg: Column) -> Column:
    return F.pmod(deg + 90.0, F.lit(180.0)) - 90.0


def epipolar_distance(u1: Column, v1: Column, u2: Column, v2: Column, f: Column) -> Column:
    """Distance in pixels of (u2, v2) from the epipolar line of (u1, v1); f is a row-major 3x3."""
    line = [f[3 * i] * u1 + f[3 * i + 1] * v1 + f[3 * i + 2] for i in range(3)]
    return F.abs(u2 * line[0] + v2 * line[1] + line[2]) / F.greatest(F.hypot(line[0], line[1]), F.lit(1e-12))


def triangulate(c1: Vec, r1: Vec, c2: Vec, r2: Vec) -> dict[str, Column]:
    """Midpoint of the shortest segment between two rays, its length, the parallax and both depths."""
    w = minus(c1, c2)
    a, b, c = dot(r1, r1), dot(r1, r2), dot(r2, r2)
    d, e = dot(r1, w), dot(r2, w)
    det = a * c - b * b
    s = F.when(F.abs(det) > 1e-12, (b * e - c * d) / det)
    t = F.when(F.abs(det) > 1e-12, (a * e - b * d) / det)
    p = tuple(c1[i] + s * r1[i] for i in range(3))
    q = tuple(c2[i] + t * r2[i] for i in range(3))
    return {
        "x": (p[0] + q[0]) / 2,
        "y": (p[1] + q[1]) / 2,
        "z": (p[2] + q[2]) / 2,
        "gap": norm(minus(p, q)),  # type: ignore[arg-type]
        "parallax_deg": F.degrees(F.acos(clamp(b / F.sqrt(a * c), -1.0, 1.0))),
        "depth_1": s,
        "depth_2": t,
    }


def residual_after_deployed(deficit: Column, h: Column, alpha: Column, beta: Column, sign: float = 1.0) -> Column:
    return alpha * deficit + sign * ((alpha - 1.0) * h + beta)


def rect_corners(centre: Vec, ax: Vec, ay: Vec, length: Column, width: Column) -> Column:
    """The four corners in order around the rectangle, as array<struct<x,y,z>>."""
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(
        *[
            F.struct(
                *[
                    (centre[i] + ax[i] * (length * (sl / 2)) + ay[i] * (width * (sw / 2))).alias("xyz"[i])
                    for i in range(3)
                ]
            )
            for sl, sw in signs
        ]
    )


def cuboid_corners(centre: Vec, ax: Vec, ay: Vec, n: Vec, length: Column, width: Column, height: Column) -> Column:
    """Top face corners followed by the four below them."""
    low = tuple(centre[i] - n[i] * height for i in range(3))
    return F.concat(rect_corners(centre, ax, ay, length, width), rect_corners(low, ax, ay, length, width))  # type: ignore[arg-type]


def pre_pick(centre: Vec, n: Vec, offset: float = 0.100) -> Vec:
    return tuple(centre[i] + n[i] * offset for i in range(3))  # type: ignore[return-value]
