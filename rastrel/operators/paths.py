"""Path geometry: the SVG path grammar, line merging, circle and ellipse fits, primitive snapping."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

_TOKEN = re.compile(r"([MmLlHhVvCcZzAaSsQqTt])|(-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "Z": 0}


def parse_path(d: str) -> list[dict] | None:
    """Subpaths of absolute line and cubic segments, or None for commands beyond M L H V C Z."""
    found = _TOKEN.findall(d or "")
    out: list[dict] = []
    x = y = 0.0
    i, command = 0, ""
    sub: dict | None = None
    while i < len(found):
        letter, _ = found[i]
        if letter:
            command, i = letter, i + 1
            if command.upper() not in _ARGS:
                return None
            if command in "Zz":
                if sub:
                    sub["closed"] = True
                    x, y = sub["start"]
                continue
        if not command or command in "Zz":
            return None
        n = _ARGS[command.upper()]
        if i + n > len(found) or any(a for a, _ in found[i : i + n]):
            return None
        v, i = [float(b) for _, b in found[i : i + n]], i + n
        ox, oy = (x, y) if command.islower() else (0.0, 0.0)
        kind = command.upper()
        if kind == "M":
            x, y = v[0] + ox, v[1] + oy
            sub = {"start": (x, y), "segs": [], "closed": False}
            out.append(sub)
            command = "l" if command == "m" else "L"
            continue
        if sub is None:
            return None
        if sub["closed"]:
            sub = {"start": (x, y), "segs": [], "closed": False}
            out.append(sub)
        if kind == "C":
            seg = ("C", v[0] + ox, v[1] + oy, v[2] + ox, v[3] + oy, v[4] + ox, v[5] + oy)
        else:
            to = (v[0] + ox, y) if kind == "H" else (x, v[0] + oy) if kind == "V" else (v[0] + ox, v[1] + oy)
            seg = ("L", 0.0, 0.0, 0.0, 0.0, *to)
        sub["segs"].append(seg)
        x, y = seg[5], seg[6]
    return out


def flatten(sub: dict, steps: int = 12) -> np.ndarray:
    """Points along a subpath; cubics are evaluated at ``steps`` parameters."""
    pts = [sub["start"]]
    for kind, x1, y1, x2, y2, x, y in sub["segs"]:
        if kind == "C":
            x0, y0 = pts[-1]
            for k in range(1, steps + 1):
                t = k / steps
                a, b, c, d = (1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3
                pts.append((a * x0 + b * x1 + c * x2 + d * x, a * y0 + b * y1 + c * y2 + d * y))
        else:
            pts.append((x, y))
    return np.array(pts)


def merge_lines(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Drop vertices greedily while every dropped one stays within ``tolerance`` of the chord that replaces it."""
    keep, at = [0], 0
    while at < len(points) - 1:
        to = at + 1
        while to + 1 < len(points):
            a, b = points[at], points[to + 1]
            ab = b - a
            n = float(ab @ ab)
            mid = points[at + 1 : to + 1]
            t = np.clip(((mid - a) @ ab) / n, 0, 1) if n > 0 else np.zeros(len(mid))
            if np.hypot(*(mid - a - t[:, None] * ab).T).max() > tolerance:
                break
            to += 1
        keep.append(to)
        at = to
    return points[keep]


def fit_circle(p: np.ndarray) -> tuple[float, float, float, float] | None:
    """(cx, cy, r, worst residual) of the algebraic least-squares circle, or None if singular."""
    m = p.mean(0)
    q = p - m
    a = np.hstack([q, np.ones((len(q), 1))])
    z = (q * q).sum(1)
    normal = a.T @ a
    if abs(np.linalg.det(normal)) < 1e-12:
        return None
    u, v, w = np.linalg.solve(normal, a.T @ z)
    r2 = w + (u * u + v * v) / 4
    if r2 <= 0:
        return None
    r = math.sqrt(r2)
    return m[0] + u / 2, m[1] + v / 2, r, float(np.abs(np.hypot(q[:, 0] - u / 2, q[:, 1] - v / 2) - r).max())


def fit_ellipse(p: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """(cx, cy, rx, ry, worst radial residual) of an axis-aligned ellipse a x^2 + b y^2 + c x + d y = 1."""
    m = p.mean(0)
    q = p - m
    scale = np.abs(q).max() or 1.0
    s = q / scale
    a = np.stack([s[:, 0] ** 2, s[:, 1] ** 2, s[:, 0], s[:, 1]], 1)
    normal = a.T @ a
    if abs(np.linalg.det(normal)) < 1e-12:
        return None
    aa, bb, cc, dd = np.linalg.solve(normal, a.sum(0))
    if aa <= 0 or bb <= 0:
        return None
    x0, y0 = -cc / (2 * aa), -dd / (2 * bb)
    g = 1 + aa * x0 * x0 + bb * y0 * y0
    rx, ry = math.sqrt(g / aa), math.sqrt(g / bb)
    rho = np.hypot((s[:, 0] - x0) / rx, (s[:, 1] - y0) / ry)
    return m[0] + x0 * scale, m[1] + y0 * scale, rx * scale, ry * scale, float(np.abs(rho - 1).max() * min(rx, ry) * scale)


def full_coverage(p: np.ndarray, cx: float, cy: float) -> bool:
    """At least 10 of 12 equal angles around the centre hold a point."""
    return len(set(np.floor((np.arctan2(p[:, 1] - cy, p[:, 0] - cx) + math.pi) / (2 * math.pi) * 12).astype(int) % 12)) >= 10


def snap(d: str, tolerance: float = 0.35) -> tuple[str, list[float]] | None:
    """A circle or ellipse for a path that is one closed subpath close to it."""
    subs = parse_path(d)
    if not subs or len(subs) != 1 or not subs[0]["closed"]:
        return None
    p = flatten(subs[0])
    if len(p) < 8:
        return None
    circle = fit_circle(p)
    if circle and circle[2] >= 3 and circle[3] <= max(tolerance, 0.02 * circle[2]) and full_coverage(p, *circle[:2]):
        return "circle", [round(v, 3) for v in circle[:3]]
    e = fit_ellipse(p)
    if e and min(e[2:4]) >= 3 and max(e[2:4]) <= 8 * min(e[2:4]) and e[4] <= max(tolerance, 0.02 * min(e[2:4])) and full_coverage(p, *e[:2]):
        return "ellipse", [round(v, 3) for v in e[:4]]
    return None


def snap_paths(paths: DataFrame) -> DataFrame:
    """paths(id, d) -> (id, kind, params, d): snapped primitives, simplified polylines, or paths left alone."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            kinds, params, texts = [], [], []
            for d in b.column("d").to_pylist():
                found, subs = snap(d or ""), parse_path(d or "")
                kinds.append(found[0] if found else "path" if subs else "kept")
                params.append(found[1] if found else None)
                if found or not subs:
                    texts.append(d)
                else:
                    lines = all(s[0] == "L" for sub in subs for s in sub["segs"])
                    texts.append("".join(emit(merge_lines(flatten(sub), 0.5), sub["closed"]) for sub in subs) if lines else d)
            yield pa.record_batch([b.column("id"), pa.array(kinds), pa.array(params, pa.list_(pa.float64())), pa.array(texts, pa.string())], names=["id", "kind", "params", "d"])

    ship(paths.sparkSession)
    return paths.select(F.col("id").cast("long").alias("id"), "d").mapInArrow(run, "id long, kind string, params array<double>, d string")


def number(v: float, decimals: int = 2) -> str:
    """A number of at most so many decimals, without trailing zeros."""
    t = f"{v:.{decimals}f}"
    t = t.rstrip("0").rstrip(".") if "." in t else t
    return "0" if t == "-0" else t


def emit(points: np.ndarray, closed: bool) -> str:
    return "M" + "L".join(f"{number(x)} {number(y)}" for x, y in points) + ("Z" if closed else "")


def circle_sums(points: DataFrame, key: str) -> DataFrame:
    """Circle fit as plain aggregates: integer moments, then the closed-form 3x3 solution on centred points."""
    s = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = points.join(s, key).withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    t = lambda a, b: F.sum(F.expr("*".join(["u"] * a + ["v"] * b)))
    m = c.groupBy(key, "n", "mx", "my").agg(t(2, 0).alias("uu"), t(0, 2).alias("vv"), t(1, 1).alias("uv"), t(3, 0).alias("uuu"), t(0, 3).alias("vvv"), t(1, 2).alias("uvv"), t(2, 1).alias("uuv"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    p, q = (F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("uuv")) / 2
    a, b = (p * F.col("vv") - q * F.col("uv")) / det, (q * F.col("uu") - p * F.col("uv")) / det
    out = m.where(F.abs(det) > 1e-9)
    return out.select(key, F.round(F.col("mx") + a, 4).alias("cx"), F.round(F.col("my") + b, 4).alias("cy"), F.round(F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")), 4).alias("radius"))


def angle_bins(points: DataFrame, key: str) -> DataFrame:
    """Occupied twelfths of the full angle around each key's mean point, and whether at least ten are."""
    s = points.groupBy(key).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    v = points.join(s, key)
    angle = F.atan2(F.col("y") * F.col("n") - F.col("sy"), F.col("x") * F.col("n") - F.col("sx"))
    b = F.pmod(F.floor((angle + math.pi) / (2 * math.pi) * 12), F.lit(12))
    return v.groupBy(key).agg(F.countDistinct(b).alias("bins")).withColumn("full", F.col("bins") >= 10)


# ---------------------------------------------------------------- SVG text

COLOR = r"(#[0-9a-fA-F]{3,8}|rgba?\([^)]*\))"


def parse_color(text: Column) -> Column:
    """struct(r, g, b, a) of #rgb, #rrggbb[aa], rgb() and rgba(); null for names and references."""
    t = F.lower(F.trim(text))
    byte = lambda s: F.conv(s, 16, 10).cast("int")
    three = F.struct(*[byte(F.concat(F.substring(t, i, 1), F.substring(t, i, 1))).alias(k) for i, k in ((2, "r"), (3, "g"), (4, "b"))], F.lit(1.0).alias("a"))
    alpha = F.when(F.length(t) == 9, F.round(byte(F.substring(t, 8, 2)) / 255, 4)).otherwise(F.lit(1.0))
    six = F.struct(*[byte(F.substring(t, i, 2)).alias(k) for i, k in ((2, "r"), (4, "g"), (6, "b"))], alpha.alias("a"))
    args = F.split(F.regexp_extract(t, r"^rgba?\(([^)]*)\)$", 1), r"\s*,\s*")
    part = lambda i: F.get(args, F.lit(i)).try_cast("double")
    fn = F.struct(*[part(i).cast("int").alias(k) for i, k in enumerate("rgb")], F.coalesce(part(3), F.lit(1.0)).alias("a"))
    return F.when(t.rlike("^#[0-9a-f]{3}$"), three).when(t.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), six).when(t.rlike(r"^rgba?\("), fn)


def svg_inner(svg: Column) -> Column:
    """Markup inside the outer element."""
    return F.regexp_extract(svg, r"(?s)<svg[^>]*>(.*)</svg>", 1)


def svg_stats(svg: Column) -> list[Column]:
    return [F.regexp_count(svg, F.lit(r"<(path|rect|circle|ellipse|polygon|g)[ >]")).cast("long").alias("elements"), F.octet_length(svg).cast("long").alias("bytes")]


# A number in markup, and the attributes that hold coordinates.
NUMBER = r"-?\d*\.\d+(?:[eE][-+]?\d+)?|-?\d+(?:[eE][-+]?\d+)?"
COORDINATES = "d points transform gradientTransform x y x1 y1 x2 y2 cx cy r rx ry width height offset fx fy stroke-width stroke-dashoffset".split()


def short_number(text: Column, decimals: int = 2) -> Column:
    """A number rounded half away from zero, without trailing zeros, and without the zero before its point."""
    t = F.round(text.try_cast("decimal(30,12)"), decimals).cast("string")
    t = F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    t = F.regexp_replace(F.when(t.isin("-0", ""), "0").otherwise(t), r"^(-?)0\.", "$1.")
    return F.coalesce(t, text)  # beyond 18 digits before the point: as it was


def _rebuilt(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` changed: the stretches between matches and the matches take turns."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    changed = F.concat(F.transform(found, change), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, changed, lambda a, b: F.concat(a, b)), "")


def round_numbers(text: Column, decimals: int = 2) -> Column:
    """Every number of a path or transform rounded to ``decimals``."""
    return _rebuilt(text, NUMBER, lambda n: short_number(n, decimals))


def round_coordinates(svg: Column, decimals: int = 2) -> Column:
    """Numbers in the coordinate attributes rounded; other attributes and text untouched."""
    names = "|".join(COORDINATES)
    return _rebuilt(svg, f"(?<![:\\w-])(?:{names})\\s*=\\s*(?:\"[^\"]*\"|'[^']*')", lambda a: F.concat(F.regexp_extract(a, r"^([\w-]+)", 1), F.lit("="), round_numbers(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), decimals)))


def minify(svg: Column, decimals: int = 2) -> Column:
    """Markup without prolog, comments, doctype, outer size and space between tags, and with short coordinates.

    Nothing that moves a pixel: shapes, order, ids, the viewBox and colours stay.
    """
    t = F.regexp_replace(svg, r"(?s)<\?xml.*?\?>|<!DOCTYPE[^>]*>|<!--.*?-->", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r">\s+<", "><"), r"\s{2,}|[\n\t]", " "))
    root = F.regexp_extract(t, r"(?s)^(<svg[^>]*>)", 1)
    bare = F.when(root.rlike("viewBox"), F.regexp_replace(root, r"\s(?:width|height)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")).otherwise(root)
    t = F.concat(bare, F.substr(t, F.length(root) + 1, F.length(t)))
    short = round_coordinates(F.regexp_replace(t, r"\s+(/?>)", "$1"), decimals)
    return F.when(F.octet_length(short) < F.octet_length(svg), short).otherwise(svg)
