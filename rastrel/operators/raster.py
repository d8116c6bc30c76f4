"""Shapes to scanlines to pixels, compositing and closed-form colours.

``shapes`` hold (img_id, seq, ...); ``runs`` are (img_id, seq, y, x1, x2), x2 included. Order matters
for compositing, so seq is part of every key. Runs meet pixels by an equi-join after exploding, never
by a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import clamp, half_up


def polygon_runs(vertices: DataFrame, width: int, height: int) -> DataFrame:
    """Even-odd fill at pixel centres from vertices(img_id, seq, i, x, y), clipped to the frame."""
    w = Window.partitionBy("img_id", "seq").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = vertices.select("img_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by1")).where("ay <> by1")
    lo, hi = F.least("ay", "by1"), F.greatest("ay", "by1")
    first = F.greatest(F.lit(0), F.ceil(lo - 0.5)).cast("int")
    last = F.least(F.lit(height - 1), F.ceil(hi - 0.5) - 1).cast("int")
    e = e.withColumn("f", first).withColumn("l", last).where("f <= l").withColumn("y", F.explode(F.expr("sequence(f, l)")))
    e = e.withColumn("xs", F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by1") - F.col("ay")))
    order = Window.partitionBy("img_id", "seq", "y").orderBy("xs")
    e = e.withColumn("k", F.row_number().over(order)).withColumn("xe", F.lead("xs").over(order)).where("k % 2 = 1 and xe is not null")
    x1 = F.greatest(F.lit(0), half_up(F.col("xs"))).cast("int")
    x2 = F.least(F.lit(width - 1), half_up(F.col("xe")) - 1).cast("int")
    return e.select("img_id", "seq", "y", x1.alias("x1"), x2.alias("x2")).where("x1 <= x2")


def ellipse_runs(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """Rows of axis-aligned ellipses(img_id, seq, cx, cy, rx, ry); radii below 0.5 give nothing."""
    e = shapes.where("rx >= 0.5 and ry >= 0.5")
    e = e.withColumn("f", F.greatest(F.lit(0), F.ceil(F.col("cy") - F.col("ry"))).cast("int")).withColumn("l", F.least(F.lit(height - 1), F.floor(F.col("cy") + F.col("ry"))).cast("int")).where("f <= l")
    e = e.withColumn("y", F.explode(F.expr("sequence(f, l)")))
    t = (F.col("y") - F.col("cy")) / F.col("ry")
    half = F.col("rx") * F.sqrt(F.greatest(F.lit(0.0), 1 - t * t))
    x1 = F.greatest(F.lit(0), F.ceil(F.col("cx") - half)).cast("int")
    x2 = F.least(F.lit(width - 1), F.floor(F.col("cx") + half)).cast("int")
    return e.select("img_id", "seq", "y", x1.alias("x1"), x2.alias("x2")).where("x1 <= x2")


def run_stats(runs: DataFrame) -> DataFrame:
    """Area and extent of each shape's runs."""
    return runs.groupBy("img_id", "seq").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), F.min("x1").alias("x0"), F.max("x2").alias("xm"), F.min("y").alias("y0"), F.max("y").alias("ym"))


def shape_caps(runs: DataFrame, max_area: int, max_extent: int) -> DataFrame:
    """Shapes with at least one pixel, within the area cap and the extent cap."""
    s = run_stats(runs)
    return s.where((F.col("area") >= 1) & (F.col("area") <= max_area) & (F.col("xm") - F.col("x0") + 1 <= max_extent) & (F.col("ym") - F.col("y0") + 1 <= max_extent))


def covered(runs: DataFrame) -> DataFrame:
    """Pixels of runs: (img_id, seq, y, x)."""
    return runs.withColumn("x", F.explode(F.expr("sequence(x1, x2)"))).drop("x1", "x2")


def optimal_color(pair: DataFrame, runs: DataFrame, alpha: float) -> DataFrame:
    """The flat colour that, blended with ``alpha``, best moves the canvas to the target: mean of (t - c)/a + c."""
    hit = covered(runs).join(pair, ["img_id", "y", "x"])
    sums = hit.groupBy("img_id", "seq").agg(F.count("*").alias("n"), *(F.sum(F.col(k) - F.col(f"c{k}")).cast("long").alias(f"d{k}") for k in "rgb"), *(F.sum(f"c{k}").cast("long").alias(f"s{k}") for k in "rgb"))
    v = lambda k: clamp(half_up((F.col(f"d{k}") / alpha + F.col(f"s{k}")) / F.col("n")), 0, 255).cast("int")
    return sums.select("img_id", "seq", *(v(k).alias(k) for k in "rgb"))


def delta_score(pair: DataFrame, runs: DataFrame, colors: DataFrame, alpha: float) -> DataFrame:
    """New total error of each shape tried alone: the old total plus the change over covered pixels only."""
    err = lambda cur: sum(((F.col(k) - cur(k)) * (F.col(k) - cur(k)) for k in "gb"), (F.col("r") - cur("r")) * (F.col("r") - cur("r")))
    old = pair.groupBy("img_id").agg(F.sum(err(lambda k: F.col(f"c{k}"))).cast("long").alias("total"), F.count("*").alias("n"))
    paint = colors.select("img_id", "seq", *(F.col(k).alias(f"p{k}") for k in "rgb"))
    hit = covered(runs).join(paint, ["img_id", "seq"]).join(pair, ["img_id", "y", "x"])
    blend = lambda k: F.col(f"c{k}") * (1 - alpha) + F.col(f"p{k}") * alpha
    change = hit.groupBy("img_id", "seq").agg(F.sum(err(blend) - err(lambda k: F.col(f"c{k}"))).alias("delta"))
    out = change.join(old, "img_id")
    return out.select("img_id", "seq", F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("total") + F.col("delta")) / (3 * F.col("n"))) / 255, 9).alias("score"))


def splat_alpha(offset: Column) -> Column:
    """Piecewise-linear Gaussian over 0..1 (1 is the cutoff at 2.5 standard deviations), zero at the end."""
    import math

    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    v = [round(math.exp(-((2.5 * o) ** 2) / 2), 12) for o in at[:-1]] + [0.0]
    out = F.lit(0.0)
    for i in range(3, -1, -1):
        out = F.when(offset < at[i + 1], F.lit(v[i]) + (offset - at[i]) * ((v[i + 1] - v[i]) / 0.25)).otherwise(out)
    return out


def splat_footprint(splats: DataFrame, width: int, height: int) -> DataFrame:
    """Weighted pixels of axis-aligned splats(img_id, seq, cx, cy, sx, sy, a)."""
    s = splats.withColumn("rx", 2.5 * F.col("sx")).withColumn("ry", 2.5 * F.col("sy"))
    px = covered(ellipse_runs(s, width, height)).join(s, ["img_id", "seq"])
    dx, dy = (F.col("x") - F.col("cx")) / F.col("rx"), (F.col("y") - F.col("cy")) / F.col("ry")
    w = F.col("a") * splat_alpha(F.sqrt(dx * dx + dy * dy))
    return px.select("img_id", "seq", "y", "x", F.round(w, 9).alias("w")).where("w > 0")


def splat_color(pair: DataFrame, footprint: DataFrame) -> DataFrame:
    """Weighted least-squares colour: sum(w (t - c (1 - w))) / sum(w^2); black where the weights vanish."""
    hit = footprint.join(pair, ["img_id", "y", "x"])
    w = F.col("w")
    sums = hit.groupBy("img_id", "seq").agg(F.sum(w * w).alias("ww"), *(F.sum(w * (F.col(k) - F.col(f"c{k}") * (1 - w))).alias(f"s{k}") for k in "rgb"))
    v = lambda k: F.when(F.col("ww") < 1e-6, 0).otherwise(clamp(half_up(F.round(F.col(f"s{k}") / F.col("ww"), 6)), 0, 255)).cast("int")
    return sums.select("img_id", "seq", *(v(k).alias(k) for k in "rgb"))


def coverage(footprint: DataFrame) -> DataFrame:
    """1 - prod(1 - w) per pixel (weights stay below 1)."""
    return footprint.groupBy("img_id", "y", "x").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("w")))), 4).alias("coverage"))


def composite(base: DataFrame, layers: DataFrame, grid: DataFrame) -> DataFrame:
    """Alpha-over of layers(img_id, seq, y, x, lr, lg, lb, a) in seq order on base colours (cr, cg, cb)."""
    stack = layers.groupBy("img_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct("seq", "lr", "lg", "lb", "a"))).alias("stack"))  # at most one entry per shape
    v = grid.join(base, "img_id").join(stack, ["img_id", "y", "x"], "left")
    empty = F.coalesce("stack", F.array().cast("array<struct<seq:bigint,lr:int,lg:int,lb:int,a:double>>"))
    fold = lambda k: F.aggregate(empty, F.col(f"c{k}").cast("double"), lambda acc, e: e[f"l{k}"] * e["a"] + acc * (1 - e["a"]))
    return v.select("img_id", "y", "x", *(F.round(fold(k), 6).alias(k) for k in "rgb"))
