"""Neighbourhood operators. Grids are dense, so row frames are pixel frames; every window is keyed by
one row or one column of one image and so bounded by the image's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import by_column, by_row, with_luma


def adjacency(labels: DataFrame) -> DataFrame:
    """(img_id, a, b, n): shared borders of 4-neighbours with different labels, a < b."""
    right, down = F.lead("label").over(by_row()), F.lead("label").over(by_column())
    both = labels.select("img_id", "label", right.alias("_r"), down.alias("_d")).select("img_id", "label", F.explode(F.array("_r", "_d")).alias("o"))
    return both.where("o <> label").groupBy("img_id", F.least("label", "o").alias("a"), F.greatest("label", "o").alias("b")).agg(F.count("*").alias("n"))


def mode_filter(labels: DataFrame, keep_at: int = 3) -> DataFrame:
    """3x3 mode: a pixel takes the commonest label around it if it is unique and its own count is at most keep_at."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    votes = labels.withColumn("o", F.explode(offsets)).groupBy("img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("img_id", "y", "x").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label")))).alias("v"))  # at most nine
    out = labels.join(best, ["img_id", "y", "x"])
    own = F.element_at(F.filter("v", lambda e: e["label"] == F.col("label")), 1)["n"] * -1
    top, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    unique = second.isNull() | (second["n"] > top["n"])
    return out.select("img_id", "y", "x", F.when(unique & (own <= keep_at), top["label"]).otherwise(F.col("label")).alias("label"))


def local_gradient(px: DataFrame) -> DataFrame:
    """Mean over the existing 4-neighbours of the summed absolute channel difference."""
    diff = lambda w, f: sum((F.abs(f(k).over(w) - F.col(k)) for k in "gb"), F.abs(f("r").over(w) - F.col("r")))
    v = px.select("img_id", "y", "x", "r", "g", "b", diff(by_row(), F.lag).alias("n0"), diff(by_row(), F.lead).alias("n1"))
    v = v.withColumn("n2", diff(by_column(), F.lag)).withColumn("n3", diff(by_column(), F.lead))
    parts = [F.col(f"n{i}") for i in range(4)]
    total = sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    count = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return v.select("img_id", "y", "x", total.cast("long").alias("total"), count.alias("cnt"))


def box_sum(df: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """(total, cnt) of ``value`` over the clipped square window: two one-dimensional sums."""
    rows, cols = by_row().rowsBetween(-radius, radius), by_column().rowsBetween(-radius, radius)
    h = df.withColumn("_s", F.sum(value).over(rows)).withColumn("_n", F.count(value).over(rows))
    return h.withColumn("total", F.sum("_s").over(cols)).withColumn("cnt", F.sum("_n").over(cols)).drop("_s", "_n")


def box_blur(px: DataFrame) -> DataFrame:
    return box_sum(with_luma(px), "l").select("img_id", "y", "x", F.round(F.col("total") / F.col("cnt"), 6).alias("blur"))


def smooth_mask(px: DataFrame, limit: int = 10) -> DataFrame:
    """Pixels whose box-blurred local gradient is at most ``limit`` per channel."""
    # gradients are sums over 1..4 neighbours and 3 channels: times 12 they are whole numbers
    g = local_gradient(px).select("img_id", "y", "x", (F.col("total") * (F.lit(12) / F.col("cnt"))).cast("long").alias("g36"))
    return box_sum(g, "g36").where(F.col("total") <= limit * 36 * F.col("cnt")).select("img_id", "y", "x")


def bright_mask(px: DataFrame, limit: int = 10) -> DataFrame:
    """Smooth pixels in the upper 28 % of the smooth luma range, where that range exceeds 60."""
    v = with_luma(px).join(smooth_mask(px, limit), ["img_id", "y", "x"])
    per = Window.partitionBy("img_id")
    v = v.withColumn("lo", F.min("l").over(per)).withColumn("hi", F.max("l").over(per))
    return v.where((F.col("hi") - F.col("lo") > 60000) & ((F.col("l") - F.col("lo")) * 100 >= (F.col("hi") - F.col("lo")) * 72)).select("img_id", "y", "x")


def smooth_weight(px: DataFrame) -> DataFrame:
    """0.02 + 0.98 * max(0, 1 - sd / 25)^2 of luma over nine taps two pixels apart."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-2, 0, 2) for dx in (-2, 0, 2)])
    v = with_luma(px)
    taps = v.withColumn("o", F.explode(offsets)).groupBy("img_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.count("*").alias("n"), F.sum("l").alias("s"), F.sum(F.col("l") * F.col("l")).alias("q"))
    taps = taps.join(v.select("img_id", "y", "x"), ["img_id", "y", "x"], "left_semi")
    var = F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.col("n"))
    weight = F.greatest(F.lit(0.0), 1 - F.sqrt(var) / 25000)
    return taps.select("img_id", "y", "x", F.round(0.02 + 0.98 * weight * weight, 6).alias("weight"))


def _flag(df: DataFrame, grid: DataFrame, name: str = "on") -> DataFrame:
    marked = df.select("img_id", "y", "x").withColumn(name, F.lit(1))
    return grid.select("img_id", "y", "x").join(marked, ["img_id", "y", "x"], "left").fillna(0, [name])


def _extreme(df: DataFrame, name: str, f, radius: int, full: bool) -> DataFrame:  # noqa: ANN001
    """Separable window minimum or maximum; with ``full`` a window that leaves the grid counts as 0."""
    for axis in (by_row(), by_column()):
        w = axis.rowsBetween(-radius, radius)
        v: Column = f(name).over(w)
        df = df.withColumn(name, F.when(F.count(name).over(w) == 2 * radius + 1, v).otherwise(0) if full else v)
    return df


def erode(mask: DataFrame, grid: DataFrame, radius: int = 1) -> DataFrame:
    """Outside counts as 0, so borders are eroded."""
    return _extreme(_flag(mask, grid), "on", F.min, radius, True).where("on = 1").select("img_id", "y", "x")


def dilate(mask: DataFrame, grid: DataFrame, radius: int = 1) -> DataFrame:
    return _extreme(_flag(mask, grid), "on", F.max, radius, False).where("on = 1").select("img_id", "y", "x")


def morph_open(mask: DataFrame, grid: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(mask, grid, radius), grid, radius)


def morph_close(mask: DataFrame, grid: DataFrame, radius: int = 1) -> DataFrame:
    """Dilate, then erode, within the mask's bounding box: the box's own edge erodes too."""
    box = mask.groupBy("img_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inner = grid.join(box, "img_id").where("x between x0 and x1 and y between y0 and y1").select("img_id", "y", "x")
    return erode(dilate(mask, inner, radius), inner, radius)


def dilate_cross(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """Grow by the 4-neighbours."""
    f = _flag(mask, grid)
    one = lambda w, g: F.coalesce(g("on").over(w), F.lit(0))
    f = f.withColumn("h", F.greatest("on", one(by_row(), F.lag), one(by_row(), F.lead))).withColumn("v", F.greatest(one(by_column(), F.lag), one(by_column(), F.lead)))
    return f.where("h = 1 or v = 1").select("img_id", "y", "x")


def fill_profile(bins: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Empty bins take the next filled one, trailing ones the last filled."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumn("filled", F.coalesce(ahead, behind))


def profile_stops(bins: DataFrame, key: str, order: str, value: str, n_bins: int, stops: int) -> DataFrame:
    """``stops`` evenly spaced samples of a profile, linear between neighbouring bins."""
    w = Window.partitionBy(key).orderBy(order)
    v = bins.select(key, F.col(order).alias("_b"), F.col(value).alias("_v"), F.lead(value).over(w).alias("_next"))
    grid = bins.select(key).distinct().withColumn("stop", F.explode(F.sequence(F.lit(0), F.lit(stops - 1))))
    grid = grid.withColumn("t", F.col("stop") * (n_bins - 1) / F.lit(stops - 1)).withColumn("_b", F.floor("t").cast("int"))
    out = grid.join(v, [key, "_b"])
    return out.select(key, "stop", F.round(F.col("_v") + (F.coalesce("_next", "_v") - F.col("_v")) * (F.col("t") - F.col("_b")), 6).alias("v"))


def plateau_stop(history: DataFrame, key: str, order: str, score: str, n: int, gain: float) -> DataFrame:
    """First accepted step whose relative gain over ``n`` steps falls below ``gain``."""
    w = Window.partitionBy(key).orderBy(order)
    v = history.withColumn("_was", F.lag(score, n).over(w))
    return v.where((F.col("_was") > 0) & ((F.col("_was") - F.col(score)) / F.col("_was") < gain)).groupBy(key).agg(F.min(order).alias("stop_at"))


def stall_count(steps: DataFrame, key: str, order: str, accepted: str) -> DataFrame:
    """Consecutive rejections since the last accepted step."""
    w = Window.partitionBy(key).orderBy(order)
    island = steps.withColumn("_i", F.sum(F.col(accepted).cast("int")).over(w))
    return island.withColumn("stalls", F.sum((~F.col(accepted)).cast("int")).over(Window.partitionBy(key, "_i").orderBy(order))).drop("_i")


def collinear_drop(points: DataFrame, key: str, seq: str) -> DataFrame:
    """Vertices of closed polygons that do not lie straight between their neighbours."""
    w = Window.partitionBy(key).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda f, g, k: F.coalesce(f(k).over(w), g(k).over(whole))
    v = points.select("*", *(near(F.lag, F.last, k).alias(f"p{k}") for k in "xy"), *(near(F.lead, F.first, k).alias(f"n{k}") for k in "xy"))
    cross = (F.col("x") - F.col("px")) * (F.col("ny") - F.col("y")) - (F.col("y") - F.col("py")) * (F.col("nx") - F.col("x"))
    return v.where(cross != 0).drop("px", "py", "nx", "ny")
