"""Moving pixels about: crops, resamples, stacks, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dims(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def crop(px: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    return px.where(inside).withColumn("x", (F.col("x") - x0).cast("int")).withColumn("y", (F.col("y") - y0).cast("int"))


def upscale(px: DataFrame, factor: int) -> DataFrame:
    """Each pixel repeated factor x factor times: no new colours."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = px.withColumn("_j", F.explode(steps)).withColumn("_i", F.explode(steps))
    return rows.withColumn("y", (F.col("y") * factor + F.col("_j")).cast("int")).withColumn("x", (F.col("x") * factor + F.col("_i")).cast("int")).drop("_i", "_j")


def resample(px: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-pixel resample: output (x, y) reads floor(x * w / width), floor(y * h / height)."""
    size = px.groupBy("img_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    sized = px.join(size, "img_id")
    # the outputs that read column x are ceil(x * width / w) .. ceil((x + 1) * width / w) - 1
    span = lambda v, n, m: F.sequence(F.ceil(F.col(v) * n / F.col(m)).cast("int"), (F.ceil((F.col(v) + 1) * n / F.col(m)) - 1).cast("int"))
    some = lambda v, n, m: F.ceil((F.col(v) + 1) * n / F.col(m)) > F.ceil(F.col(v) * n / F.col(m))
    rows = sized.where(some("x", width, "_w") & some("y", height, "_h"))
    rows = rows.withColumn("_xs", span("x", width, "_w")).withColumn("_ys", span("y", height, "_h"))
    rows = rows.withColumn("y", F.explode("_ys")).withColumn("x", F.explode("_xs"))
    return rows.select("img_id", "y", "x", "r", "g", "b")


def spread(px: DataFrame, scale: Column) -> DataFrame:
    """Enlarge by a factor of at least one: nearest pixels."""
    span = lambda v: F.sequence(F.ceil(F.col(v) * scale).cast("int"), (F.ceil((F.col(v) + 1) * scale) - 1).cast("int"))
    rows = px.withColumn("_xs", span("x")).withColumn("_ys", span("y"))
    return rows.withColumn("y", F.explode("_ys")).withColumn("x", F.explode("_xs")).select("img_id", "y", "x", "r", "g", "b")


def stack(px: DataFrame, gap: int, background: tuple[int, int, int], vertical: bool = False, sheet: Column | None = None) -> DataFrame:
    """The images of each sheet side by side (or one below the other) in img_id order, ``gap`` apart, padded with the background.

    A sheet is one output image, numbered by ``sheet`` (all images: sheet 0); the running sum of places is
    over the few images of a sheet.
    """
    on = F.lit(0).cast("long") if sheet is None else sheet.cast("long")
    size = dims(px).withColumn("sheet", on)
    along, across, n = ("y", "x", "height") if vertical else ("x", "y", "width")
    order = Window.partitionBy("sheet").orderBy("img_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = size.select("img_id", "sheet", "width", "height", F.coalesce(F.sum(F.col(n) + gap).over(order), F.lit(0)).cast("int").alias("start"))
    moved = px.join(placed, "img_id").select("sheet", F.col(across), (F.col(along) + F.col("start")).cast("int").alias(along), "r", "g", "b")
    last, wide = F.max(F.col("start") + F.col(n)), F.max("width" if vertical else "height")
    total = placed.groupBy("sheet").agg((wide if vertical else last).alias("w"), (last if vertical else wide).alias("h"))
    grid = total.select("sheet", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("sheet", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    out = grid.join(moved, ["sheet", "y", "x"], "left")
    return out.select(F.col("sheet").alias("img_id"), "y", "x", *(F.coalesce(k, F.lit(v)).alias(k) for k, v in zip("rgb", background, strict=True)))


def hstack(px: DataFrame, gap: int, background: tuple[int, int, int]) -> DataFrame:
    return stack(px, gap, background)


def vstack(px: DataFrame, gap: int, background: tuple[int, int, int]) -> DataFrame:
    return stack(px, gap, background, vertical=True)


def draw_boxes(px: DataFrame, boxes: DataFrame, rgb: tuple[int, int, int], thickness: int = 1) -> DataFrame:
    """Outlines of boxes(img_id, bx, by0, bw, bh), drawn inside their bounds and clipped to the image."""
    b = boxes.select("img_id", *(F.col(k).cast("int").alias(k) for k in ("bx", "by0", "bw", "bh")))
    cells = b.withColumn("y", F.explode(F.expr("sequence(by0, by0 + bh - 1)"))).withColumn("x", F.explode(F.expr("sequence(bx, bx + bw - 1)")))
    t = thickness
    rim = cells.where((F.col("x") - F.col("bx") < t) | (F.col("bx") + F.col("bw") - 1 - F.col("x") < t) | (F.col("y") - F.col("by0") < t) | (F.col("by0") + F.col("bh") - 1 - F.col("y") < t))
    hit = rim.select("img_id", "y", "x").distinct().withColumn("_on", F.lit(True))
    out = px.join(hit, ["img_id", "y", "x"], "left")
    return out.select("img_id", "y", "x", *(F.when(F.col("_on"), v).otherwise(F.col(k)).cast("int").alias(k) for k, v in zip("rgb", rgb, strict=True)))
