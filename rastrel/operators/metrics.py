"""Error measures between an image and its canvas (cr, cg, cb beside r, g, b in one row, so no join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import half_up, square


def squared_error() -> Column:
    return sum((square(F.col(k) - F.col(f"c{k}")) for k in "gb"), square(F.col("r") - F.col("cr"))).cast("long")


def rmse_of(sse: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(sse / (3 * n)) / 255).otherwise(0.0)


def rmse(pair: DataFrame, *by: str) -> DataFrame:
    keys = by or ("img_id",)
    return pair.groupBy(*keys).agg(F.sum(squared_error()).alias("sse"), F.count("*").alias("n")).select(*keys, F.round(rmse_of(F.col("sse"), F.col("n")), 9).alias("rmse"))


def avg_color(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(*(half_up(F.avg(k)).alias(k) for k in "rgb"))


def error_map(pair: DataFrame, block: int = 16, weight: Column | None = None) -> DataFrame:
    """Squared error per cell; cells at the right and bottom edge may be smaller."""
    e = squared_error() if weight is None else squared_error() * weight
    cells = pair.groupBy("img_id", F.floor(F.col("y") / block).cast("int").alias("r"), F.floor(F.col("x") / block).cast("int").alias("c"))
    cells = cells.agg(F.sum(e).alias("err"), F.count("*").alias("area"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return cells.select("img_id", "r", "c", (F.col("c") * block).cast("int").alias("x"), (F.col("r") * block).cast("int").alias("y"), "w", "h", "err", "area")


def topk_cells(cells: DataFrame, k: int = 6) -> DataFrame:
    """The k worst cells per image; ties go to the earlier cell in row order."""
    order = Window.partitionBy("img_id").orderBy(F.desc("err"), "r", "c")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_dssim(pair: DataFrame, window: int = 11, *keys: str) -> DataFrame:
    """(1 - mean structural similarity) / 2 over non-overlapping blocks of 8-bit integer luma."""
    gray = lambda p: F.floor((F.col(p + "r") * 77 + F.col(p + "g") * 150 + F.col(p + "b") * 29 + 128) / 256).cast("long")
    keys = keys or ("img_id",)
    v = pair.select(*keys, F.floor(F.col("y") / window).alias("by0"), F.floor(F.col("x") / window).alias("bx"), gray("").alias("a"), gray("c").alias("e"))
    m = v.groupBy(*keys, "by0", "bx").agg(F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum("e").alias("se"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("e") * F.col("e")).alias("see"), F.sum(F.col("a") * F.col("e")).alias("sae"))
    n = F.col("n")
    ma, me = F.col("sa") / n, F.col("se") / n
    va, ve, co = F.col("saa") / n - ma * ma, F.col("see") / n - me * me, F.col("sae") / n - ma * me
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * ma * me + c1) * (2 * co + c2) / ((ma * ma + me * me + c1) * (va + ve + c2))
    return m.select(*keys, ssim.alias("s")).groupBy(*keys).agg(F.round((1 - F.avg("s")) / 2, 6).alias("dssim"))


def edge_band_error(pair: DataFrame, band: int = 3) -> DataFrame:
    """Mean absolute channel difference within ``band`` pixels of the frame."""
    per = Window.partitionBy("img_id")
    v = pair.withColumn("_w", F.max("x").over(per)).withColumn("_h", F.max("y").over(per))
    near = v.where((F.col("x") < band) | (F.col("y") < band) | (F.col("_w") - F.col("x") < band) | (F.col("_h") - F.col("y") < band))
    d = sum((F.abs(F.col(k) - F.col(f"c{k}")) for k in "gb"), F.abs(F.col("r") - F.col("cr")))
    return near.groupBy("img_id").agg(F.round(F.sum(d) / (3 * F.count("*")), 6).alias("band_error"))


def subject_score(pair: DataFrame, share: float = 0.47) -> DataFrame:
    """Error of the central crop and of the whole frame."""
    per = Window.partitionBy("img_id")
    v = pair.withColumn("_w", F.max("x").over(per) + 1).withColumn("_h", F.max("y").over(per) + 1)
    side = lambda p, n: (F.col(p) >= F.floor(F.col(n) * (1 - share) / 2)) & (F.col(p) < F.floor(F.col(n) * (1 - share) / 2) + F.floor(F.col(n) * share))
    inside = side("x", "_w") & side("y", "_h")
    e = squared_error()
    sums = v.groupBy("img_id").agg(F.sum(F.when(inside, e)).alias("s"), F.count_if(inside).alias("n"), F.sum(e).alias("sa"), F.count("*").alias("na"))
    return sums.select("img_id", F.round(rmse_of(F.col("s"), F.col("n")), 9).alias("subject"), F.round(rmse_of(F.col("sa"), F.col("na")), 9).alias("frame"))


def box_dssim(pair: DataFrame, boxes: DataFrame) -> DataFrame:
    """DSSIM of each box's crop, weighted by area; boxes narrower than 8 pixels are skipped."""
    b = boxes.where("bw >= 8 and bh >= 8")
    inside = pair.join(b, "img_id").where("x >= bx and x < bx + bw and y >= by0 and y < by0 + bh")
    inside = inside.withColumn("x", F.col("x") - F.col("bx")).withColumn("y", F.col("y") - F.col("by0"))
    d = block_dssim(inside.withColumn("box", F.concat_ws(":", "bx", "by0", "bw", "bh")).withColumn("size", F.col("bw") * F.col("bh")), 11, "img_id", "box", "size")
    return d.groupBy("img_id").agg(F.round(F.sum(F.col("dssim") * F.col("size")) / F.sum("size"), 6).alias("box_dssim"))
