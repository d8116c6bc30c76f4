"""Whole-image signals, classes and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.pixels import half_up, key4, luma


def by_row() -> WindowSpec:
    """One row of an image, left to right."""
    return Window.partitionBy("img_id", "y").orderBy("x")


def by_column() -> WindowSpec:
    """One column of an image, top to bottom."""
    return Window.partitionBy("img_id", "x").orderBy("y")


def with_luma(px: DataFrame) -> DataFrame:
    return px.select("img_id", "y", "x", luma().alias("l"))


def distinct_colors(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(F.countDistinct(key4()).alias("colors"))


def luma_mode(px: DataFrame) -> DataFrame:
    """The fullest of 16 luma buckets (first on ties) and the share of it and its neighbours."""
    n = with_luma(px).groupBy("img_id", F.floor(F.col("l") / 16000).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    best = n.groupBy("img_id").agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("mode"), F.sum("n").alias("total"))
    near = n.join(best, "img_id").where(F.abs(F.col("bucket") - F.col("mode")) <= 1)
    return near.groupBy("img_id", "mode").agg(F.round(F.sum("n") / F.max("total"), 6).alias("bg_frac"))


def central_gradient(px: DataFrame) -> DataFrame:
    """Interior pixels with |l[x+1]-l[x-1]| + |l[y+1]-l[y-1]| (luma times 1000)."""
    v = with_luma(px)
    step = lambda w: F.abs(F.lead("l").over(w) - F.lag("l").over(w))
    return v.select("img_id", "y", "x", "l", step(by_row()).alias("dx")).withColumn("dy", step(by_column())).where("dx is not null and dy is not null").select("img_id", "y", "x", "l", (F.col("dx") + F.col("dy")).alias("grad"))


def edge_stats(px: DataFrame) -> DataFrame:
    g = F.col("grad")
    part = lambda cond: F.round(F.count_if(cond) / F.count("*"), 6)
    return central_gradient(px).groupBy("img_id").agg(part(g > 40000).alias("edge"), part((g > 12000) & (g <= 40000)).alias("texture"), part((g > 1500) & (g <= 12000)).alias("smooth_share"), F.round(1 - F.least(F.lit(1.0), F.sum(g) / F.count("*") / 40000), 6).alias("smoothness"))


def ink_mask(px: DataFrame) -> DataFrame:
    """Pixels whose luma lies more than 45 from the image's commonest luma bucket's centre."""
    bg = luma_mode(px).select("img_id", (F.col("mode") * 16000 + 8000).alias("bg"))
    return with_luma(px).join(bg, "img_id").where(F.abs(F.col("l") - F.col("bg")) > 45000).select("img_id", "y", "x")


def run_length(mask: DataFrame, order: str = "x", across: str = "y") -> DataFrame:
    """Length of the run of consecutive mask pixels along ``order`` that each pixel lies in."""
    w = Window.partitionBy("img_id", across).orderBy(order)
    island = mask.withColumn("_i", F.col(order) - F.row_number().over(w))
    return island.withColumn("run", F.count("*").over(Window.partitionBy("img_id", across, "_i"))).drop("_i")


def thin_share(mask: DataFrame) -> DataFrame:
    """Share of mask pixels whose shorter run, horizontal or vertical, is at most 3."""
    both = run_length(run_length(mask).withColumnRenamed("run", "h"), "y", "x").withColumnRenamed("run", "v")
    return both.groupBy("img_id").agg(F.count("*").alias("ink"), F.round(F.count_if(F.least("h", "v") <= 3) / F.count("*"), 6).alias("thin_frac"))


def analyze(px: DataFrame) -> DataFrame:
    """One row of signals per image."""
    return distinct_colors(px).join(luma_mode(px), "img_id").join(edge_stats(px), "img_id").join(thin_share(ink_mask(px)), "img_id", "left")


def class_rule() -> Column:
    """Text, then smooth photo, then flat, illustration, photo."""
    edge, colors = F.col("edge"), F.col("colors")
    return (
        F.when((edge >= 0.15) & (edge < 0.42) & (colors <= 200) & (F.col("bg_frac") >= 0.4), "text")
        .when((F.col("smooth_share") >= 0.5) & (F.col("texture") >= 0.04), "photo")
        .when((colors <= 24) & (edge < 0.18), "flat")
        .when((colors <= 400) & (edge < 0.32), "illustration")
        .otherwise("photo")
    )


# Quality tiers (work side, trace side, budget, target error, plateau gain, bytes).
TIERS = [("draft", 256, 700, 60, 0.02, 0.02, 307200), ("balanced", 320, 1000, 160, 0.006, 0.012, 819200), ("high", 384, 1400, 320, 0.003, 0.006, 1536000), ("max", 448, 2000, 600, 0.0015, 0.003, None)]
TIER_SCHEMA = "quality string, work_res int, trace_res int, budget int, target double, plateau double, max_bytes long"
# Presets (speckle, colour precision, layer step, corner, mode, path precision).
PRESETS = [("flat", 8, 6, 16, 60, "spline", 2), ("fine", 3, 8, 8, 45, "spline", 2), ("text", 2, 8, 8, 40, "spline", 2), ("document", 2, 6, 28, 40, "spline", 1), ("shading", 4, 4, 48, 60, "polygon", 2), ("poster", 4, 8, 4, 60, "polygon", 2)]
PRESET_SCHEMA = "preset string, speckle int, precision int, layer_step int, corner int, mode string, path_precision int"


def plan_rules(analysis: DataFrame) -> DataFrame:
    """analysis(type, quality, glyphs) joined to its tier row (four rows, broadcast) -> plan columns."""
    tiers = analysis.sparkSession.createDataFrame(TIERS, TIER_SCHEMA)
    a = analysis.join(F.broadcast(tiers), "quality", "left").where("budget is not null")
    kind, doc = F.col("type"), F.col("glyphs") > 800
    pick = lambda text, photo, rest: F.when(kind == "text", text).when(kind == "photo", photo).otherwise(rest)
    preset = pick(F.when(doc, "document").otherwise("text"), F.lit("poster"), F.lit("flat"))
    alpha = pick(F.lit(0.9), F.when(F.col("quality").isin("draft", "balanced"), 0.55).otherwise(0.45), F.when(kind == "flat", 0.92).otherwise(0.8))
    cap = F.when(F.col("quality") == "max", 200).when((F.col("quality") == "high") & ~doc, 120).otherwise(50)
    budget = pick(F.least("budget", cap), half_up(F.col("budget") * 1.4), F.col("budget"))
    trace = pick(F.when(doc, F.least("trace_res", F.lit(1200))).otherwise(F.greatest("trace_res", F.lit(1300))), F.col("trace_res"), F.col("trace_res"))
    return a.select("img_id", "type", "quality", preset.alias("preset"), alpha.cast("double").alias("alpha"), budget.cast("long").alias("budget"), trace.cast("int").alias("trace_res"), (kind != "flat").alias("saliency"), (kind == "photo").alias("use_splats"))
