"""Palettes: assignment, recentring, counts, median cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import half_up, key5, lattice, square
from ..session import ship


def quantize(px: DataFrame, levels: int) -> DataFrame:
    """Lattice colours with their packed 24-bit key."""
    q = px.select("img_id", "y", "x", *(lattice(k, levels).alias(k) for k in "rgb"))
    return q.withColumn("key", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("long"))


def first_colors(px: DataFrame, k: int) -> DataFrame:
    """A palette (img_id, c, pr, pg, pb) of the k commonest lattice colours; ties by key."""
    n = quantize(px, 4).groupBy("img_id", "key").agg(F.count("*").alias("n"), F.first("r").alias("pr"), F.first("g").alias("pg"), F.first("b").alias("pb"))
    order = Window.partitionBy("img_id").orderBy(F.desc("n"), "key")
    return n.withColumn("c", (F.row_number().over(order) - 1).cast("int")).where(F.col("c") < k).select("img_id", "c", "pr", "pg", "pb")


def _as_array(palette: DataFrame) -> DataFrame:
    """One row per image: its palette in order (at most a few hundred entries)."""
    return palette.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("c", "pr", "pg", "pb"))).alias("pal"))


def nearest(pal: Column) -> Column:
    """The entry nearest to (r, g, b); the lowest index wins ties."""
    d = lambda e: (square(F.col("r") - e["pr"]) + square(F.col("g") - e["pg"]) + square(F.col("b") - e["pb"])).cast("long")
    return F.array_min(F.transform(pal, lambda e: F.struct(d(e).alias("d"), e["c"].alias("c"))))["c"]


def assign(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Each pixel's palette label. The palette travels as one array per image, so there is no pixel x colour join."""
    return px.join(_as_array(palette), "img_id").select("img_id", "y", "x", nearest(F.col("pal")).alias("label"))


def assign_by_key(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Labels decided once per 5-bit colour key, by the first pixel in scan order with that key."""
    keyed = px.withColumn("key", key5())
    firsts = keyed.groupBy("img_id", "key").agg(F.min_by(F.struct("r", "g", "b"), F.struct("y", "x")).alias("f")).select("img_id", "key", "f.r", "f.g", "f.b")
    named = firsts.join(_as_array(palette), "img_id").select("img_id", "key", nearest(F.col("pal")).alias("label"))
    return keyed.join(named, ["img_id", "key"]).select("img_id", "y", "x", "label")


def recentre(px: DataFrame, labels: DataFrame, palette: DataFrame) -> DataFrame:
    """One Lloyd step: rounded means of the labels' pixels; a colour without pixels stays."""
    means = px.join(labels, ["img_id", "y", "x"]).groupBy("img_id", F.col("label").alias("c")).agg(*(half_up(F.avg(k)).cast("int").alias(f"m{k}") for k in "rgb"))
    out = palette.join(means, ["img_id", "c"], "left")
    return out.select("img_id", "c", *(F.coalesce(f"m{k}", f"p{k}").alias(f"p{k}") for k in "rgb"))


def counts(labels: DataFrame) -> DataFrame:
    """Pixels per label, for labels with at least max(9, 0.02 % of the image) of them."""
    n = labels.groupBy("img_id", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("img_id"))
    return n.withColumn("total", total).where(F.col("n") >= F.greatest(F.lit(9), half_up(F.col("total") * 0.0002))).select("img_id", "label", "n")


def median_cut(px: DataFrame, k: int) -> DataFrame:
    """Palette by median cut: always split the box with the largest population times widest range.

    The split falls on the widest channel at the value boundary nearest to the median (downwards on
    ties). Sequential per image, so it is a kernel over the image's distinct colours with counts.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rgb, n = np.stack([t[c].to_numpy() for c in "rgb"], 1).astype(np.int64), t["n"].to_numpy()
        order = np.lexsort(rgb.T[::-1])
        rgb, n = rgb[order], n[order]
        boxes = [np.arange(len(n))]
        while len(boxes) < k:
            ranges = [np.ptp(rgb[b], axis=0) for b in boxes]
            best = max(range(len(boxes)), key=lambda i: (n[boxes[i]].sum() * ranges[i].max(), -i))
            if ranges[best].max() == 0:
                break
            b, channel = boxes[best], int(np.argmax(ranges[best]))
            b = b[np.argsort(rgb[b, channel], kind="stable")]
            v, upto = rgb[b, channel], np.cumsum(n[b])
            cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
            half = upto[-1] / 2
            cut = cuts[int(np.argmin(np.abs(upto[cuts - 1] - half)))]
            boxes[best : best + 1] = [b[:cut], b[cut:]]
        mean = [np.floor((rgb[b] * n[b, None]).sum(0) / n[b].sum() + 0.5).astype(np.int32) for b in boxes]
        return pa.table({"img_id": pa.array([key[0].as_py()] * len(boxes), pa.int64()), "c": pa.array(range(len(boxes)), pa.int32()), **{f"p{c}": pa.array([int(m[i]) for m in mean], pa.int32()) for i, c in enumerate("rgb")}, "n": pa.array([int(n[b].sum()) for b in boxes], pa.int64())})

    ship(px.sparkSession)
    return px.groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("n")).groupBy("img_id").applyInArrow(run, "img_id long, c int, pr int, pg int, pb int, n long")


def first_split(px: DataFrame) -> DataFrame:
    """Box statistics that decide median cut's first split."""
    span = lambda k: F.max(k) - F.min(k)
    s = px.groupBy("img_id").agg(F.count("*").alias("n"), *(span(k).alias(f"range_{k}") for k in "rgb"))
    widest = F.greatest("range_r", "range_g", "range_b")
    channel = F.when(F.col("range_r") == widest, "r").when(F.col("range_g") == widest, "g").otherwise("b")
    return s.select("img_id", "n", "range_r", "range_g", "range_b", channel.alias("channel"), (F.col("n") * widest).alias("priority"))


def tone_fit(pair: DataFrame) -> DataFrame:
    """Per channel: least-squares gain and bias from canvas to target, clamped, and the moment gain."""
    out = []
    for k in "rgb":
        fit = pair.groupBy("img_id").agg(F.regr_slope(k, f"c{k}").alias("s"), F.regr_intercept(k, f"c{k}").alias("i"), F.stddev_pop(k).alias("dt"), F.stddev_pop(f"c{k}").alias("dc"))
        gain = F.least(F.lit(1.25), F.greatest(F.lit(0.8), F.col("s")))
        bias = F.least(F.lit(25.0), F.greatest(F.lit(-25.0), F.col("i")))
        out.append(fit.select("img_id", F.lit(k).alias("channel"), F.round(gain, 6).alias("gain"), F.round(bias, 6).alias("bias"), F.round(F.col("dt") / F.nullif("dc", F.lit(0.0)), 6).alias("moment_gain")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def tone_apply(df: DataFrame, fit: DataFrame) -> DataFrame:
    """c * gain + bias on every channel, rounded half up and clamped. One fit row per image and channel."""
    wide = fit.groupBy("img_id").pivot("channel", ["r", "g", "b"]).agg(F.first("gain").alias("gain"), F.first("bias").alias("bias"))
    out = df.join(wide, "img_id")
    v = lambda k: F.least(F.lit(255), F.greatest(F.lit(0), half_up(F.col(k) * F.col(f"{k}_gain") + F.col(f"{k}_bias")))).cast("int")
    return out.select(*(v(k).alias(k) if k in ("r", "g", "b") else k for k in df.columns))
