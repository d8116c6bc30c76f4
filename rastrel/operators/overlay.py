"""Overlays on a traced base: gradient blobs, text patches, tone match, and the size governor."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import gradients, metrics, neighbours, palette, segment
from .paths import fit_ellipse

BLOB = "img_id long, comp long, area long, x0 int, y0 int, x1 int, y1 int, cx double, cy double, ra double, rb double, theta double, cand int, rmse double"


def dedupe_blobs(blobs: DataFrame, most: int = 4) -> DataFrame:
    """Largest first, a blob stays if its centre is in no kept box and no kept centre in its box.

    What stays depends on what stayed before, so it is a kernel over one image's few blobs; the plan
    emits at most ``most`` of them.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        kept: list[dict] = []
        inside = lambda p, b: b["x0"] <= p["cx"] <= b["x1"] and b["y0"] <= p["cy"] <= b["y1"]
        for b in sorted(t.to_pylist(), key=lambda b: (-b["area"], b["comp"])):
            if not any(inside(b, k) or inside(k, b) for k in kept) and len(kept) < most:
                kept.append(b)
        return pa.Table.from_pylist(kept, schema=t.schema)

    ship(blobs.sparkSession)
    return blobs.groupBy("img_id").applyInArrow(run, blobs.schema)


def fit_overlay(px: DataFrame, smooth: int = 10, share: float = 0.012, least: int = 200, gain: float = 0.8) -> DataFrame:
    """Blobs of smooth and of bright smooth pixels that a gradient explains better than a flat colour.

    Masks are opened, split into components, and gated by area, axes, fill and border contact; the fit
    must beat the flat error by ``gain`` and by more than 0.01, within 0.16.
    """
    found = None
    for k, mask in enumerate((neighbours.smooth_mask(px, smooth), neighbours.bright_mask(px, smooth))):
        opened = neighbours.morph_open(mask, px).withColumn("label", F.lit(k))
        comps = segment.components(opened).withColumn("comp", F.col("comp") * 2 + k)
        found = comps if found is None else found.unionByName(comps)
    found = cut(found)  # read three times below
    size = px.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    stats = found.groupBy("img_id", "comp").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).join(size, "img_id")
    w, h = F.col("w"), F.col("h")
    touches = sum(((c).cast("int") for c in (F.col("y0") == 0, F.col("x1") == w - 1, F.col("y1") == h - 1)), (F.col("x0") == 0).cast("int"))
    whole = ((F.col("x1") - F.col("x0") + 1) * 100 >= w * 92) & ((F.col("y1") - F.col("y0") + 1) * 100 >= h * 92)
    stats = stats.where((F.col("area") >= F.greatest(F.lit(least), F.floor(w * h * share))) & (touches < 3) & ~whole)
    own = found.join(stats.select("img_id", "comp"), ["img_id", "comp"], "left_semi").select("img_id", "y", "x", "comp").join(px, ["img_id", "y", "x"])
    shape = gradients.ellipse_moments(own, ("img_id", "comp"))
    fit = gradients.fit_any(own, 8, 3, 32, ("img_id", "comp")).join(gradients.flat_sse(own, ("img_id", "comp")), ["img_id", "comp"])
    g, f = (F.sqrt(F.greatest(F.lit(0.0), F.col(k)) / (3 * F.col("n"))) / 255 for k in ("sse", "flat"))
    fit = fit.select("img_id", "comp", "cand", F.round(g, 6).alias("rmse"), F.round(f, 6).alias("flat_rmse"))
    blobs = stats.join(shape, ["img_id", "comp"]).join(fit, ["img_id", "comp"])
    fill = F.col("area") / (math.pi * F.col("ra") * F.col("rb"))
    blobs = blobs.where((F.col("ra") >= 4) & (F.col("rb") >= 4) & (fill >= 0.6) & (F.col("rmse") <= gain * F.col("flat_rmse")) & (F.col("flat_rmse") - F.col("rmse") > 0.01) & (F.col("rmse") <= 0.16))
    return dedupe_blobs(blobs.select(*(F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in BLOB.split(", ")))))


def text_patches(pair: DataFrame, boxes: DataFrame, max_bytes: int = 150_000) -> DataFrame:
    """(img_id, id, bytes, path, before, after): patches for boxes(img_id, id, x0, y0, x1, y1) that lower the canvas's error enough.

    Each box of at least 12 pixels a side is cropped, enlarged twice, traced and rendered back over the
    canvas; what is measured is the patch itself. A group is one image.
    """
    from ..sources.pixels import pack_images
    from . import vectorize

    packed = pack_images(pair).join(pack_images(pair.select("img_id", "y", "x", *(F.col(f"c{k}").alias(k) for k in "rgb"))).select("img_id", F.col("data").alias("canvas")), "img_id")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            h, w = row["height"], row["width"]
            target, canvas = (np.frombuffer(row[k], np.uint8).reshape(h, w, 3).astype(np.float64) for k in ("data", "canvas"))
            for b in sorted(right.to_pylist(), key=lambda b: b["id"]):
                ys, xs = slice(b["y0"], b["y1"] + 1), slice(b["x0"], b["x1"] + 1)
                crop, under = target[ys, xs], canvas[ys, xs]
                if min(crop.shape[:2]) < 12:
                    continue
                fine = np.repeat(np.repeat(crop, 2, 0), 2, 1)
                marks = vectorize.region_marks(fine, vectorize.regions(fine, 8, 4))
                size = f"{2 * crop.shape[1]} {2 * crop.shape[0]}"
                patch = vectorize.rasterize(f'<svg viewBox="0 0 {size}">{marks}</svg>', crop.shape[1], crop.shape[0])
                before, after = (round(vectorize.dssim(crop, v), 9) for v in (under, patch))
                if len(marks) <= max_bytes and after < 0.97 * before:
                    out.append({"img_id": row["img_id"], "id": b["id"], "bytes": len(marks), "path": marks, "before": before, "after": after})
        kinds = [("img_id", pa.int64()), ("id", pa.int64()), ("bytes", pa.int64()), ("path", pa.string()), ("before", pa.float64()), ("after", pa.float64())]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    ship(pair.sparkSession)
    placed = boxes.select("img_id", F.col("id").cast("long").alias("id"), *(F.col(k).cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")))
    return packed.groupBy("img_id").cogroup(placed.groupBy("img_id")).applyInArrow(run, "img_id long, id long, bytes long, path string, before double, after double")


def tone_match(pair: DataFrame, gain: float = 0.995) -> DataFrame:
    """(img_id, drift, before, after, kept): whether remapping the canvas's colours lowers its DSSIM enough.

    The drift is the largest mean shift of a channel; below 1 the canvas is left alone.
    """
    fit = palette.tone_fit(pair)
    mapped = palette.tone_apply(pair.select("img_id", "y", "x", *(F.col(f"c{k}").alias(k) for k in "rgb")), fit).select("img_id", "y", "x", *(F.col(k).alias(f"c{k}") for k in "rgb"))
    after = metrics.block_dssim(pair.drop("cr", "cg", "cb").join(mapped, ["img_id", "y", "x"])).withColumnRenamed("dssim", "after")
    before = metrics.block_dssim(pair).withColumnRenamed("dssim", "before")
    drift = pair.groupBy("img_id").agg(F.round(F.greatest(*(F.abs(F.avg(k) - F.avg(f"c{k}")) for k in "rgb")), 6).alias("drift"))
    out = drift.join(before, "img_id").join(after, "img_id")
    return out.withColumn("kept", (F.col("drift") >= 1) & (F.col("after") <= gain * F.col("before")))


def govern_size(start: DataFrame, measured: DataFrame, last: int) -> DataFrame:
    """start(img_id, place, max_bytes), measured(img_id, place, bytes) -> the place taken.

    The walk begins at the predicted place and goes on until measured bytes fit; else it ends at the last.
    Both sides have rows for every image, whatever their files' sizes promise, so neither is ever broadcast.
    """
    v = measured.join(start.select("img_id", F.col("place").alias("first"), "max_bytes").hint("merge"), "img_id")
    ok = (F.col("place") >= F.col("first")) & (F.col("max_bytes").isNull() | (F.col("bytes") <= F.col("max_bytes")))
    return v.groupBy("img_id").agg(F.coalesce(F.min(F.when(ok, F.col("place"))), F.lit(last)).alias("place"))


def ellipse_fits(points: DataFrame, key: str) -> DataFrame:
    """Axis-aligned ellipse of each key's points (one outline each), or none where singular."""

    def run(k: tuple, t: pa.Table) -> pa.Table:
        p = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], 1)
        e = fit_ellipse(p[np.lexsort(p.T)])
        names = ["cx", "cy", "rx", "ry", "residual"]
        return pa.table({key: pa.array([k[0].as_py()] if e else [], pa.int64()), **{n: pa.array([round(float(v), 6)] if e else [], pa.float64()) for n, v in zip(names, e or [0] * 5, strict=True)}})

    ship(points.sparkSession)
    return points.select(key, "x", "y").groupBy(key).applyInArrow(run, f"{key} long, cx double, cy double, rx double, ry double, residual double")
