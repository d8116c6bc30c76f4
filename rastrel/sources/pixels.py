"""Pixel tables and the places they come from.

``px(img_id long, y int, x int, r int, g int, b int)`` has one row per pixel of a dense grid; set
operators use it. ``packed(img_id long, width int, height int, data binary)`` has one row per image;
kernels whose next step needs the canvas of the last use that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import clamp, lattice
from ..session import ship

SIDE = 64
LEVELS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channel(v: Column) -> Column:
    return clamp(F.floor(v.cast("double") * 256 + 128), 0, 255).cast("int")


def embedding_pixels(embeddings: DataFrame) -> DataFrame:
    """Vectors as images: one vector is a row of 64 pixels, 64 consecutive vectors an image."""
    row = embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    at = lambda k: channel(F.get("embedding", (F.col("x") + 21 * k) % SIDE))
    return row.select(F.floor(F.col("vec_id") / SIDE).alias("img_id"), (F.col("vec_id") % SIDE).cast("int").alias("y"), "x", at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(table(spark, sf_dir, "embeddings"))


def with_canvas(px: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``px`` with a current canvas (cr, cg, cb): the lattice-quantized image itself."""
    return px.select("*", *(lattice(k, levels).alias(f"c{k}") for k in "rgb"))


def solid(spark: SparkSession, img_id: int, width: int, height: int, rgb: tuple[int, int, int]) -> DataFrame:
    """A constant-colour image."""
    return spark.range(width * height).select(F.lit(img_id).cast("long").alias("img_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), *(F.lit(v).alias(k) for k, v in zip("rgb", rgb, strict=True)))


def heatmap(lineitem: DataFrame) -> DataFrame:
    """A table as an image: 64 part buckets by 64 order buckets, channels are scaled counts and sums."""
    cells = lineitem.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").alias("k"))
    return cells.select(F.lit(0).cast("long").alias("img_id"), "y", "x", (F.col("n") * 7 % 256).cast("int").alias("r"), (F.col("q") % 256).cast("int").alias("g"), (F.col("k") * 3 % 256).cast("int").alias("b"))


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as ``packed``, through Spark's image source (which stores BGR rows)."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for h, w, n, d in zip(*(b.column(k).to_pylist() for k in ("height", "width", "nChannels", "data")), strict=True):
                a = np.frombuffer(d, np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, 2) if n == 1 else a[..., 2::-1].astype(np.float64)
                if n == 4:  # flatten alpha on white
                    alpha = a[..., 3:4] / 255.0
                    rgb = np.rint(rgb * alpha + 255 * (1 - alpha))
                data.append(rgb.astype(np.uint8).tobytes())
            yield pa.record_batch([b.column("origin"), b.column("width"), b.column("height"), pa.array(data, pa.binary())], names=["origin", "width", "height", "data"])

    ship(spark)
    return raw.select("origin", "width", "height", "nChannels", "data").mapInArrow(run, "origin string, width int, height int, data binary")


def decode_data_url(payload: Column) -> Column:
    """Bytes of a base64 data URL or of bare base64; null if empty or over 25 MB."""
    raw = F.try_to_binary(F.element_at(F.split(payload, ","), -1), F.lit("base64"))
    return F.when((F.octet_length(raw) > 0) & (F.octet_length(raw) <= 25 * 1024 * 1024), raw)


def pack_images(px: DataFrame) -> DataFrame:
    """``px`` as ``packed``; a group is one image."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        out = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        out[y, x] = np.stack([t[k].to_numpy() for k in "rgb"], 1)
        return pa.table({"img_id": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([out.shape[1]], pa.int32()), "height": pa.array([out.shape[0]], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    ship(px.sparkSession)
    return px.select("img_id", "y", "x", "r", "g", "b").groupBy("img_id").applyInArrow(run, "img_id long, width int, height int, data binary")


def unpack_images(packed: DataFrame) -> DataFrame:
    """``packed`` as ``px``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, d in zip(*(b.column(k).to_pylist() for k in ("img_id", "width", "height", "data")), strict=True):
                a = np.frombuffer(d, np.uint8).reshape(h * w, 3).astype(np.int32)
                at = np.arange(h * w)
                yield pa.record_batch([pa.array(np.full(h * w, i)), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *(pa.array(np.ascontiguousarray(a[:, k])) for k in range(3))], names=["img_id", "y", "x", "r", "g", "b"])

    ship(packed.sparkSession)
    return packed.select("img_id", "width", "height", "data").mapInArrow(run, "img_id long, y int, x int, r int, g int, b int")


def cubic_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a cubic resample (Catmull-Rom, widened when shrinking), one row per output pixel."""
    scale = n / m
    wide = max(1.0, scale)
    at = (np.arange(m)[:, None] + 0.5) * scale - 0.5
    t = np.abs(np.arange(n)[None, :] - at) / wide
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def fit_inside(packed: DataFrame, max_side: int, enlarge: bool = False) -> DataFrame:
    """``packed`` images scaled by a cubic kernel so that the longer side is ``max_side``; smaller ones stay unless ``enlarge``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, d in zip(*(b.column(k).to_pylist() for k in ("img_id", "width", "height", "data")), strict=True):
                share = max_side / max(w, h)
                if share < 1 or enlarge and share > 1:
                    to = [max(1, int(v * share + 0.5)) for v in (h, w)]
                    a = np.frombuffer(d, np.uint8).reshape(h, w, 3).astype(np.float64)
                    a = np.einsum("yh,hwc,xw->yxc", cubic_weights(h, to[0]), a, cubic_weights(w, to[1]), optimize=True)
                    (h, w), d = to, np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([d], pa.binary())], names=["img_id", "width", "height", "data"])

    ship(packed.sparkSession)
    return packed.select("img_id", "width", "height", "data").mapInArrow(run, "img_id long, width int, height int, data binary")


def resize(px: DataFrame, max_side: int, enlarge: bool = False) -> DataFrame:
    """Scale so that the longer side is ``max_side``: area means down, nearest pixels up. ``fit_inside`` is the cubic form."""
    size = px.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    sized = px.join(size, "img_id")
    scale = F.lit(max_side) / F.greatest("w", "h")
    down = sized.where(scale < 1).groupBy("img_id", F.floor(F.col("y") * scale).cast("int").alias("y"), F.floor(F.col("x") * scale).cast("int").alias("x")).agg(*(F.floor(F.avg(k) + 0.5).cast("int").alias(k) for k in "rgb"))
    same = sized.where(scale >= 1)
    if not enlarge:
        return down.unionByName(same.select("img_id", "y", "x", "r", "g", "b"))
    from ..operators.geometry import spread

    return down.unionByName(spread(same, scale))
