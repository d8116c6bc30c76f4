"""PNG and SVG sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB PNG file."""
    rows = np.frombuffer(rgb, np.uint8).reshape(height, width * 3)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def encode_png(packed: DataFrame) -> DataFrame:
    """(img_id, width, height, png)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [png(w, h, d) for w, h, d in zip(*(b.column(k).to_pylist() for k in ("width", "height", "data")), strict=True)]
            yield pa.record_batch([b.column("img_id"), b.column("width"), b.column("height"), pa.array(files, pa.binary())], names=["img_id", "width", "height", "png"])

    ship(packed.sparkSession)
    return packed.select("img_id", "width", "height", "data").mapInArrow(run, "img_id long, width int, height int, png binary")


def emit_svg(elements: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_id, svg) from elements(img_id, seq, el) in seq order and sizes(img_id, width, height, background)."""
    body = elements.groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "el"))), lambda e: e["el"]), "").alias("body"))
    doc = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('"><clipPath id="f"><path d="M0 0H'), F.col("width").cast("string"), F.lit("V"), F.col("height").cast("string"), F.lit('H0z"/></clipPath><g clip-path="url(#f)"><rect width="100%" height="100%" fill="'), F.col("background"), F.lit('"/>'), F.coalesce("body", F.lit("")), F.lit("</g></svg>"),
    )
    return sizes.join(body, "img_id", "left").select("img_id", doc.alias("svg"))
