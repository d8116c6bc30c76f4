"""Text regions: tile backgrounds, glyph clusters, rows, boxes. Boxes are (img_id, id, x0, y0, x1, y1)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .segment import component_stats, labelled
from .signals import by_column, by_row, with_luma


def tile_background(px: DataFrame, tile: int = 32, share: float = 0.5, slope: float = 8.0) -> DataFrame:
    """Commonest of 32 luma buckets per tile, the share of it and its neighbours, mean gradient there, validity."""
    keys = ["img_id", "ty", "tx"]
    v = with_luma(px).select("img_id", "y", "x", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("l") / 8000).cast("int").alias("bucket"))
    n = v.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("mode"), F.sum("n").alias("total"))
    near = n.join(best, keys).where(F.abs(F.col("bucket") - F.col("mode")) <= 1).groupBy(*keys, "mode", "total").agg(F.sum("n").alias("band"))
    # flatness is that of the band's inside: pixels whose four neighbours are in the band, too
    around = {n: f("l").over(w) for n, f, w in (("a", F.lag, by_row()), ("b", F.lead, by_row()), ("c", F.lag, by_column()), ("d", F.lead, by_column()))}
    g = with_luma(px).withColumns(around).where("a is not null and b is not null and c is not null and d is not null")
    g = g.select("img_id", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), "l", *around, (F.abs(F.col("b") - F.col("a")) + F.abs(F.col("d") - F.col("c"))).alias("grad"))
    inside = [F.abs(F.floor(F.col(k) / 8000) - F.col("mode")) <= 1 for k in ("l", *around)]
    flat = g.join(best, keys).where(reduce(Column.__and__, inside)).groupBy(*keys).agg(F.count("*").alias("inner"), F.sum("grad").alias("g"))
    out = near.join(flat, keys, "left")
    ok = (F.col("band") >= share * F.col("total")) & (F.col("inner") * 5 >= F.col("total")) & (F.col("g") <= int(slope * 1000) * F.col("inner"))
    return out.select(*keys, "mode", F.round(F.col("band") / F.col("total"), 6).alias("share"), F.round(F.col("g") / F.col("inner") / 1000, 6).alias("flatness"), F.coalesce(ok, F.lit(False)).alias("valid"))


def local_ink(px: DataFrame, tile: int = 32) -> DataFrame:
    """Ink against the tile's background luma; in tiles without one, only near-white pixels."""
    bg = tile_background(px, tile).select("img_id", "ty", "tx", "mode", "valid")
    v = with_luma(px).withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int")).join(bg, ["img_id", "ty", "tx"])
    ink = F.when(F.col("valid"), F.abs(F.col("l") - (F.col("mode") * 8000 + 4000)) > 45000).otherwise(F.col("l") >= 240000)
    return v.where(ink).select("img_id", "y", "x")


# Ink differs by so much from its tile's colour; relaxed detection doubles and more the slope of
# a flat background, and takes vivid pixels on dark tiles and on glowing panels.
INK, FLAT_SLOPE, RELAXED_SLOPE, DARK_IMAGE = 45, 8.0, 22.0, 65


def _tiled(px: DataFrame, tile: int) -> DataFrame:
    l = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114).cast("long")
    return px.select("img_id", "y", "x", "r", "g", "b", l.alias("l"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))


def tile_colors(px: DataFrame, tile: int = 32, slope: float = FLAT_SLOPE) -> DataFrame:
    """(img_id, ty, tx, valid, tr, tg, tb, mean): each tile's background colour (of its commonest lumas) and mean luma."""
    keys = ["img_id", "ty", "tx"]
    bg = tile_background(px, tile, slope=slope).select(*keys, "mode", "valid")
    v = _tiled(px, tile).join(bg, keys)
    band = F.abs(F.floor(F.col("l") / 8000) - F.col("mode")) <= 1
    return v.groupBy(*keys, "valid").agg(*(F.avg(F.when(band, F.col(k))).alias(f"t{k}") for k in "rgb"), (F.avg("l") / 1000).alias("mean"))


def text_ink(px: DataFrame, relaxed: bool = False, tile: int = 32) -> DataFrame:
    """Pixels that differ from their tile's background by more than INK in a channel; near-white ones where a tile has none.

    Relaxed: also vivid bright pixels on dark tiles without a background, and pixels much more vivid than a bright one.
    """
    bg = tile_colors(px, tile, RELAXED_SLOPE if relaxed else FLAT_SLOPE)
    v = _tiled(px, tile).join(bg, ["img_id", "ty", "tx"])
    away = F.greatest(*(F.abs(F.col(k) - F.col(f"t{k}")) for k in "rgb")) > INK
    bright = F.col("l") >= 240000
    if relaxed:
        vivid = F.greatest("r", "g", "b") - F.least("r", "g", "b")
        panel = F.greatest("tr", "tg", "tb") - F.least("tr", "tg", "tb")
        panel_luma = F.col("tr") * 0.299 + F.col("tg") * 0.587 + F.col("tb") * 0.114
        bright |= (F.col("mean") <= 110) & (F.greatest("r", "g", "b") >= 190) & (vivid >= 90)
        away |= (panel_luma >= 140) & (vivid >= 70) & (vivid - panel >= 40)
    return v.where(F.when(F.col("valid"), away).otherwise(bright)).select("img_id", "y", "x")


def median_luma(px: DataFrame) -> DataFrame:
    """Upper middle luma of each image, from a histogram of at most 256 whole values per image."""
    h = with_luma(px).groupBy("img_id", F.floor(F.col("l") / 1000).cast("int").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("img_id").orderBy("v")
    t = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("img_id")))
    return t.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("img_id").agg(F.min("v").alias("median"))


def glyph_filter(stats: DataFrame, long_side: int) -> DataFrame:
    """Components of glyph size and density: area 4 .. 0.6 s^2, sides up to s = 13 % of the long side, density 0.1."""
    s = int(long_side * 0.13)
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return stats.where(F.col("area").between(4, int(0.6 * s * s)) & (w <= s) & (h <= s) & (F.col("area") * 10 >= w * h))


def _gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.lit(0), F.col(b0) - F.col(a1) - 1, F.col(a0) - F.col(b1) - 1)


def _pairs(boxes: DataFrame, grow: Column | None = None, cell: int = 32) -> DataFrame:
    """Pairs a < b of one image whose boxes, grown by ``grow`` on every side, share a cell of a grid."""
    at = lambda v: F.floor(v / cell).cast("int")
    v = boxes.withColumn("_g", F.lit(0) if grow is None else grow)
    for axis in "yx":
        v = v.withColumn(f"c{axis}", F.explode(F.sequence(at(F.col(f"{axis}0") - F.col("_g")), at(F.col(f"{axis}1") + F.col("_g")))))
    other = v.select("img_id", "cy", "cx", *(F.col(k).alias(f"{k}_b") for k in ("id", "x0", "y0", "x1", "y1")))
    keep = ["img_id", "id", "id_b", "x0", "y0", "x1", "y1", "x0_b", "y0_b", "x1_b", "y1_b"]
    return v.join(other, ["img_id", "cy", "cx"]).where("id < id_b").select(*keep).distinct()


def glyph_pairs(boxes: DataFrame, relaxed: bool = False) -> DataFrame:
    """(img_id, id, id_b): boxes closer than 1.6 and 0.9 times the lower height (times ten in integers).

    Relaxed: at most 16 and 8 pixels, and heights alike to 0.45.
    """
    p = _pairs(boxes, F.col("y1") - F.col("y0") + 1)
    one, two = F.col("y1") - F.col("y0") + 1, F.col("y1_b") - F.col("y0_b") + 1
    h = F.least(one, two)
    near = (_gap("x0", "x1", "x0_b", "x1_b") * 10 < h * 16) & (_gap("y0", "y1", "y0_b", "y1_b") * 10 < h * 9)
    if relaxed:
        near &= (_gap("x0", "x1", "x0_b", "x1_b") <= 16) & (_gap("y0", "y1", "y0_b", "y1_b") <= 8) & (h * 100 >= F.greatest(one, two) * 45)
    return p.where(near).select("img_id", "id", "id_b")


def spanning_labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(img_id, id, cluster): smallest id reachable over pairs, one image at a time (its boxes are few)."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def find(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for a, b in zip(t["id"].to_pylist(), t["id_b"].to_pylist(), strict=True):
            a, b = find(a), find(a if b is None else b)
            parent[max(a, b)] = min(a, b)
        ids = sorted(parent)
        return pa.table({"img_id": pa.array([key[0].as_py()] * len(ids), pa.int64()), "id": pa.array(ids, pa.int64()), "cluster": pa.array([find(i) for i in ids], pa.int64())})

    ship(nodes.sparkSession)
    rows = nodes.select("img_id", F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("id_b"))
    rows = rows.unionByName(pairs.select("img_id", F.col("id").cast("long").alias("id"), F.col("id_b").cast("long").alias("id_b")))
    return rows.groupBy("img_id").applyInArrow(run, "img_id long, id long, cluster long")


def glyph_clusters(boxes: DataFrame) -> DataFrame:
    """Clusters of near glyph boxes with their statistics."""
    c = spanning_labels(boxes, glyph_pairs(boxes))
    return cluster_stats(boxes.withColumn("id", F.col("id").cast("long")).join(c, ["img_id", "id"]))


def cluster_stats(members: DataFrame) -> DataFrame:
    """Box, glyph count, coverage and variation of heights and widths of every cluster."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    v = members.select("img_id", "cluster", "x0", "y0", "x1", "y1", w.cast("long").alias("w"), h.cast("long").alias("h"))
    s = v.groupBy("img_id", "cluster").agg(F.count("*").alias("glyphs"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y1") - F.min("y0") + 1).alias("h"), F.sum(F.col("w") * F.col("h")).alias("ink"), *(f for k in "wh" for f in (F.sum(k).alias(f"s{k}"), F.sum(F.col(k) * F.col(k)).alias(f"q{k}"))))
    n = F.col("glyphs")
    cv = lambda k: F.round(F.sqrt(n * F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}")) / F.col(f"s{k}"), 6)
    return s.select("img_id", "cluster", "glyphs", "x", "y", "w", "h", F.round(F.col("ink") / (F.col("w") * F.col("h")), 6).alias("coverage"), cv("h").alias("h_cv"), cv("w").alias("w_cv"))


def cluster_strokes(members: DataFrame) -> DataFrame:
    """(img_id, cluster, ink, slim, stroke): ink share of the box, mean height by width, mean stroke by mean height.

    ``members`` has glyphs' boxes with their own area and stroke.
    """
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    box = (F.max("x1") - F.min("x0") + 1) * (F.max("y1") - F.min("y0") + 1)
    return members.groupBy("img_id", "cluster").agg(F.round(F.sum("area") / box, 6).alias("ink"), F.round(F.avg(h / w), 6).alias("slim"), F.round(F.avg("stroke") / F.avg(h), 6).alias("stroke"))


def aligned(boxes: DataFrame) -> DataFrame:
    """Boxes with a horizontal neighbour on the same baseline (semi join over pairs that share a cell)."""
    p = _pairs(boxes, 2 * (F.col("y1") - F.col("y0") + 1))
    gap, offset = _gap("x0", "x1", "x0_b", "x1_b"), F.abs(F.col("y1") - F.col("y1_b")) * 2
    near = lambda side: (offset <= F.col(f"y1{side}") - F.col(f"y0{side}") + 1) & (gap <= 2 * (F.col(f"y1{side}") - F.col(f"y0{side}") + 1))
    hit = p.select("img_id", F.explode(F.filter(F.array(F.when(near(""), F.col("id")), F.when(near("_b"), F.col("id_b"))), lambda i: i.isNotNull())).alias("id")).distinct()
    return boxes.join(hit, ["img_id", "id"], "left_semi")


def overlaps(prefix_a: str = "", suffix_b: str = "_b") -> Column:
    a, b = (lambda k: F.col(prefix_a + k)), (lambda k: F.col(k + suffix_b))
    return (a("x0") <= b("x1")) & (b("x0") <= a("x1")) & (a("y0") <= b("y1")) & (b("y0") <= a("y1"))


def without_overlaps(relaxed: DataFrame, strict: DataFrame) -> DataFrame:
    """All strict boxes, and the relaxed ones that overlap none of them (anti join)."""
    b = strict.select(F.col("img_id").alias("img_b"), *(F.col(k).alias(f"{k}_b") for k in ("x0", "y0", "x1", "y1")))
    left = relaxed.join(b, (F.col("img_id") == F.col("img_b")) & overlaps(), "left_anti")
    return strict.withColumn("relaxed", F.lit(False)).unionByName(left.withColumn("relaxed", F.lit(True)))


def merge_boxes(boxes: DataFrame, cell: int = 32) -> DataFrame:
    """Overlapping boxes merged until none overlap; a merged box may meet others, so rounds repeat.

    Boxes meet in the cells of a grid they both lie in, not as all pairs of an image.
    """
    v = cut(boxes.select("img_id", F.col("id").cast("long").alias("id"), "x0", "y0", "x1", "y1"))
    while True:
        pairs = _pairs(v, cell=cell).where(overlaps()).select("img_id", "id", "id_b")
        if not pairs.head(1):
            return v
        c = spanning_labels(v, pairs)
        merged = v.join(c, ["img_id", "id"]).groupBy("img_id", F.col("cluster").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        v = cut(merged, v)


def text_rows(boxes: DataFrame) -> DataFrame:
    """Rows of boxes: by centre, a new row where the gap exceeds 0.7 of the mean height."""
    per = Window.partitionBy("img_id")
    w = per.orderBy("cy2", "id")
    v = boxes.withColumn("cy2", F.col("y0") + F.col("y1")).withColumn("_h", F.sum(F.col("y1") - F.col("y0") + 1).over(per)).withColumn("_n", F.count("*").over(per))
    new = (F.col("cy2") - F.lag("cy2").over(w)) * 5 * F.col("_n") > 7 * F.col("_h")
    return v.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("row", F.sum("_new").over(w)).select("img_id", "id", "row")


def cap_regions(boxes: DataFrame, k: int = 10) -> DataFrame:
    """Strict boxes before relaxed ones, then more glyphs, then lower id; the first k per image."""
    w = Window.partitionBy("img_id").orderBy("relaxed", F.desc("glyphs"), "id")
    return boxes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Fixed values, strict and relaxed: least glyphs, share of height, width and area a cluster may take, spread of heights and widths.
GATES = {False: (6, 0.6, 0.95, 0.4, 1.1, 1.0), True: (5, 0.3, 0.6, 0.1, 1.6, 1.35)}
PAD = 4


def reads_as_text(m: dict[str, np.ndarray], width: int, height: int, relaxed: bool = False) -> bool:
    """Whether glyphs (arrays x0, y0, x1, y1, area, stroke) of one cluster pass every gate of size, spread, stroke, rows and alignment."""
    least, tall, wide, large, h_spread, w_spread = GATES[relaxed]
    n = len(m["x0"])
    w, h = m["x1"] - m["x0"] + 1.0, m["y1"] - m["y0"] + 1.0
    box_w, box_h = m["x1"].max() - m["x0"].min() + 1, m["y1"].max() - m["y0"].min() + 1
    if n < least or box_w < 6 or box_h < 6 or not 0.2 <= box_w / box_h <= 30:
        return False
    if box_h > tall * height or box_w > wide * width or box_w * box_h > large * width * height:
        return False
    if not 0.04 <= m["area"].sum() / (box_w * box_h) <= 0.8 or h.std() / h.mean() > h_spread or w.std() / w.mean() > w_spread:
        return False
    if (h / w).mean() > 2.5 or h.mean() >= 12 and m["stroke"].mean() / h.mean() > 0.42:
        return False
    centre = (m["y0"] + m["y1"]) / 2
    order = np.argsort(centre, kind="stable")
    row = np.cumsum(np.diff(centre[order], prepend=centre[order[0]]) > 0.7 * h.mean())
    filled = 0
    for r in range(int(row[-1]) + 1):
        own = order[row == r]
        if len(own) >= 3 and w[own].sum() >= 0.45 * (m["x1"][own].max() - m["x0"][own].min() + 1):
            filled += len(own)
    if filled < 0.5 * n:
        return False
    taller = np.maximum(h[:, None], h)
    gap = np.maximum(0, np.maximum(m["x0"][None, :] - m["x1"][:, None], m["x0"][:, None] - m["x1"][None, :]))
    near = (np.abs(centre[:, None] - centre) < 0.6 * taller) & (gap < 2.5 * taller) & ~np.eye(n, dtype=bool)
    return near.any(1).sum() >= 0.55 * n


def cluster_boxes(members: DataFrame, relaxed: bool = False) -> DataFrame:
    """(img_id, id, x0, y0, x1, y1, glyphs) of the clusters that read as text, padded, from glyphs
    (img_id, cluster, x0, y0, x1, y1, area, stroke, width, height); a group is one cluster."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        m = {k: t[k].to_numpy().astype(float) for k in ("x0", "y0", "x1", "y1", "area", "stroke")}
        width, height = t["width"][0].as_py(), t["height"][0].as_py()
        ok = reads_as_text(m, width, height, relaxed)
        box = (max(0, m["x0"].min() - PAD), max(0, m["y0"].min() - PAD), min(width - 1, m["x1"].max() + PAD), min(height - 1, m["y1"].max() + PAD))
        row = [key[0].as_py(), key[1].as_py(), *map(int, box), t.num_rows]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]
        return pa.table({n: pa.array([v] if ok else [], k) for n, v, k in zip(("img_id", "id", "x0", "y0", "x1", "y1", "glyphs"), row, kinds, strict=True)})

    ship(members.sparkSession)
    return members.groupBy("img_id", "cluster").applyInArrow(run, "img_id long, id long, x0 int, y0 int, x1 int, y1 int, glyphs long")


def find_text(px: DataFrame, relaxed: bool = False) -> DataFrame:
    """Boxes of one detection: ink, components, glyphs, clusters, gates."""
    size = px.groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    stats = component_stats(labelled(text_ink(px, relaxed).withColumn("label", F.lit(1)))).join(size, "img_id")
    side = F.floor(F.greatest("width", "height") * 0.13)
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    fits = (F.col("area") >= 4) & (F.col("area") <= 0.6 * side * side) & (w <= side) & (h <= side) & (F.col("area") * 10 >= w * h)
    glyphs = cut(stats.where(fits).withColumnRenamed("comp", "id"))
    return cluster_boxes(glyphs.join(spanning_labels(glyphs, glyph_pairs(glyphs, relaxed)), ["img_id", "id"]), relaxed)


def text_regions(px: DataFrame) -> DataFrame:
    """(img_id, id, x0, y0, x1, y1, glyphs, relaxed): strict boxes and, in dark images, relaxed ones that meet none."""
    strict = cut(find_text(px))
    dark = median_luma(px).where(F.col("median") <= DARK_IMAGE).select("img_id")
    loose = find_text(px.join(dark, "img_id", "left_semi"), relaxed=True)
    both = without_overlaps(loose, strict)
    return cap_regions(both.select("img_id", "id", "x0", "y0", "x1", "y1", "glyphs", "relaxed")).drop("rank")


def box_pixels(px: DataFrame, boxes: DataFrame, tile: int = 32) -> DataFrame:
    """Rows of ``px`` with each box (id, x0, y0, x1, y1) they lie in: both meet in the tiles of a grid."""
    at = lambda v: F.floor(F.col(v) / tile).cast("int")
    spread = boxes.withColumn("ty", F.explode(F.sequence(at("y0"), at("y1")))).withColumn("tx", F.explode(F.sequence(at("x0"), at("x1"))))
    tiled = px.withColumn("ty", at("y")).withColumn("tx", at("x"))
    return tiled.join(spread, ["img_id", "ty", "tx"]).where("x between x0 and x1 and y between y0 and y1").drop("ty", "tx")


def patch_gate(pair: DataFrame, boxes: DataFrame, min_side: int = 12, gain: float = 0.97) -> DataFrame:
    """Boxes where the patched pixels (pr, pg, pb) lower the base canvas's error enough."""
    inside = box_pixels(pair, boxes.where(f"x1 - x0 + 1 >= {min_side} and y1 - y0 + 1 >= {min_side}"))
    err = lambda p: sum(((F.col(k) - F.col(f"{p}{k}")) * (F.col(k) - F.col(f"{p}{k}")) for k in "gb"), (F.col("r") - F.col(f"{p}r")) * (F.col("r") - F.col(f"{p}r")))
    s = inside.groupBy("img_id", "id").agg(F.sum(err("c")).cast("long").alias("before"), F.sum(err("p")).cast("long").alias("after"))
    return s.withColumn("accepted", F.col("after") < gain * F.col("before"))
