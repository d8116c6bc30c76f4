"""Registered queries over regions, text boxes, saliency, shapes, documents and jobs, with the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pixels import gaussian, segment_distance, uniform
from ..operators import gradients, metrics, neighbours, overlay, palette, paths, raster, refine, saliency, segment, signals, text
from ..registry import register
from ..sources import sinks
from ..sources.pixels import pack_images, pixels, table, unpack_images, with_canvas
from ..streaming import jobs
from . import convert
from .catalog import BOXES, CELLS, DSSIM, MODE, PAL, Q4, SSE, TONE, boxes, linear_sql, px_query, radial_sql
from .sql import SQ, sql


def q4(px: DataFrame) -> DataFrame:
    return palette.quantize(px, 4).select("img_id", "y", "x", F.col("key").alias("label"))


def comps(px: DataFrame) -> DataFrame:
    return segment.components(q4(px))


# ---------------------------------------------------------------- regions
COMP = """reach AS (SELECT img_id, y, x, label, CAST(y * 64 + x AS BIGINT) AS root FROM q UNION
   SELECT c.img_id, c.y, c.x, c.label, r.root FROM reach r JOIN q c ON c.img_id = r.img_id AND c.label = r.label AND abs(c.y - r.y) + abs(c.x - r.x) = 1),
 rooted AS (SELECT img_id, y, x, label, min(root) AS root FROM reach GROUP BY img_id, y, x, label),
 comp AS (SELECT img_id, y, x, label, CAST(dense_rank() OVER (PARTITION BY img_id ORDER BY root) - 1 AS BIGINT) AS comp FROM rooted)"""
px_query("components", comps, "SELECT * FROM comp", Q4, COMP, recursive=True)
SIDES = """sides AS (SELECT *, CASE WHEN lag(comp) OVER h = comp THEN 0 ELSE 1 END AS l, CASE WHEN lead(comp) OVER h = comp THEN 0 ELSE 1 END AS r,
   CASE WHEN lag(comp) OVER v = comp THEN 0 ELSE 1 END AS t, CASE WHEN lead(comp) OVER v = comp THEN 0 ELSE 1 END AS d FROM comp WINDOW h AS (PARTITION BY img_id, y ORDER BY x), v AS (PARTITION BY img_id, x ORDER BY y)),
 cstats AS (SELECT img_id, comp, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(sum(l + r + t + d) AS BIGINT) AS perim, round(2 * count(*) / sum(l + r + t + d), 6) AS stroke FROM sides GROUP BY img_id, comp)"""
px_query("component_stats", lambda p: segment.component_stats(comps(p)), "SELECT * FROM cstats", Q4, COMP, SIDES, recursive=True)
px_query("glyph_filter", lambda p: text.glyph_filter(segment.component_stats(comps(p)), 64), "SELECT * FROM cstats WHERE area BETWEEN 4 AND 38 AND x1 - x0 + 1 <= 8 AND y1 - y0 + 1 <= 8 AND area * 10 >= (x1 - x0 + 1) * (y1 - y0 + 1)", Q4, COMP, SIDES, recursive=True)
px_query("fragmentation", lambda p: segment.fragmentation(comps(p)), """SELECT *, regions > 40 OR top8 < 0.85e0 AS fragmented FROM (SELECT img_id, count(*) AS regions, round(sum(CASE WHEN k <= 8 THEN area ELSE 0 END) / sum(area), 6) AS top8
  FROM (SELECT img_id, comp, count(*) AS area, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, comp) AS k FROM comp GROUP BY img_id, comp) GROUP BY img_id)""", Q4, COMP, recursive=True)
px_query("region_border", lambda p: segment.region_border(comps(p)), "SELECT a.img_id, least(a.comp, c.comp) AS a, greatest(a.comp, c.comp) AS b, count(*) AS n FROM comp a JOIN comp c ON c.img_id = a.img_id AND ((c.x = a.x + 1 AND c.y = a.y) OR (c.y = a.y + 1 AND c.x = a.x)) WHERE a.comp <> c.comp GROUP BY ALL", Q4, COMP, recursive=True)
px_query("boundary_edges", lambda p: segment.boundary_edges(comps(p)), """SELECT img_id, comp, x AS ax, y AS ay, x + 1 AS bx, y AS by1 FROM sides WHERE t = 1 UNION ALL SELECT img_id, comp, x + 1, y, x + 1, y + 1 FROM sides WHERE r = 1
  UNION ALL SELECT img_id, comp, x + 1, y + 1, x, y + 1 FROM sides WHERE d = 1 UNION ALL SELECT img_id, comp, x, y + 1, x, y FROM sides WHERE l = 1""", Q4, COMP, SIDES, recursive=True)
px_query("merge_small", lambda p: segment.merge_small(comps(p), 9), None)
px_query("tiled_components", lambda p: segment.tiled_components(q4(p), 16).groupBy("img_id", "comp").agg(F.count("*").alias("area")).select("img_id", "area"), "SELECT img_id, count(*) AS area FROM comp GROUP BY img_id, comp", Q4, COMP, recursive=True)
px_query("region_trace", lambda p: convert.region_trace(p), None)
px_query("layer_trace", lambda p: convert.layer_trace(p), None)
FLAT = "count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r) AS qr, sum(g * g) AS qg, sum(b * b) AS qb"
px_query("region_fit", lambda p: gradients.region_fit(p.withColumn("comp", F.floor(F.col("y") / 32) * 2 + F.floor(F.col("x") / 32))), f"""SELECT img_id, comp, kind, CASE WHEN kind <> 'solid' THEN CAST(cand AS INTEGER) END AS cand, round(CASE WHEN kind <> 'solid' THEN g ELSE f END, 6) AS rmse FROM (
  SELECT *, CASE WHEN NOT (g <= 0.6e0 * f AND g < f - 1e-4) THEN 'solid' WHEN cand < 8 THEN 'linear' ELSE 'radial' END AS kind FROM (SELECT img_id, comp, cand, sqrt(greatest(0.0e0, sse) / (3 * n)) / 255 AS g, sqrt(greatest(0.0e0, flat) / (3 * n)) / 255 AS f FROM (
   SELECT * FROM (SELECT * FROM linear UNION ALL SELECT * FROM radial) QUALIFY row_number() OVER (PARTITION BY img_id, comp ORDER BY sse, cand) = 1)
  JOIN (SELECT img_id, comp, round({SSE}, 3) AS flat FROM (SELECT img_id, comp, {FLAT} FROM reg GROUP BY ALL) GROUP BY ALL) USING (img_id, comp)))""",
  "reg AS (SELECT *, CAST(y // 32 * 2 + x // 32 AS BIGINT) AS comp FROM px)", linear_sql("reg", "img_id, comp", 8, 32), *radial_sql("reg", "img_id, comp", 3, 32, 8))

# ---------------------------------------------------------------- text regions
TILE = """tl AS (SELECT img_id, CAST(y // 32 AS INTEGER) AS ty, CAST(x // 32 AS INTEGER) AS tx, CAST(l // 8000 AS INTEGER) AS bucket, l, y, x FROM luma),
 tn AS (SELECT img_id, ty, tx, bucket, count(*) AS n FROM tl GROUP BY ALL),
 tm AS (SELECT img_id, ty, tx, bucket AS mode, sum(n) OVER (PARTITION BY img_id, ty, tx) AS total FROM tn QUALIFY row_number() OVER (PARTITION BY img_id, ty, tx ORDER BY n DESC, bucket) = 1),
 tb AS (SELECT img_id, ty, tx, mode, max(total) AS total, sum(n) AS band FROM tn JOIN tm USING (img_id, ty, tx) WHERE abs(bucket - mode) <= 1 GROUP BY ALL),
 tg AS (SELECT img_id, y, x, l, lag(l) OVER h AS na, lead(l) OVER h AS nb, lag(l) OVER v AS nc, lead(l) OVER v AS nd FROM luma WINDOW h AS (PARTITION BY img_id, y ORDER BY x), v AS (PARTITION BY img_id, x ORDER BY y)),
 tf AS (SELECT t.img_id, t.ty, t.tx, count(*) AS inner_n, sum(abs(nb - na) + abs(nd - nc)) AS g FROM tg g JOIN tm t ON t.img_id = g.img_id AND t.ty = g.y // 32 AND t.tx = g.x // 32
  WHERE abs(l // 8000 - mode) <= 1 AND abs(na // 8000 - mode) <= 1 AND abs(nb // 8000 - mode) <= 1 AND abs(nc // 8000 - mode) <= 1 AND abs(nd // 8000 - mode) <= 1 GROUP BY ALL),
 tiles AS (SELECT img_id, ty, tx, mode, round(band / total, 6) AS share, round(g / inner_n / 1000, 6) AS flatness, coalesce(band >= 0.5e0 * total AND inner_n * 5 >= total AND g <= 8000 * inner_n, false) AS valid FROM tb LEFT JOIN tf USING (img_id, ty, tx))"""
px_query("tile_background", text.tile_background, "SELECT * FROM tiles", TILE)
px_query("local_ink", text.local_ink, "SELECT img_id, y, x FROM tl JOIN tiles USING (img_id, ty, tx) WHERE CASE WHEN valid THEN abs(l - (mode * 8000 + 4000)) > 45000 ELSE l >= 240000 END", TILE)
px_query("median_luma", text.median_luma, "SELECT img_id, CAST(v AS INTEGER) AS median FROM (SELECT img_id, l // 1000 AS v, row_number() OVER (PARTITION BY img_id ORDER BY l // 1000) AS k, count(*) OVER (PARTITION BY img_id) AS n FROM luma) WHERE k = n // 2 + 1")
GAPX, GAPY = "greatest(0, c.x0 - a.x1 - 1, a.x0 - c.x1 - 1)", "greatest(0, c.y0 - a.y1 - 1, a.y0 - c.y1 - 1)"
PAIRS = f"pairs AS (SELECT a.img_id, a.id, c.id AS id_b FROM boxes a JOIN boxes c ON c.img_id = a.img_id AND a.id < c.id WHERE {GAPX} * 10 < (least(a.y1 - a.y0, c.y1 - c.y0) + 1) * 16 AND {GAPY} * 10 < (least(a.y1 - a.y0, c.y1 - c.y0) + 1) * 9)"
px_query("glyph_pairs", lambda p: text.glyph_pairs(boxes(p)), "SELECT * FROM pairs", BOXES, PAIRS)
CLUST = """bothways AS (SELECT img_id, id, id_b FROM pairs UNION ALL SELECT img_id, id_b, id FROM pairs), creach AS (SELECT img_id, id, id AS c FROM boxes UNION SELECT r.img_id, e.id_b, r.c FROM creach r JOIN bothways e ON e.img_id = r.img_id AND e.id = r.id),
 members AS (SELECT b.*, cluster FROM boxes b JOIN (SELECT img_id, id, min(c) AS cluster FROM creach GROUP BY ALL) USING (img_id, id)),
 clusters AS (SELECT img_id, cluster, count(*) AS glyphs, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) + 1 AS w, max(y1) - min(y0) + 1 AS h, round(sum((x1 - x0 + 1) * (y1 - y0 + 1)) / ((max(x1) - min(x0) + 1) * (max(y1) - min(y0) + 1)), 6) AS coverage,
  round(sqrt(count(*) * sum((y1 - y0 + 1) ** 2) - sum(y1 - y0 + 1) ** 2) / sum(y1 - y0 + 1), 6) AS h_cv, round(sqrt(count(*) * sum((x1 - x0 + 1) ** 2) - sum(x1 - x0 + 1) ** 2) / sum(x1 - x0 + 1), 6) AS w_cv FROM members GROUP BY img_id, cluster)"""
px_query("glyph_cluster", lambda p: text.glyph_clusters(boxes(p)), "SELECT * FROM clusters", BOXES, PAIRS, CLUST, recursive=True)
px_query("cluster_stats", lambda p: text.cluster_stats(boxes(p).withColumn("cluster", F.col("id") % 5)), "SELECT * FROM clusters", BOXES, "members AS (SELECT *, id % 5 AS cluster FROM boxes)", CLUST[CLUST.index("clusters AS"):])
px_query("cluster_strokes", lambda p: text.cluster_strokes(boxes(p).withColumn("cluster", F.col("id") % 5).withColumn("area", F.col("id") % 9 + 3).withColumn("stroke", (F.col("id") % 7 + 1) / 2)), "SELECT img_id, id % 5 AS cluster, round(sum(id % 9 + 3) / ((max(x1) - min(x0) + 1) * (max(y1) - min(y0) + 1)), 6) AS ink, round(avg((y1 - y0 + 1) / (x1 - x0 + 1)), 6) AS slim, round(avg((id % 7 + 1) / 2) / avg(y1 - y0 + 1), 6) AS stroke FROM boxes GROUP BY ALL", BOXES)


def page(px: DataFrame) -> DataFrame:
    """Images as pages: marks where red is high, on a background that darkens by tile."""
    on = F.col("r") > 230
    return px.select("img_id", "y", "x", F.when(on, 30).otherwise(240).alias("r"), F.when(on, F.floor(F.col("g") / 2)).otherwise(240).cast("int").alias("g"), F.when(on, F.col("b")).otherwise(240 - F.floor(F.col("x") / 32) * 60).cast("int").alias("b"))


PAGE = ["page AS (SELECT img_id, y, x, CASE WHEN r > 230 THEN 30 ELSE 240 END AS r, CASE WHEN r > 230 THEN g // 2 ELSE 240 END AS g, CASE WHEN r > 230 THEN b ELSE 240 - x // 32 * 60 END AS b FROM px)", "pluma AS (SELECT img_id, y, x, CAST(r * 299 + g * 587 + b * 114 AS BIGINT) AS l FROM page)"]


def ink_sql(slope: int, relaxed: bool) -> list[str]:
    """Background colours of a page's tiles and its ink in ``inked``."""
    vivid, panel = "greatest(r, g, b) - least(r, g, b)", "greatest(tr, tg, tb) - least(tr, tg, tb)"
    away = "greatest(abs(r - tr), abs(g - tg), abs(b - tb)) > 45" + (f" OR (tr * 0.299e0 + tg * 0.587e0 + tb * 0.114e0 >= 140 AND {vivid} >= 70 AND {vivid} - ({panel}) >= 40)" if relaxed else "")
    bright = "l >= 240000" + (f" OR (mean <= 110 AND greatest(r, g, b) >= 190 AND {vivid} >= 90)" if relaxed else "")
    return [*PAGE, TILE.replace("luma", "pluma").replace("g <= 8000 * inner_n", f"g <= {slope} * inner_n"),
            "tcol AS (SELECT t.img_id, t.ty, t.tx, valid, avg(CASE WHEN abs(l // 8000 - mode) <= 1 THEN r END) AS tr, avg(CASE WHEN abs(l // 8000 - mode) <= 1 THEN g END) AS tg, avg(CASE WHEN abs(l // 8000 - mode) <= 1 THEN b END) AS tb, avg(l) / 1000 AS mean FROM page p JOIN pluma USING (img_id, y, x) JOIN tiles t ON t.img_id = p.img_id AND t.ty = p.y // 32 AND t.tx = p.x // 32 GROUP BY ALL)",
            f"inked AS (SELECT p.img_id, p.y, p.x FROM page p JOIN pluma USING (img_id, y, x) JOIN tcol t ON t.img_id = p.img_id AND t.ty = p.y // 32 AND t.tx = p.x // 32 WHERE CASE WHEN valid THEN {away} ELSE {bright} END)"]


px_query("text_ink", lambda p: text.text_ink(page(p)), "SELECT * FROM inked", *ink_sql(8000, False))
px_query("text_ink_relaxed", lambda p: text.text_ink(page(p), relaxed=True), "SELECT * FROM inked", *ink_sql(22000, True))


def typed(px: DataFrame) -> DataFrame:
    """Images as typed pages: three rows of small upright marks with a bar."""
    row, at = F.col("y") % 20, F.col("x") % 7
    mark = row.between(4, 10) & (at.isin(1, 2) | (row == 7) & at.between(1, 4)) & F.col("x").between(1, 56)
    return px.select("img_id", "y", "x", *(F.when(mark, F.floor(F.col(k) / 8)).otherwise(235).cast("int").alias(k) for k in "rgb"))


px_query("text_regions", lambda p: text.text_regions(typed(p)), None)
px_query("aligned_semi", lambda p: text.aligned(boxes(p)), f"SELECT * FROM boxes a WHERE EXISTS (SELECT 1 FROM boxes c WHERE c.img_id = a.img_id AND c.id <> a.id AND abs(a.y1 - c.y1) * 2 <= a.y1 - a.y0 + 1 AND {GAPX} <= 2 * (a.y1 - a.y0 + 1))", BOXES)
LAP = "a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1"
px_query("box_anti", lambda p: text.without_overlaps(boxes(p).where("id >= 8"), boxes(p).where("id < 8")), f"SELECT *, false AS relaxed FROM boxes WHERE id < 8 UNION ALL SELECT *, true FROM boxes a WHERE id >= 8 AND NOT EXISTS (SELECT 1 FROM boxes c WHERE c.id < 8 AND c.img_id = a.img_id AND {LAP})", BOXES)
px_query("box_merge", lambda p: text.merge_boxes(boxes(p)), None)
px_query("text_rows", lambda p: text.text_rows(boxes(p)), "SELECT img_id, id, CAST(sum(n) OVER (PARTITION BY img_id ORDER BY cy2, id) AS BIGINT) AS row FROM (SELECT img_id, id, cy2, CASE WHEN (cy2 - lag(cy2) OVER (PARTITION BY img_id ORDER BY cy2, id)) * 5 * k > 7 * hs THEN 1 ELSE 0 END AS n FROM (SELECT img_id, id, y0 + y1 AS cy2, sum(y1 - y0 + 1) OVER (PARTITION BY img_id) AS hs, count(*) OVER (PARTITION BY img_id) AS k FROM boxes))", BOXES)
px_query("region_cap", lambda p: text.cap_regions(boxes(p).select("img_id", "id", (F.col("id") % 3 == 0).alias("relaxed"), (F.col("x0") % 9).alias("glyphs"))), "SELECT img_id, id, id % 3 = 0 AS relaxed, x0 % 9 AS glyphs, CAST(row_number() OVER (PARTITION BY img_id ORDER BY id % 3 = 0, x0 % 9 DESC, id) AS INTEGER) AS rank FROM boxes QUALIFY rank <= 10", BOXES)
px_query("patch_gate", lambda p: text.patch_gate(p.withColumns({f"p{k}": F.floor(F.col(k) / 32).cast("int") * 32 + 16 for k in "rgb"}), boxes(p).withColumn("x1", F.col("x0") + 14).withColumn("y1", F.col("y0") + 12)), f"""SELECT *, after < 0.97e0 * before AS accepted FROM (SELECT b.img_id, b.id, CAST(sum({SQ}) AS BIGINT) AS before, CAST(sum((r - r // 32 * 32 - 16) ** 2 + (g - g // 32 * 32 - 16) ** 2 + (b - b // 32 * 32 - 16) ** 2) AS BIGINT) AS after
  FROM canvas c JOIN (SELECT img_id, id, x0, y0 FROM boxes) b ON b.img_id = c.img_id AND x BETWEEN x0 AND x0 + 14 AND y BETWEEN y0 AND y0 + 12 GROUP BY b.img_id, b.id)""".replace("(b - b //", "(c.b - c.b //").replace("(b - cb)", "(c.b - cb)"), BOXES, canvas=True)
px_query("region_union", lambda p: segment.component_stats(segment.components(neighbours.smooth_mask(p, 45).withColumn("label", F.lit(1)))).select("img_id", "area", F.lit("plain").alias("src")).unionByName(segment.component_stats(segment.components(neighbours.bright_mask(p, 45).withColumn("label", F.lit(1)))).select("img_id", "area", F.lit("bright").alias("src"))).where("area >= 12"), None)

# ---------------------------------------------------------------- saliency
SAL = """cm AS (SELECT img_id, CAST(y // 8 AS INTEGER) AS gy, CAST(x // 8 AS INTEGER) AS gx, count(*) AS area, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY img_id, y // 8, x // 8),
 con AS (SELECT a.img_id, a.gy, a.gx, round(sum(sqrt((a.mr - o.mr) ** 2 + (a.mg - o.mg) ** 2 + (a.mb - o.mb) ** 2) * o.area) / sum(o.area), 6) AS contrast FROM cm a JOIN cm o ON o.img_id = a.img_id AND (a.gy <> o.gy OR a.gx <> o.gx) GROUP BY a.img_id, a.gy, a.gx),
 sal AS (SELECT img_id, gy, gx, round(0.4e0 + 0.6e0 * least(1.0e0, d * 0.55e0 + greatest(d, 0.15e0) * exp(-((gx - (w - 1) / 2) ** 2 + (gy - (h - 1) / 2) ** 2) / (2 * (0.55e0 * least(w, h)) ** 2)) * 0.45e0), 6) AS s FROM (
  SELECT con.*, CASE WHEN top > 0 THEN contrast / top ELSE 0 END AS d, w, h FROM con JOIN (SELECT img_id, max(contrast) AS top, max(gx) + 1 AS w, max(gy) + 1 AS h FROM con GROUP BY img_id) USING (img_id)))"""
px_query("saliency_contrast", saliency.contrast, "SELECT * FROM con", SAL)
px_query("saliency", saliency.prior, "SELECT * FROM sal", SAL)
px_query("bilinear_up", lambda p: saliency.bilinear(p, saliency.prior(p), "s", 64, 8), """SELECT p.img_id, CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, round(a.s + (b.s - a.s) * (u - x0) + (c.s + (d.s - c.s) * (u - x0) - (a.s + (b.s - a.s) * (u - x0))) * (v - y0) + 1e-9, 6) AS s FROM (
  SELECT *, CAST(floor(u) AS INTEGER) AS x0, CAST(floor(v) AS INTEGER) AS y0, least(CAST(floor(u) AS INTEGER) + 1, 7) AS x1, least(CAST(floor(v) AS INTEGER) + 1, 7) AS y1 FROM (SELECT img_id, y, x, greatest(0.0e0, least(7.0e0, (x + 0.5e0) / 8 - 0.5e0)) AS u, greatest(0.0e0, least(7.0e0, (y + 0.5e0) / 8 - 0.5e0)) AS v FROM px)) q,
  LATERAL (SELECT CAST(q.img_id AS BIGINT) AS img_id, q.y, q.x) p JOIN sal a ON a.img_id = q.img_id AND a.gy = y0 AND a.gx = x0 JOIN sal b ON b.img_id = q.img_id AND b.gy = y0 AND b.gx = x1 JOIN sal c ON c.img_id = q.img_id AND c.gy = y1 AND c.gx = x0 JOIN sal d ON d.img_id = q.img_id AND d.gy = y1 AND d.gx = x1""", SAL)


# ---------------------------------------------------------------- shapes
def ellipses(px: DataFrame) -> DataFrame:
    e = px.where("x = 1")
    return e.select("img_id", F.col("y").alias("seq"), *((F.col(a) % 64).cast("double").alias(n) for a, n in (("r", "cx"), ("g", "cy"))), (1 + F.col("b") % 14).cast("double").alias("rx"), (1 + (F.col("r") + F.col("b")) % 14).cast("double").alias("ry"))


def polygons(px: DataFrame) -> DataFrame:
    return px.where("x between 2 and 6").select("img_id", F.col("y").alias("seq"), (F.col("x") - 2).alias("i"), (F.col("r") % 80 - 8).cast("double").alias("x"), (F.col("g") % 80 - 8).cast("double").alias("y"))


def splats(px: DataFrame) -> DataFrame:
    return px.where("x = 7").select("img_id", F.col("y").alias("seq"), *((F.col(a) % 64).cast("double").alias(n) for a, n in (("r", "cx"), ("g", "cy"))), (2 + F.col("b") % 6).cast("double").alias("sx"), (2 + F.col("g") % 6).cast("double").alias("sy"), ((30 + F.col("r") % 60) / 100).alias("a"))


def runs(px: DataFrame) -> DataFrame:
    return raster.ellipse_runs(ellipses(px), 64, 64)


ELL = """ell AS (SELECT img_id, y AS seq, CAST(r % 64 AS DOUBLE) AS cx, CAST(g % 64 AS DOUBLE) AS cy, CAST(1 + b % 14 AS DOUBLE) AS rx, CAST(1 + (r + b) % 14 AS DOUBLE) AS ry FROM px WHERE x = 1),
 er AS (SELECT img_id, seq, CAST(yy AS INTEGER) AS y, CAST(greatest(0, ceil(cx - half)) AS INTEGER) AS x1, CAST(least(63, floor(cx + half)) AS INTEGER) AS x2 FROM (
   SELECT *, rx * sqrt(greatest(0.0e0, 1 - ((yy - cy) / ry) * ((yy - cy) / ry))) AS half FROM ell, (SELECT unnest(range(0, 64)) AS yy) WHERE yy >= ceil(cy - ry) AND yy <= floor(cy + ry))),
 runs AS (SELECT * FROM er WHERE x1 <= x2), hit AS (SELECT img_id, seq, y, CAST(unnest(range(x1, x2 + 1)) AS INTEGER) AS x FROM runs)"""
px_query("ellipse_runs", runs, "SELECT * FROM runs", ELL)
RUNSTAT = "rs AS (SELECT img_id, seq, CAST(sum(x2 - x1 + 1) AS BIGINT) AS area, min(x1) AS x0, max(x2) AS xm, min(y) AS y0, max(y) AS ym FROM runs GROUP BY img_id, seq)"
px_query("run_area", lambda p: raster.run_stats(runs(p)), "SELECT * FROM rs", ELL, RUNSTAT)
px_query("shape_caps", lambda p: raster.shape_caps(runs(p), 250, 20), "SELECT * FROM rs WHERE area BETWEEN 1 AND 250 AND xm - x0 + 1 <= 20 AND ym - y0 + 1 <= 20", ELL, RUNSTAT)
px_query("polygon_runs", lambda p: raster.polygon_runs(polygons(p), 64, 64), """SELECT img_id, seq, y, x1, x2 FROM (SELECT img_id, seq, CAST(yy AS INTEGER) AS y, CAST(greatest(0, floor(xs + 0.5)) AS INTEGER) AS x1, CAST(least(63, floor(xe + 0.5) - 1) AS INTEGER) AS x2 FROM (
  SELECT img_id, seq, yy, xs, lead(xs) OVER w AS xe, row_number() OVER w AS k FROM (SELECT *, ax + (yy + 0.5e0 - ay) * (bx - ax) / (by1 - ay) AS xs FROM edges, (SELECT unnest(range(0, 64)) AS yy) WHERE ay <> by1 AND yy + 0.5e0 >= least(ay, by1) AND yy + 0.5e0 < greatest(ay, by1)) WINDOW w AS (PARTITION BY img_id, seq, yy ORDER BY xs)) WHERE k % 2 = 1 AND xe IS NOT NULL) WHERE x1 <= x2""",
  "verts AS (SELECT img_id, y AS seq, x - 2 AS i, CAST(r % 80 - 8 AS DOUBLE) AS vx, CAST(g % 80 - 8 AS DOUBLE) AS vy FROM px WHERE x BETWEEN 2 AND 6)",
  "edges AS (SELECT img_id, seq, vx AS ax, vy AS ay, coalesce(lead(vx) OVER w, first(vx) OVER f) AS bx, coalesce(lead(vy) OVER w, first(vy) OVER f) AS by1 FROM verts WINDOW w AS (PARTITION BY img_id, seq ORDER BY i), f AS (PARTITION BY img_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
COLOR = "color AS (SELECT img_id, seq, " + ", ".join(f"CAST(least(255, greatest(0, floor((sum({k} - c{k}) / 0.5e0 + sum(c{k})) / count(*) + 0.5))) AS INTEGER) AS {k}" for k in "rgb") + " FROM hit JOIN canvas USING (img_id, y, x) GROUP BY img_id, seq)"
px_query("optimal_color", lambda p: raster.optimal_color(p, runs(p), 0.5), "SELECT * FROM color", ELL, COLOR, canvas=True)
NEW = " + ".join(f"({k} - (c{k} * 0.5e0 + p{k} * 0.5e0)) ** 2 - ({k} - c{k}) ** 2" for k in "rgb")
px_query("delta_score", lambda p: raster.delta_score(p, runs(p), raster.optimal_color(p, runs(p), 0.5), 0.5), f"SELECT img_id, seq, round(sqrt(greatest(0.0e0, total + delta) / (3 * n)) / 255, 9) AS score FROM (SELECT img_id, seq, sum({NEW}) AS delta FROM hit JOIN canvas USING (img_id, y, x) JOIN (SELECT img_id, seq, r AS pr, g AS pg, b AS pb FROM color) USING (img_id, seq) GROUP BY img_id, seq) JOIN (SELECT img_id, sum({SQ}) AS total, count(*) AS n FROM canvas GROUP BY img_id) USING (img_id)", ELL, COLOR, canvas=True)
K = [round(math.exp(-((2.5 * o) ** 2) / 2), 12) for o in (0.25, 0.5, 0.75)]
SPL = f"""sp AS (SELECT img_id, y AS seq, CAST(r % 64 AS DOUBLE) AS cx, CAST(g % 64 AS DOUBLE) AS cy, CAST(2 + b % 6 AS DOUBLE) AS sx, CAST(2 + g % 6 AS DOUBLE) AS sy, (30 + r % 60) / 100 AS a FROM px WHERE x = 7),
 sr AS (SELECT *, 2.5e0 * sx AS rx, 2.5e0 * sy AS ry FROM sp), foot AS (SELECT img_id, seq, y, x, w FROM (SELECT img_id, seq, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, round(a * CASE
  WHEN o < 0.25e0 THEN 1 + o * (({K[0]}e0 - 1) / 0.25e0) WHEN o < 0.5e0 THEN {K[0]}e0 + (o - 0.25e0) * (({K[1]}e0 - {K[0]}e0) / 0.25e0) WHEN o < 0.75e0 THEN {K[1]}e0 + (o - 0.5e0) * (({K[2]}e0 - {K[1]}e0) / 0.25e0)
  WHEN o < 1 THEN {K[2]}e0 + (o - 0.75e0) * ((0 - {K[2]}e0) / 0.25e0) ELSE 0 END, 9) AS w FROM (SELECT *, sqrt(((xx - cx) / rx) * ((xx - cx) / rx) + ((yy - cy) / ry) * ((yy - cy) / ry)) AS o FROM (
   SELECT *, rx * sqrt(greatest(0.0e0, 1 - ((yy - cy) / ry) * ((yy - cy) / ry))) AS half FROM sr, (SELECT unnest(range(0, 64)) AS yy) WHERE yy >= ceil(cy - ry) AND yy <= floor(cy + ry)), (SELECT unnest(range(0, 64)) AS xx) WHERE xx >= ceil(cx - half) AND xx <= floor(cx + half))) WHERE w > 0)"""
px_query("splat_footprint", lambda p: raster.splat_footprint(splats(p), 64, 64), "SELECT * FROM foot", SPL)
px_query("splat_color", lambda p: raster.splat_color(p, raster.splat_footprint(splats(p), 64, 64)), "SELECT img_id, seq, " + ", ".join(f"CAST(CASE WHEN sum(w * w) < 1e-6 THEN 0 ELSE least(255, greatest(0, floor(round(sum(w * ({k} - c{k} * (1 - w))) / sum(w * w), 6) + 0.5))) END AS INTEGER) AS {k}" for k in "rgb") + " FROM foot JOIN canvas USING (img_id, y, x) GROUP BY img_id, seq", SPL, canvas=True)
px_query("coverage", lambda p: raster.coverage(raster.splat_footprint(splats(p), 64, 64)), "SELECT img_id, y, x, round(1 - exp(sum(ln(1 - w))), 4) AS coverage FROM foot GROUP BY img_id, y, x", SPL)
px_query("composite", lambda p: _composite(p), "SELECT p.img_id, p.y, p.x, " + ", ".join(f"round(coalesce(list_reduce(list_prepend({{'v': CAST({v} AS DOUBLE), 'a': 0.0e0}}, l.s{k}), lambda acc, e: {{'v': e.v * e.a + acc.v * (1 - e.a), 'a': 0.0e0}}).v, {v}), 6) AS {k}" for k, v in zip("rgb", (250, 240, 230), strict=True)) + """ FROM px p LEFT JOIN (
  SELECT h.img_id, h.y, h.x, """ + ", ".join(f"list({{'v': CAST(c.{k} AS DOUBLE), 'a': 0.5e0}} ORDER BY h.seq) AS s{k}" for k in "rgb") + " FROM hit h JOIN color c ON c.img_id = h.img_id AND c.seq = h.seq GROUP BY ALL) l ON l.img_id = p.img_id AND l.y = p.y AND l.x = p.x", ELL, COLOR)


def _composite(px: DataFrame) -> DataFrame:
    few = runs(px)
    color = raster.optimal_color(with_canvas(px), few, 0.5)
    layers = raster.covered(few).join(color, ["img_id", "seq"]).select("img_id", F.col("seq").cast("long").alias("seq"), "y", "x", *(F.col(k).alias(f"l{k}") for k in "rgb"), F.lit(0.5).alias("a"))
    base = px.select("img_id").distinct().select("img_id", *(F.lit(v).alias(f"c{k}") for k, v in zip("rgb", (250, 240, 230), strict=True)))
    return raster.composite(base, layers, px.select("img_id", "y", "x"))


def packed(s: SparkSession, d: str) -> DataFrame:
    px = pixels(s, d)
    base = palette.quantize(px, 2)
    return pack_images(px).join(pack_images(base).select("img_id", F.col("data").alias("canvas")), "img_id")


register("pack_roundtrip", lambda s, d: unpack_images(pack_images(pixels(s, d))), sql("SELECT * FROM px"))
register("png_sink", lambda s, d: sinks.encode_png(pack_images(pixels(s, d))).select("img_id", "width", "height", F.octet_length("png").alias("bytes")))
register("refine_step", lambda s, d: refine.refine_images(packed(s, d), refine.Options(budget=60)))
register("prune_pass", lambda s, d: refine.refine_images(packed(s, d), refine.Options(budget=60), with_prune=True))
register("splat_fit", lambda s, d: refine.splat_images(packed(s, d), 60))
register("shape_eval", lambda s, d: refine.evaluate_shapes(packed(s, d), ellipses(pixels(s, d)).select("img_id", "seq", F.lit("ellipse").alias("kind"), F.array("cx", "cy", "rx", "ry").alias("p"))).withColumn("score", F.round("score", 9)), sql("""SELECT img_id, seq, round(sqrt(greatest(0.0e0, total + """ + " + ".join(f"(u{k} - 2 * {k} * t{k} + {k} * {k} * n * 0.25e0)" for k in "rgb") + """) / (3 * pixels)) / 255, 9) AS score, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM (
  SELECT *, """ + ", ".join(f"least(255.0e0, greatest(0.0e0, floor(t{k} / (n * 0.25e0) + 0.5))) AS {k}" for k in "rgb") + " FROM hits JOIN whole USING (img_id))",
  # canvas of two levels, halfway alpha: sums of a (R + a c) and of 2 a R c + a a c c
  "two AS (SELECT img_id, y, x, r, g, b, " + ", ".join(f"{k} // 128 * 128 + 64 AS c{k}" for k in "rgb") + " FROM px)",
  f"whole AS (SELECT img_id, CAST(sum({SQ}) AS DOUBLE) AS total, count(*) AS pixels FROM two GROUP BY img_id)",
  "ell AS (SELECT img_id, y AS seq, r % 64 AS cx, g % 64 AS cy, 1 + b % 14 AS rx, 1 + (r + b) % 14 AS ry FROM px WHERE x = 1)",
  "hits AS (SELECT e.img_id, seq, count(*) AS n, " + ", ".join(f"sum(0.5e0 * (t.{k} - c{k} + 0.5e0 * c{k})) AS t{k}, sum((t.{k} - c{k}) * c{k} + 0.25e0 * c{k} * c{k}) AS u{k}" for k in "rgb") + " FROM ell e JOIN two t ON t.img_id = e.img_id AND t.x >= cx - rx AND t.x <= cx + rx AND t.y >= cy - ry AND t.y <= cy + ry WHERE ((t.x + 0.5e0 - cx) / rx) ** 2 + ((t.y + 0.5e0 - cy) / ry) ** 2 <= 1 GROUP BY e.img_id, seq)"))
register("convert", lambda s, d: convert.convert(pixels(s, d), "draft"))
px_query("weighted_pick", lambda p: _pick(metrics.topk_cells(metrics.error_map(p))), """SELECT img_id, arg_min(rank, rank) AS rank FROM (SELECT img_id, CAST(rank AS INTEGER) AS rank, sum(err) OVER (PARTITION BY img_id ORDER BY rank) AS upto, sum(err) OVER (PARTITION BY img_id) AS total,
  CAST(('0x' || substr(md5('pick:' || CAST(img_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0e0 AS u FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY err DESC, r, c) AS rank FROM cells QUALIFY rank <= 6)) WHERE upto > u * total GROUP BY img_id""", CELLS, canvas=True)


def _pick(top: DataFrame) -> DataFrame:
    per = Window.partitionBy("img_id")
    v = top.withColumn("upto", F.sum("err").over(per.orderBy("rank"))).withColumn("total", F.sum("err").over(per))
    return v.where(F.col("upto") > uniform(F.concat(F.lit("pick:"), F.col("img_id").cast("string"))) * F.col("total")).groupBy("img_id").agg(F.min("rank").alias("rank"))


# ---------------------------------------------------------------- paths and documents
def points(px: DataFrame) -> DataFrame:
    return px.select("img_id", F.col("y").alias("i"), F.col("x").alias("s"), (F.col("r") % 40).cast("double").alias("x"), (F.col("g") % 40).cast("double").alias("y"))


PTS = "pts AS (SELECT img_id, y AS i, x AS s, CAST(r % 40 AS DOUBLE) AS px, CAST(g % 40 AS DOUBLE) AS py FROM px)"
px_query("circle_fit", lambda p: paths.circle_sums(points(p), "img_id"), """SELECT img_id, round(mx + a, 4) AS cx, round(my + b, 4) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) AS radius FROM (SELECT *, (p * vv - q * uv) / (uu * vv - uv * uv) AS a, (q * uu - p * uv) / (uu * vv - uv * uv) AS b FROM (
  SELECT *, (uuu + uvv) / 2 AS p, (vvv + uuv) / 2 AS q FROM (SELECT img_id, n, mx, my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u) AS uuu, sum(v * v * v) AS vvv, sum(u * v * v) AS uvv, sum(u * u * v) AS uuv
   FROM (SELECT img_id, n, mx, my, px - mx AS u, py - my AS v FROM pts JOIN (SELECT img_id, count(*) AS n, avg(px) AS mx, avg(py) AS my FROM pts GROUP BY img_id) USING (img_id)) GROUP BY ALL)) WHERE abs(uu * vv - uv * uv) > 1e-9)""", PTS)
px_query("full_coverage", lambda p: paths.angle_bins(points(p), "img_id"), "SELECT img_id, bins, bins >= 10 AS full FROM (SELECT img_id, count(DISTINCT CAST(floor((atan2(py * n - sy, px * n - sx) + pi()) / (2 * pi()) * 12) AS BIGINT) % 12) AS bins FROM pts JOIN (SELECT img_id, count(*) AS n, sum(px) AS sx, sum(py) AS sy FROM pts GROUP BY img_id) USING (img_id) GROUP BY img_id)", PTS)
px_query("collinear_drop", lambda p: neighbours.collinear_drop(p.select((F.col("img_id") * 64 + F.col("y")).alias("img_id"), F.col("x").alias("i"), F.floor(F.col("r") / 64).alias("x"), F.floor(F.col("g") / 64).alias("y")), "img_id", "i"), """SELECT img_id, i, vx AS x, vy AS y FROM (SELECT *, coalesce(lag(vx) OVER w, last(vx) OVER f) AS ax, coalesce(lag(vy) OVER w, last(vy) OVER f) AS ay, coalesce(lead(vx) OVER w, first(vx) OVER f) AS bx, coalesce(lead(vy) OVER w, first(vy) OVER f) AS by1
  FROM (SELECT img_id * 64 + y AS img_id, x AS i, CAST(r // 64 AS BIGINT) AS vx, CAST(g // 64 AS BIGINT) AS vy FROM px) WINDOW w AS (PARTITION BY img_id ORDER BY i), f AS (PARTITION BY img_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE (vx - ax) * (by1 - vy) - (vy - ay) * (bx - vx) <> 0""")
HEX = "'#' || " + " || ".join(f"lpad(lower(hex({k})), 2, '0')" for k in "rgb")
px_query("color_parse", lambda p: p.select("img_id", "y", "x", convert.fill("r", "g", "b").alias("t")).withColumn("c", paths.parse_color(F.when(F.col("x") % 4 == 0, F.concat(F.substring("t", 1, 4))).when(F.col("x") % 4 == 1, F.concat(F.col("t"), F.lit("80"))).when(F.col("x") % 4 == 2, F.lit("none")).otherwise(F.col("t")))).select("img_id", "y", "x", "c.r", "c.g", "c.b", "c.a"), f"""SELECT img_id, y, x, CASE WHEN x % 4 = 2 THEN NULL WHEN x % 4 = 0 THEN CAST('0x' || t[2] || t[2] AS INTEGER) ELSE r END AS r, CASE WHEN x % 4 = 2 THEN NULL WHEN x % 4 = 0 THEN CAST('0x' || t[3] || t[3] AS INTEGER) ELSE g END AS g,
  CASE WHEN x % 4 = 2 THEN NULL WHEN x % 4 = 0 THEN CAST('0x' || t[4] || t[4] AS INTEGER) ELSE b END AS b, CASE x % 4 WHEN 2 THEN NULL WHEN 1 THEN round(128 / 255, 4) ELSE 1.0e0 END AS a FROM (SELECT *, {HEX} AS t FROM px)""")


def documents(px: DataFrame) -> DataFrame:
    """One document per image, an ellipse element per row."""
    e = ellipses(px)
    n = lambda c: F.col(c).cast("int").cast("string")
    el = F.concat(F.lit('<ellipse cx="'), n("cx"), F.lit('" cy="'), n("cy"), F.lit('" rx="'), n("rx"), F.lit('" ry="'), n("ry"), F.lit('"/>'))
    sizes = px.groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).withColumn("background", F.lit("#ffffff"))
    return sinks.emit_svg(e.select("img_id", "seq", el.alias("el")), sizes)


SVG = """body AS (SELECT img_id, string_agg('<ellipse cx="' || CAST(r % 64 AS VARCHAR) || '" cy="' || CAST(g % 64 AS VARCHAR) || '" rx="' || CAST(1 + b % 14 AS VARCHAR) || '" ry="' || CAST(1 + (r + b) % 14 AS VARCHAR) || '"/>', '' ORDER BY y) AS t FROM px WHERE x = 1 GROUP BY img_id),
 svgs AS (SELECT img_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || w || ' ' || h || '"><clipPath id="f"><path d="M0 0H' || w || 'V' || h || 'H0z"/></clipPath><g clip-path="url(#f)"><rect width="100%" height="100%" fill="#ffffff"/>' || t || '</g></svg>' AS svg
  FROM body JOIN (SELECT img_id, CAST(max(x) + 1 AS VARCHAR) AS w, CAST(max(y) + 1 AS VARCHAR) AS h FROM px GROUP BY img_id) USING (img_id))"""
px_query("svg_emit", documents, "SELECT * FROM svgs", SVG)
px_query("svg_inner", lambda p: documents(p).select("img_id", paths.svg_inner(F.col("svg")).alias("markup")), "SELECT img_id, regexp_extract(svg, '(?s)<svg[^>]*>(.*)</svg>', 1) AS markup FROM svgs", SVG)
px_query("svg_stats", lambda p: documents(p).select("img_id", *paths.svg_stats(F.col("svg"))), "SELECT img_id, CAST(len(regexp_extract_all(svg, '<(path|rect|circle|ellipse|polygon|g)[ >]')) AS BIGINT) AS elements, CAST(octet_length(encode(svg)) AS BIGINT) AS bytes FROM svgs", SVG)
COORDS = lambda p: p.select("img_id", "y", "x", F.concat(F.lit("M"), (F.col("r") / 7 - 18).cast("decimal(10,6)").cast("string"), F.lit(" "), (F.col("g") / 200).cast("decimal(10,4)").cast("string"), F.lit("L"), F.col("b").cast("string"), F.lit(".995Z")).alias("t"))
px_query("coord_round", lambda p: COORDS(p).select("img_id", "y", "x", paths.round_numbers(F.col("t")).alias("d")), """SELECT img_id, y, x, 'M' || list_extract(n, 1) || ' ' || list_extract(n, 2) || 'L' || list_extract(n, 3) || 'Z' AS d FROM (SELECT img_id, y, x, list_transform(v, lambda k: regexp_replace(
   CASE WHEN t2(k) = '-0' THEN '0' ELSE t2(k) END, '^(-?)0\\.', '\\1.')) AS n FROM (SELECT img_id, y, x, [CAST(round(CAST(r AS DOUBLE) / 7 - 18, 6) AS DECIMAL(18,6)), CAST(round(CAST(g AS DOUBLE) / 200, 4) AS DECIMAL(18,6)), CAST(b AS DECIMAL(18,6)) + 0.995] AS v FROM px))""".replace("t2(k)", "regexp_replace(regexp_replace(CAST(round(k, 2) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"))
px_query("def_dedupe", lambda p: _defs(p), "SELECT img_id, y, x, CAST(dense_rank() OVER (PARTITION BY img_id ORDER BY f) AS INTEGER) AS def FROM (SELECT img_id, y, x, min(y * 64 + x) OVER (PARTITION BY img_id, r // 12, g // 12, b // 12) AS f FROM px)")


def _defs(px: DataFrame) -> DataFrame:
    """Gradient definitions shared by quantized colour, numbered by first appearance."""
    key = [F.floor(F.col(k) / 12) for k in "rgb"]
    first = F.min(F.col("y") * 64 + F.col("x")).over(Window.partitionBy("img_id", *key))
    v = px.withColumn("_f", first)
    return v.select("img_id", "y", "x", F.dense_rank().over(Window.partitionBy("img_id").orderBy("_f")).alias("def"))


PATHS = ["M0 0L10 0L20 0L20 20L0 20Z", "M10 0C15.52 0 20 4.48 20 10C20 15.52 15.52 20 10 20C4.48 20 0 15.52 0 10C0 4.48 4.48 0 10 0Z", "M0 0h5v5h-5z", "M0 0A5 5 0 0 1 10 0"]
register("snap_primitives", lambda s, d: paths.snap_paths(table(s, d, "region").select(F.col("r_regionkey").alias("id"), F.get(F.array(*map(F.lit, PATHS)), F.col("r_regionkey") % 4).alias("d"))))


# ---------------------------------------------------------------- candidates, budgets, jobs
def presets(s: SparkSession) -> DataFrame:
    return s.createDataFrame(signals.PRESETS, signals.PRESET_SCHEMA)


PRESET = "presets(preset, speckle, precision, layer_step) AS (VALUES " + ", ".join(f"('{p[0]}', {p[1]}, {p[2]}, {p[3]})" for p in signals.PRESETS) + ")"
register("ladder", lambda s, d: convert.ladder(presets(s)), f"WITH {PRESET} SELECT preset, CAST(i AS INTEGER) AS rung, CAST(least(64, speckle * 2 ** i) AS INTEGER) AS speckle, CAST(least(128, floor(layer_step * 1.8e0 ** i + 0.5)) AS INTEGER) AS layer_step, CAST(greatest(3, precision - i) AS INTEGER) AS precision FROM presets, (SELECT unnest(range(0, 4)) AS i)")
WALK = "(0, 1.0e0, 0), " + ", ".join(f"({a}, {b}e0, {i + 1})" for i, (a, b) in enumerate(convert.LADDER_WALK))
register("predict_rung", lambda s, d: convert.predict_rung(table(s, d, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_partkey") * 7919 % 3000000).alias("raw_bytes"), F.lit(307200).cast("long").alias("max_bytes"))), f"SELECT p_partkey AS img_id, CAST(coalesce(min(CASE WHEN p_partkey * 7919 % 3000000 * 0.62e0 * 0.5e0 ** rung * res ** 2.2e0 <= 256000 THEN place END), 6) AS INTEGER) AS place FROM part, (VALUES {WALK}) w(rung, res, place) GROUP BY p_partkey")


def trials(s: SparkSession, d: str) -> DataFrame:
    """Measured results per image and configuration, from the line items of each order."""
    v = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("img_id"), F.col("l_linenumber").cast("int").alias("ord")).agg(F.sum("l_partkey").alias("k"), F.count("*").alias("ms"))
    return v.select("img_id", "ord", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("candidate"), ((F.col("k") % 997 + 3) / 40000).alias("score"), (1 + (F.col("k") % 3) / 100).alias("bias"), (2000 + F.col("k") * 31 % 9000).cast("long").alias("bytes"), "ms")


TRIALS = "trials AS (SELECT img_id, ord, 'c' || CAST(ord AS VARCHAR) AS candidate, (k % 997 + 3) / 40000 AS score, 1 + (k % 3) / 100 AS bias, CAST(2000 + k * 31 % 9000 AS BIGINT) AS bytes, ms FROM (SELECT l_orderkey AS img_id, CAST(l_linenumber AS INTEGER) AS ord, CAST(sum(l_partkey) AS BIGINT) AS k, count(*) AS ms FROM lineitem GROUP BY ALL))"
FOLD = "list_reduce(list_prepend(list_extract(rs, 1), rs), lambda best, r: CASE WHEN r.score * r.bias < best.score * best.bias THEN r ELSE best END)"
SMALL = "list_reduce(list_prepend(b0, rs), lambda best, r: CASE WHEN r.score <= best.score * 1.07e0 AND r.bytes * 3 <= best.bytes THEN r ELSE best END)"
CLEAR = "list_reduce(list_prepend(b1, rs), lambda best, r: CASE WHEN best.score <= 0.006e0 AND r.score <= 0.006e0 AND r.bytes * 1.3e0 <= best.bytes THEN r ELSE best END)"
register("pick_candidate", lambda s, d: convert.pick(trials(s, d)), f"WITH {TRIALS}, l AS (SELECT img_id, list({{'candidate': candidate, 'score': score, 'bias': bias, 'bytes': bytes}} ORDER BY ord) AS rs FROM trials GROUP BY img_id), a AS (SELECT *, {FOLD} AS b0 FROM l), b AS (SELECT *, {SMALL} AS b1 FROM a), c AS (SELECT img_id, {CLEAR} AS w FROM b) SELECT img_id, w.candidate AS candidate, w.score AS score, w.bytes AS bytes FROM c")
register("sweep_best", lambda s, d: trials(s, d).groupBy("img_id").agg(F.min_by("candidate", F.struct("score", "ord")).alias("candidate"), F.min("score").alias("score")), f"WITH {TRIALS} SELECT img_id, candidate, score FROM trials QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY score, ord) = 1")
register("bench_summary", lambda s, d: _summary(trials(s, d)), f"WITH {TRIALS} SELECT candidate, round(avg(score), 9) AS mean_score, round(quantile_cont(score, 0.5), 9) AS median_score, round(avg(bytes), 6) AS mean_bytes, round(avg(ms), 6) AS mean_ms, sum(CASE WHEN score = best THEN 1 ELSE 0 END)::BIGINT AS wins, round(avg(score * bytes / 1024), 9) AS score_kb FROM (SELECT *, min(score) OVER (PARTITION BY img_id) AS best FROM trials) GROUP BY candidate")
register("sweep_rank", lambda s, d: _summary(trials(s, d)).select("candidate", F.row_number().over(Window.orderBy("mean_score", "candidate")).alias("by_score"), F.row_number().over(Window.orderBy("score_kb", "candidate")).alias("by_bytes")), f"WITH {TRIALS}, s AS (SELECT candidate, round(avg(score), 9) AS m, round(avg(score * bytes / 1024), 9) AS k FROM trials GROUP BY candidate) SELECT candidate, CAST(row_number() OVER (ORDER BY m, candidate) AS INTEGER) AS by_score, CAST(row_number() OVER (ORDER BY k, candidate) AS INTEGER) AS by_bytes FROM s")
register("relative_gain", lambda s, d: trials(s, d).withColumn("best", F.min("score").over(Window.partitionBy("img_id"))).select("img_id", "candidate", F.round((F.col("score") - F.col("best")) / F.col("score"), 9).alias("gain")), f"WITH {TRIALS} SELECT img_id, candidate, round((score - min(score) OVER (PARTITION BY img_id)) / score, 9) AS gain FROM trials")


def _summary(t: DataFrame) -> DataFrame:
    v = t.withColumn("best", F.min("score").over(Window.partitionBy("img_id")))
    return v.groupBy("candidate").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.percentile("score", 0.5), 9).alias("median_score"), F.round(F.avg("bytes"), 6).alias("mean_bytes"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.count_if(F.col("score") == F.col("best")).alias("wins"), F.round(F.avg(F.col("score") * F.col("bytes") / 1024), 9).alias("score_kb"))


def progress(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    phase = F.get(F.array(*map(F.lit, jobs.PHASES)), (F.col("event_id") % 7).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), phase.alias("phase"), F.round("value", 6).alias("score"), (F.col("event_id") % 160).alias("i"), F.lit(160).alias("budget"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("run"), F.col("ts").cast("timestamp").alias("ts"))


PHASE = "list_extract(['" + "', '".join(jobs.PHASES) + "'], CAST(event_id % 7 AS INTEGER) + 1)"
PROG = f"prog AS (SELECT user_id AS job_id, event_id AS seq, {PHASE} AS phase, round(value, 6) AS score, event_id % 160 AS i, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS run, ts FROM events)"
register("progress_latest", lambda s, d: jobs.progress_latest(progress(s, d)), f"WITH {PROG} SELECT job_id, seq, phase, score, n FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM prog) WHERE k = 1")
register("throttle", lambda s, d: jobs.throttled(progress(s, d)).select("job_id", "seq", "phase", "preview"), f"""WITH RECURSIVE {PROG}, shown AS (SELECT * FROM prog WHERE phase <> 'refine' OR i % 10 = 0),
  own AS (SELECT job_id, seq, i, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM shown WHERE phase = 'refine' AND run = 'A'),
  walk AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(-1 AS BIGINT) AS seq, false AS kept FROM own UNION ALL
   SELECT o.job_id, o.k, CASE WHEN o.i - w.last >= 20 THEN o.i ELSE w.last END, o.seq, o.i - w.last >= 20 FROM walk w JOIN own o ON o.job_id = w.job_id AND o.k = w.k + 1)
  SELECT s.job_id, s.seq, s.phase, coalesce(w.kept, false) AS preview FROM shown s LEFT JOIN walk w ON w.job_id = s.job_id AND w.seq = s.seq""")
LINE = "j AS (SELECT user_id AS server, event_id AS job_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS t, 900 + event_id % 7 * 1200 AS work, CASE WHEN event_id % 4 = 0 THEN CAST(floor(epoch(ts) / 60) AS BIGINT) + event_id % 2500 END AS quits, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts) / 60) AS BIGINT), event_id) AS k FROM events)"
register("job_queue", lambda s, d: jobs.schedule(_arrivals(s, d), 20000), f"""WITH RECURSIVE {LINE}, run AS (
  SELECT DISTINCT server, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT), CAST(0 AS BIGINT)] AS free, CAST([] AS STRUCT(t BIGINT, started BIGINT, ended BIGINT)[]) AS live, CAST(NULL AS BIGINT) AS job_id, 0 AS status, 0 AS position, CAST(NULL AS BIGINT) AS started, CAST(NULL AS BIGINT) AS ended FROM j
  UNION ALL SELECT server, k, CASE WHEN full_ OR gone THEN free ELSE list_transform(free, lambda f, i: CASE WHEN i = list_position(free, list_min(free)) THEN ends ELSE f END) END, CASE WHEN full_ THEN kept ELSE list_append(kept, {{'t': t, 'started': begins, 'ended': ends}}) END, job_id,
   CASE WHEN full_ THEN 429 ELSE 200 END, CASE WHEN full_ THEN NULL WHEN begins > t THEN 1 + len(list_filter(kept, lambda x: x.started > t)) ELSE 0 END, CASE WHEN NOT full_ AND NOT gone THEN begins END, CASE WHEN NOT full_ THEN ends END FROM (
    SELECT *, len(kept) >= 16 AS full_, CASE WHEN gone THEN quits ELSE least(begins + work, CASE WHEN quits IS NOT NULL THEN greatest(quits, begins) END) END AS ends FROM (SELECT *, quits IS NOT NULL AND quits <= begins AND begins > t AS gone FROM (
     SELECT j.*, r.free, greatest(j.t, list_min(r.free)) AS begins, list_filter(r.live, lambda x: x.ended > j.t AND j.t - x.t <= 20000) AS kept FROM run r JOIN j ON j.server = r.server AND j.k = r.k + 1))))
  SELECT server, job_id, CAST(status AS INTEGER) AS status, CAST(position AS INTEGER) AS position, started, ended FROM run WHERE k > 0""")


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    """Every event as a job of its user's server, times in minutes."""
    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    return table(s, d, "events").select(F.col("user_id").alias("server"), F.col("event_id").alias("job_id"), t.alias("t"), (900 + F.col("event_id") % 7 * 1200).alias("work"), F.when(F.col("event_id") % 4 == 0, t + F.col("event_id") % 2500).alias("quits"))


def _bodies(s: SparkSession, d: str) -> DataFrame:
    """Request bodies: whole, without an image, with an empty one, and not JSON."""
    e = F.col("event_id") % 4
    image = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("props").cast("binary")))
    body = F.when(e == 0, F.to_json(F.struct(image.alias("image"), F.lit("high").alias("quality")))).when(e == 1, F.lit('{"quality": "draft"}')).when(e == 2, F.lit('{"image": "data:,", "saliency": true}')).otherwise(F.concat(F.lit("{"), F.col("props")))
    return table(s, d, "events").select("event_id", body.alias("body"))


register("job_request", lambda s, d: jobs.requests(_bodies(s, d)).select("event_id", "status", "quality", F.octet_length("data").cast("long").alias("bytes")), """SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 200 ELSE 400 END AS INTEGER) AS status, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'draft' ELSE 'balanced' END AS quality,
  CASE WHEN event_id % 4 = 0 THEN CAST(octet_length(encode(props)) AS BIGINT) END AS bytes FROM events""")
register("event_json", lambda s, d: jobs.event_json(progress(s, d).where("phase = 'refine'").select("job_id", "seq", "phase", "i", "budget", "run")), f"""WITH {PROG} SELECT job_id, seq, '{{"phase":"refine","i":' || CAST(i AS VARCHAR) || ',"budget":160,"run":"' || run || '"}}' AS data FROM prog WHERE phase = 'refine'""")
px_query("gaussian_draw", lambda p: p.select("img_id", "y", "x", (F.round(gaussian((F.col("r") + 1) / 257, F.col("g") / 256), 6) + 0.0).alias("v")), "SELECT img_id, y, x, round(sqrt(-2 * ln((r + 1) / 257)) * cos(2 * pi() * (g / 256)), 6) + 0.0e0 AS v FROM px")
px_query("segment_distance", lambda p: p.select("img_id", "y", "x", F.round(segment_distance(*(F.col(k).cast("double") for k in ("x", "y", "r", "g", "b", "r"))), 6).alias("v")), """SELECT img_id, y, x, round(sqrt((x - r - t * (b - r)) ** 2 + (y - g - t * (r - g)) ** 2), 6) AS v FROM (
  SELECT *, CASE WHEN (b - r) ** 2 + (r - g) ** 2 > 0 THEN least(1.0e0, greatest(0.0e0, ((x - r) * (b - r) + (y - g) * (r - g)) / ((b - r) ** 2 + (r - g) ** 2))) ELSE 0.0e0 END AS t FROM px)""")
register("job_stats", lambda s, d: jobs.stats(progress(s, d)), f"WITH {PROG}, l AS (SELECT phase FROM prog QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1) SELECT count(*) FILTER (phase IN ('analysis', 'trace', 'refine')) AS active, count(*) FILTER (phase IN ('open', 'queued')) AS queued, count(*) FILTER (phase IN ('done', 'error')) AS finished FROM l")
register("queue_depth", lambda s, d: jobs.queue_depth(table(s, d, "events").select(F.col("event_type").alias("server"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t0")).withColumn("t1", F.col("t0") + (F.col("event_id") % 300) * 1000000 + 1)), "WITH ev AS (SELECT event_type AS server, epoch_us(ts) AS t, 1 AS d FROM events UNION ALL SELECT event_type, epoch_us(ts) + event_id % 300 * 1000000 + 1, -1 FROM events), net AS (SELECT server, t, sum(d) AS d FROM ev GROUP BY ALL) SELECT server, t, CAST(sum(d) OVER (PARTITION BY server ORDER BY t) AS BIGINT) AS active FROM net")
register("job_submit", lambda s, d: jobs.validated(table(s, d, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "data:x;base64,!!").otherwise(F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("props").cast("binary")))).alias("payload"))).select("job_id", F.octet_length("data").cast("long").alias("bytes")), "SELECT event_id AS job_id, CAST(octet_length(encode(props)) AS BIGINT) AS bytes FROM events WHERE event_id % 5 >= 2 AND octet_length(encode(props)) > 0")
register("job_reap", lambda s, d: jobs.reap(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("created"), (F.col("event_id") % 3 == 0).alias("started")), "2024-01-02 00:00:00", 86400).select("event_id", "started"), "SELECT event_id, event_id % 3 = 0 AS started FROM events WHERE event_id % 3 = 0 OR CAST(epoch(TIMESTAMP '2024-01-02 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) <= 86400")
register("windowed_progress", lambda s, d: jobs.windowed_progress(progress(s, d)).select(F.unix_seconds("start").alias("start"), "phase", "n"), f"WITH {PROG} SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start, phase, count(*) AS n FROM prog GROUP BY ALL")
register("plateau_stop", lambda s, d: neighbours.plateau_stop(_history(s, d), "job_id", "step", "score", 8, 0.02), "WITH h AS (SELECT l_suppkey AS job_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS step, l_orderkey, l_linenumber, l_partkey FROM lineitem), s AS (SELECT job_id, CAST(step AS INTEGER) AS step, 1000 / (10 + step) AS score FROM h), l AS (SELECT *, lag(score, 8) OVER (PARTITION BY job_id ORDER BY step) AS was FROM s) SELECT job_id, min(step) AS stop_at FROM l WHERE was > 0 AND (was - score) / was < 0.02e0 GROUP BY job_id")


def _history(s: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("job_id"), step.alias("step")).withColumn("score", 1000 / (10 + F.col("step")))


register("stall_count", lambda s, d: neighbours.stall_count(table(s, d, "events").select("user_id", "event_id", (F.col("value") > 50).alias("accepted")), "user_id", "event_id", "accepted"), "WITH i AS (SELECT user_id, event_id, value > 50 AS accepted, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, event_id, accepted, CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, k ORDER BY event_id) AS BIGINT) AS stalls FROM i")
register("lcg", lambda s, d: table(s, d, "nation").select("n_nationkey", F.aggregate(F.sequence(F.lit(1), F.col("n_nationkey") + 1), F.col("n_nationkey").cast("long"), lambda acc, _: F.pmod(acc * 1664525 + 1013904223, F.lit(4294967296))).alias("state")), "SELECT n_nationkey, list_reduce(list_prepend(CAST(n_nationkey AS BIGINT), CAST(generate_series(1, n_nationkey + 1) AS BIGINT[])), lambda acc, x: (acc * 1664525 + 1013904223) % 4294967296) AS state FROM nation")
px_query("glyph_ink", lambda p: signals.ink_mask(p).groupBy("img_id").agg(F.count("*").alias("ink")), "SELECT img_id, count(*) AS ink FROM ink GROUP BY img_id", MODE)
px_query("palette_first", lambda p: palette.first_colors(p, 8), "SELECT * FROM pal", PAL)

# ---------------------------------------------------------------- overlays
px_query("overlay_fit", lambda p: overlay.fit_overlay(_with_disc(p)), None)


def _with_disc(px: DataFrame) -> DataFrame:
    """The images with a shaded disc in their middle."""
    inside = (F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 32) * (F.col("y") - 32) < 400
    shade = {"r": F.col("x") * 3 + 20, "g": F.col("x") * 2 + F.col("y"), "b": F.lit(60)}
    return px.withColumns({k: F.when(inside, v).otherwise(F.col(k)).cast("int") for k, v in shade.items()})


px_query("blob_dedupe", lambda p: overlay.dedupe_blobs(boxes(p).select("img_id", F.col("id").alias("comp"), ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).cast("long").alias("area"), "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))), None)
px_query("text_patches", lambda p: overlay.text_patches(p, boxes(p).withColumn("x1", F.col("x0") + 14).withColumn("y1", F.col("y0") + 12)), None, canvas=True)
px_query("tone_match", overlay.tone_match, "SELECT d.img_id, drift, b.dssim AS before, a.dssim AS after, drift >= 1 AND a.dssim <= 0.995e0 * b.dssim AS kept FROM (SELECT img_id, round(greatest(abs(avg(r) - avg(cr)), abs(avg(g) - avg(cg)), abs(avg(b) - avg(cb))), 6) AS drift FROM canvas GROUP BY img_id) d JOIN (SELECT img_id, round((1 - avg(s)) / 2, 6) AS dssim FROM ssim GROUP BY img_id) b USING (img_id) JOIN (SELECT img_id, round((1 - avg(s)) / 2, 6) AS dssim FROM ssim2 GROUP BY img_id) a USING (img_id)", TONE, DSSIM.format(keys="", source="canvas"),
  "mapped AS (SELECT img_id, y, x, r, g, b, " + ", ".join(f"CAST(least(255, greatest(0, floor(c{k} * max(CASE WHEN channel = '{k}' THEN gain END) + max(CASE WHEN channel = '{k}' THEN bias END) + 0.5))) AS INTEGER) AS c{k}" for k in "rgb") + " FROM canvas JOIN tone USING (img_id) GROUP BY img_id, y, x, r, g, b, cr, cg, cb)",
  DSSIM.format(keys="", source="mapped").replace("blocks", "blocks2").replace("ssim AS", "ssim2 AS"), canvas=True)
px_query("ellipse_fit", lambda p: overlay.ellipse_fits(points(p), "img_id"), None)
register("size_governor", lambda s, d: overlay.govern_size(_sizes(s, d).select("img_id", convert.first_place(F.col("raw_bytes"), F.col("max_bytes")).alias("place"), "max_bytes"), _measured(s, d), len(convert.LADDER_WALK)), f"WITH p AS (SELECT p_partkey AS img_id, CAST(coalesce(min(CASE WHEN p_partkey * 7919 % 3000000 * 0.62e0 * 0.5e0 ** rung * res ** 2.2e0 <= 256000 THEN place END), 6) AS INTEGER) AS f FROM part, (VALUES {WALK}) w(rung, res, place) GROUP BY p_partkey) SELECT img_id, CAST(coalesce(min(CASE WHEN k >= f AND img_id * 7919 % 3000000 // (k + 1) <= 307200 THEN k END), 6) AS INTEGER) AS place FROM p, (SELECT unnest(range(0, 7)) AS k) GROUP BY img_id")


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_partkey") * 7919 % 3000000).alias("raw_bytes"), F.lit(307200).cast("long").alias("max_bytes"))


def _measured(s: SparkSession, d: str) -> DataFrame:
    v = _sizes(s, d).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return v.select("img_id", "place", F.floor(F.col("raw_bytes") / (F.col("place") + 1)).alias("bytes"))


px_query("path_simplify", lambda p: paths.snap_paths(p.groupBy("img_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "r"))), lambda e: F.concat((e["x"] * 4).cast("string"), F.lit(" "), F.floor(e["r"] / 32).cast("string"))), "L").alias("t")).select((F.col("img_id") * 64 + F.col("y")).alias("id"), F.concat(F.lit("M"), "t").alias("d"))), None)
