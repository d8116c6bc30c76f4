"""Registered queries over pixels, metrics, signals, neighbourhoods and palettes, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pixels import luma
from ..operators import geometry, gradients, metrics, neighbours, palette, signals
from ..registry import register
from ..sources.pixels import SIDE, heatmap, pixels, solid, table, with_canvas
from .sql import SQ, sql


def px_query(name: str, f, body: str | None, *ctes: str, canvas: bool = False, recursive: bool = False) -> None:  # noqa: ANN001
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = pixels(spark, sf_dir)
        return f(with_canvas(px) if canvas else px)

    register(name, run, sql(body, *ctes, recursive=recursive) if body else None)


def boxes(px: DataFrame) -> DataFrame:
    """Deterministic boxes from the first pixel of each row."""
    b = px.where("x = 0").select("img_id", F.col("y").cast("long").alias("id"), (F.col("r") % 48).alias("x0"), (F.col("g") % 48).alias("y0"), "r", "b")
    return b.select("img_id", "id", "x0", "y0", (F.col("x0") + 1 + F.col("b") % 12).alias("x1"), (F.col("y0") + 1 + F.floor(F.col("r") / 3).cast("int") % 10).alias("y1"))


BOXES = """boxes AS (SELECT img_id, CAST(y AS BIGINT) AS id, r % 48 AS x0, g % 48 AS y0,
  r % 48 + 1 + b % 12 AS x1, g % 48 + 1 + (r // 3) % 10 AS y1 FROM px WHERE x = 0)"""


def wh(px: DataFrame) -> DataFrame:
    return boxes(px).select("img_id", F.col("x0").alias("bx"), F.col("y0").alias("by0"), (F.col("x1") - F.col("x0") + 9).alias("bw"), (F.col("y1") - F.col("y0") + 9).alias("bh"))


WH = "wh AS (SELECT img_id, x0 AS bx, y0 AS by0, x1 - x0 + 9 AS bw, y1 - y0 + 9 AS bh FROM boxes)"

# ---------------------------------------------------------------- scans and geometry
px_query("scan_pixels", lambda p: p, "SELECT * FROM px")
px_query("image_dims", geometry.dims, "SELECT img_id, max(x) + 1 AS width, max(y) + 1 AS height FROM px GROUP BY img_id")
px_query("crop_box", lambda p: geometry.crop(p, 10, 20, 30, 25), "SELECT img_id, y - 20 AS y, x - 10 AS x, r, g, b FROM px WHERE x BETWEEN 10 AND 39 AND y BETWEEN 20 AND 44")
px_query("nearest_upscale", lambda p: geometry.upscale(p, 2), "SELECT img_id, CAST(y * 2 + j AS INTEGER) AS y, CAST(x * 2 + i AS INTEGER) AS x, r, g, b FROM px, (SELECT unnest(range(0, 2)) AS j), (SELECT unnest(range(0, 2)) AS i)")
px_query("nearest_resample", lambda p: geometry.resample(p, 40, 24), """SELECT p.img_id, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, r, g, b FROM (
  SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id) d, (SELECT unnest(range(0, 40)) AS ox), (SELECT unnest(range(0, 24)) AS oy), px p
  WHERE p.img_id = d.img_id AND p.x = ox * w // 40 AND p.y = oy * h // 24""")
px_query("vstack", lambda p: geometry.vstack(p, 4, (10, 20, 30)), """SELECT CAST(0 AS BIGINT) AS img_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x,
  coalesce(r, 10) AS r, coalesce(g, 20) AS g, coalesce(b, 30) AS b
  FROM (SELECT unnest(range(0, (SELECT CAST(max(w) AS BIGINT) FROM t))) AS gx), (SELECT unnest(range(0, (SELECT CAST(max(h) AS BIGINT) FROM t))) AS gy)
  LEFT JOIN (SELECT p.x, p.y + s.l AS y, r, g, b FROM px p JOIN s USING (img_id)) m ON m.x = gx AND m.y = gy""",
  "d AS (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id)",
  "s AS (SELECT img_id, w, h, coalesce(sum(h + 4) OVER (ORDER BY img_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM d)",
  "t AS (SELECT max(w) AS w, max(l + h) AS h FROM s)")
px_query("hstack", lambda p: geometry.hstack(p, 4, (10, 20, 30)), """SELECT CAST(0 AS BIGINT) AS img_id, CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x,
  coalesce(r, 10) AS r, coalesce(g, 20) AS g, coalesce(b, 30) AS b
  FROM (SELECT unnest(range(0, (SELECT CAST(max(w) AS BIGINT) FROM t))) AS gx), (SELECT unnest(range(0, (SELECT CAST(max(h) AS BIGINT) FROM t))) AS gy)
  LEFT JOIN (SELECT p.y, p.x + s.l AS x, r, g, b FROM px p JOIN s USING (img_id)) m ON m.x = gx AND m.y = gy""",
  "d AS (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id)",
  "s AS (SELECT img_id, w, h, coalesce(sum(w + 4) OVER (ORDER BY img_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM d)",
  "t AS (SELECT max(l + w) AS w, max(h) AS h FROM s)")
px_query("draw_boxes", lambda p: geometry.draw_boxes(p, wh(p), (255, 0, 0), 2), """SELECT p.img_id, p.y, p.x, CASE WHEN o THEN 255 ELSE r END AS r, CASE WHEN o THEN 0 ELSE g END AS g, CASE WHEN o THEN 0 ELSE b END AS b
  FROM (SELECT p.*, EXISTS (SELECT 1 FROM wh w WHERE w.img_id = p.img_id AND p.x BETWEEN bx AND bx + bw - 1 AND p.y BETWEEN by0 AND by0 + bh - 1
    AND (p.x - bx < 2 OR bx + bw - 1 - p.x < 2 OR p.y - by0 < 2 OR by0 + bh - 1 - p.y < 2)) AS o FROM px p) p""", BOXES, WH)
register("solid_image", lambda s, d: solid(s, 7, 20, 10, (1, 2, 3)), "SELECT CAST(7 AS BIGINT) AS img_id, CAST(i // 20 AS INTEGER) AS y, CAST(i % 20 AS INTEGER) AS x, 1 AS r, 2 AS g, 3 AS b FROM (SELECT unnest(range(0, 200)) AS i)")
HEAT = """SELECT CAST(0 AS BIGINT) AS img_id, y, x, CAST(n * 7 % 256 AS INTEGER) AS r, CAST(q % 256 AS INTEGER) AS g, CAST(k * 3 % 256 AS INTEGER) AS b FROM (
  SELECT CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, sum(l_linenumber) AS k FROM lineitem GROUP BY ALL)"""
register("heatmap_scan", lambda s, d: heatmap(table(s, d, "lineitem")), HEAT)
register("heatmap_error_map", lambda s, d: metrics.error_map(with_canvas(heatmap(table(s, d, "lineitem")))), f"""WITH h AS ({HEAT}), c AS (SELECT *, r // 64 * 64 + 32 AS cr, g // 64 * 64 + 32 AS cg, b // 64 * 64 + 32 AS cb FROM h)
  SELECT img_id, CAST(y // 16 AS INTEGER) AS r, CAST(x // 16 AS INTEGER) AS c, CAST(x // 16 * 16 AS INTEGER) AS x, CAST(y // 16 * 16 AS INTEGER) AS y,
  max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum({SQ}) AS BIGINT) AS err, count(*) AS area FROM c GROUP BY img_id, y // 16, x // 16""")
px_query("decode_base64", lambda p: _decode(p), """SELECT img_id, y, CAST(octet_length(from_base64(s)) AS BIGINT) AS bytes, upper(hex(from_base64(s))) AS hexed FROM (
  SELECT img_id, y, to_base64(encode(string_agg(CAST(r AS VARCHAR), ',' ORDER BY x))) AS s FROM px GROUP BY img_id, y)""")


def _decode(p: DataFrame) -> DataFrame:
    from ..sources.pixels import decode_data_url

    row = p.groupBy("img_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "r"))), lambda e: e["r"].cast("string")), ",").alias("t"))
    url = row.select("img_id", "y", F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("t").cast("binary"))).alias("u"))
    return url.select("img_id", "y", decode_data_url(F.col("u")).alias("d")).select("img_id", "y", F.octet_length("d").cast("long").alias("bytes"), F.hex("d").alias("hexed"))


# ---------------------------------------------------------------- metrics
px_query("rmse", metrics.rmse, f"SELECT img_id, round(sqrt(sum({SQ}) / (3 * count(*))) / 255, 9) AS rmse FROM canvas GROUP BY img_id", canvas=True)
px_query("avg_color", metrics.avg_color, "SELECT img_id, CAST(floor(avg(r) + 0.5) AS BIGINT) AS r, CAST(floor(avg(g) + 0.5) AS BIGINT) AS g, CAST(floor(avg(b) + 0.5) AS BIGINT) AS b FROM px GROUP BY img_id")
CELLS = f"""cells AS (SELECT img_id, CAST(y // 16 AS INTEGER) AS r, CAST(x // 16 AS INTEGER) AS c, CAST(x // 16 * 16 AS INTEGER) AS x, CAST(y // 16 * 16 AS INTEGER) AS y,
  max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum({SQ}) AS BIGINT) AS err, count(*) AS area FROM canvas GROUP BY img_id, y // 16, x // 16)"""
px_query("error_map", metrics.error_map, "SELECT * FROM cells", CELLS, canvas=True)
px_query("topk_cells", lambda p: metrics.topk_cells(metrics.error_map(p)), "SELECT *, CAST(row_number() OVER (PARTITION BY img_id ORDER BY err DESC, r, c) AS INTEGER) AS rank FROM cells QUALIFY rank <= 6", CELLS, canvas=True)
DSSIM = """blocks AS (SELECT img_id, {keys} count(*) AS n, sum(a) AS sa, sum(e) AS se, sum(a * a) AS saa, sum(e * e) AS see, sum(a * e) AS sae FROM (
  SELECT *, CAST((77 * r + 150 * g + 29 * b + 128) // 256 AS BIGINT) AS a, CAST((77 * cr + 150 * cg + 29 * cb + 128) // 256 AS BIGINT) AS e FROM {source}) GROUP BY img_id, {keys} y // 11, x // 11),
 ssim AS (SELECT img_id, {keys} (2 * (sa / n) * (se / n) + 6.5025e0) * (2 * (sae / n - (sa / n) * (se / n)) + 58.5225e0)
   / (((sa / n) * (sa / n) + (se / n) * (se / n) + 6.5025e0) * ((saa / n - (sa / n) * (sa / n)) + (see / n - (se / n) * (se / n)) + 58.5225e0)) AS s FROM blocks)"""
px_query("block_dssim", metrics.block_dssim, "SELECT img_id, round((1 - avg(s)) / 2, 6) AS dssim FROM ssim GROUP BY img_id", DSSIM.format(keys="", source="canvas"), canvas=True)
px_query("edge_band_error", metrics.edge_band_error, """SELECT img_id, round(sum(abs(r - cr) + abs(g - cg) + abs(b - cb)) / (3 * count(*)), 6) AS band_error
  FROM canvas JOIN (SELECT img_id, max(x) AS w, max(y) AS h FROM px GROUP BY img_id) USING (img_id) WHERE x < 3 OR y < 3 OR w - x < 3 OR h - y < 3 GROUP BY img_id""", canvas=True)
px_query("subject_score", metrics.subject_score, f"""SELECT img_id, round(sqrt(sum(CASE WHEN i THEN {SQ} END) / (3 * sum(CASE WHEN i THEN 1 END))) / 255, 9) AS subject, round(sqrt(sum({SQ}) / (3 * count(*))) / 255, 9) AS frame
  FROM (SELECT *, x >= floor(w * 0.53e0 / 2) AND x < floor(w * 0.53e0 / 2) + floor(w * 0.47e0) AND y >= floor(h * 0.53e0 / 2) AND y < floor(h * 0.53e0 / 2) + floor(h * 0.47e0) AS i
  FROM canvas JOIN (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img_id) USING (img_id)) GROUP BY img_id""", canvas=True)
px_query("box_dssim", lambda p: metrics.box_dssim(p, wh(p)), """SELECT img_id, round(sum(d * bw * bh) / sum(bw * bh), 6) AS box_dssim FROM (
  SELECT img_id, bx, by0, bw, bh, round((1 - avg(s)) / 2, 6) AS d FROM ssim GROUP BY img_id, bx, by0, bw, bh) GROUP BY img_id""", BOXES, WH,
  "inside AS (SELECT c.img_id, bx, by0, bw, bh, c.y - by0 AS y, c.x - bx AS x, r, g, b, cr, cg, cb FROM canvas c JOIN wh w ON w.img_id = c.img_id AND bw >= 8 AND bh >= 8 AND c.x >= bx AND c.x < bx + bw AND c.y >= by0 AND c.y < by0 + bh)",
  DSSIM.format(keys="bx, by0, bw, bh,", source="inside"), canvas=True)

# ---------------------------------------------------------------- signals
px_query("luma", lambda p: p.select("img_id", "y", "x", luma().alias("luma")), "SELECT img_id, y, x, l AS luma FROM luma")
px_query("quantize_lattice", lambda p: palette.quantize(p, 4), "SELECT img_id, y, x, cr AS r, cg AS g, cb AS b, CAST(cr * 65536 + cg * 256 + cb AS BIGINT) AS key FROM canvas")
px_query("distinct_colors", signals.distinct_colors, "SELECT img_id, count(DISTINCT (r // 16) * 256 + (g // 16) * 16 + b // 16) AS colors FROM px GROUP BY img_id")
MODE = """hist AS (SELECT img_id, CAST(l // 16000 AS INTEGER) AS bucket, count(*) AS n FROM luma GROUP BY ALL),
 modes AS (SELECT img_id, bucket AS mode, sum(n) OVER (PARTITION BY img_id) AS total, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, bucket) AS k FROM hist QUALIFY k = 1),
 bg AS (SELECT img_id, mode, round(sum(n) / max(total), 6) AS bg_frac FROM hist JOIN modes USING (img_id) WHERE abs(bucket - mode) <= 1 GROUP BY img_id, mode),
 ink AS (SELECT img_id, y, x FROM luma JOIN bg USING (img_id) WHERE abs(l - (mode * 16000 + 8000)) > 45000)"""
px_query("luma_mode", signals.luma_mode, "SELECT * FROM bg", MODE)
px_query("ink_mask", signals.ink_mask, "SELECT * FROM ink", MODE)
GRAD = """grad AS (SELECT img_id, y, x, l, abs(lead(l) OVER h - lag(l) OVER h) + abs(lead(l) OVER v - lag(l) OVER v) AS g FROM luma
  WINDOW h AS (PARTITION BY img_id, y ORDER BY x), v AS (PARTITION BY img_id, x ORDER BY y)),
 stats AS (SELECT img_id, round(sum(CASE WHEN g > 40000 THEN 1 ELSE 0 END) / count(*), 6) AS edge, round(sum(CASE WHEN g > 12000 AND g <= 40000 THEN 1 ELSE 0 END) / count(*), 6) AS texture,
  round(sum(CASE WHEN g > 1500 AND g <= 12000 THEN 1 ELSE 0 END) / count(*), 6) AS smooth_share, round(1 - least(1.0e0, sum(g) / count(*) / 40000), 6) AS smoothness FROM grad WHERE g IS NOT NULL GROUP BY img_id)"""
px_query("edge_stats", signals.edge_stats, "SELECT * FROM stats", GRAD)
RUNS = """isl AS (SELECT *, x - row_number() OVER (PARTITION BY img_id, y ORDER BY x) AS hi, y - row_number() OVER (PARTITION BY img_id, x ORDER BY y) AS vi FROM ink),
 runs AS (SELECT img_id, y, x, count(*) OVER (PARTITION BY img_id, y, hi) AS h, count(*) OVER (PARTITION BY img_id, x, vi) AS v FROM isl)"""
px_query("run_length", lambda p: signals.run_length(signals.ink_mask(p)), "SELECT img_id, y, x, h AS run FROM runs", MODE, RUNS)
THIN = "thin AS (SELECT img_id, count(*) AS ink, round(sum(CASE WHEN least(h, v) <= 3 THEN 1 ELSE 0 END) / count(*), 6) AS thin_frac FROM runs GROUP BY img_id)"
px_query("thin_share", lambda p: signals.thin_share(signals.ink_mask(p)), "SELECT * FROM thin", MODE, RUNS, THIN)
ANALYSIS = """colors AS (SELECT img_id, count(DISTINCT (r // 16) * 256 + (g // 16) * 16 + b // 16) AS colors FROM px GROUP BY img_id),
 analysis AS (SELECT * FROM colors JOIN bg USING (img_id) JOIN stats USING (img_id) LEFT JOIN thin USING (img_id)),
 classed AS (SELECT *, CASE WHEN edge >= 0.15e0 AND edge < 0.42e0 AND colors <= 200 AND bg_frac >= 0.4e0 THEN 'text' WHEN smooth_share >= 0.5e0 AND texture >= 0.04e0 THEN 'photo'
  WHEN colors <= 24 AND edge < 0.18e0 THEN 'flat' WHEN colors <= 400 AND edge < 0.32e0 THEN 'illustration' ELSE 'photo' END AS type FROM analysis)"""
px_query("analyze", signals.analyze, "SELECT * FROM analysis", MODE, RUNS, THIN, GRAD, ANALYSIS)
px_query("classify", lambda p: signals.analyze(p).select("img_id", signals.class_rule().alias("type")), "SELECT img_id, type FROM classed", MODE, RUNS, THIN, GRAD, ANALYSIS)
PLAN = """plans AS (SELECT img_id, type, quality, CASE type WHEN 'text' THEN CASE WHEN glyphs > 800 THEN 'document' ELSE 'text' END WHEN 'photo' THEN 'poster' ELSE 'flat' END AS preset,
  CAST(CASE WHEN type = 'text' THEN 0.9 WHEN type = 'photo' THEN CASE WHEN quality IN ('draft', 'balanced') THEN 0.55 ELSE 0.45 END WHEN type = 'flat' THEN 0.92 ELSE 0.8 END AS DOUBLE) AS alpha,
  CAST(CASE WHEN type = 'text' THEN least(budget, CASE WHEN quality = 'max' THEN 200 WHEN quality = 'high' AND NOT glyphs > 800 THEN 120 ELSE 50 END)
    WHEN type = 'photo' THEN floor(budget * 1.4e0 + 0.5) ELSE budget END AS BIGINT) AS budget,
  CAST(CASE WHEN type = 'text' THEN CASE WHEN glyphs > 800 THEN least(trace_res, 1200) ELSE greatest(trace_res, 1300) END ELSE trace_res END AS INTEGER) AS trace_res,
  type <> 'flat' AS saliency, type = 'photo' AS use_splats FROM asked JOIN (VALUES ('draft', 700, 60), ('balanced', 1000, 160), ('high', 1400, 320), ('max', 2000, 600)) t(quality, trace_res, budget) USING (quality)),
 dummy AS (SELECT 1)"""
ASKED = """asked AS (SELECT CAST(p_partkey AS BIGINT) AS img_id, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'photo' WHEN 2 THEN 'flat' ELSE 'illustration' END AS type,
  CASE p_size % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'balanced' WHEN 2 THEN 'high' ELSE 'max' END AS quality, CAST(p_partkey * 37 % 1600 AS INTEGER) AS glyphs, (p_partkey * 13 % 100) / 100 AS smooth_share, (p_partkey * 29 % 50) / 100 AS texture FROM part)"""


def asked(s: SparkSession, d: str) -> DataFrame:
    """Analysis rows of every class and tier, from the part table."""
    k, z = F.col("p_partkey"), F.col("p_size")
    pick = lambda v, names: F.element_at(F.array(*map(F.lit, names)), (v % 4 + 1).cast("int"))
    return table(s, d, "part").select(k.alias("img_id"), pick(k, ["text", "photo", "flat", "illustration"]).alias("type"), pick(z, ["draft", "balanced", "high", "max"]).alias("quality"), (k * 37 % 1600).cast("int").alias("glyphs"), ((k * 13 % 100) / 100).alias("smooth_share"), ((k * 29 % 50) / 100).alias("texture"))


register("plan_rules", lambda s, d: signals.plan_rules(asked(s, d)), sql("SELECT * FROM plans", ASKED, PLAN))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    from .convert import candidates

    a = asked(s, d)
    return candidates(signals.plan_rules(a).join(a.select("img_id", "smooth_share", "texture"), "img_id")).select("img_id", "candidate", F.round("bias", 9).alias("bias"))


register("candidates", _candidates, sql("""SELECT img_id, candidate, round(bias, 9) AS bias FROM (SELECT p.*, a.smooth_share, a.texture,
  use_splats OR (p.type = 'illustration' AND a.smooth_share >= 0.3e0 AND a.smooth_share < 0.8e0) AS sp, p.quality IN ('high', 'max') AS hi FROM plans p JOIN asked a USING (img_id)),
  (VALUES ('base', 1.0e0), ('splat', 1 / 1.07e0), ('alternate', 1 / 0.97e0), ('layered', 1.0e0), ('native', 1.0e0)) c(candidate, bias)
  WHERE candidate = 'base' OR (candidate = 'splat' AND sp) OR (candidate = 'alternate' AND hi AND preset IN ('flat', 'fine') AND NOT sp AND smooth_share < 0.5e0)
   OR (candidate = 'layered' AND hi AND (preset = 'text' OR (type = 'illustration' AND smooth_share < 0.8e0 AND texture < 0.25e0))) OR (candidate = 'native' AND quality = 'max' AND type = 'text')""", ASKED, PLAN))

# ---------------------------------------------------------------- neighbourhoods
NEAR = """near AS (SELECT *, abs(r - lag(r) OVER h) + abs(g - lag(g) OVER h) + abs(b - lag(b) OVER h) AS n0, abs(r - lead(r) OVER h) + abs(g - lead(g) OVER h) + abs(b - lead(b) OVER h) AS n1,
  abs(r - lag(r) OVER v) + abs(g - lag(g) OVER v) + abs(b - lag(b) OVER v) AS n2, abs(r - lead(r) OVER v) + abs(g - lead(g) OVER v) + abs(b - lead(b) OVER v) AS n3 FROM px
  WINDOW h AS (PARTITION BY img_id, y ORDER BY x), v AS (PARTITION BY img_id, x ORDER BY y)),
 lg AS (SELECT img_id, y, x, CAST(coalesce(n0, 0) + coalesce(n1, 0) + coalesce(n2, 0) + coalesce(n3, 0) AS BIGINT) AS total,
  CAST((n0 IS NOT NULL)::INT + (n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT AS INTEGER) AS cnt FROM near)"""
px_query("local_gradient", neighbours.local_gradient, "SELECT * FROM lg", NEAR)


def boxed(value: str, source: str, name: str) -> str:
    return f"""{name}_h AS (SELECT *, sum({value}) OVER w AS s_, count({value}) OVER w AS n_ FROM {source} WINDOW w AS (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 {name} AS (SELECT img_id, y, x, sum(s_) OVER w AS total, sum(n_) OVER w AS cnt FROM {name}_h WINDOW w AS (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


px_query("box_blur", neighbours.box_blur, "SELECT img_id, y, x, round(total / cnt, 6) AS blur FROM bl", boxed("l", "luma", "bl"))
SMOOTH = ["g36 AS (SELECT img_id, y, x, CAST(total * (12 // cnt) AS BIGINT) AS g36 FROM lg)", boxed("g36", "g36", "sm"), "smooth AS (SELECT img_id, y, x FROM sm WHERE total <= 60 * 36 * cnt)"]
px_query("smooth_mask", lambda p: neighbours.smooth_mask(p, 60), "SELECT * FROM smooth", NEAR, *SMOOTH)
px_query("bright_mask", lambda p: neighbours.bright_mask(p, 60), """SELECT img_id, y, x FROM (SELECT img_id, y, x, l, min(l) OVER (PARTITION BY img_id) AS lo, max(l) OVER (PARTITION BY img_id) AS hi FROM luma JOIN smooth USING (img_id, y, x))
  WHERE hi - lo > 60000 AND (l - lo) * 100 >= (hi - lo) * 72""", NEAR, *SMOOTH)
px_query("smooth_weight", neighbours.smooth_weight, """SELECT img_id, y, x, round(0.02e0 + 0.98e0 * w * w, 6) AS weight FROM (
  SELECT a.img_id, a.y, a.x, greatest(0.0e0, 1 - sqrt(greatest(0.0e0, (sum(c.l * c.l) - sum(c.l) * sum(c.l) / count(*)) / count(*))) / 25000) AS w
  FROM luma a JOIN luma c ON c.img_id = a.img_id AND c.y - a.y IN (-2, 0, 2) AND c.x - a.x IN (-2, 0, 2) GROUP BY a.img_id, a.y, a.x)""")
px_query("mode_filter", lambda p: neighbours.mode_filter(palette.quantize(p, 2).select("img_id", "y", "x", F.col("key").alias("label"))), """SELECT q.img_id, q.y, q.x, CASE WHEN v.second IS NULL OR v.second < v.top THEN CASE WHEN own.n <= 3 THEN v.label ELSE q.label END ELSE q.label END AS label
  FROM q JOIN votes own ON own.img_id = q.img_id AND own.y = q.y AND own.x = q.x AND own.label = q.label
  JOIN (SELECT img_id, y, x, label, n AS top, lead(n) OVER w AS second, row_number() OVER w AS k FROM votes WINDOW w AS (PARTITION BY img_id, y, x ORDER BY n DESC, label) QUALIFY k = 1) v ON v.img_id = q.img_id AND v.y = q.y AND v.x = q.x""",
  "q AS (SELECT img_id, y, x, CAST((r // 128 * 128 + 64) * 65536 + (g // 128 * 128 + 64) * 256 + b // 128 * 128 + 64 AS BIGINT) AS label FROM px)",
  # each pixel votes at its nine neighbours' places: one equi-join instead of a range join
  "cast_ AS (SELECT img_id, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, label FROM q, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx))",
  "votes AS (SELECT c.img_id, c.y, c.x, c.label, count(*) AS n FROM cast_ c JOIN px USING (img_id, y, x) GROUP BY c.img_id, c.y, c.x, c.label)")
Q4 = "q AS (SELECT img_id, y, x, CAST(cr * 65536 + cg * 256 + cb AS BIGINT) AS label FROM canvas)"
px_query("adjacency", lambda p: neighbours.adjacency(palette.quantize(p, 4).select("img_id", "y", "x", F.col("key").alias("label"))), """SELECT a.img_id, least(a.label, c.label) AS a, greatest(a.label, c.label) AS b, count(*) AS n FROM q a JOIN q c ON c.img_id = a.img_id
  AND ((c.x = a.x + 1 AND c.y = a.y) OR (c.y = a.y + 1 AND c.x = a.x)) WHERE a.label <> c.label GROUP BY ALL""", Q4)


AROUND = "(SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)"


def spread_sql(source: str) -> str:
    """Places of the nine neighbours of every pixel of a mask, as often as they are reached."""
    return f"SELECT img_id, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM {source}, {AROUND}"


def morph(name: str, f, found: str, below: int = 170) -> None:  # noqa: ANN001
    """Morphology on the mask of dark-red pixels."""
    px_query(name, lambda p: f(p.where(F.col("r") < below).select("img_id", "y", "x"), p), f"SELECT img_id, y, x FROM px SEMI JOIN {found} USING (img_id, y, x)", f"m AS (SELECT img_id, y, x FROM px WHERE r < {below})",
             f"grown AS (SELECT DISTINCT * FROM ({spread_sql('m')}) g SEMI JOIN px USING (img_id, y, x))",
             # a pixel stays if all nine places around it are in the mask; outside the image counts as not
             f"er AS (SELECT img_id, y, x FROM ({spread_sql('m')}) SEMI JOIN m USING (img_id, y, x) GROUP BY img_id, y, x HAVING count(*) = 9)",
             f"opened AS (SELECT DISTINCT * FROM ({spread_sql('er')}))",
             f"closed AS (SELECT img_id, y, x FROM ({spread_sql('grown')}) SEMI JOIN grown USING (img_id, y, x) GROUP BY img_id, y, x HAVING count(*) = 9)",
             "crossed AS (SELECT DISTINCT m.img_id, m.y + dy AS y, m.x + dx AS x FROM m, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx))")


morph("morph_erode", neighbours.erode, "er")
morph("morph_dilate", neighbours.dilate, "grown")
morph("morph_open", neighbours.morph_open, "opened")
morph("mask_dilate", neighbours.dilate_cross, "crossed")
morph("morph_close", neighbours.morph_close, "closed", 100)

# ---------------------------------------------------------------- palettes
PAL = """pal AS (SELECT img_id, CAST(k - 1 AS INTEGER) AS c, pr, pg, pb FROM (SELECT img_id, cr * 65536 + cg * 256 + cb AS key, cr AS pr, cg AS pg, cb AS pb, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, cr * 65536 + cg * 256 + cb) AS k
  FROM canvas GROUP BY img_id, cr, cg, cb) WHERE k <= 8)"""
ASSIGN = "asg AS (SELECT img_id, y, x, arg_min(c, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 1000 + c) AS label FROM px JOIN pal USING (img_id) GROUP BY img_id, y, x)"
px_query("palette_assign", lambda p: palette.assign(p, palette.first_colors(p, 8)), "SELECT * FROM asg", PAL, ASSIGN)
px_query("palette_counts", lambda p: palette.counts(palette.assign(p, palette.first_colors(p, 8))), "SELECT img_id, label, n FROM (SELECT img_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY img_id) AS t FROM asg GROUP BY img_id, label) WHERE n >= greatest(9, floor(t * 0.0002e0 + 0.5))", PAL, ASSIGN)
px_query("palette_memo", lambda p: palette.assign_by_key(p, palette.first_colors(p, 8)), """SELECT p.img_id, p.y, p.x, k.label FROM px p JOIN (SELECT img_id, key, arg_min(c, ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) * 1000 + c) AS label FROM f JOIN pal USING (img_id) GROUP BY img_id, key) k
  ON k.img_id = p.img_id AND k.key = (p.r // 8) * 1024 + (p.g // 8) * 32 + p.b // 8""", PAL,
  "f AS (SELECT img_id, (r // 8) * 1024 + (g // 8) * 32 + b // 8 AS key, r, g, b FROM px QUALIFY row_number() OVER (PARTITION BY img_id, (r // 8) * 1024 + (g // 8) * 32 + b // 8 ORDER BY y, x) = 1)")
px_query("palette_lloyd", lambda p: palette.recentre(p, palette.assign(p, palette.first_colors(p, 8)), palette.first_colors(p, 8)), """SELECT l.img_id, l.c, CAST(coalesce(floor(mr + 0.5), pr) AS INTEGER) AS pr, CAST(coalesce(floor(mg + 0.5), pg) AS INTEGER) AS pg, CAST(coalesce(floor(mb + 0.5), pb) AS INTEGER) AS pb
  FROM pal l LEFT JOIN (SELECT img_id, label AS c, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px JOIN asg USING (img_id, y, x) GROUP BY img_id, label) m USING (img_id, c)""", PAL, ASSIGN)
px_query("layer_order", lambda p: palette.counts(palette.assign(p, palette.first_colors(p, 8))).withColumn("layer", F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("n"), "label"))), """SELECT img_id, label, n, CAST(row_number() OVER (PARTITION BY img_id ORDER BY n DESC, label) AS INTEGER) AS layer FROM (
  SELECT img_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY img_id) AS t FROM asg GROUP BY img_id, label) WHERE n >= greatest(9, floor(t * 0.0002e0 + 0.5))""", PAL, ASSIGN)
px_query("median_cut", lambda p: palette.median_cut(p, 8), None)
px_query("median_cut_first", palette.first_split, """SELECT *, n * greatest(range_r, range_g, range_b) AS priority FROM (SELECT img_id, count(*) AS n, max(r) - min(r) AS range_r, max(g) - min(g) AS range_g, max(b) - min(b) AS range_b,
  CASE WHEN max(r) - min(r) = greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) THEN 'r' WHEN max(g) - min(g) = greatest(max(g) - min(g), max(b) - min(b)) THEN 'g' ELSE 'b' END AS channel FROM px GROUP BY img_id)""")
TONE = "tone AS (" + " UNION ALL ".join(f"SELECT img_id, '{k}' AS channel, round(least(1.25e0, greatest(0.8e0, regr_slope({k}, c{k}))), 6) AS gain, round(least(25.0e0, greatest(-25.0e0, regr_intercept({k}, c{k}))), 6) AS bias, round(stddev_pop({k}) / nullif(stddev_pop(c{k}), 0), 6) AS moment_gain FROM canvas GROUP BY img_id" for k in "rgb") + ")"
px_query("tone_fit", palette.tone_fit, "SELECT * FROM tone", TONE, canvas=True)
px_query("tone_apply", lambda p: palette.tone_apply(p.select("img_id", "y", "x", F.col("cr").alias("r"), F.col("cg").alias("g"), F.col("cb").alias("b")), palette.tone_fit(p)), "SELECT img_id, y, x, " + ", ".join(f"CAST(least(255, greatest(0, floor(c{k} * max(CASE WHEN channel = '{k}' THEN gain END) + max(CASE WHEN channel = '{k}' THEN bias END) + 0.5))) AS INTEGER) AS {k}" for k in "rgb") + " FROM canvas JOIN tone USING (img_id) GROUP BY img_id, y, x, cr, cg, cb", TONE, canvas=True)

# ---------------------------------------------------------------- gradients
px_query("weighted_centroid", gradients.weighted_centroid, """SELECT img_id, round(sum(x * w) / nullif(sum(w), 0), 6) AS light_x, round(sum(y * w) / nullif(sum(w), 0), 6) AS light_y, round(sum(x * d) / nullif(sum(d), 0), 6) AS dark_x, round(sum(y * d) / nullif(sum(d), 0), 6) AS dark_y
  FROM (SELECT img_id, x, y, (l // 1000) * (l // 1000) AS w, (255 - l // 1000) * (255 - l // 1000) AS d FROM luma) GROUP BY img_id""")
px_query("ellipse_moments", lambda p: gradients.ellipse_moments(p.where("r < 100"), ("img_id",)), """SELECT img_id, round(sx / n, 6) AS cx, round(sy / n, 6) AS cy, round(2.12e0 * sqrt(greatest(0.0e0, m + g)), 6) AS ra, round(2.12e0 * sqrt(greatest(0.0e0, m - g)), 6) AS rb, round(atan2(2 * xy, xx - yy) / 2, 6) AS theta FROM (
  SELECT *, (xx + yy) / 2 AS m, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS g FROM (SELECT *, (sxx * n - sx * sx) / (n * n) AS xx, (syy * n - sy * sy) / (n * n) AS yy, (sxy * n - sx * sy) / (n * n) AS xy FROM (
   SELECT img_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM px WHERE r < 100 GROUP BY img_id)))""")
px_query("gradient_profile", lambda p: gradients.profile(p, "y", 16), "SELECT img_id, CAST(y * 16 // n AS INTEGER) AS bin, round(avg(r), 6) AS mr, round(avg(g), 6) AS mg, round(avg(b), 6) AS mb FROM px JOIN (SELECT img_id, max(y) + 1 AS n FROM px GROUP BY img_id) USING (img_id) GROUP BY img_id, y * 16 // n")
SSE = "sum(qr - sr * sr / n + qg - sg * sg / n + qb - sb * sb / n)"
BINNED = "SELECT img_id, cand, bin, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r) AS qr, sum(g * g) AS qg, sum(b * b) AS qb"
CANDS = ", ".join(f"({i}, {co!r}::DOUBLE, {si!r}::DOUBLE)" for i, co, si in gradients.angles(12))
px_query("gradient_fit", gradients.fit_linear, f"""SELECT img_id, CAST(cand AS INTEGER) AS cand, sse, n FROM (SELECT img_id, cand, round({SSE}, 3) AS sse, CAST(sum(n) AS BIGINT) AS n FROM ({BINNED} FROM (
   SELECT img_id, cand, r, g, b, CASE WHEN hi - lo > 1e-9 THEN floor(round((u - lo) / (hi - lo) * 47, 9)) ELSE 0 END AS bin FROM (SELECT img_id, cand, r, g, b, x * co + y * si AS u, least(x0 * co, x1 * co) + y0 * si AS lo, greatest(x0 * co, x1 * co) + y1 * si AS hi
   FROM px JOIN (SELECT img_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY img_id) USING (img_id), (VALUES {CANDS}) t(cand, co, si))) GROUP BY img_id, cand, bin) GROUP BY img_id, cand) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY sse, cand) = 1""")


def radial_sql(source: str, keys: str, grid: int, bins: int, first: int = 0) -> list[str]:
    """The steps of the radial search over ``source``: boxes with centroids, centres, bins, errors in ``radial``."""
    w, d = "(l // 1000) * (l // 1000)", "(255 - l // 1000) * (255 - l // 1000)"
    mean = lambda v, w: f"round(sum({v} * {w}) / nullif(sum({w}), 0), 6)"
    return [f"rbox AS (SELECT {keys}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, {mean('x', w)} AS lx, {mean('y', w)} AS ly, {mean('x', d)} AS dx, {mean('y', d)} AS dy FROM (SELECT *, r * 299 + g * 587 + b * 114 AS l FROM {source}) GROUP BY {keys})",
            f"centres AS (SELECT {keys}, x0, x1, y0, y1, 0 AS cand, lx AS cx, ly AS cy FROM rbox UNION ALL SELECT {keys}, x0, x1, y0, y1, 1, dx, dy FROM rbox UNION ALL SELECT {keys}, x0, x1, y0, y1, 2 + j * {grid} + i, x0 + (x1 - x0 + 1) * i / {grid - 1}, y0 + (y1 - y0 + 1) * j / {grid - 1} FROM rbox, (SELECT unnest(range(0, {grid})) AS i), (SELECT unnest(range(0, {grid})) AS j))",
            f"rbins AS (SELECT {keys}, cand + {first} AS cand, r, g, b, least({bins - 1}, floor(round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / greatest(sqrt(greatest(abs(x0 - cx), abs(x1 - cx)) ** 2 + greatest(abs(y0 - cy), abs(y1 - cy)) ** 2), 1e-9) * {bins - 1}, 9))) AS bin FROM {source} JOIN centres USING ({keys}) WHERE cx IS NOT NULL)",
            f"radial AS (SELECT {keys}, cand, round({SSE}, 3) AS sse, sum(n) AS n FROM (SELECT {keys}, cand, bin, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r) AS qr, sum(g * g) AS qg, sum(b * b) AS qb FROM rbins GROUP BY ALL) GROUP BY {keys}, cand)"]


def linear_sql(source: str, keys: str, n: int, bins: int) -> str:
    """Errors of the directions in ``linear``."""
    cands = ", ".join(f"({i}, {co!r}::DOUBLE, {si!r}::DOUBLE)" for i, co, si in gradients.angles(n))
    return f"""linear AS (SELECT {keys}, cand, round({SSE}, 3) AS sse, sum(n) AS n FROM (SELECT {keys}, cand, bin, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, sum(r * r) AS qr, sum(g * g) AS qg, sum(b * b) AS qb FROM (
   SELECT {keys}, cand, r, g, b, CASE WHEN hi - lo > 1e-9 THEN floor(round((u - lo) / (hi - lo) * {bins - 1}, 9)) ELSE 0 END AS bin FROM (SELECT {keys}, cand, r, g, b, x * co + y * si AS u, least(x0 * co, x1 * co) + y0 * si AS lo, greatest(x0 * co, x1 * co) + y1 * si AS hi
   FROM {source} JOIN (SELECT {keys}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {source} GROUP BY {keys}) USING ({keys}), (VALUES {cands}) t(cand, co, si))) GROUP BY ALL) GROUP BY {keys}, cand)"""


px_query("radial_fit", gradients.fit_radial, "SELECT img_id, CAST(cand AS INTEGER) AS cand, sse, CAST(n AS BIGINT) AS n FROM radial QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY sse, cand) = 1", *radial_sql("px", "img_id", 5, 48))
px_query("gradient_model", gradients.gradient_model, """SELECT img_id, CASE WHEN radial THEN 'radial' ELSE 'linear' END AS kind, CAST(cand AS INTEGER) AS cand, round(sqrt(greatest(0.0e0, sse) / (3 * n)) / 255, 6) AS rmse FROM (
  SELECT *, false AS radial FROM linear UNION ALL SELECT *, true FROM radial) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY sse, radial, cand) = 1""", linear_sql("px", "img_id", 12, 48), *radial_sql("px", "img_id", 5, 48))


def _bins(p: DataFrame) -> DataFrame:
    """One profile of 64 bins per image row (img_id is the row's number), some bins empty."""
    return p.select((F.col("img_id") * 64 + F.col("y")).alias("img_id"), F.col("x").alias("bin"), F.when(F.col("r") % 3 != 0, F.col("g")).alias("v"))


BINS = "bins AS (SELECT img_id * 64 + y AS img_id, x AS bin, CASE WHEN r % 3 <> 0 THEN g END AS v FROM px)"
FILLED = "filled AS (SELECT img_id, bin, v, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY img_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY img_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM bins)"
px_query("profile_fill", lambda p: neighbours.fill_profile(_bins(p), "img_id", "bin", "v"), "SELECT * FROM filled", BINS, FILLED)
px_query("profile_stops", lambda p: neighbours.profile_stops(neighbours.fill_profile(_bins(p), "img_id", "bin", "v"), "img_id", "bin", "filled", 64, 12), """SELECT g.img_id, CAST(stop AS INTEGER) AS stop, round(filled + (coalesce(nx, filled) - filled) * (t - b), 6) AS v FROM (
  SELECT img_id, stop, stop * 63 / 11 AS t, CAST(floor(stop * 63 / 11) AS INTEGER) AS b FROM (SELECT DISTINCT img_id FROM bins), (SELECT unnest(range(0, 12)) AS stop)) g
  JOIN (SELECT *, lead(filled) OVER (PARTITION BY img_id ORDER BY bin) AS nx FROM filled) f ON f.img_id = g.img_id AND f.bin = g.b""", BINS, FILLED)
px_query("gradient_render", lambda p: gradients.render(p.select("img_id").distinct(), p.select("img_id", "y", "x"), gradients.profile(p, "y", 16), 16), """SELECT t.img_id, t.y, t.x, """ + ", ".join(f"CAST(least(255, greatest(0, round_even(a.m{k} + (c.m{k} - a.m{k}) * (t.t - t.b), 0))) AS INTEGER) AS {k}" for k in "rgb") + """
  FROM (SELECT img_id, y, x, y * 15 / greatest(1, n - 1) AS t, CAST(floor(y * 15 / greatest(1, n - 1)) AS INTEGER) AS b FROM px JOIN (SELECT img_id, max(y) + 1 AS n FROM px GROUP BY img_id) USING (img_id)) t
  JOIN prof a ON a.img_id = t.img_id AND a.bin = t.b JOIN prof c ON c.img_id = t.img_id AND c.bin = least(t.b + 1, 15)""",
  "prof AS (SELECT img_id, CAST(y * 16 // n AS INTEGER) AS bin, round(avg(r), 6) AS mr, round(avg(g), 6) AS mg, round(avg(b), 6) AS mb FROM px JOIN (SELECT img_id, max(y) + 1 AS n FROM px GROUP BY img_id) USING (img_id) GROUP BY img_id, y * 16 // n)")
register("resize", lambda s, d: _resized(s, d), sql("SELECT img_id, CAST(floor(y * 0.5) AS INTEGER) AS y, CAST(floor(x * 0.5) AS INTEGER) AS x, CAST(floor(avg(r) + 0.5) AS INTEGER) AS r, CAST(floor(avg(g) + 0.5) AS INTEGER) AS g, CAST(floor(avg(b) + 0.5) AS INTEGER) AS b FROM px GROUP BY img_id, floor(y * 0.5), floor(x * 0.5)"))


def _resized(s: SparkSession, d: str) -> DataFrame:
    from ..sources.pixels import resize

    return resize(pixels(s, d), SIDE // 2)
