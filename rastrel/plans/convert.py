"""Conversion of images to vector documents: analyze, plan, candidates, converge, pick, finish.

Candidates are rows, so the search runs one task per (image, candidate); ``operators.vectorize`` does the
work on one of them. Signals and text boxes are plans over pixels, all else travels as one packed row
per image. A score is the dissimilarity of the rendered document, so it always belongs to its markup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import palette, paths, segment, signals, text, vectorize
from ..operators.refine import KINDS
from ..operators.vectorize import LADDER_WALK
from ..session import cut, dealt, ship
from ..sources.pixels import pack_images


def ladder(presets: DataFrame, rungs: int = 4) -> DataFrame:
    """Preset rungs: coarser speckle, wider layers and lower precision at each."""
    v = presets.withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(rungs - 1))))
    return v.select("preset", "rung", F.least(F.lit(64), F.col("speckle") * F.pow(F.lit(2), F.col("rung"))).cast("int").alias("speckle"), F.least(F.lit(128), F.floor(F.col("layer_step") * F.pow(F.lit(1.8), F.col("rung")) + 0.5)).cast("int").alias("layer_step"), F.greatest(F.lit(3), F.col("precision") - F.col("rung")).cast("int").alias("precision"))


def first_place(raw_bytes: Column, max_bytes: Column) -> Column:
    """Place in the walk of the first rung predicted to fit, less 50 KiB of headroom; the last where none is.

    Minified bytes are about 0.62 of raw ones and fall by half a rung and with the 2.2th power of resolution.
    """
    walk = [(0, 1.0), *LADDER_WALK]
    fits = lambda rung, res: max_bytes.isNull() | (raw_bytes * 0.62 * F.pow(F.lit(0.5), F.lit(rung)) * F.pow(F.lit(res), F.lit(2.2)) <= max_bytes - 51200)
    return F.coalesce(*(F.when(fits(*w), F.lit(i)) for i, w in enumerate(walk)), F.lit(len(LADDER_WALK)))


def predict_rung(sizes: DataFrame) -> DataFrame:
    """sizes(img_id, raw_bytes, max_bytes) -> first rung of the walk predicted to fit."""
    return sizes.groupBy("img_id").agg(F.min(first_place(F.col("raw_bytes"), F.col("max_bytes"))).alias("place"))


def candidates(plans: DataFrame) -> DataFrame:
    """plans(img_id, type, quality, preset, smooth_share, texture, ...) -> one row per run to try, with its bias."""
    splat = F.col("use_splats") | ((F.col("type") == "illustration") & (F.col("smooth_share") >= 0.3) & (F.col("smooth_share") < 0.8))
    high = F.col("quality").isin("high", "max")
    c = lambda name, bias, when: F.when(when, F.struct(F.lit(name).alias("candidate"), F.lit(bias).alias("bias")))
    runs = F.array(c("base", 1.0, F.lit(True)), c("splat", 1 / 1.07, splat), c("alternate", 1 / 0.97, high & F.col("preset").isin("flat", "fine") & ~splat & (F.col("smooth_share") < 0.5)), c("layered", 1.0, high & ((F.col("preset") == "text") | ((F.col("type") == "illustration") & (F.col("smooth_share") < 0.8) & (F.col("texture") < 0.25)))), c("native", 1.0, (F.col("quality") == "max") & (F.col("type") == "text")))
    return plans.withColumn("_c", F.explode(F.filter(runs, lambda r: r.isNotNull()))).select("*", "_c.candidate", "_c.bias").drop("_c")


def pick(results: DataFrame) -> DataFrame:
    """results(img_id, ord, candidate, score, bias, bytes) -> the chosen one.

    Lowest biased score first (earlier wins ties). Then, in order, one within 7 % of the best at a third
    of its bytes replaces it; then, if the best is below 0.006, one below that at 1.3 times fewer bytes.
    Both later rules change the best as they go, so they are a fold over the image's few candidates.
    """
    rows = results.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("ord", "candidate", "score", "bias", "bytes"))).alias("rs"))
    first = F.aggregate("rs", F.get("rs", F.lit(0)), lambda best, r: F.when(r["score"] * r["bias"] < best["score"] * best["bias"], r).otherwise(best))
    small = F.aggregate("rs", F.col("b0"), lambda best, r: F.when((r["score"] <= best["score"] * 1.07) & (r["bytes"] * 3 <= best["bytes"]), r).otherwise(best))
    clear = F.aggregate("rs", F.col("b1"), lambda best, r: F.when((best["score"] <= 0.006) & (r["score"] <= 0.006) & (r["bytes"] * 1.3 <= best["bytes"]), r).otherwise(best))
    out = rows.withColumn("b0", first).withColumn("b1", small).withColumn("b2", clear)
    return out.select("img_id", F.col("b2.candidate").alias("candidate"), F.col("b2.score").alias("score"), F.col("b2.bytes").alias("bytes"))


def region_trace(px: DataFrame, step: int = 64, least: int = 9) -> DataFrame:
    """Base trace: quantize, components, merge small ones, loops around each: (img_id, comp, fill, area, path)."""
    q = palette.quantize(px, 256 // step)
    comps = segment.merge_small(segment.components(q.select("img_id", "y", "x", F.col("key").alias("label"))), least)
    color = comps.join(px, ["img_id", "y", "x"]).groupBy("img_id", "comp").agg(F.count("*").alias("area"), *(F.floor(F.avg(k) + 0.5).cast("int").alias(k) for k in "rgb"))
    loops = segment.trace_loops(segment.boundary_edges(comps))
    return color.join(path_text(loops, "comp"), ["img_id", "comp"]).select("img_id", "comp", fill("r", "g", "b").alias("fill"), "area", "path")


def preset_trace(px: DataFrame, preset: str, rung: int = 0) -> DataFrame:
    """Base trace by a named preset at a rung of its ladder: colour steps by layer step and precision, speckle squared merged."""
    p = coarser(PRESETS[preset], rung)
    return region_trace(px, 1 << max(0, max(p["layer_step"], 1 << (8 - p["precision"])).bit_length() - 1), p["speckle"] ** 2)


def coarser(preset: dict, rung: int) -> dict:
    return {**preset, "speckle": min(64, preset["speckle"] * 2**rung), "layer_step": min(128, int(preset["layer_step"] * 1.8**rung + 0.5)), "precision": max(3, preset["precision"] - rung)}


#: The tracer's part of each preset, by name.
PRESETS = {p[0]: {"speckle": p[1], "precision": p[2], "layer_step": p[3]} for p in signals.PRESETS}


def path_text(loops: DataFrame, key: str) -> DataFrame:
    """(img_id, key, path): a component's loops as one path."""
    point = lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))
    one = F.concat(F.lit("M"), F.array_join(F.transform("points", point), "L"), F.lit("Z"))
    rows = loops.select("img_id", F.col("comp").alias(key), "loop", one.alias("d"))
    return rows.groupBy("img_id", key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loop", "d"))), lambda e: e["d"]), "").alias("path"))


def fill(r: str, g: str, b: str) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.col(k))), 2, "0") for k in (r, g, b)))


def layer_trace(px: DataFrame, colors: int = 8, lloyd: int = 2) -> DataFrame:
    """Layered trace: median cut, memoized labels, recentring, mode filter, pruning, layers by size: (img_id, layer, fill, n, path)."""
    pal = palette.median_cut(px, colors).select("img_id", "c", "pr", "pg", "pb")
    labels = palette.assign_by_key(px, pal)
    for _ in range(lloyd):
        pal = palette.recentre(px, labels, pal)
        labels = palette.assign(px, pal)
    from ..operators.neighbours import mode_filter

    labels = mode_filter(labels)
    kept = palette.counts(labels).join(pal.withColumnRenamed("c", "label"), ["img_id", "label"])
    order = Window.partitionBy("img_id").orderBy(F.desc("n"), "label")
    layers = kept.withColumn("layer", F.row_number().over(order) - 1)
    edges = segment.boundary_edges(labels.join(kept.select("img_id", "label"), ["img_id", "label"], "left_semi").select("img_id", "y", "x", F.col("label").cast("long").alias("comp")))
    texts = path_text(segment.trace_loops(edges), "label").withColumn("label", F.col("label").cast("int"))
    return layers.join(texts, ["img_id", "label"]).select("img_id", F.col("layer").cast("int").alias("layer"), fill("pr", "pg", "pb").alias("fill"), "n", "path")


RESULT = "img_id long, candidate string, ord int, bias double, base string, base_score double, score double, rmse double, shapes int, bytes long, svg string, history array<struct<i:int,added:int,score:double,improved:boolean>>"
RUN_FIELDS = ("quality", "type", "preset", "alpha", "budget", "saliency", "smooth_share", "texture", "glyphs")


def run_plan(row: dict, overrides: dict) -> dict:
    """What one candidate does, from its plan row: the arguments of ``vectorize``. ``overrides`` replace any of them."""
    tier = {t[0]: t for t in signals.TIERS}[row["quality"]]
    kind, name, document = row["type"], row["candidate"], row["preset"] == "document"
    preset = {"flat": "fine", "fine": "flat"}.get(row["preset"], row["preset"]) if name == "alternate" else row["preset"]
    plateau = max(tier[5], 0.012 if document else 0.02) if kind == "text" else tier[5]
    out = {
        "preset": PRESETS[preset], "alpha": row["alpha"], "budget": row["budget"], "target": tier[4], "plateau": plateau, "saliency": row["saliency"],
        "kinds": ["rotated_rect"] if kind == "text" else ["rotated_ellipse"] if kind == "photo" else list(KINDS),
        # text keeps every byte: small letters must not be coarsened away
        "max_bytes": None if kind == "text" else tier[6],
        "snapping": kind in ("flat", "illustration") and name != "layered",
        "scale": 2 if kind == "text" and not document and name not in ("layered", "native") else 1,
        "layers": 48 if name == "layered" else 0,
        "splats": min(400, round(1.2 * row["budget"])) if name == "splat" else 0,
    }
    return {**out, **overrides}


def converge(runs: DataFrame, overrides: dict | None = None) -> DataFrame:
    """runs(img_id, width, height, data, weight, candidate, ord, bias and the fields of a plan) -> measured results.

    A group is one (image, candidate), but a splat run comes after its base run, whose result it takes over
    where it adopts no splats; ``weight`` is the caller's importance per pixel (doubles) or null.
    """
    overrides = overrides or {}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        found, done = [], []
        for row in sorted(t.to_pylist(), key=lambda r: r["ord"]):
            h, w = row["height"], row["width"]
            target = np.frombuffer(row["data"], np.uint8).reshape(h, w, 3).astype(np.float64)
            weight = np.frombuffer(row["weight"], "<f8").reshape(h, w) if row["weight"] else None
            plan = run_plan(row, overrides)
            plain = next((r for p, r in done if p == {**plan, "splats": 0}), None)
            r = vectorize.vectorize(target, row["img_id"], plan, weight, plain)
            done.append((plan, r))
            out = {k: row[k] for k in ("img_id", "candidate", "ord", "bias")}
            found.append(out | {"base": r.base, "base_score": r.base_score, "score": r.score, "rmse": r.rmse, "shapes": r.shapes, "bytes": len(r.svg.encode()), "svg": r.svg, "history": r.history})
        step = pa.struct([("i", pa.int32()), ("added", pa.int32()), ("score", pa.float64()), ("improved", pa.bool_())])
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string(), *[pa.float64()] * 3, pa.int32(), pa.int64(), pa.string(), pa.list_(step)]
        return pa.Table.from_pylist(found, schema=pa.schema(list(zip(found[0], kinds, strict=True))))

    ship(runs.sparkSession)
    line = runs.withColumn("line", F.when(F.col("candidate") == "splat", "base").otherwise(F.col("candidate")))
    return dealt(line, "img_id", "line").groupBy("img_id", "line").applyInArrow(run, RESULT)


def analysis_of(px: DataFrame, quality: str) -> DataFrame:
    """Signals, class and text probe of every image: one row each."""
    ink = signals.ink_mask(px)
    size = px.groupBy("img_id").agg(F.greatest(F.max("x"), F.max("y")).alias("side"))
    parts = segment.component_stats(segment.labelled(ink.select("img_id", "y", "x", F.lit(1).alias("label")))).join(size, "img_id")
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    glyph = F.col("area").between(3, 2200) & (w <= 0.09 * (F.col("side") + 1)) & (h <= 0.09 * (F.col("side") + 1))
    glyphs = parts.groupBy("img_id").agg(F.count_if(glyph).alias("glyphs"), F.sum("area").alias("inked"))
    v = signals.analyze(px).join(px.groupBy("img_id").agg(F.count("*").alias("n")), "img_id").join(glyphs, "img_id", "left")
    v = v.withColumn("glyphs", F.coalesce("glyphs", F.lit(0))).withColumn("quality", F.lit(quality))
    # many glyph-sized parts on one background read as text
    textish = (F.col("bg_frac") >= 0.4) & F.col("inked").between(F.col("n") * 0.01, F.col("n") * 0.45) & (F.col("glyphs") >= 45)
    return v.withColumn("type", F.when(textish, "text").otherwise(signals.class_rule()))


def convert(px: DataFrame, quality: str = "draft", budget: int | None = None, overrides: dict | None = None, weights: DataFrame | None = None) -> DataFrame:
    """px -> (img_id, type, candidate, base, base_score, score, shapes, bytes, svg, history): the whole conversion.

    ``overrides`` replace fields of every run's plan, ``weights`` (img_id, weight: doubles per pixel as
    bytes) the importance map. Scores are of the picked run; the finish only ever lowers them.
    """
    px = cut(px)
    packed = cut(pack_images(px))
    analysis = cut(analysis_of(px, quality))
    plans = signals.plan_rules(analysis).join(analysis.select("img_id", "smooth_share", "texture", "glyphs"), "img_id")
    place = F.row_number().over(Window.partitionBy("img_id").orderBy(F.col("candidate") != "base", "candidate"))
    runs = candidates(plans).select("img_id", "candidate", place.cast("int").alias("ord"), "bias", *RUN_FIELDS).join(packed, "img_id")
    weight = weights.select("img_id", "weight") if weights is not None else packed.select("img_id", F.lit(None).cast("binary").alias("weight")).limit(0)
    overrides = {**(overrides or {}), **({} if budget is None else {"budget": budget})}
    results = cut(converge(runs.join(weight, "img_id", "left"), overrides))
    chosen = results.join(pick(results).select("img_id", "candidate"), ["img_id", "candidate"]).join(analysis.select("img_id", "type", F.col("quality").alias("q")), "img_id")
    out = finish(chosen.drop("q"), packed, text.text_regions(px.join(analysis.where("type in ('photo', 'illustration')").select("img_id"), "img_id", "left_semi")))
    small = paths.minify(F.col("svg"))
    out = out.select("img_id", "type", "candidate", "base", F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"), "shapes", F.octet_length(small).cast("long").alias("bytes"), small.alias("svg"), "history")
    return out


FINISHED = "img_id long, type string, candidate string, base string, base_score double, score double, shapes int, svg string, history array<struct<i:int,added:int,score:double,improved:boolean>>"


def finish(chosen: DataFrame, packed: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text patches and tone match for photos and illustrations; a group is one image."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            target = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3).astype(np.float64)
            svg, score = row["svg"], row["score"]
            if row["type"] in ("photo", "illustration"):
                found = sorted(right.to_pylist(), key=lambda b: b["id"])
                tried = vectorize.tone_matched(target, vectorize.add_patches(target, svg, found, PRESETS["text"]))
                after = vectorize.dssim(target, vectorize.rasterize(tried))
                if after <= score:
                    svg, score = tried, after
            rows.append({**{k: row[k] for k in ("img_id", "type", "candidate", "base", "base_score")}, "score": score, "shapes": row["shapes"], "svg": svg, "history": row["history"]})
        step = pa.struct([("i", pa.int32()), ("added", pa.int32()), ("score", pa.float64()), ("improved", pa.bool_())])
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.list_(step)]
        return pa.Table.from_pylist(rows, schema=pa.schema([(f.split()[0], k) for f, k in zip(FINISHED.split(", "), kinds, strict=True)]))

    ship(chosen.sparkSession)
    left = dealt(chosen.join(packed, "img_id"), "img_id").groupBy("img_id")
    return left.cogroup(boxes.select("img_id", "id", "x0", "y0", "x1", "y1").groupBy("img_id")).applyInArrow(run, FINISHED)


def progress_json(results: DataFrame) -> DataFrame:
    """(img_id, event): every step of a conversion's search as the JSON text of a progress event."""
    v = results.select("img_id", F.size("history").alias("budget"), F.explode("history").alias("h"))
    event = F.struct(F.lit("refine").alias("phase"), (F.col("h.i") + 1).alias("i"), "budget", F.col("h.added").alias("added"), F.col("h.score").alias("score"), F.col("h.improved").alias("improved"))
    return v.select("img_id", F.to_json(event).alias("event"))
