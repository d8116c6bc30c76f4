"""Kernels and properties of the raster engine."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastrel.operators import geometry, metrics, neighbours, palette, paths, raster, refine, render, segment, text, vectorize
from rastrel.plans import convert
from rastrel.sources import sinks
from rastrel.sources.pixels import decode_images, fit_inside, pack_images, solid, unpack_images, with_canvas
from rastrel.streaming import jobs

PX = "img_id long, y int, x int, r int, g int, b int"


def image(spark, array, img_id=0):
    h, w, _ = array.shape
    return spark.createDataFrame([(img_id, y, x, *map(int, array[y, x])) for y in range(h) for x in range(w)], PX)


def canvas_of(target):
    return refine.Canvas(target.astype(float), np.zeros(target.shape), np.ones(target.shape[:2]))


# ---------------------------------------------------------------- search
@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from(refine.KINDS), st.floats(0.2, 1.0))
def test_incremental_error_equals_full(seed, kind, alpha):
    rng = np.random.default_rng(seed)
    c = canvas_of(rng.integers(0, 256, (40, 40, 3)))
    p = refine.random_shape(rng, kind, (5, 5, 30, 30))
    e = c.evaluate(kind, p, alpha, np.inf, np.inf)
    if e:
        c.commit(kind, p, e[1], alpha, e[0])
        assert abs(c.error - c.full()) <= 1e-9 * max(1.0, c.full())


def test_exact_colour_is_recovered():
    target = np.full((20, 20, 3), (200, 100, 50))
    e = canvas_of(target).evaluate("rotated_rect", np.array([10.0, 10, 10, 10, 0]), 1.0, np.inf, np.inf)
    assert e[1].tolist() == [200, 100, 50] and abs(e[0]) < 1e-6


def test_steps_never_raise_the_error_and_repeat():
    target = np.full((48, 48, 3), 20)
    target[12:36, 12:36] = (220, 60, 40)
    a, b = canvas_of(target), canvas_of(target)
    last, first = a.score(), a.score()
    for i in range(8):
        refine.step(a, refine.Options(), i, 3)
        refine.step(b, refine.Options(), i, 3)
        assert a.score() <= last
        last = a.score()
    assert last < first and a.shapes == b.shapes
    thin = refine.prune(a, np.zeros(target.shape))
    assert len(thin.shapes) <= len(a.shapes) and thin.score() <= 1.2 * a.score()


def test_splats_lower_the_error():
    y, x = np.mgrid[0:32, 0:32]
    target = np.stack([255 * np.exp(-((x - 16) ** 2 + (y - 16) ** 2) / 60)] * 3, 2)
    c = canvas_of(target)
    before = c.score()
    refine.splat_fit(c, 1, budget=6, tries=16, age=15)
    assert c.score() < 0.7 * before and abs(c.error - c.full()) < 1e-6 * c.full() + 1e-6


# ---------------------------------------------------------------- paths
def test_path_grammar_and_snapping():
    assert paths.parse_path("M0 0A5 5 0 0 1 10 0") is None and paths.parse_path("L1 1") is None
    sub = paths.parse_path("m1 2h3v4l-3-4z m5 5c1 0 1 1 0 1")
    assert [len(s["segs"]) for s in sub] == [3, 1] and sub[0]["closed"] and sub[1]["start"] == (6.0, 7.0)
    k = 5.5228
    circle = f"M20 10C20 {10 + k} {10 + k} 20 10 20C{10 - k} 20 0 {10 + k} 0 10C0 {10 - k} {10 - k} 0 10 0C{10 + k} 0 20 {10 - k} 20 10Z"
    kind, p = paths.snap(circle)
    assert kind == "circle" and np.allclose(p, [10, 10, 10], atol=0.05)
    assert paths.snap("M0 0L20 0L20 20L0 20Z") is None
    t = np.linspace(0, 2 * np.pi, 60)[:-1]
    e = paths.fit_ellipse(np.stack([30 + 12 * np.cos(t), 40 + 5 * np.sin(t)], 1))
    assert np.allclose(e[:4], [30, 40, 12, 5], atol=1e-6)


def test_line_merge_keeps_corners():
    line = np.array([[0, 0], [5, 0], [10, 0], [10, 5], [10, 10]], float)
    assert paths.merge_lines(line, 0.1).tolist() == [[0, 0], [10, 0], [10, 10]]
    assert [paths.number(v) for v in (1.0, 2.50, -0.001, 3.14159)] == ["1", "2.5", "0", "3.14"]


# ---------------------------------------------------------------- regions
def flood(label):
    out, n = np.full(label.shape, -1), 0
    for y in range(label.shape[0]):
        for x in range(label.shape[1]):
            if out[y, x] < 0:
                stack = [(y, x)]
                out[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < label.shape[0] and 0 <= d < label.shape[1] and out[c, d] < 0 and label[c, d] == label[a, b]:
                            out[c, d] = n
                            stack.append((c, d))
                n += 1
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 999))
def test_components_equal_flood_fill(h, w, seed):
    label = np.random.default_rng(seed).integers(0, 2, (h, w))
    y, x = np.mgrid[0:h, 0:w]
    order = np.random.default_rng(seed + 1).permutation(h * w)
    got = segment.label_runs(y.ravel()[order], x.ravel()[order], label.ravel()[order])
    assert (got == flood(label).ravel()[order]).all()


def test_merge_and_trace(spark):
    a = np.zeros((12, 12, 3), int)
    a[3:9, 3:9] = 200
    a[5, 5] = 90
    px = image(spark, a)
    labels = px.select("img_id", "y", "x", F.col("r").alias("label"))
    merged = segment.merge_small(segment.components(labels), 4)
    assert merged.select("comp").distinct().count() == 2
    loops = segment.trace_loops(segment.boundary_edges(merged)).orderBy("comp", "loop").collect()
    assert [len(r["points"]) for r in loops] == [4, 4, 4]
    areas = lambda p: abs(sum(u["x"] * v["y"] - v["x"] * u["y"] for u, v in zip(p, p[1:] + p[:1]))) / 2
    assert sorted(areas(r["points"]) for r in loops) == [36, 36, 144]
    tiles = segment.tiled_components(labels, 5).groupBy("comp").count().collect()
    assert sorted(r["count"] for r in tiles) == [1, 35, 108]


# ---------------------------------------------------------------- filters and palettes
def test_upscale_invents_no_colours_and_bars_survive(spark):
    a = np.array([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (255, 255, 0)]])
    up = geometry.upscale(image(spark, a), 2)
    assert up.count() == 16 and up.select("r", "g", "b").distinct().count() == 4
    bars = np.repeat(np.array([(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 255, 255)]), 4, 0)[None].repeat(8, 0)
    pal = palette.median_cut(image(spark, bars), 6).collect()
    assert {(r["pr"], r["pg"], r["pb"]) for r in pal} == {tuple(map(int, c)) for c in bars[0, ::4]}


def test_identical_images_have_no_error(spark):
    px = image(spark, np.random.default_rng(1).integers(0, 256, (24, 24, 3)))
    same = px.withColumns({f"c{k}": F.col(k) for k in "rgb"})
    assert metrics.rmse(same).first()["rmse"] == 0 and metrics.block_dssim(same).first()["dssim"] == 0
    worst = metrics.topk_cells(metrics.error_map(same.withColumn("cr", F.when((F.col("x") >= 16) & (F.col("y") >= 16), 0).otherwise(F.col("r"))), 8), 1).first()
    assert (worst["x"], worst["y"]) == (16, 16)


def test_opening_drops_specks_and_keeps_blocks(spark):
    a = np.zeros((12, 12, 3), int)
    a[2:8, 2:8] = 1
    a[10, 10] = 1
    px = image(spark, a)
    out = neighbours.morph_open(px.where("r = 1").select("img_id", "y", "x"), px)
    assert out.count() == 36 and not out.where("x = 10").count()


# ---------------------------------------------------------------- shapes
def test_polygon_and_ellipse_areas_and_clipping(spark):
    square = spark.createDataFrame([(0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(2, 2), (8, 2), (8, 8), (2, 8)])], "img_id long, seq int, i int, x double, y double")
    assert raster.run_stats(raster.polygon_runs(square, 16, 16)).first()["area"] == 36
    big = square.withColumn("x", (F.col("x") - 5) * 50).withColumn("y", (F.col("y") - 5) * 50)
    s = raster.run_stats(raster.polygon_runs(big, 32, 32)).first()
    assert (s["x0"], s["xm"], s["y0"], s["ym"], s["area"]) == (0, 31, 0, 31, 1024)
    e = spark.createDataFrame([(0, 0, 50.0, 50.0, 30.0, 20.0), (0, 1, 5.0, 5.0, 0.4, 3.0)], "img_id long, seq int, cx double, cy double, rx double, ry double")
    r = raster.run_stats(raster.ellipse_runs(e, 100, 100)).collect()
    assert len(r) == 1 and abs(r[0]["area"] - np.pi * 600) < 0.08 * np.pi * 600


def test_optimal_colour_and_delta(spark):
    px = with_canvas(image(spark, np.full((20, 20, 3), (201, 99, 3))), 1)
    runs = spark.createDataFrame([(0, 0, y, 3, 12) for y in range(3, 13)], "img_id long, seq int, y int, x1 int, x2 int")
    color = raster.optimal_color(px, runs, 1.0)
    assert tuple(color.first())[2:] == (201, 99, 3)
    score = raster.delta_score(px, runs, color, 1.0).first()["score"]
    full = px.withColumns({f"c{k}": F.when(F.col("x").between(3, 12) & F.col("y").between(3, 12), F.col(k)).otherwise(F.col(f"c{k}")) for k in "rgb"})
    assert abs(score - metrics.rmse(full).first()["rmse"]) < 1e-9


# ---------------------------------------------------------------- sources, sinks, documents
def test_png_round_trip_through_the_image_source(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 256, (9, 14, 3))
    px = image(spark, a)
    row = sinks.encode_png(pack_images(px)).first()
    (tmp_path / "one.png").write_bytes(row["png"])
    back = decode_images(spark, str(tmp_path)).withColumn("img_id", F.lit(0).cast("long"))
    assert sorted(map(tuple, unpack_images(back).collect())) == sorted(map(tuple, px.collect()))
    assert solid(spark, 1, 4, 3, (9, 8, 7)).count() == 12


def test_merged_boxes_do_not_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 60, (2, 25)), *rng.integers(1, 14, (2, 25))))]
    out = [r.asDict() for r in text.merge_boxes(spark.createDataFrame(rows, "img_id long, id long, x0 int, y0 int, x1 int, y1 int")).collect()]
    for i, a in enumerate(out):
        for b in out[:i]:
            assert not (a["x0"] <= b["x1"] and b["x0"] <= a["x1"] and a["y0"] <= b["y1"] and b["y0"] <= a["y1"])
    assert all(any(o["x0"] <= r[2] and o["x1"] >= r[4] and o["y0"] <= r[3] and o["y1"] >= r[5] for o in out) for r in rows)


def test_pick_follows_its_three_rules(spark):
    rows = [(1, 0, "a", 0.05, 1.0, 9000), (1, 1, "b", 0.049, 1.1, 9000), (2, 0, "a", 0.050, 1.0, 9000), (2, 1, "b", 0.053, 1.0, 2900), (3, 0, "a", 0.004, 1.0, 9000), (3, 1, "b", 0.0059, 1.0, 6000), (4, 0, "a", 0.05, 1.0, 9000), (4, 1, "b", 0.06, 1.0, 10)]
    got = convert.pick(spark.createDataFrame(rows, "img_id long, ord int, candidate string, score double, bias double, bytes long"))
    assert {r["img_id"]: r["candidate"] for r in got.collect()} == {1: "a", 2: "b", 3: "b", 4: "a"}


def test_conversion_is_no_worse_than_its_base(spark):
    a = np.full((32, 32, 3), 240)
    a[6:20, 6:20] = (200, 30, 30)
    a[16:28, 14:30] = (30, 60, 200)
    out = convert.convert(image(spark, a), "draft", budget=4).collect()
    assert len(out) == 1 and out[0]["score"] <= out[0]["base_score"]
    assert out[0]["svg"].startswith("<svg ") and out[0]["svg"].count("<svg") == 1 and out[0]["svg"].endswith("</svg>")


def drawing():
    """A flat drawing, a shaded disc on it, and a smooth field: (name, pixels)."""
    y, x = np.mgrid[:64, :64]
    flat = np.zeros((64, 64, 3)) + (250, 250, 245)
    flat[(x - 20) ** 2 + (y - 24) ** 2 < 150] = (200, 30, 40)
    flat[40:56, 30:60] = (20, 90, 200)
    disc = flat.copy()
    inside = (x - 32) ** 2 + (y - 32) ** 2 < 400
    field = np.stack([x * 3 + 20, y * 2 + 30, x + y + 10], 2).astype(float)
    disc[inside] = field[inside]
    return {"flat": flat, "disc": disc, "field": field}


@pytest.mark.parametrize("name", ["flat", "disc", "field"])
@pytest.mark.parametrize("candidate", ["base", "splat", "layered"])
def test_scores_belong_to_their_documents(name, candidate):
    target = np.floor(drawing()[name])
    row = {"quality": "draft", "type": "flat" if name == "flat" else "illustration", "candidate": candidate, "preset": "flat", "alpha": 0.8, "budget": 24, "saliency": name != "flat"}
    r = vectorize.vectorize(target, 1, convert.run_plan(row, {}))
    assert abs(vectorize.dssim(target, render.rasterize(r.svg)) - r.score) < 1e-12 and r.score <= r.base_score
    assert r.score < (1e-9 if name == "flat" else 0.1) and len(r.history) <= 24
    doc = render.parse(r.svg)
    assert (doc.width, doc.height) == (64, 64) and doc.elements


def test_whole_and_region_gradients_are_found():
    y, x = np.mgrid[:64, :64]
    for ramp, radial in ((x * 3.0, False), (np.hypot(x - 20, y - 30) * 4, True)):
        target = np.floor(np.clip(np.stack([ramp + 20, ramp * 0.5 + 60, 200 - ramp * 0.7], 2), 0, 255))
        fit = vectorize.fit_gradient(target, *(v.ravel() for v in (y, x)), 12, 5, 48)
        assert fit.rmse < 0.25 * fit.flat and (not radial or fit.radial)
        drawn = render.rasterize(vectorize.document(64, 64, f'<defs>{fit.markup("g", 12)}</defs><rect width="100%" height="100%" fill="url(#g)"/>'))
        assert vectorize.rmse(target, drawn) < 1.5 * fit.rmse + 0.01


def test_rendering_follows_the_markup():
    svg = ('<svg viewBox="0 0 20 10"><clipPath id="f"><path d="M0 0H20V10H0z"/></clipPath><g clip-path="url(#f)"><rect width="100%" height="100%" fill="#102030"/>'
           '<path fill="#fff" d="M2 2H8V8H2ZM4 4V6H6V4Z"/><g transform="translate(10 0) scale(2)" opacity=".5"><rect x="1" y="1" width="2" height="2" fill="#ff0000"/></g>'
           '<ellipse cx="17" cy="5" rx="2" ry="1" transform="rotate(90 17 5)" fill="#00ff00"/><path fill="none" d="M0 0H20"/></g></svg>')  # fmt: skip
    a = render.rasterize(svg)
    assert a.shape == (10, 20, 3) and tuple(a[0, 0]) == (16, 32, 48)
    assert tuple(a[3, 3]) == (255, 255, 255) and tuple(a[5, 5]) == (16, 32, 48)  # a hole
    assert tuple(a[3, 13]) == ((16 + 255) / 2, 16, 24) and tuple(a[6, 13]) == (16, 32, 48)
    assert tuple(a[3, 17]) == (0, 255, 0) and tuple(a[5, 15]) == ((16 + 255) / 2, 16, 24)  # turned upright; half-seen red below
    b = render.rasterize(svg, 40, 20)
    assert (b[::2, ::2] == a).all() and (b[1::2, 1::2] == a).all()
    wound = render.winding([np.array([[0, 0], [8, 0], [8, 8], [0, 8]], float), np.array([[2, 2], [6, 2], [6, 6], [2, 6]], float)], 8, 8)
    assert wound.all() and not render.winding([np.array([[0, 0], [8, 0], [8, 8], [0, 8]], float), np.array([[2, 2], [6, 2], [6, 6], [2, 6]], float)], 8, 8, True)[3, 3]


def test_documents_render_to_packed_pixels(spark):
    a = drawing()["flat"].astype(int)
    out = convert.convert(image(spark, a, 7), "draft").collect()[0]
    back = render.render_documents(spark.createDataFrame([(7, out["svg"]), (8, None)], "img_id long, svg string")).collect()
    assert len(back) == 1 and (back[0]["width"], back[0]["height"]) == (64, 64)
    got = np.frombuffer(bytes(back[0]["data"]), np.uint8).reshape(64, 64, 3)
    assert abs(vectorize.dssim(a.astype(float), got) - out["score"]) < 1e-3 and out["type"] == "flat" and out["bytes"] == len(out["svg"])


def test_overrides_and_weights_reach_the_search(spark):
    a = (drawing()["field"] + np.random.default_rng(0).integers(0, 60, (64, 64, 3))).clip(0, 255).astype(int)
    px = image(spark, a)
    few = convert.convert(px, "draft", overrides={"budget": 3, "splats": 0}).collect()[0]
    assert len(few["history"]) <= 3
    weight = np.zeros((64, 64))
    weight[:, :20] = 1
    part = convert.convert(px, "draft", overrides={"budget": 12, "splats": 0, "target": 0.0}, weights=spark.createDataFrame([(0, weight.tobytes())], "img_id long, weight binary")).collect()[0]
    events = [json.loads(r["event"]) for r in convert.progress_json(spark.createDataFrame([part])).collect()]
    assert [e["i"] for e in events] == list(range(1, len(part["history"]) + 1)) and all(e["phase"] == "refine" for e in events)


def test_base_trace_obeys_its_byte_budget():
    rng = np.random.default_rng(4)
    target = np.kron(rng.integers(0, 256, (16, 16, 3)), np.ones((6, 6, 1)))
    preset = convert.PRESETS["poster"]
    whole = vectorize.base_trace(target, preset)
    small = vectorize.base_trace(target, preset, max_bytes=vectorize.HEADROOM + 4000)
    assert len(small) < len(whole) / 2
    smooth = np.floor(drawing()["field"])
    fine, coarse = (vectorize.regions(smooth, convert.coarser(convert.PRESETS["fine"], k)["layer_step"], 4) for k in (0, 3))
    assert len(np.unique(coarse)) < len(np.unique(fine))


def test_whole_image_steps_lower_the_error():
    c = canvas_of(np.full((40, 40, 3), (200, 60, 40)))
    before = c.score()
    assert refine.step(c, refine.Options(everywhere=True, alpha=1.0), 0, 1) and c.score() < 0.7 * before


def test_text_is_found_and_texture_is_not(spark):
    rng = np.random.default_rng(6)
    page = np.full((96, 128, 3), 245)
    for row in range(3):
        for k in range(9):  # strokes: an upright and two bars, like letters of one line
            y, x = 10 + 26 * row, 8 + 12 * k
            page[y : y + 12, x : x + 2] = 10
            page[y : y + 2, x : x + 7] = 10
            page[y + 6 : y + 8, x : x + 6 - k % 3] = 10
    boxes = text.text_regions(image(spark, page)).collect()
    assert boxes and sum(b["glyphs"] for b in boxes) == 27 and all(b["x0"] <= 8 and b["x1"] >= 100 for b in boxes)
    speckle = np.where(rng.random((96, 128, 1)) < 0.04, 10, 245) + np.zeros((96, 128, 3), int)
    assert not text.text_regions(image(spark, speckle)).count()


def test_gates_of_a_cluster():
    def line(n, h=10, w=6, gap=3, jitter=0):
        rng = np.random.default_rng(1)
        x = np.arange(n) * (w + gap) + 5.0
        y = 20.0 + rng.integers(0, jitter + 1, n)
        return {"x0": x, "x1": x + w - 1, "y0": y, "y1": y + h - 1, "area": np.full(n, w * h * 0.4), "stroke": np.full(n, 2.0)}

    assert text.reads_as_text(line(8), 200, 100) and not text.reads_as_text(line(5), 200, 100) and text.reads_as_text(line(5), 200, 100, relaxed=True)
    assert not text.reads_as_text(line(8, jitter=200), 200, 400)  # no rows
    assert not text.reads_as_text({**line(8, h=14), "stroke": np.full(8, 7.0)}, 200, 100)  # solid blobs
    assert not text.reads_as_text(line(20), 180, 100)  # the whole width


def test_cubic_resize_keeps_flats_and_size(spark):
    a = np.full((30, 50, 3), (10, 130, 250))
    out = fit_inside(pack_images(image(spark, a)), 25).collect()[0]
    got = np.frombuffer(bytes(out["data"]), np.uint8).reshape(15, 25, 3)
    assert (got == (10, 130, 250)).all()
    assert fit_inside(pack_images(image(spark, a)), 100).collect()[0]["width"] == 50 and fit_inside(pack_images(image(spark, a)), 100, enlarge=True).collect()[0]["width"] == 100


def test_minified_markup_draws_the_same(spark):
    svg = '<?xml version="1.0"?>\n<!-- c -->\n<svg xmlns="u" width="20" height="20" viewBox="0 0 20 20">\n  <rect x="1.0049" y="0.500" width="4.000" height="3" fill="#123456" id="a1.999" />\n <path fill="#abc" d="M2.0001 8.2L9.999 8.2L9 15.20Z"/></svg>'
    small = spark.createDataFrame([(svg,)], "t string").select(paths.minify(F.col("t"))).first()[0]
    assert len(small) < 0.8 * len(svg) and 'id="a1.999"' in small and 'x="1" y=".5" width="4"' in small
    assert (render.rasterize(small) == render.rasterize(svg)).all()


def test_tiles_of_many_images_stay_apart(spark):
    """Codes far beyond what a sum over all components could hold."""
    base = 1 << 16
    rows = [(i, base + y, base + x, (x // 2 + y // 2) % 2) for i in range(3) for y in range(8) for x in range(8)]
    labels = spark.createDataFrame(rows, "img_id long, y int, x int, label int")
    got = segment.tiled_components(labels, 4).groupBy("img_id", "comp").count().collect()
    assert sorted(r["count"] for r in got) == [4] * 48
    one = segment.labelled(labels.where("img_id < 2"), limit=10).groupBy("img_id", "comp").count().collect()
    assert sorted(r["count"] for r in one) == [4] * 32


# ---------------------------------------------------------------- streams
def slow_line(jobs_, ttl):
    free, live, out = [0, 0], [], {}
    for t, job, work, quits in sorted(jobs_, key=lambda j: j[:2]):
        live = [x for x in live if x[2] > t and t - x[0] <= ttl]
        if len(live) >= 16:
            out[job] = (429, None, None, None)
            continue
        at = free.index(min(free))
        begins = max(t, free[at])
        place = 1 + sum(x[1] > t for x in live) if begins > t else 0
        if begins > t and quits is not None and quits <= begins:
            ends, started = quits, None
        else:
            ends = begins + work if quits is None else min(begins + work, max(quits, begins))
            started = free[at] = begins
            free[at] = ends
        live.append((t, begins, ends))
        out[job] = (200, place, started, ends)
    return out


def test_line_of_jobs_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [("a", i, int(t), int(w), None if q % 3 else int(t + q)) for i, (t, w, q) in enumerate(zip(rng.integers(0, 4000, 300), rng.integers(10, 90, 300), rng.integers(1, 200, 300)))]
    got = {r["job_id"]: (r["status"], r["position"], r["started"], r["ended"]) for r in jobs.schedule(spark.createDataFrame(rows, "server string, job_id long, t long, work long, quits long"), 300).collect()}
    want = slow_line([(t, i, w, q) for _, i, t, w, q in rows], 300)
    assert got == want and {r[0] for r in got.values()} == {200, 429} and any(r[1] and r[2] is None for r in got.values())


def test_admission_stream(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    first = [("s", i, "submit", at(i)) for i in range(18)]
    second = [("s", 0, "done", at(30)), ("s", 3, "quit", at(31)), ("s", 1, "done", at(32)), ("s", 90, "submit", at(33))]
    seen = []
    for k, b in enumerate((first, second)):
        spark.createDataFrame(b, "server string, job_id long, kind string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = jobs.queue_events(spark.readStream.schema("server string, job_id long, kind string, ts timestamp").parquet(str(tmp_path / "in" / "*")))
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    events = {}
    for _, job, event, place in seen:
        events.setdefault(job, []).append((event, place))
    assert events[0] == events[1] == [("started", 0)] and events[16] == events[17] == [("rejected", 0)]
    assert events[2] == [("queued", 1), ("started", 0)] and events[3] == [("queued", 2)] and events[4] == [("queued", 3), ("started", 0)]
    assert events[90][0][0] == "queued"


def test_requests_and_events_are_json(spark):
    raw = [(1, json.dumps({"image": "data:image/png;base64,aGVsbG8=", "quality": "max", "saliency": False})), (2, "not json"), (3, "{}"), (4, json.dumps({"image": "data:,"})), (5, json.dumps({"image": "aGVsbG8="})), (6, None)]
    got = {r["job_id"]: r for r in jobs.requests(spark.createDataFrame(raw, "job_id long, body string")).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: 200, 2: 400, 3: 400, 4: 400, 5: 200, 6: 400}
    assert bytes(got[1]["data"]) == b"hello" and (got[1]["quality"], got[1]["saliency"]) == ("max", False) and got[5]["quality"] == "balanced"
    rows = [(1, 1, "refine", 10, "A", "<svg/>", "secret"), (1, 2, "refine", 20, "B", "<svg/>", "secret")]
    out = [json.loads(r["data"]) for r in jobs.event_json(spark.createDataFrame(rows, "job_id long, seq long, phase string, i long, run string, svg string, model string")).orderBy("seq").collect()]
    assert out == [{"phase": "refine", "i": 10, "svg": "<svg/>", "run": "A"}, {"phase": "refine", "i": 20, "run": "B"}]


def test_a_running_job_can_be_cancelled(spark):
    import threading
    import time

    slow = lambda: spark.range(4, numPartitions=4).rdd.map(lambda x: time.sleep(30)).count()
    failed = []

    def work():
        try:
            jobs.run_job(spark, "j1", slow)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(3)
    jobs.cancel_job(spark, "j1")
    thread.join(20)
    assert failed and not thread.is_alive()


def test_job_state_survives_batches_and_expires(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    batches = [[(1, "open", 0), (2, "open", 0), (3, "open", 1)], [(1, "refine", 60), (2, "done", 61)], [(4, "open", 4000)], [(5, "open", 8000)]]
    for k, b in enumerate(batches):
        spark.createDataFrame([(j, p, t0 + dt.timedelta(seconds=s)) for j, p, s in b], "job_id long, phase string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    schema = "job_id long, phase string, ts timestamp"
    seen = []

    def sink(df, _):
        seen.extend(map(tuple, df.collect()))

    for k in range(len(batches)):  # a new query each time, on the same checkpoint: state is read back
        stage = tmp_path / "stage"
        stage.mkdir(exist_ok=True)
        for f in (tmp_path / "in" / f"{k}").glob("*.parquet"):
            (stage / f"{k}-{f.name}").write_bytes(f.read_bytes())
        stream = jobs.track(spark.readStream.schema(schema).parquet(str(stage)))
        q = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert (1, "refine", 2, False) in seen and (2, "done", 2, False) in seen
    assert (1, "refine", 2, True) in seen and (3, "open", 1, True) in seen and not any(s[0] == 2 and s[3] for s in seen)


def test_windowed_progress_streams_like_batch(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as job_id", "if(id % 3 = 0, 'refine', 'done') as phase", "timestamp_seconds(id * 40) as ts")
    rows.write.parquet(str(tmp_path / "ev"))
    stream = jobs.windowed_progress(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("progress_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("progress_windows").collect())) == sorted(map(tuple, jobs.windowed_progress(rows).collect()))


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["img_id", "r", "c", "x", "y", "w", "h", "err", "area", "rank"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("key", ["", "data:;base64,", "data:x;base64,***"])
def test_bad_payloads_are_rejected(spark, key):
    rows = spark.createDataFrame([(1, key), (2, "aGVsbG8=")], "job_id long, payload string")
    assert [(r["job_id"], bytes(r["data"])) for r in jobs.validated(rows).collect()] == [(2, b"hello")]


def test_packed_images_keep_arrow_types(spark):
    t = pack_images(image(spark, np.zeros((2, 3, 3), int))).toArrow()
    assert t.schema.field("data").type in (pa.binary(), pa.large_binary()) and len(t["data"][0].as_py()) == 18
