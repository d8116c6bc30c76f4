"""Gradient profiles and models, centroids, moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import square

CHANNELS = "rgb"


def angles(n: int) -> list[tuple[int, float, float]]:
    """(candidate, cosine, sine) of n directions over half a turn, to twelve decimals."""
    return [(i, round(math.cos(math.pi * i / n), 12), round(math.sin(math.pi * i / n), 12)) for i in range(n)]


def profile_sse(binned: DataFrame, *keys: str) -> DataFrame:
    """Squared error against the mean of each bin, from one pass of integer sums: sum(v^2) - sum(v)^2 / n."""
    sums = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.sum(k).cast("long").alias(f"s{k}") for k in CHANNELS), *(F.sum(square(F.col(k))).cast("long").alias(f"q{k}") for k in CHANNELS))
    sse: Column = sum((F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n") for k in "gb"), F.col("qr") - F.col("sr") * F.col("sr") / F.col("n"))
    return sums.groupBy(*keys).agg(F.round(F.sum(sse), 3).alias("sse"), F.sum("n").alias("n"))


def profile(px: DataFrame, axis: str, bins: int) -> DataFrame:
    """Mean colour per bin along one axis."""
    top = px.groupBy("img_id").agg((F.max(axis) + 1).alias("_n"))
    b = px.join(top, "img_id").withColumn("bin", F.floor(F.col(axis) * bins / F.col("_n")).cast("int"))
    return b.groupBy("img_id", "bin").agg(*(F.round(F.avg(k), 6).alias(f"m{k}") for k in CHANNELS))


def fit_linear(px: DataFrame, n_angles: int = 12, bins: int = 48, keys: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """(keys, cand, sse): the best direction, each tried on every pixel; the first wins ties.

    Projections are scaled between the extremes over the key's bounding box, which needs no extra pass
    over the pixels. The candidate list has a fixed length.
    """
    box = px.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    tries = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(co).alias("co"), F.lit(si).alias("si")) for i, co, si in angles(n_angles)])
    rows = px.join(box, list(keys)).withColumn("t", F.explode(tries))
    co, si = F.col("t.co"), F.col("t.si")
    low = F.least(F.col("x0") * co, F.col("x1") * co) + F.col("y0") * si
    high = F.greatest(F.col("x0") * co, F.col("x1") * co) + F.col("y1") * si
    u = F.col("x") * co + F.col("y") * si
    place = F.when(high - low > 1e-9, F.floor(F.round((u - low) / (high - low) * (bins - 1), 9))).otherwise(0).cast("int")
    binned = rows.select(*keys, F.col("t.cand").alias("cand"), place.alias("bin"), *CHANNELS)
    return _best(profile_sse(binned, *keys, "cand"), keys)


def _best(tried: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    best = tried.groupBy(*keys).agg(F.min(F.struct("sse", "cand", "n")).alias("b"))
    return best.select(*keys, F.col("b.cand").alias("cand"), F.col("b.sse").alias("sse"), F.col("b.n").alias("n"))


def flat_sse(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return profile_sse(px.select(*keys, F.lit(0).alias("bin"), *CHANNELS), *keys).select(*keys, F.col("sse").alias("flat"))


def fit_any(px: DataFrame, directions: int, grid: int, bins: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cand, sse, n): the best of all directions and, numbered after them, the radial candidates."""
    both = fit_linear(px, directions, bins, keys).unionByName(fit_radial(px, bins, grid, keys).withColumn("cand", F.col("cand") + directions))
    return _best(both, keys)


def region_fit(px: DataFrame, keys: tuple[str, ...] = ("img_id", "comp")) -> DataFrame:
    """Per region: the best of 8 directions and 11 centres if its error is at most 0.6 of flat and lower by more than 1e-4, else solid.

    Candidates 0 to 7 are directions, 8 and 9 the light and dark centroid, 10 to 18 a 3 x 3 lattice over the box.
    """
    fit = fit_any(px, 8, 3, 32, keys).join(flat_sse(px, keys), list(keys))
    g = F.sqrt(F.greatest(F.lit(0.0), F.col("sse")) / (3 * F.col("n"))) / 255
    f = F.sqrt(F.greatest(F.lit(0.0), F.col("flat")) / (3 * F.col("n"))) / 255
    kind = F.when((g <= 0.6 * f) & (g < f - 1e-4), F.when(F.col("cand") < 8, "linear").otherwise("radial")).otherwise("solid")
    return fit.select(*keys, kind.alias("kind"), F.when(kind != "solid", F.col("cand")).cast("int").alias("cand"), F.round(F.when(kind != "solid", g).otherwise(f), 6).alias("rmse"))


def fit_radial(px: DataFrame, bins: int = 48, grid: int = 5, keys: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """(keys, cand, sse, n): the best centre for a radial profile.

    Candidate 0 is the centroid of squared luma, 1 that of squared darkness, the others a grid by grid
    lattice from edge to edge of the key's box. Distances are scaled by that to the farthest corner.
    """
    light = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000).cast("long")
    wl, wd = light * light, (255 - light) * (255 - light)
    mean = lambda v, w: F.round(F.sum(F.col(v) * w) / F.nullif(F.sum(w), F.lit(0)), 6)
    box = px.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), mean("x", wl).alias("lx"), mean("y", wl).alias("ly"), mean("x", wd).alias("dx"), mean("y", wd).alias("dy"))
    centre = lambda k, cx, cy: F.struct(F.lit(k).alias("cand"), cx.cast("double").alias("cx"), cy.cast("double").alias("cy"))
    side = lambda v, i: F.col(f"{v}0") + (F.col(f"{v}1") - F.col(f"{v}0") + 1) * i / (grid - 1)
    tries = [centre(0, F.col("lx"), F.col("ly")), centre(1, F.col("dx"), F.col("dy"))]
    tries += [centre(2 + j * grid + i, side("x", i), side("y", j)) for j in range(grid) for i in range(grid)]
    rows = px.join(box, list(keys)).withColumn("t", F.explode(F.filter(F.array(*tries), lambda t: t["cx"].isNotNull())))
    far = lambda v: F.greatest(F.abs(F.col(f"{v}0") - F.col(f"t.c{v}")), F.abs(F.col(f"{v}1") - F.col(f"t.c{v}")))
    away = lambda a, b: F.sqrt(a * a + b * b)
    reach = F.greatest(away(far("x"), far("y")), F.lit(1e-9))
    place = F.least(F.lit(bins - 1), F.floor(F.round(away(F.col("x") - F.col("t.cx"), F.col("y") - F.col("t.cy")) / reach * (bins - 1), 9))).cast("int")
    return _best(profile_sse(rows.select(*keys, F.col("t.cand").alias("cand"), place.alias("bin"), *CHANNELS), *keys, "cand"), keys)


def gradient_model(px: DataFrame) -> DataFrame:
    """(img_id, kind, cand, rmse): the best of 12 directions and 27 centres over the whole image; directions win ties."""
    both = fit_linear(px).withColumn("radial", F.lit(False)).unionByName(fit_radial(px).withColumn("radial", F.lit(True)))
    best = both.groupBy("img_id").agg(F.min(F.struct("sse", "radial", "cand", "n")).alias("b"))
    rmse = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("b.sse")) / (3 * F.col("b.n"))) / 255, 6)
    return best.select("img_id", F.when(F.col("b.radial"), "radial").otherwise("linear").alias("kind"), F.col("b.cand").cast("int").alias("cand"), rmse.alias("rmse"))


def weighted_centroid(px: DataFrame) -> DataFrame:
    """Centroids weighted by squared luma and by squared darkness."""
    light = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000).cast("long")
    v = px.select("img_id", "x", "y", (light * light).alias("wl"), ((255 - light) * (255 - light)).alias("wd"))
    at = lambda p, w: F.round(F.sum(F.col(p) * F.col(w)) / F.nullif(F.sum(w), F.lit(0)), 6)
    return v.groupBy("img_id").agg(at("x", "wl").alias("light_x"), at("y", "wl").alias("light_y"), at("x", "wd").alias("dark_x"), at("y", "wd").alias("dark_y"))


def ellipse_moments(px: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Centre, semi-axes (2 * 1.06 standard deviations) and angle of each key's pixels, from integer sums."""
    s = px.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("sx"), F.sum("y").cast("long").alias("sy"), F.sum(F.col("x") * F.col("x")).cast("long").alias("sxx"), F.sum(F.col("y") * F.col("y")).cast("long").alias("syy"), F.sum(F.col("x") * F.col("y")).cast("long").alias("sxy"))
    n = F.col("n")
    cxx, cyy, cxy = ((F.col(f"s{a}{b}") * n - F.col(f"s{a}") * F.col(f"s{b}")) / (n * n) for a, b in ("xx", "yy", "xy"))
    mean, gap = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    axis = lambda v: F.round(2.12 * F.sqrt(F.greatest(F.lit(0.0), v)), 6)
    return s.select(*keys, F.round(F.col("sx") / n, 6).alias("cx"), F.round(F.col("sy") / n, 6).alias("cy"), axis(mean + gap).alias("ra"), axis(mean - gap).alias("rb"), F.round(F.atan2(2 * cxy, cxx - cyy) / 2, 6).alias("theta"))


def render(fit: DataFrame, grid: DataFrame, profile_: DataFrame, bins: int) -> DataFrame:
    """Pixels of a vertical gradient: linear between the bins of a profile, rounded half to even."""
    top = grid.groupBy("img_id").agg((F.max("y") + 1).alias("_h"))
    t = grid.join(top, "img_id").withColumn("t", F.col("y") * (bins - 1) / F.greatest(F.lit(1), F.col("_h") - 1))
    t = t.withColumn("b0", F.floor("t").cast("int")).withColumn("b1", F.least(F.col("b0") + 1, F.lit(bins - 1)).cast("int"))
    p = profile_.join(fit, "img_id", "left_semi")
    one = p.select("img_id", F.col("bin").alias("b0"), *(F.col(f"m{k}").alias(f"u{k}") for k in CHANNELS))
    two = p.select("img_id", F.col("bin").alias("b1"), *(F.col(f"m{k}").alias(f"v{k}") for k in CHANNELS))
    out = t.join(one, ["img_id", "b0"]).join(two, ["img_id", "b1"])
    mix = lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.col(f"u{k}") + (F.col(f"v{k}") - F.col(f"u{k}")) * (F.col("t") - F.col("b0"))))).cast("int")
    return out.select("img_id", "y", "x", *(mix(k).alias(k) for k in CHANNELS))
