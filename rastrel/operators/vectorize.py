"""One image into one document: base trace, gradients, overlay, splats, shapes, patches, tone. Numpy, one image per task.

Every stage emits markup and is judged on that markup rendered back (``render.rasterize``), so a score
always belongs to its document. A stage is adopted only if it lowers the error by the stated factor.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

from . import refine as rf
from .paths import number, snap
from .render import rasterize, snapshot
from .segment import grid_components, grid_edges, loops_of, merge_grid

#: Fixed values: (rung, resolution share) in the order they are tried for size.
LADDER_WALK = [(1, 1.0), (1, 0.7), (1, 0.57), (2, 0.7), (2, 0.57), (3, 0.57)]
# Minified share of raw bytes, headroom of a byte budget.
MINIFIED, HEADROOM = 0.62, 51200


# ---------------------------------------------------------------- measures

def rmse(target: np.ndarray, canvas: np.ndarray) -> float:
    return math.sqrt(float(((target - canvas) ** 2).mean())) / 255


def dssim(target: np.ndarray, canvas: np.ndarray, window: int = 11) -> float:
    """Structural dissimilarity over whole blocks of integer luma; images smaller than a block are one."""
    luma = [(snapshot(v).astype(np.int64) @ np.array([77, 150, 29]) + 128) >> 8 for v in (target, canvas)]
    h, w = luma[0].shape
    rows, cols = np.arange(0, h, window), np.arange(0, w, window)
    total = lambda v: np.add.reduceat(np.add.reduceat(v, rows, 0), cols, 1).astype(float)
    n = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    (a, b), (c1, c2) = luma, ((0.01 * 255) ** 2, (0.03 * 255) ** 2)
    ma, mb = total(a) / n, total(b) / n
    va, vb, cov = total(a * a) / n - ma * ma, total(b * b) / n - mb * mb, total(a * b) / n - ma * mb
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return float((1 - s.mean()) / 2)


def document(width: int, height: int, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{body}</svg>'


# ---------------------------------------------------------------- weights

def cells_of(v: np.ndarray, cell: int) -> np.ndarray:
    """Mean of every cell x cell block, ragged at the far edges."""
    rows, cols = np.arange(0, v.shape[0], cell), np.arange(0, v.shape[1], cell)
    n = np.outer(np.diff(np.append(rows, v.shape[0])), np.diff(np.append(cols, v.shape[1])))
    return np.add.reduceat(np.add.reduceat(v, rows, 0), cols, 1) / (n[..., None] if v.ndim == 3 else n)


def saliency(target: np.ndarray, centre: float = 0.45, floor: float = 0.4) -> np.ndarray:
    """Regional contrast with a centre prior, per pixel: some 12 cells a side, bilinear between them."""
    h, w, _ = target.shape
    cell = max(8, round(max(h, w) / 12))
    m = cells_of(target, cell)
    gh, gw = m.shape[:2]
    flat = m.reshape(-1, 3)
    away = np.sqrt(((flat[:, None] - flat) ** 2).sum(2))
    d = (away.sum(1) / max(1, len(flat) - 1)).reshape(gh, gw)
    d = d / d.max() if d.max() > 0 else d
    y, x = np.mgrid[:gh, :gw]
    prior = np.exp(-((x - (gw - 1) / 2) ** 2 + (y - (gh - 1) / 2) ** 2) / (2 * (0.55 * min(gh, gw)) ** 2))
    s = floor + (1 - floor) * np.minimum(1.0, d * (1 - centre) + np.maximum(d, 0.15) * prior * centre)
    v, u = (np.clip((np.arange(n) + 0.5) / cell - 0.5, 0, g - 1) for n, g in ((h, gh), (w, gw)))
    across = np.stack([np.interp(u, np.arange(gw), row) for row in s])
    return np.stack([np.interp(v, np.arange(gh), col) for col in across.T], 1)


def smoothness(target: np.ndarray) -> np.ndarray:
    """Weight near 1 where the luma around a pixel hardly varies."""
    luma = np.pad(target @ np.array([0.299, 0.587, 0.114]), 2, mode="edge")
    h, w = target.shape[:2]
    near = np.stack([luma[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for dy in (-2, 0, 2) for dx in (-2, 0, 2)])
    return 0.02 + 0.98 * np.maximum(0, 1 - near.std(0) / 25) ** 2


# ---------------------------------------------------------------- traces

def fill(rgb: np.ndarray | tuple) -> str:
    return "#" + "".join(f"{int(v):02x}" for v in rgb)


def outline(loops: list[list[tuple[int, int]]]) -> str:
    """Path text of axis-aligned loops: one coordinate per corner."""
    out = []
    for points in loops:
        text, (x, y) = f"M{points[0][0]} {points[0][1]}", points[0]
        for px, py in points[1:]:
            text += f"H{px}" if py == y else f"V{py}" if px == x else f"L{px} {py}"
            x, y = px, py
        out.append(text + "Z")
    return "".join(out)


def regions(target: np.ndarray, step: int, least: int) -> np.ndarray:
    """Components of colours quantized by ``step``, small ones merged."""
    q = np.minimum(255, snapshot(target).astype(np.int64) // step * step + step // 2)
    grid = grid_components(q[..., 0] * 65536 + q[..., 1] * 256 + q[..., 2])
    return merge_grid(grid, least)


def region_marks(target: np.ndarray, grid: np.ndarray, snapping: bool = False, fills: dict[int, str] | None = None) -> str:
    """Markup of all regions, the largest first; a region close to a circle or ellipse may become one."""
    kinds, place, area = np.unique(grid, return_inverse=True, return_counts=True)
    place = place.ravel()
    mean = np.stack([np.floor(np.bincount(place, target[..., k].ravel()) / area + 0.5) for k in range(3)], 1)
    edges, out = grid_edges(grid), []
    for i in sorted(range(len(kinds)), key=lambda i: (-area[i], kinds[i])):
        loops = loops_of(edges[int(kinds[i])])
        ink = (fills or {}).get(int(kinds[i])) or fill(mean[i])
        found = snap("M" + "L".join(f"{x} {y}" for x, y in loops[0]) + "Z") if snapping and len(loops) == 1 and len(loops[0]) >= 8 else None
        if found:
            names = ("cx", "cy", "r") if found[0] == "circle" else ("cx", "cy", "rx", "ry")
            out.append(f"<{found[0]} " + " ".join(f'{n}="{number(v)}"' for n, v in zip(names, found[1], strict=True)) + f' fill="{ink}"/>')
        else:
            out.append(f'<path fill="{ink}" d="{outline(loops)}"/>')
    return "".join(out)


def median_cut(rgb: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """k mean colours: the box with the largest population times widest range is split at the value boundary nearest its median."""
    boxes = [np.arange(len(n))]
    while len(boxes) < k:
        spans = [np.ptp(rgb[b], axis=0) for b in boxes]
        best = max(range(len(boxes)), key=lambda i: (n[boxes[i]].sum() * spans[i].max(), -i))
        if spans[best].max() == 0:
            break
        b, channel = boxes[best], int(np.argmax(spans[best]))
        b = b[np.argsort(rgb[b, channel], kind="stable")]
        v, upto = rgb[b, channel], np.cumsum(n[b])
        cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
        at = cuts[int(np.argmin(np.abs(upto[cuts - 1] - upto[-1] / 2)))]
        boxes[best : best + 1] = [b[:at], b[at:]]
    return np.array([np.floor((rgb[b] * n[b, None]).sum(0) / n[b].sum() + 0.5) for b in boxes])


def vote(labels: np.ndarray, keep: int = 3) -> np.ndarray:
    """3 x 3 mode filter: a label seen at most ``keep`` times around gives way to a single commonest one."""
    h, w = labels.shape
    wide = np.pad(labels, 1, constant_values=-1)
    near = np.stack([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
    seen = (near[:, None] == near[None]).sum(1) * (near >= 0)
    top = seen.max(0)
    best = np.where(seen == top, near, np.iinfo(np.int64).max).min(0)
    other = np.where(seen == top, near, -1).max(0)
    return np.where((seen[4] <= keep) & (best == other), best, labels)


def layered_marks(target: np.ndarray, k: int = 48, lloyd: int = 2) -> str:
    """One path per palette colour, the commonest first: median cut, recentring, mode filter, rare labels dropped."""
    u8 = snapshot(target).reshape(-1, 3).astype(np.int64)
    rgb, n = np.unique(u8, axis=0, return_counts=True)
    pal = median_cut(rgb, n, k)

    def nearest() -> np.ndarray:
        out = np.empty(len(u8), np.int64)
        for a in range(0, len(u8), 1 << 14):
            out[a : a + (1 << 14)] = ((u8[a : a + (1 << 14), None] - pal) ** 2).sum(2).argmin(1)
        return out

    labels = nearest()
    for _ in range(lloyd):
        count = np.bincount(labels, minlength=len(pal))
        mean = np.stack([np.bincount(labels, u8[:, c], len(pal)) for c in range(3)], 1) / np.maximum(count, 1)[:, None]
        pal = np.where(count[:, None] > 0, np.floor(mean + 0.5), pal)
        labels = nearest()
    grid = vote(labels.reshape(target.shape[:2]))
    count = np.bincount(grid.ravel(), minlength=len(pal))
    edges = grid_edges(grid)
    order = [c for c in np.argsort(-count, kind="stable") if count[c] >= max(9, math.floor(grid.size * 0.0002 + 0.5))]
    under = f'<rect width="100%" height="100%" fill="{fill(pal[order[0]])}"/>' if order else ""
    return under + "".join(f'<path fill="{fill(pal[c])}" d="{outline(loops_of(edges[int(c)]))}"/>' for c in order)


def shrink(target: np.ndarray, share: float) -> np.ndarray:
    """Area means on a grid smaller by ``share``."""
    h, w = (max(1, round(n * share)) for n in target.shape[:2])
    y, x = np.arange(target.shape[0]) * h // target.shape[0], np.arange(target.shape[1]) * w // target.shape[1]
    cell = (y[:, None] * w + x).ravel()
    n = np.bincount(cell, minlength=h * w)
    return np.stack([np.bincount(cell, target[..., k].ravel(), h * w) / n for k in range(3)], 1).reshape(h, w, 3)


def base_trace(target: np.ndarray, preset: dict, scale: int = 1, layers: int = 0, snapping: bool = False, max_bytes: int | None = None) -> str:
    """Markup of the trace by a preset (speckle, precision, layer_step), coarser along the ladder until its bytes fit.

    The walk starts where the first trace's bytes predict a fit. ``scale`` traces an enlarged image,
    ``layers`` colours with one path each instead of regions.
    """
    h, w = target.shape[:2]

    def at(rung: int, share: float) -> str:
        image = target if share == 1 else shrink(target, share)
        image = np.repeat(np.repeat(image, scale, 0), scale, 1)
        if layers:
            marks = layered_marks(image, max(2, layers >> rung))
        else:
            step = max(min(128, math.floor(preset["layer_step"] * 1.8**rung + 0.5)), 1 << (8 - max(3, preset["precision"] - rung)))
            marks = region_marks(image, regions(image, step, min(64, preset["speckle"] * 2**rung) ** 2), snapping)
        if image.shape[:2] == (h, w):
            return marks
        return f'<g transform="scale({number(w / image.shape[1], 5)} {number(h / image.shape[0], 5)})">{marks}</g>'

    first = at(0, 1.0)
    if max_bytes is None or len(first) * MINIFIED <= max_bytes - HEADROOM:
        return first
    places = [p for p in LADDER_WALK if len(first) * MINIFIED * 0.5 ** p[0] * p[1] ** 2.2 <= max_bytes - HEADROOM]
    start = LADDER_WALK.index(places[0]) if places else len(LADDER_WALK) - 1
    for rung, share in LADDER_WALK[start:]:
        last = at(rung, share)
        if len(last) * MINIFIED <= max_bytes:
            break
    return last


# ---------------------------------------------------------------- gradients

@dataclass
class Fit:
    """A gradient's kind, place, colours of its bins, and errors (of the gradient, of a flat fill)."""

    radial: bool
    place: tuple[float, ...]
    profile: np.ndarray
    rmse: float
    flat: float
    mean: np.ndarray

    def markup(self, name: str, stops: int) -> str:
        """A definition in user space with evenly spaced stops."""
        bins = len(self.profile)
        t = np.linspace(0, bins - 1, stops)
        colors = np.stack([np.interp(t, np.arange(bins) + 0.5, self.profile[:, k]) for k in range(3)], 1)
        marks = "".join(f'<stop offset="{number(i / (stops - 1), 3)}" stop-color="{fill(snapshot(c))}"/>' for i, c in enumerate(colors))
        names, tag = (("cx", "cy", "r"), "radialGradient") if self.radial else (("x1", "y1", "x2", "y2"), "linearGradient")
        place = " ".join(f'{n}="{number(v)}"' for n, v in zip(names, self.place, strict=True))
        return f'<{tag} id="{name}" gradientUnits="userSpaceOnUse" {place}>{marks}</{tag}>'


def fit_gradient(target: np.ndarray, y: np.ndarray, x: np.ndarray, directions: int, lattice: int, bins: int) -> Fit:
    """The best of some directions, the two luma centroids and a lattice of centres over given pixels."""
    c = target[y, x]
    x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
    light = c @ np.array([0.299, 0.587, 0.114])
    total, square = c.sum(0), (c * c).sum()
    flat = square - (total * total).sum() / len(c)
    tries: list[tuple[bool, tuple[float, ...], np.ndarray]] = []
    for i in range(directions):
        co, si = math.cos(math.pi * i / directions), math.sin(math.pi * i / directions)
        ends = [px * co + py * si for px in (x0, x1) for py in (y0, y1)]
        lo, span = min(ends), (max(ends) - min(ends)) or 1.0
        tries.append((False, (co * lo + 0.5, si * lo + 0.5, co * (lo + span) + 0.5, si * (lo + span) + 0.5), (x * co + y * si - lo) / span))
    centres = [(float((x * q).sum() / q.sum()), float((y * q).sum() / q.sum())) for q in (light**2, (255 - light) ** 2) if q.sum() > 0]
    centres += [(x0 + (x1 - x0 + 1) * i / (lattice - 1), y0 + (y1 - y0 + 1) * j / (lattice - 1)) for j in range(lattice) for i in range(lattice)]
    for cx, cy in centres:
        reach = max(math.hypot(px - cx, py - cy) for px in (x0, x1) for py in (y0, y1)) or 1.0
        tries.append((True, (cx + 0.5, cy + 0.5, reach), np.hypot(x - cx, y - cy) / reach))
    best: tuple | None = None
    for radial, place, t in tries:
        b = np.clip((t * (bins - 1)).astype(int), 0, bins - 1)
        n = np.bincount(b, minlength=bins)
        sums = np.stack([np.bincount(b, c[:, k], bins) for k in range(3)], 1)
        sse = square - ((sums * sums).sum(1)[n > 0] / n[n > 0]).sum()
        if best is None or sse < best[0] - 1e-9:
            best = (sse, radial, place, sums, n)
    sse, radial, place, sums, n = best
    held = np.flatnonzero(n)
    profile = (sums[held] / n[held, None])[np.clip(np.searchsorted(held, np.arange(bins)), 0, len(held) - 1)]
    scale = lambda e: math.sqrt(max(0.0, e) / (3 * len(c))) / 255
    return Fit(radial, place, profile, scale(sse), scale(flat), total / len(c))


def region_gradients(target: np.ndarray, levels: int = 4) -> str | None:
    """Regions of a coarse quantization, the larger ones with a gradient where it explains them well; None if shattered."""
    h, w = target.shape[:2]
    least = max(64, math.floor(0.004 * w * h))
    grid = regions(target, 256 // levels, least)
    kinds, area = np.unique(grid, return_counts=True)
    if len(kinds) > 40 or np.sort(area)[::-1][:8].sum() < 0.85 * grid.size:
        return None
    fills, defs = {}, ""
    for c, n in zip(kinds.tolist(), area.tolist(), strict=True):
        if n >= least:
            fit = fit_gradient(target, *np.nonzero(grid == c), 8, 3, 32)
            if fit.rmse <= 0.6 * fit.flat and fit.rmse < fit.flat - 1e-4:
                defs += fit.markup(f"r{c}", 10)
                fills[c] = f"url(#r{c})"
    return f"<defs>{defs}</defs>{region_marks(target, grid, fills=fills)}" if fills else region_marks(target, grid)


def _window(v: np.ndarray, radius: int, least: bool) -> np.ndarray:
    """Separable minimum or maximum over a square; the frame's outside counts as 0."""
    for axis in (0, 1):
        wide = np.pad(v, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
        parts = [np.take(wide, np.arange(i, i + v.shape[axis]), axis) for i in range(2 * radius + 1)]
        v = np.min(parts, 0) if least else np.max(parts, 0)
    return v


def smooth_masks(target: np.ndarray, limit: float = 10.0) -> list[np.ndarray]:
    """Pixels whose blurred local gradient is low, and the bright ones among them."""
    h, w = target.shape[:2]
    total, n = np.zeros((h, w)), np.zeros((h, w))
    for axis in (0, 1):
        d = np.abs(np.diff(target, axis=axis)).mean(2)
        for first in (True, False):
            at = [slice(None), slice(None)]
            at[axis] = slice(0, -1) if first else slice(1, None)
            total[tuple(at)] += d
            n[tuple(at)] += 1
    local = np.pad(total / np.maximum(n, 1), 1, mode="edge")
    blur = np.mean([local[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], 0)
    plain = blur <= limit
    luma = target @ np.array([0.299, 0.587, 0.114])
    if not plain.any() or np.ptp(luma[plain]) <= 60:
        return [plain]
    lo, hi = luma[plain].min(), luma[plain].max()
    return [plain, plain & (luma >= lo + 0.72 * (hi - lo))]


def overlay_blobs(target: np.ndarray, most: int = 4) -> list[tuple[tuple[float, ...], Fit]]:
    """Ellipses (cx, cy, ra, rb, theta) with a gradient: smooth blobs that one explains better than a flat fill."""
    h, w = target.shape[:2]
    found = []
    for mask in smooth_masks(target):
        opened = _window(_window(mask.astype(np.int8), 1, True), 1, False) > 0
        if not opened.any():
            continue
        ys, xs = np.nonzero(opened)
        grid = np.full((h, w), -1, np.int64)
        from .segment import label_runs

        grid[ys, xs] = label_runs(ys, xs, np.zeros(len(ys), np.int64))
        kinds, area = np.unique(grid[ys, xs], return_counts=True)
        for c, n in zip(kinds.tolist(), area.tolist(), strict=True):
            if n < max(200, 0.012 * w * h):
                continue
            y, x = np.nonzero(grid == c)
            x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
            if (x0 == 0) + (y0 == 0) + (x1 == w - 1) + (y1 == h - 1) >= 3 or x1 - x0 + 1 >= 0.92 * w and y1 - y0 + 1 >= 0.92 * h:
                continue
            cov = np.cov(np.stack([x, y]), bias=True)
            mean, gap = (cov[0, 0] + cov[1, 1]) / 2, math.hypot((cov[0, 0] - cov[1, 1]) / 2, cov[0, 1])
            ra, rb = 2.12 * math.sqrt(mean + gap), 2.12 * math.sqrt(max(0.0, mean - gap))
            if rb < 4 or n < 0.6 * math.pi * ra * rb:
                continue
            fit = fit_gradient(target, y, x, 8, 3, 32)
            if fit.rmse <= 0.8 * fit.flat and fit.flat - fit.rmse > 0.01 and fit.rmse <= 0.16:
                found.append((n, (x0, y0, x1, y1), (x.mean() + 0.5, y.mean() + 0.5, ra, rb, math.atan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1]) / 2), fit))
    kept: list[tuple] = []
    inside = lambda e, b: b[0] <= e[0] <= b[2] + 1 and b[1] <= e[1] <= b[3] + 1
    for blob in sorted(found, key=lambda f: -f[0]):
        if len(kept) < most and not any(inside(blob[2], k[1]) or inside(k[2], blob[1]) for k in kept):
            kept.append(blob)
    return [(e, f) for _, _, e, f in kept]


# ---------------------------------------------------------------- shapes as markup

def element(kind: str, p: list[float], r: int, g: int, b: int, alpha: float) -> str:
    """Compact markup of one committed shape."""
    ink = f'fill="#{r:02x}{g:02x}{b:02x}"' + (f' fill-opacity="{number(alpha)}"' if alpha < 1 else "")
    v = [number(x) for x in p]
    if kind == "triangle":
        return f'<path d="M{v[0]} {v[1]}L{v[2]} {v[3]}L{v[4]} {v[5]}Z" {ink}/>'
    turn = f' transform="rotate({number(p[4] * 180 / np.pi)} {v[0]} {v[1]})"' if len(p) > 4 else ""
    if kind == "rotated_rect":
        return f'<rect x="{number(p[0] - p[2])}" y="{number(p[1] - p[3])}" width="{number(2 * p[2])}" height="{number(2 * p[3])}"{turn} {ink}/>'
    return f'<ellipse cx="{v[0]}" cy="{v[1]}" rx="{number(max(p[2], 0.5))}" ry="{number(max(p[3], 0.5))}"{turn} {ink}/>'


def splat_marks(p: list[float], r: int, g: int, b: int) -> str:
    """A splat as rings of one colour: between two knots of its profile, the alpha that their difference takes."""
    out, ink = "", f"#{r:02x}{g:02x}{b:02x}"
    knots = (0.875, 0.625, 0.375, 0.125)
    alpha = [p[5] * float(np.interp(k, (0.0, 0.25, 0.5, 0.75, 1.0), (*np.exp(-((rf.CUTOFF * np.array([0.0, 0.25, 0.5, 0.75])) ** 2) / 2), 0.0))) for k in knots]
    under = 0.0
    for k, a in zip(knots, alpha, strict=True):
        over = 1 - (1 - a) / (1 - under)  # what this ring adds on the ones around it
        under = a
        size = rf.CUTOFF * (k + 0.125)
        out += f'<ellipse cx="{number(p[0] + 0.5)}" cy="{number(p[1] + 0.5)}" rx="{number(size * p[2])}" ry="{number(size * p[3])}" transform="rotate({number(p[4] * 180 / np.pi)} {number(p[0] + 0.5)} {number(p[1] + 0.5)})" fill="{ink}" fill-opacity="{number(over, 4)}"/>'
    return out


@dataclass
class Result:
    """A finished run: its document, the base's and its own error, shapes, kind of base, and the search's history."""

    svg: str
    base_score: float
    score: float
    rmse: float
    shapes: int
    base: str
    history: list[dict] = field(default_factory=list)


def vectorize(target: np.ndarray, img_id: int, plan: dict, weight: np.ndarray | None = None, plain: Result | None = None) -> Result:
    """Run one candidate on one image.

    ``plan`` holds preset (speckle, precision, layer_step), budget, alpha, kinds, target, plateau, max_bytes,
    saliency, snapping, scale, layers, splats (their budget, 0 for none). ``plain`` is the result of the same
    plan without splats, if there is one: where no splats are adopted, the rest would only repeat it.
    """
    h, w = target.shape[:2]
    importance = weight if weight is not None else saliency(target) if plan["saliency"] else np.ones((h, w))
    importance = importance.copy()
    render = lambda body: rasterize(document(w, h, body), background=tuple(np.floor(target.reshape(-1, 3).mean(0) + 0.5)))
    body = base_trace(target, plan["preset"], plan["scale"], plan["layers"], False, plan["max_bytes"])
    seed, kind = render(body), "trace"
    if plan["snapping"]:
        snapped = base_trace(target, plan["preset"], plan["scale"], plan["layers"], True, plan["max_bytes"])
        canvas = render(snapped)
        if len(snapped) < len(body) and rmse(target, canvas) <= rmse(target, seed) + 1e-4:
            body, seed = snapped, canvas
    y, x = (v.ravel() for v in np.indices((h, w)))
    whole = fit_gradient(target, y, x, 12, 5, 48)
    if whole.rmse < 0.85 * rmse(target, seed):
        body, kind = f'<defs>{whole.markup("base", 12)}</defs><rect width="100%" height="100%" fill="url(#base)"/>', "gradient"
        seed = render(body)
    if dssim(target, seed) > 0.02:
        shaded = region_gradients(target)
        canvas = render(shaded) if shaded else None
        if canvas is not None and dssim(target, canvas) < dssim(target, seed):
            body, seed, kind = shaded, canvas, "region gradients"
    blobs = overlay_blobs(target)
    if blobs:
        defs = "".join(f.markup(f"o{i}", 10) for i, (_, f) in enumerate(blobs))
        shapes = [f'<ellipse cx="{number(e[0])}" cy="{number(e[1])}" rx="{number(e[2])}" ry="{number(e[3])}" transform="rotate({number(math.degrees(e[4]))} {number(e[0])} {number(e[1])})" fill="{{}}"/>' for e, _ in blobs]
        # gradients lie in the ellipse's own, unturned space: turn them back
        marks = "".join(s.format(f"url(#o{i})") for i, s in enumerate(shapes))
        turned = re.sub(r'<(linear|radial)Gradient id="o(\d+)"', lambda m: f'{m[0]} gradientTransform="rotate({number(-math.degrees(blobs[int(m[2])][0][4]))} {number(blobs[int(m[2])][0][0])} {number(blobs[int(m[2])][0][1])})"', defs)
        canvas = render(f"{body}<defs>{turned}</defs>{marks}")
        if dssim(target, canvas) < dssim(target, seed):
            body, seed, kind = f"{body}<defs>{turned}</defs>{marks}", canvas, kind + ", overlay"
            importance[rasterize(document(w, h, "".join(s.format("#000000") for s in shapes)))[..., 0] < 128] = 0
    if plan["splats"]:
        splats = rf.Canvas(target, seed.copy(), smoothness(target))
        rf.splat_fit(splats, img_id, plan["splats"])
        marks = "".join(splat_marks(p, r, g, b) for _, p, r, g, b, _, _ in splats.shapes)
        canvas = render(body + marks)
        if splats.shapes and rmse(target, canvas) < 0.9 * rmse(target, seed):
            body, seed, kind = body + marks, canvas, kind + ", splats"
            covered = np.zeros((h, w))
            for _, p, *_ in splats.shapes:
                ys, xs, a = rf.splat_weights(np.array(p), w, h)
                covered[ys, xs] = 1 - (1 - covered[ys, xs]) * (1 - a)
            importance[covered > 0.35] = 0
            plain = None
    if plain:
        return plain
    base_score = dssim(target, seed)
    # a close base needs no shapes; a gradient one few and only clear gains
    budget = 0 if base_score < min(0.013, 2 * plan["target"]) else min(plan["budget"], 30) if kind == "gradient" else plan["budget"]
    canvas = rf.Canvas(target, seed.copy(), importance)
    epsilon = max(1e-6, 0.02 * canvas.score()) if kind == "gradient" else 1e-7
    close = lambda c: dssim(target, c.current) <= plan["target"]
    options = rf.Options(budget=budget, alpha=plan["alpha"], kinds=tuple(plan["kinds"]), plateau_gain=plan["plateau"], epsilon=epsilon, close=close)
    history = rf.refine(canvas, options, img_id)
    thin = rf.prune(canvas, seed)
    canvas = thin if thin.score() <= 1.12 * canvas.score() else canvas
    marks = "".join(element(*s[:6]) for s in canvas.shapes)
    final, shapes = render(body + marks), len(canvas.shapes)
    if marks and dssim(target, final) > base_score:  # worse than the base: the base alone
        marks, final, shapes = "", seed, 0
    under = f'<rect width="100%" height="100%" fill="{fill(np.floor(target.reshape(-1, 3).mean(0) + 0.5))}"/>'
    return Result(document(w, h, under + body + marks), base_score, dssim(target, final), rmse(target, final), shapes, kind, history)


# ---------------------------------------------------------------- finish

def add_patches(target: np.ndarray, svg: str, boxes: list[dict], preset: dict, max_bytes: int = 150_000) -> str:
    """The document with a finer trace over each text box that lowers its error there by three per cent or more."""
    canvas, patches = rasterize(svg), ""
    for b in boxes:
        ys, xs = slice(b["y0"], b["y1"] + 1), slice(b["x0"], b["x1"] + 1)
        crop = target[ys, xs]
        if min(crop.shape[:2]) < 12:
            continue
        fine = np.repeat(np.repeat(crop, 2, 0), 2, 1)
        marks = f'<g transform="translate({b["x0"]} {b["y0"]}) scale(.5)">{region_marks(fine, regions(fine, preset["layer_step"], preset["speckle"] ** 2))}</g>'
        after = rasterize(svg.replace("</svg>", patches + marks + "</svg>"))
        if len(marks) <= max_bytes and dssim(crop, after[ys, xs]) < 0.97 * dssim(crop, canvas[ys, xs]):
            patches, canvas = patches + marks, after
    return svg.replace("</svg>", f'<g id="patches">{patches}</g></svg>') if patches else svg


_HEX = re.compile(r'(fill|stop-color)="#([0-9a-f]{6})"')


def tone_matched(target: np.ndarray, svg: str) -> str:
    """The document with its colours mapped by a clamped line per channel, least squares or moments, where that is closer."""
    canvas = rasterize(svg)
    t, c = target.reshape(-1, 3), canvas.reshape(-1, 3)
    if np.abs(t.mean(0) - c.mean(0)).max() < 1:
        return svg
    spread = c.std(0)
    slope = np.where(spread > 0, ((t - t.mean(0)) * (c - c.mean(0))).mean(0) / np.maximum(spread**2, 1e-9), 1.0)
    moment = np.where(spread > 0, t.std(0) / np.maximum(spread, 1e-9), 1.0)
    best, score = svg, 0.995 * dssim(target, canvas)
    for gain in (slope, moment):
        gain = np.clip(gain, 0.8, 1.25)
        bias = np.clip(t.mean(0) - gain * c.mean(0), -25, 25)

        def mapped(m: re.Match, gain: np.ndarray = gain, bias: np.ndarray = bias) -> str:
            rgb = np.array([int(m[2][i : i + 2], 16) for i in (0, 2, 4)])
            return f'{m[1]}="{fill(np.clip(np.floor(rgb * gain + bias + 0.5), 0, 255))}"'

        tried = _HEX.sub(mapped, svg)
        after = dssim(target, rasterize(tried))
        if after <= score:
            best, score = tried, after
    return best
