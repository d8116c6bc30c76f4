"""Greedy refinement of one image's canvas by shapes and splats: numpy kernels, one image per task.

Each step depends on the canvas the last one left, so a group is one (image, candidate) and Spark's
parallelism is over groups. Randomness is a counter-based generator keyed by seed, image and step, so
reruns give identical shapes. Evaluation touches only a shape's bounding box.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

KINDS = ("triangle", "ellipse", "rotated_ellipse", "rotated_rect")
SHAPE_SCHEMA = "img_id long, seq int, kind string, p array<double>, r int, g int, b int, alpha double, score double"


@dataclass
class Options:
    """Budget and search effort of one refinement. The defaults."""

    budget: int = 40
    kinds: tuple[str, ...] = KINDS
    alpha: float = 0.8
    block: int = 16
    top_k: int = 6
    expand: float = 1.4
    max_area: float = 0.06
    epsilon: float = 1e-7
    candidates: int = 3
    tries: int = 24
    age: int = 80
    seed: int = 1
    plateau_window: int = 24
    plateau_gain: float = 0.012
    target: float = 0.0
    #: Whole-image steps instead of steps around the worst cells.
    everywhere: bool = False
    #: Asked after every CHECK accepted shapes; true ends the search.
    close: Callable[[Canvas], bool] | None = None


#: Search effort of a whole-image step (candidates, tries, age), accepted shapes between target checks.
EVERYWHERE, CHECK = (4, 30, 100), 8


@lru_cache(maxsize=64)
def numbers(n: int, first: float) -> np.ndarray:
    """first, first + 1, ... as doubles: kept, since a search asks for them at every try."""
    out = np.arange(n) + first
    out.flags.writeable = False
    return out


def mask_of(kind: str, p: np.ndarray, width: int, height: int, max_extent: float = math.inf) -> tuple[slice, slice, np.ndarray] | None:
    """(rows, columns, coverage) of a shape inside the frame, pixel centres, or None if it covers nothing or reaches too far.

    A search calls this for every try on a few hundred pixels, so calls cost more than arithmetic: scalars are
    Python's, rows and columns stay vectors as long as they can.
    """
    p = p.tolist()
    if kind == "triangle":
        xs, ys = p[0::2], p[1::2]
        box = min(xs), max(xs), min(ys), max(ys)
    else:
        cx, cy, a, b = p[:4]
        theta = p[4] if len(p) > 4 else 0.0
        co, si = math.cos(theta), math.sin(theta)
        rx, ry = (math.hypot(a * co, b * si), math.hypot(a * si, b * co)) if "ellipse" in kind else (abs(a * co) + abs(b * si), abs(a * si) + abs(b * co))
        box = cx - rx, cx + rx, cy - ry, cy + ry
    x0, x1 = max(0, math.floor(box[0])), min(width - 1, math.ceil(box[1]))
    y0, y1 = max(0, math.floor(box[2])), min(height - 1, math.ceil(box[3]))
    if x0 > x1 or y0 > y1 or x1 + 1 - x0 > max_extent or y1 + 1 - y0 > max_extent:
        return None
    x, y = numbers(width, 0.5)[x0 : x1 + 1], numbers(height, 0.5)[y0 : y1 + 1, None]
    if kind == "triangle":
        s, t, u = ((xs[j] - xs[i]) * (y - ys[i]) - (ys[j] - ys[i]) * (x - xs[i]) for i, j in ((0, 1), (1, 2), (2, 0)))
        m = (np.minimum(np.minimum(s, t), u) >= 0) | (np.maximum(np.maximum(s, t), u) <= 0)
    else:
        x, y = x - cx, y - cy
        u, v = (x * co + y * si, y * co - x * si) if si else (x, y)
        if "ellipse" in kind:
            u, v = u / max(a, 0.5), v / max(b, 0.5)
            u *= u
            v *= v
            m = u + v <= 1
        else:
            m = (np.abs(u) <= a) & (np.abs(v) <= b)
    return (slice(y0, y1 + 1), slice(x0, x1 + 1), m) if np.count_nonzero(m) else None


def random_shape(rng: np.random.Generator, kind: str, box: tuple[float, float, float, float]) -> np.ndarray:
    x, y, w, h = box
    cx, cy = x + rng.random() * w, y + rng.random() * h
    if kind == "triangle":
        return np.concatenate([[cx, cy], [cx + (rng.random() - 0.5) * w, cy + (rng.random() - 0.5) * h], [cx + (rng.random() - 0.5) * w, cy + (rng.random() - 0.5) * h]])
    radii = [1 + rng.random() * w / 2, 1 + rng.random() * h / 2]
    return np.array([cx, cy, *radii] + ([rng.random() * math.pi] if kind.startswith("rotated") else []))


def mutate(rng: np.random.Generator, p: np.ndarray, side: int) -> np.ndarray:
    """One parameter moved by a normal step: 8 % of the longer side, or 0.3 radians for an angle."""
    out = p.copy()
    i = int(rng.integers(len(p)))
    out[i] += rng.normal() * (0.3 if len(p) == 5 and i == 4 else 0.08 * side)
    if len(p) < 6 and i in (2, 3):
        out[i] = max(0.5, out[i])
    return out


@dataclass
class Canvas:
    """Target, current colours in float64, optional weights, and the running weighted error."""

    target: np.ndarray
    current: np.ndarray
    weight: np.ndarray
    shapes: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.error = self.full()
        #: Per pixel, summed over its channels or for each: w, w R, w c, 2 w R c, w c c, with R the residual
        #: and c the current colour. An overlay of alpha a changes the error by sums of these times a and a a.
        self.planes = np.empty((*self.weight.shape, 9))
        self.refresh(slice(None), slice(None))

    def refresh(self, ys: slice, xs: slice) -> None:
        """Bring the planes of a window up to date after its colours changed."""
        w, c = self.weight[ys, xs][..., None], self.current[ys, xs]
        r = self.target[ys, xs] - c
        self.planes[ys, xs] = np.concatenate([w, w * r, w * c, 2 * (w * r * c).sum(2, keepdims=True), (w * c * c).sum(2, keepdims=True)], 2)

    @staticmethod
    def best_color(square: float, toward: list[float], rest: float) -> tuple[float, list[float]]:
        """(change of the error, colour) for the sums of w a a, w a (R + a c), and 2 w a R c + w a a c c."""
        i, j, k = toward
        r, g, b = (min(255.0, max(0.0, float(math.floor(v / square + 0.5)))) for v in toward) if square > 1e-12 else (0.0, 0.0, 0.0)
        return rest - 2 * (r * i + g * j + b * k) + (r * r + g * g + b * b) * square, [r, g, b]

    def full(self) -> float:
        return float((((self.target - self.current) ** 2).sum(2) * self.weight).sum())

    def score(self, error: float | None = None) -> float:
        n = float(self.weight.sum())
        return math.sqrt(max(0.0, self.error if error is None else error) / (3 * n)) / 255 if n else 0.0

    def evaluate(self, kind: str, p: np.ndarray, alpha: float, max_area: float, max_extent: float) -> tuple[float, np.ndarray] | None:
        """(error if the shape were added, its best colour); None if it breaks the caps."""
        h, w, _ = self.target.shape
        found = mask_of(kind, p, w, h, max_extent)
        if not found:
            return None
        ys, xs, m = found
        if np.count_nonzero(m) > max_area:
            return None
        v = np.add.reduce(self.planes[ys, xs][m], 0).tolist()
        two = alpha * alpha
        change, color = self.best_color(two * v[0], [alpha * v[i] + two * v[i + 3] for i in (1, 2, 3)], alpha * v[7] + two * v[8])
        return self.error + change, np.array(color)

    def commit(self, kind: str, p: np.ndarray, color: np.ndarray, alpha: float, error: float) -> None:
        h, w, _ = self.target.shape
        ys, xs, m = mask_of(kind, p, w, h)
        part = self.current[ys, xs]
        part[m] = part[m] * (1 - alpha) + color * alpha
        self.refresh(ys, xs)
        self.error = error
        self.shapes.append((kind, [float(v) for v in p], *(int(v) for v in color), alpha, self.score()))


def error_cells(canvas: Canvas, block: int) -> list[tuple[float, int, int, int, int]]:
    e = ((canvas.target - canvas.current) ** 2).sum(2) * canvas.weight
    h, w = e.shape
    rows = np.add.reduceat(np.add.reduceat(e, np.arange(0, h, block), 0), np.arange(0, w, block), 1)
    return [(float(rows[r, c]), c * block, r * block, min(block, w - c * block), min(block, h - r * block)) for r in range(rows.shape[0]) for c in range(rows.shape[1])]


def worst_place(canvas: Canvas, o: Options, rng: np.random.Generator) -> tuple[float, float, float, float, float, float] | None:
    """(x, y, w, h, largest area, largest extent) around one of the worst cells, by roulette over their errors."""
    h, w, _ = canvas.target.shape
    cells = sorted(error_cells(canvas, o.block), key=lambda c: (-c[0], c[2], c[1]))[: o.top_k]
    total = sum(c[0] for c in cells)
    if total <= 0:
        return None
    at = rng.random() * total
    for cell in cells:
        at -= cell[0]
        if at <= 0:
            break
    _, x, y, cw, ch = cell
    gx, gy = cw * (o.expand - 1) / 2, ch * (o.expand - 1) / 2
    extent = min(0.22 * max(w, h), 2.5 * max(cw, ch) * o.expand) if max(w, h) > 64 else max(w, h)
    return x - gx, y - gy, cw * o.expand, ch * o.expand, min(o.max_area * w * h, max(9 * cw * ch, 256)), extent


def step(canvas: Canvas, o: Options, number: int, img_id: int) -> bool:
    """Worst cells -> roulette -> random tries there -> hill climb -> keep if the score falls.

    With ``everywhere`` the tries fall on the whole image, with the effort of such a step.
    """
    h, w, _ = canvas.target.shape
    rng = np.random.Generator(np.random.Philox(key=[(o.seed << 32) ^ (img_id & 0xFFFFFFFF), number]))
    place = (0.0, 0.0, float(w), float(h), math.inf, math.inf) if o.everywhere else worst_place(canvas, o, rng)
    if not place:
        return False
    box, max_area, max_extent = place[:4], place[4], place[5]
    candidates, tries, patience = EVERYWHERE if o.everywhere else (o.candidates, o.tries, o.age)
    reach = max(w, h) if max(w, h) <= 64 or o.everywhere else int(max(box[2], box[3]))
    best: tuple | None = None
    for _ in range(candidates):
        kind = o.kinds[int(rng.integers(len(o.kinds)))]
        own: tuple | None = None
        for _ in range(tries):
            p = random_shape(rng, kind, box)
            e = canvas.evaluate(kind, p, o.alpha, max_area, max_extent)
            if e and (own is None or e[0] < own[0]):
                own = (e[0], p, e[1])
        age = 0
        while own and age < patience:
            p = mutate(rng, own[1], reach)
            e = canvas.evaluate(kind, p, o.alpha, max_area, max_extent)
            age += 1
            if e and e[0] < own[0]:
                own, age = (e[0], p, e[1]), 0
        if own and (best is None or own[0] < best[0]):
            best = (own[0], kind, own[1], own[2])
    if not best or canvas.score(best[0]) >= canvas.score() - o.epsilon:
        return False
    canvas.commit(best[1], best[2], best[3], o.alpha, best[0])
    return True


def refine(canvas: Canvas, o: Options, img_id: int) -> list[dict]:
    """Steps until budget, stall, plateau or target; the history has one row per step."""
    history, accepted, stalls = [], [canvas.score()], 0
    limit = max(40, math.floor(0.4 * o.budget))
    for i in range(o.budget):
        ok = step(canvas, o, i, img_id)
        stalls = 0 if ok else stalls + 1
        if ok:
            accepted.append(canvas.score())
        history.append({"i": i, "added": len(canvas.shapes), "score": canvas.score(), "improved": ok})
        flat = len(accepted) > o.plateau_window and accepted[-1 - o.plateau_window] > 0 and (accepted[-1 - o.plateau_window] - accepted[-1]) / accepted[-1 - o.plateau_window] < o.plateau_gain
        met = ok and o.close is not None and len(canvas.shapes) % CHECK == 0 and o.close(canvas)
        if stalls >= limit or flat or met or canvas.score() <= o.target:
            break
    return history


def prune(canvas: Canvas, seed: np.ndarray, gain: float = 0.0008) -> Canvas:
    """Replay the shapes from the seed canvas, recolour each, and keep those that still lower the score enough."""
    out = Canvas(canvas.target, seed.copy(), canvas.weight)
    for kind, p, _, _, _, alpha, _ in canvas.shapes:
        e = out.evaluate(kind, np.array(p), alpha, np.inf, np.inf)
        if e and out.score() > 0 and (out.score() - out.score(e[0])) / out.score() > gain:
            out.commit(kind, np.array(p), e[1], alpha, e[0])
    return out


def unpacked(t: pa.Table, name: str, row: int) -> np.ndarray:
    return np.frombuffer(t[name][row].as_py(), np.uint8).reshape(t["height"][row].as_py(), t["width"][row].as_py(), 3).astype(np.float64)


def refine_images(packed: DataFrame, o: Options, with_prune: bool = False) -> DataFrame:
    """packed(img_id, width, height, data, canvas) -> shapes in drawing order."""

    def one(img_id: int, t: pa.Table) -> list[tuple]:
        target, seed = unpacked(t, "data", 0), unpacked(t, "canvas", 0)
        canvas = Canvas(target, seed.copy(), np.ones(target.shape[:2]))
        refine(canvas, o, img_id)
        if with_prune:
            thin = prune(canvas, seed)
            canvas = thin if thin.score() <= 1.12 * canvas.score() else canvas
        return canvas.shapes

    return _grouped(packed, one)


def _grouped(packed: DataFrame, one: Callable[[int, pa.Table], list[tuple]]) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        img_id = key[0].as_py()
        shapes = one(img_id, t)
        cols = list(zip(*shapes, strict=True)) if shapes else [()] * 7
        names = ["kind", "p", "r", "g", "b", "alpha", "score"]
        kinds = [pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table({"img_id": pa.array([img_id] * len(shapes), pa.int64()), "seq": pa.array(range(len(shapes)), pa.int32()), **{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)}})

    ship(packed.sparkSession)
    return packed.groupBy("img_id").applyInArrow(run, SHAPE_SCHEMA)


# ---------------------------------------------------------------- splats

# Reach in standard deviations, least deviation, largest alpha; the profile's knots over the reach.
CUTOFF, MIN_SD, MAX_ALPHA = 2.5, 1.2, 0.95
KNOTS = np.array([0.0, 0.25, 0.5, 0.75, 1.0])
PROFILE = np.append(np.exp(-((CUTOFF * KNOTS[:-1]) ** 2) / 2), 0.0)
# Planes of a canvas that a splat's alpha multiplies, and those that its square does.
SPLAT_PLANES = [1, 2, 3, 7], [0, 4, 5, 6, 8]


def splat_weights(p: list[float], width: int, height: int) -> tuple[slice, slice, np.ndarray] | None:
    """(rows, columns, alpha) of a Gaussian splat (cx, cy, sx, sy, theta, a), zero at the cutoff."""
    cx, cy, sx, sy, theta, a = p
    reach = CUTOFF * max(sx, sy)
    x0, x1 = max(0, math.floor(cx - reach)), min(width - 1, math.ceil(cx + reach))
    y0, y1 = max(0, math.floor(cy - reach)), min(height - 1, math.ceil(cy + reach))
    if x0 > x1 or y0 > y1:
        return None
    x, y = numbers(width, 0.0)[x0 : x1 + 1] - cx, numbers(height, 0.0)[y0 : y1 + 1, None] - cy
    co, si = math.cos(theta) / CUTOFF, math.sin(theta) / CUTOFF
    u, v = x * (co / sx) + y * (si / sx), y * (co / sy) - x * (si / sy)
    u *= u
    v *= v
    u += v
    w = np.interp(np.sqrt(u, out=u), KNOTS, PROFILE, right=0.0)
    w *= a
    return slice(y0, y1 + 1), slice(x0, x1 + 1), w


def splat_fit(canvas: Canvas, img_id: int, budget: int = 60, seed: int = 1, tries: int = 48, age: int = 40, block: int = 16) -> None:
    """Add splats while each lowers the error; a quarter of the proposals have the image's scale."""
    h, w, _ = canvas.target.shape
    # the canvas's planes, those times a first, then those times a a, each one lying together; a window of them is
    # copied so that sums run in the order of its rows and columns
    first, second = (np.ascontiguousarray(np.moveaxis(canvas.planes[..., k], 2, 0)) for k in SPLAT_PLANES)

    def value(p: list[float]) -> tuple[float, list[float]] | None:
        found = splat_weights(p, w, h)
        if not found:
            return None
        ys, xs, a = found
        i, j, k, rest = np.einsum("ij,ijk->k", a, first[:, ys, xs].copy().transpose(1, 2, 0)).tolist()
        a *= a
        square, l, m, n, more = np.einsum("ij,ijk->k", a, second[:, ys, xs].copy().transpose(1, 2, 0)).tolist()  # noqa: E741
        change, color = canvas.best_color(square if square >= 1e-6 else 0.0, [i + l, j + m, k + n], rest + more)
        return canvas.error + change, color

    stalls = 0
    for number in range(budget):
        rng = np.random.Generator(np.random.Philox(key=[(seed << 32) ^ (img_id & 0xFFFFFFFF), 1_000_000 + number]))
        cells = sorted(error_cells(canvas, block), key=lambda c: (-c[0], c[2], c[1]))[:8]
        if not cells or cells[0][0] <= 0:
            return
        best: tuple | None = None
        for k in range(tries):
            _, x, y, cw, ch = cells[int(rng.integers(len(cells)))]
            scale = max(w, h) / 4 if k % 4 == 0 else 1.5 * max(cw, ch)
            p = [x + rng.random() * cw, y + rng.random() * ch, max(MIN_SD, rng.random() * scale), max(MIN_SD, rng.random() * scale), rng.random() * math.pi, 0.3 + 0.6 * rng.random()]
            e = value(p)
            if e and (best is None or e[0] < best[0]):
                best = (e[0], p, e[1])
        misses = 0
        while best and misses < age:
            p = best[1].copy()
            i = int(rng.integers(6))
            p[i] += rng.normal() * (0.3, 0.3, 0.3, 0.3, 0.3, 0.1)[i] * (max(2.0, p[2]) if i < 4 else 1)
            p[2:4] = max(MIN_SD, p[2]), max(MIN_SD, p[3])
            p[5] = min(MAX_ALPHA, max(0.03, p[5]))
            e = value(p)
            misses += 1
            if e and e[0] < best[0]:
                best, misses = (e[0], p, e[1]), 0
        if best and best[0] < canvas.error * (1 - 1e-6):
            ys, xs, a = splat_weights(best[1], w, h)
            canvas.current[ys, xs] = canvas.current[ys, xs] * (1 - a[..., None]) + np.array(best[2]) * a[..., None]
            canvas.refresh(ys, xs)
            for own, k in zip((first, second), SPLAT_PLANES, strict=True):
                own[:, ys, xs] = np.moveaxis(canvas.planes[ys, xs][..., k], 2, 0)
            canvas.error = best[0]
            canvas.shapes.append(("splat", [float(v) for v in best[1]], *(int(v) for v in best[2]), float(best[1][5]), canvas.score()))
            stalls = 0
        else:
            stalls += 1
            if stalls >= max(30, math.floor(0.35 * budget)):
                return


def splat_images(packed: DataFrame, budget: int = 20, seed: int = 1, tries: int = 48) -> DataFrame:
    """packed(img_id, width, height, data, canvas) -> splats in drawing order."""

    def one(img_id: int, t: pa.Table) -> list[tuple]:
        target = unpacked(t, "data", 0)
        canvas = Canvas(target, unpacked(t, "canvas", 0).copy(), np.ones(target.shape[:2]))
        splat_fit(canvas, img_id, budget, seed, tries)
        return canvas.shapes

    return _grouped(packed, one)


def evaluate_shapes(packed: DataFrame, shapes: DataFrame, alpha: float = 0.5, max_area: float = np.inf) -> DataFrame:
    """(img_id, seq, score, r, g, b): each shape tried alone on its image's canvas (area cap only, no extent cap).

    One group is one image with the shapes to try on it.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            target = unpacked(left, "data", 0)
            canvas = Canvas(target, unpacked(left, "canvas", 0), np.ones(target.shape[:2]))
            for seq, kind, p in zip(right["seq"].to_pylist(), right["kind"].to_pylist(), right["p"].to_pylist(), strict=True):
                e = canvas.evaluate(kind, np.array(p), alpha, max_area, np.inf)
                if e:
                    rows.append((seq, canvas.score(e[0]), *(int(v) for v in e[1])))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        names = [("seq", pa.int32()), ("score", pa.float64()), ("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32())]
        return pa.table({"img_id": pa.array([key[0].as_py()] * len(rows), pa.int64()), **{n: pa.array(c, k) for (n, k), c in zip(names, cols, strict=True)}})

    ship(packed.sparkSession)
    return packed.groupBy("img_id").cogroup(shapes.groupBy("img_id")).applyInArrow(run, "img_id long, seq int, score double, r int, g int, b int")
