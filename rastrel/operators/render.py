"""Rendering documents back to pixels: this engine's own markup, sampled at pixel centres.

Covers what the engine emits: paths of lines and cubics, rectangles, ellipses and circles, groups with
transforms and opacity, flat fills and linear or radial gradients in user space. Elements are laid over
each other in document order. There is no anti-aliasing, so a measure of a rendered document is one of
exactly the pixels that the engine searched on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .paths import flatten, parse_path

_TAG = re.compile(r"<(/?)([A-Za-z]+)((?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_STEP = re.compile(r"(translate|scale|rotate|matrix)\(([^)]*)\)")
_URL = re.compile(r"url\(#([^)]+)\)")
SHAPES = ("path", "rect", "ellipse", "circle")


@dataclass
class Gradient:
    """A linear (x1, y1, x2, y2) or radial (cx, cy, r) gradient in user space with its stops."""

    radial: bool
    place: tuple[float, ...]
    matrix: np.ndarray = field(default_factory=lambda: np.eye(3))
    offsets: list[float] = field(default_factory=list)
    colors: list[tuple[int, int, int]] = field(default_factory=list)

    def paint(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        back = np.linalg.inv(self.matrix)
        x, y = back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2]
        if self.radial:
            cx, cy, r = self.place
            t = np.hypot(x - cx, y - cy) / max(r, 1e-9)
        else:
            x1, y1, x2, y2 = self.place
            dx, dy = x2 - x1, y2 - y1
            t = ((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-9)
        c = np.array(self.colors, float)
        return np.stack([np.interp(t, self.offsets, c[:, k]) for k in range(3)], -1)


@dataclass
class Element:
    tag: str
    geometry: dict[str, str]
    fill: tuple[int, int, int] | str
    alpha: float
    matrix: np.ndarray


@dataclass
class Document:
    width: int
    height: int
    elements: list[Element]
    gradients: dict[str, Gradient]


def color(text: str) -> tuple[int, int, int] | None:
    t = text.strip().lower()
    if re.fullmatch(r"#[0-9a-f]{3}", t):
        return tuple(int(c * 2, 16) for c in t[1:])
    if re.fullmatch(r"#[0-9a-f]{6}", t):
        return int(t[1:3], 16), int(t[3:5], 16), int(t[5:7], 16)
    return None


def matrix(text: str) -> np.ndarray:
    """The affine map of a transform attribute, 2 x 3."""
    out = np.eye(3)
    for kind, args in _STEP.findall(text or ""):
        v = [float(x) for x in re.split(r"[\s,]+", args.strip())]
        m = np.eye(3)
        if kind == "translate":
            m[:2, 2] = v[0], v[1] if len(v) > 1 else 0.0
        elif kind == "scale":
            m[0, 0], m[1, 1] = v[0], v[1] if len(v) > 1 else v[0]
        elif kind == "matrix":
            m[:2] = np.array(v).reshape(3, 2).T
        else:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            m[:2, :2] = [[c, -s], [s, c]]
            if len(v) == 3:
                m[:2, 2] = np.array(v[1:]) - m[:2, :2] @ np.array(v[1:])
        out = out @ m
    return out


def parse(svg: str) -> Document:
    """The painted elements of a document; clip paths are left out, the frame clips anyway."""
    width = height = 0
    elements: list[Element] = []
    gradients: dict[str, Gradient] = {}
    stack, clipped, current = [(np.eye(3), 1.0)], 0, None
    for close, tag, attributes, empty in _TAG.findall(svg):
        if tag == "clipPath":
            clipped += -1 if close else 1
            continue
        if close:
            if tag == "g":
                stack.pop()
            continue
        a = {k: v or w for k, v, w in _ATTRIBUTE.findall(attributes)}
        number = lambda k, d=0.0, a=a: float(a.get(k, d))
        if tag == "svg":
            box = [float(v) for v in a.get("viewBox", f"0 0 {a.get('width', 0)} {a.get('height', 0)}").split()]
            width, height = int(box[2]), int(box[3])
        elif tag in ("linearGradient", "radialGradient"):
            radial = tag == "radialGradient"
            place = tuple(number(k) for k in (("cx", "cy", "r") if radial else ("x1", "y1", "x2", "y2")))
            current = gradients[a["id"]] = Gradient(radial, place, matrix(a.get("gradientTransform", "")))
        elif tag == "stop" and current:
            offset = a.get("offset", "0")
            current.offsets.append(float(offset[:-1]) / 100 if offset.endswith("%") else float(offset))
            current.colors.append(color(a.get("stop-color", "#000000")) or (0, 0, 0))
        elif tag == "g" and not empty:
            m, alpha = stack[-1]
            stack.append((m @ matrix(a.get("transform", "")), alpha * number("opacity", 1.0)))
        elif tag in SHAPES and not clipped:
            m, alpha = stack[-1]
            url = _URL.match(a.get("fill", ""))
            fill = url[1] if url else color(a.get("fill", "#000000"))
            if fill is not None:
                elements.append(Element(tag, a, fill, alpha * number("fill-opacity", 1.0) * number("opacity", 1.0), m @ matrix(a.get("transform", ""))))
    return Document(width, height, elements, gradients)


def winding(loops: list[np.ndarray], width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """Coverage of closed loops at pixel centres: every edge steps the winding number right of it, row by row."""
    change = np.zeros((height, width + 1), np.int32)
    for p in loops:
        q = np.roll(p, -1, axis=0)
        for (ax, ay), (bx, by_) in zip(p.tolist(), q.tolist(), strict=True):
            if ay == by_:
                continue
            sign, lo, hi = (1, ay, by_) if ay < by_ else (-1, by_, ay)
            y0, y1 = max(0, math.ceil(lo - 0.5)), min(height, math.ceil(hi - 0.5))
            if y0 >= y1:
                continue
            rows = np.arange(y0, y1)
            x = ax + (rows + 0.5 - ay) * (bx - ax) / (by_ - ay)
            change[rows, np.clip(np.ceil(x - 0.5), 0, width).astype(int)] += sign
    total = np.cumsum(change[:, :-1], axis=1)
    return total % 2 == 1 if even_odd else total != 0


def coverage(e: Element, width: int, height: int) -> tuple[slice, slice, np.ndarray] | None:
    """(rows, columns, mask) of an element inside the frame."""
    v = lambda k, d=0.0: float(str(e.geometry.get(k, d)).rstrip("%"))
    if e.tag == "path":
        subs = parse_path(e.geometry.get("d", "")) or []
        loops = [flatten(s) @ e.matrix[:2, :2].T + e.matrix[:2, 2] for s in subs if s["segs"]]
        if not loops:
            return None
        p = np.concatenate(loops)
    else:
        if e.tag == "rect":
            full = e.geometry.get("width") == "100%"
            x, y, w, h = (0.0, 0.0, width, height) if full else (v("x"), v("y"), v("width"), v("height"))
            corners = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
        else:
            rx, ry = (v("r"), v("r")) if e.tag == "circle" else (v("rx"), v("ry"))
            corners = np.array([[v("cx") + i * rx, v("cy") + j * ry] for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
        p = corners @ e.matrix[:2, :2].T + e.matrix[:2, 2]
    x0, y0 = (max(0, math.floor(p[:, k].min())) for k in (0, 1))
    x1, y1 = (min(n, math.ceil(p[:, k].max()) + 1) for k, n in ((0, width), (1, height)))
    if x0 >= x1 or y0 >= y1:
        return None
    if e.tag == "path":
        mask = winding([q - (x0, y0) for q in loops], x1 - x0, y1 - y0, e.geometry.get("fill-rule") == "evenodd")
    elif e.tag == "rect":
        mask = winding([p - (x0, y0)], x1 - x0, y1 - y0)
    else:
        back = np.linalg.inv(e.matrix) if abs(np.linalg.det(e.matrix)) > 1e-12 else None
        if back is None:
            return None
        gx, gy = np.arange(x0, x1)[None, :] + 0.5, np.arange(y0, y1)[:, None] + 0.5
        u = (back[0, 0] * gx + back[0, 1] * gy + back[0, 2] - v("cx")) / max(rx, 1e-9)
        w = (back[1, 0] * gx + back[1, 1] * gy + back[1, 2] - v("cy")) / max(ry, 1e-9)
        mask = u * u + w * w <= 1
    return slice(y0, y1), slice(x0, x1), mask


def rasterize(svg: str, width: int | None = None, height: int | None = None, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Pixels (height, width, 3) in float64; another size than the document's is read at the nearest pixel."""
    doc = parse(svg)
    out = np.empty((doc.height, doc.width, 3))
    out[:] = background
    for e in doc.elements:
        found = coverage(e, doc.width, doc.height)
        if not found:
            continue
        ys, xs, mask = found
        part = out[ys, xs]
        if isinstance(e.fill, str):
            if e.fill not in doc.gradients:
                continue
            y, x = np.nonzero(mask)
            # gradients lie in the user space of their element
            back = np.linalg.inv(e.matrix)
            px, py = x + xs.start + 0.5, y + ys.start + 0.5
            ink = doc.gradients[e.fill].paint(back[0, 0] * px + back[0, 1] * py + back[0, 2], back[1, 0] * px + back[1, 1] * py + back[1, 2])
        else:
            ink = np.array(e.fill, float)
        part[mask] = part[mask] * (1 - e.alpha) + ink * e.alpha
    w, h = width or doc.width, height or doc.height
    if (w, h) != (doc.width, doc.height):
        out = out[(np.arange(h) * doc.height // h)[:, None], (np.arange(w) * doc.width // w)[None, :]]
    return out


def snapshot(canvas: np.ndarray) -> np.ndarray:
    """Stored bytes: rounded half to even and clamped."""
    return np.clip(np.rint(canvas), 0, 255).astype(np.uint8)


def render_documents(docs: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """docs(img_id, svg) as packed pixels (img_id, width, height, data); a null document is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, svg in zip(b.column("img_id").to_pylist(), b.column("svg").to_pylist(), strict=True):
                if svg is None:
                    continue
                a = snapshot(rasterize(svg, width, height))
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([a.shape[1]], pa.int32()), pa.array([a.shape[0]], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["img_id", "width", "height", "data"])

    ship(docs.sparkSession)
    return docs.select("img_id", "svg").mapInArrow(run, "img_id long, width int, height int, data binary")
