"""Regions: connected components, merging, borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .neighbours import adjacency
from .signals import by_column, by_row


def label_runs(y: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """4-connected components of equal labels over scattered pixels; ids by first pixel in scan order."""
    order = np.lexsort((x, y))
    y, x, label = y[order], x[order], label[order]
    n = len(y)
    if n:  # a tile's own grid, wherever it lies
        y, x = y - y.min(), x - x.min()
    width = int(x.max()) + 2 if n else 1
    at = np.full((int(y.max()) + 2 if n else 1) * width, -1, np.int64)
    flat = y.astype(np.int64) * width + x
    at[flat] = np.arange(n)
    edges = []
    for step, inside in ((1, x + 1 < width), (width, np.ones(n, bool))):
        other = np.where(inside, at[np.minimum(flat + step, len(at) - 1)], -1)
        ok = (other >= 0) & (flat + step < len(at))
        ok[ok] &= label[other[ok]] == label[np.flatnonzero(ok)]
        edges.append(np.stack([np.flatnonzero(ok), other[ok]]))
    a, b = np.concatenate(edges, 1)
    root = np.arange(n)
    while True:  # pointers to the smaller root, halved until nothing moves
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    ids = np.zeros(n, np.int64)
    firsts = np.flatnonzero(root == np.arange(n))
    ids[firsts] = np.arange(len(firsts))
    out = np.empty(n, np.int64)
    out[order] = ids[root]
    return out


def components(labels: DataFrame) -> DataFrame:
    """labels(img_id, y, x, label) with ``comp``; a group is one image."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        comp = label_runs(*(t[k].to_numpy() for k in ("y", "x", "label")))
        return t.select(["img_id", "y", "x", "label"]).append_column("comp", pa.array(comp))

    ship(labels.sparkSession)
    kind = dict(labels.dtypes)["label"]
    return labels.select("img_id", "y", "x", "label").groupBy("img_id").applyInArrow(run, f"img_id long, y int, x int, label {kind}, comp long")


def tiled_components(labels: DataFrame, tile: int = 256) -> DataFrame:
    """Components of images too large for one task: label tiles apart, then join labels across tile borders.

    ``comp`` is the smallest (tile, local id) code of the component rather than a scan-order number.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        comp = label_runs(*(t[k].to_numpy() for k in ("y", "x", "label")))
        code = np.int64(key[1].as_py()) * (1 << 40) + np.int64(key[2].as_py()) * (1 << 20) + comp
        return t.select(["img_id", "y", "x", "label"]).append_column("local", pa.array(code))

    ship(labels.sparkSession)
    kind = dict(labels.dtypes)["label"]
    v = labels.select("img_id", "y", "x", "label", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    local = v.groupBy("img_id", "ty", "tx").applyInArrow(run, f"img_id long, y int, x int, label {kind}, local long")
    local = cut(local)
    edge = local.where((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    near = edge.select("img_id", F.explode(F.array(F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x")))).alias("p"), F.col("label").alias("l2"), F.col("local").alias("m"))
    links = edge.join(near.select("img_id", "p.y", "p.x", "l2", "m"), ["img_id", "y", "x"]).where("label = l2 and local <> m").select("img_id", "local", "m").distinct()
    both = cut(links.unionByName(links.select("img_id", F.col("m").alias("local"), F.col("local").alias("m"))))
    root = cut(local.select("img_id", "local").distinct().withColumn("comp", F.col("local")))
    while True:  # one row per local component; each round follows every link once and halves pointers
        step = both.join(root.withColumnRenamed("local", "m").withColumnRenamed("comp", "c"), ["img_id", "m"]).groupBy("img_id", "local").agg(F.min("c").alias("c"))
        low = root.join(step, ["img_id", "local"], "left").select("img_id", "local", F.col("comp").alias("was"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        to = low.select("img_id", F.col("local").alias("comp"), F.col("comp").alias("cc"))
        new = cut(low.join(to, ["img_id", "comp"]).select("img_id", "local", F.col("cc").alias("comp"), (F.col("cc") < F.col("was")).alias("moved")), root)
        root = new
        if not new.where("moved").head(1):
            return local.join(root.drop("moved"), ["img_id", "local"]).drop("local")


#: Images of more pixels than this are labelled tile by tile.
TASK_PIXELS = 16_000_000


def labelled(labels: DataFrame, limit: int = TASK_PIXELS) -> DataFrame:
    """Components of every image: whole where an image fits a task, by tiles where it does not.

    Both number a component so that equal numbers of one image are one component; numbers of tiled images are codes.
    """
    size = labels.groupBy("img_id").agg(F.count("*").alias("n"))
    if not size.where(F.col("n") > limit).head(1):
        return components(labels)
    large = size.where(F.col("n") > limit).select("img_id")
    tiled = tiled_components(labels.join(large, "img_id", "left_semi"))
    return components(labels.join(large, "img_id", "left_anti")).unionByName(tiled.select("img_id", "y", "x", "label", "comp"))


def component_stats(comps: DataFrame) -> DataFrame:
    """Area, box, outer perimeter and stroke width of every component."""
    edge = lambda w, f: (f("comp").over(w).isNull() | (f("comp").over(w) != F.col("comp"))).cast("int")
    v = comps.withColumn("_p", edge(by_row(), F.lag) + edge(by_row(), F.lead)).withColumn("_p", F.col("_p") + edge(by_column(), F.lag) + edge(by_column(), F.lead))
    s = v.groupBy("img_id", "comp").agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.sum("_p").alias("perim"))
    return s.withColumn("stroke", F.round(2 * F.col("area") / F.col("perim"), 6))


def fragmentation(comps: DataFrame) -> DataFrame:
    """Share of the eight largest components, and whether the image is fragmented."""
    n = comps.groupBy("img_id", "comp").agg(F.count("*").alias("area"))
    rank = F.row_number().over(Window.partitionBy("img_id").orderBy(F.desc("area"), "comp"))
    s = n.withColumn("k", rank).groupBy("img_id").agg(F.count("*").alias("regions"), F.round(F.sum(F.when(F.col("k") <= 8, F.col("area")).otherwise(0)) / F.sum("area"), 6).alias("top8"))
    return s.withColumn("fragmented", (F.col("regions") > 40) | (F.col("top8") < 0.85))


def region_border(comps: DataFrame) -> DataFrame:
    """Border lengths between components."""
    return adjacency(comps.select("img_id", "y", "x", F.col("comp").alias("label")))


def merge_grid(grid: np.ndarray, least: int, rounds: int = 20) -> np.ndarray:
    """``grid`` of component numbers (-1: none) with small ones absorbed, smallest first, into the neighbour
    with the longest border (ties: the larger, then the lower id). Each absorption changes the next one's borders."""
    comp = grid[grid >= 0]
    area = dict(zip(*(v.tolist() for v in np.unique(comp, return_counts=True)), strict=True))
    border: dict[int, dict[int, int]] = {c: {} for c in area}
    for a, b in ((grid[:, :-1], grid[:, 1:]), (grid[:-1], grid[1:])):
        ok = (a != b) & (a >= 0) & (b >= 0)
        pairs, n = np.unique(np.stack([a[ok], b[ok]], 1), axis=0, return_counts=True)
        for (p, q), k in zip(pairs.tolist(), n.tolist(), strict=True):
            border[p][q] = border[p].get(q, 0) + k
            border[q][p] = border[q].get(p, 0) + k
    into: dict[int, int] = {}
    for _ in range(rounds):
        small = sorted((c for c, n in area.items() if n < least and border[c]), key=lambda c: (area[c], c))
        done = False
        for c in small:
            if c not in area or area[c] >= least or not border[c]:
                continue
            to = max(border[c], key=lambda o: (border[c][o], area[o], -o))
            into[c] = to
            area[to] += area.pop(c)
            for o, n in border.pop(c).items():
                border[o].pop(c, None)
                if o != to:
                    border[o][to] = border[o].get(to, 0) + n
                    border[to][o] = border[to].get(o, 0) + n
            done = True
        if not done:
            break

    def last(c: int) -> int:
        while c in into:
            c = into[c]
        return c

    names = np.arange(int(grid.max(initial=-1)) + 2)
    for c in into:
        names[c] = last(c)
    return np.where(grid >= 0, names[grid], -1)


def merge_small(comps: DataFrame, least: int, rounds: int = 20) -> DataFrame:
    """Components below ``least`` pixels absorbed by their neighbours, image by image."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        y, x, comp = (t[k].to_numpy() for k in ("y", "x", "comp"))
        kinds, place = np.unique(comp, return_inverse=True)
        grid = np.full((y.max() + 1, x.max() + 1), -1, np.int64)
        grid[y, x] = place
        return pa.table({"img_id": t["img_id"], "y": t["y"], "x": t["x"], "comp": pa.array(kinds[merge_grid(grid, least, rounds)[y, x]])})

    ship(comps.sparkSession)
    return comps.select("img_id", "y", "x", "comp").groupBy("img_id").applyInArrow(run, "img_id long, y int, x int, comp long")


def grid_components(label: np.ndarray) -> np.ndarray:
    """4-connected components of a whole image's labels, numbered in scan order."""
    y, x = np.indices(label.shape)
    return label_runs(y.ravel(), x.ravel(), label.ravel()).reshape(label.shape)


def grid_edges(grid: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
    """Directed unit edges (ax, ay, bx, by) around every component, the component on the right hand."""
    wide = np.pad(grid, 1, constant_values=-1)
    here, out = wide[1:-1, 1:-1], {}
    sides = ((wide[:-2, 1:-1], (0, 0, 1, 0)), (wide[1:-1, 2:], (1, 0, 1, 1)), (wide[2:, 1:-1], (1, 1, 0, 1)), (wide[1:-1, :-2], (0, 1, 0, 0)))
    for other, (ax, ay, bx, by_) in sides:
        ys, xs = np.nonzero((other != here) & (here >= 0))
        for c, x, y in zip(here[ys, xs].tolist(), xs.tolist(), ys.tolist(), strict=True):
            out.setdefault(c, []).append((x + ax, y + ay, x + bx, y + by_))
    return out


def boundary_edges(comps: DataFrame) -> DataFrame:
    """Directed unit edges around every component, the component on the right hand (clockwise in image axes)."""
    off = lambda w, f: f("comp").over(w).isNull() | (f("comp").over(w) != F.col("comp"))
    v = comps.withColumn("l", off(by_row(), F.lag)).withColumn("r", off(by_row(), F.lead))
    v = v.withColumn("t", off(by_column(), F.lag)).withColumn("d", off(by_column(), F.lead))
    e = lambda cond, ax, ay, bx, by_: F.when(cond, F.struct((F.col("x") + ax).alias("ax"), (F.col("y") + ay).alias("ay"), (F.col("x") + bx).alias("bx"), (F.col("y") + by_).alias("by1")))
    edges = F.array(e(F.col("t"), 0, 0, 1, 0), e(F.col("r"), 1, 0, 1, 1), e(F.col("d"), 1, 1, 0, 1), e(F.col("l"), 0, 1, 0, 0))
    return v.select("img_id", "comp", F.explode(edges).alias("e")).where("e is not null").select("img_id", "comp", "e.ax", "e.ay", "e.bx", "e.by1")


def loops_of(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed loops of directed edges without straight vertices, longest first.

    At a corner with two ways out the loop turns right, so regions touching at a corner keep all edges.
    """
    ways: dict[tuple, list[tuple]] = {}
    for ax, ay, bx, by_ in sorted(edges):
        ways.setdefault((ax, ay), []).append((bx, by_))
    loops = []
    while ways:
        start = at = next(iter(ways))
        points, came = [], None
        while True:
            out = ways[at]
            if came is None or len(out) == 1:
                to = out.pop(0)
            else:
                turn = lambda q: came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0])  # noqa: B023, E731
                to = max(out, key=turn)
                out.remove(to)
            if not out:
                del ways[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != came:
                points.append(at)
            came, at = step, to
            if at == start:
                break
        if len(points) > 1 and (points[0][0] - points[-1][0] == 0) == (came[0] == 0) and (points[1][0] - points[0][0], points[1][1] - points[0][1])[0] * came[1] == came[0] * (points[1][1] - points[0][1]):
            points.pop(0)
        loops.append(points)
    loops.sort(key=lambda p: (-len(p), p))
    return loops


def trace_loops(edges: DataFrame) -> DataFrame:
    """(img_id, comp, loop, points): closed loops of boundary edges without straight vertices, longest first."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        loops = loops_of(list(zip(*(t[k].to_pylist() for k in ("ax", "ay", "bx", "by1")), strict=True)))
        n = len(loops)
        kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        return pa.table({"img_id": pa.array([key[0].as_py()] * n, pa.int64()), "comp": pa.array([key[1].as_py()] * n, pa.int64()), "loop": pa.array(range(n), pa.int32()), "points": pa.array([[{"x": x, "y": y} for x, y in p] for p in loops], kind)})

    ship(edges.sparkSession)
    return edges.groupBy("img_id", "comp").applyInArrow(run, "img_id long, comp long, loop int, points array<struct<x:int,y:int>>")
