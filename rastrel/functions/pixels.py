"""Column helpers shared by the raster operators. Integers are kept until the last line of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def half_up(v: Column) -> Column:
    """Round half towards positive infinity, as a long."""
    return F.floor(v + F.lit(0.5)).cast("long")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def byte(v: Column) -> Column:
    """Round half to even and clamp to 0..255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v))).cast("int")


def luma(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    """Luma times 1000, exact."""
    return (c(r) * 299 + c(g) * 587 + c(b) * 114).cast("long")


def key4(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """12-bit colour key: four bits a channel."""
    top = [F.shiftright(F.col(x), 4) for x in (r, g, b)]
    return F.shiftleft(top[0], 8).bitwiseOR(F.shiftleft(top[1], 4)).bitwiseOR(top[2])


def key5(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """15-bit colour key: five bits a channel."""
    top = [F.shiftright(F.col(x), 3) for x in (r, g, b)]
    return F.shiftleft(top[0], 10).bitwiseOR(F.shiftleft(top[1], 5)).bitwiseOR(top[2])


def lattice(v: str | Column, levels: int) -> Column:
    """Channel value at the centre of its lattice cell."""
    step = 256 // levels
    return (F.floor(c(v) / step) * step + step // 2).cast("int")


def square(v: Column) -> Column:
    return v * v


def uniform(key: Column) -> Column:
    """A portable number in [0, 1) from a key's text."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def gaussian(u: Column, v: Column) -> Column:
    """A standard normal from two uniforms (u above 0)."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by_: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by_ - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, clamp(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy)
