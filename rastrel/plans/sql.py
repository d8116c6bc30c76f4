"""Common table expressions of the SQL that checks the raster queries."""

from __future__ import annotations


def _channel(k: int) -> str:
    return f"CAST(least(255, greatest(0, floor(CAST(embedding[(i + {21 * k}) % 64 + 1] AS DOUBLE) * 256 + 128))) AS INTEGER)"


PX = f"""px AS (
  SELECT CAST(vec_id // 64 AS BIGINT) AS img_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i AS INTEGER) AS x,
         {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b
  FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"""
CANVAS = """canvas AS (
  SELECT *, CAST(r // 64 * 64 + 32 AS INTEGER) AS cr, CAST(g // 64 * 64 + 32 AS INTEGER) AS cg,
         CAST(b // 64 * 64 + 32 AS INTEGER) AS cb FROM px)"""
LUMA = "luma AS (SELECT img_id, y, x, CAST(299 * r + 587 * g + 114 * b AS BIGINT) AS l FROM px)"
SQ = "((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb))"


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """The pixel views, further expressions, and the query proper."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([PX, CANVAS, LUMA, *ctes]) + "\n" + body
