"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (partial sums before the shuffle, so a source with a third of all rows
costs one row per task). Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; they
share the total by weight, and a target stops at ``LIMIT`` times its source's size with the excess
reshared until none is above. With ``T`` the total, that is target = min(LIMIT*size, level*weight)
for the one level at which the targets sum to T: starting with no source at its bound, the level is
what is left of T by the weight of the sources below their bounds, until no further source stops.
Sources are ranked by a range sort and the counts of its partitions, so any number of them may be mixed.
A document is taken floor(rate) times, plus once more if its hashed uniform is below the fraction.

Defined cases: null text has size 0; null source is a source of its own; a source of size 0 has
target 0; repeated rows with one doc_id decide alike; an empty table gives an empty result; long texts
only count as larger sizes. A row travels as one struct, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LIMIT = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the place of each source in code-point order, null last, from 0."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # one row per partition of the sort
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    placed = parts.withColumn("inside", inside).join(F.broadcast(offsets), "part")
    return cut(placed.select("source", "source_size", (F.col("before") + F.col("inside") - 1).alias("place")), parts)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, source_size), one per source."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    w = _ranked(sizes).withColumn("weight", weight).withColumn("bound", LIMIT * F.col("source_size"))
    total, weights = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total / weights if weights else 0.0), None
    while level != before:
        stopped = F.col("bound") / F.col("weight") < level
        bound, gone = w.where(stopped).agg(F.coalesce(F.sum("bound"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        before, level = level, ((total - bound) / (weights - gone) if weights and weights > gone else level)
    return w.select("source", "source_size", F.least(F.col("bound").cast("double"), level * F.col("weight")).alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone; the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of (row, doc_id, source, size) with source_size, target and copies: how often the mix takes each."""
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (uniform(F.col("doc_id"), seed) < rate - whole).cast("int")
    return out.withColumn("copies", F.least(whole + extra, F.lit(LIMIT)).cast("long"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: what the mix takes of it."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return with_copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    out = with_copies(sized).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 3 * source_size AS bound,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1 AS weight,
         sum(source_size) OVER () AS total
  FROM per
), levels AS (
  SELECT *, CAST(total - coalesce(sum(bound) OVER (ORDER BY bound / weight, source ASC NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY bound / weight, source ASC NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted
), picked AS (
  SELECT min(level) AS level FROM (
    SELECT level, row_number() OVER (ORDER BY bound / weight, level) AS k FROM levels WHERE level <= bound / weight) WHERE k = 1
), targets AS (
  SELECT source, source_size, coalesce(least(CAST(bound AS DOUBLE), p.level * weight), 0.0) AS target
  FROM levels CROSS JOIN picked p
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM rated
"""
