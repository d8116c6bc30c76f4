"""Queries on tables whose last image ends early, lacks rows or repeats some, against their SQL; work of few bytes and many rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel import registry
from rastrel.operators import vectorize
from rastrel.plans import convert


def rows(table, columns):
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns])))


def against_sql(spark, folder, table, name):
    got = registry.queries()[name](spark, str(folder)).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).to_arrow_table()
    return rows(got, sorted(want.column_names)), rows(want, sorted(want.column_names))


# rows of the last image: 1 to 3 past a cell's edge, or 57 to 63, leave places that have cells but no pixels
@pytest.mark.parametrize("ids", [[*range(64), *range(64, 64 + 18)], [*range(61)], [v for v in range(64) if v not in (20, 41)], [*range(40), 5, 5]], ids=["18 rows", "61 rows", "two rows missing", "a row thrice"])
def test_bilinear_up_gives_the_pixels_there_are(spark, tmp_path, ids):
    vectors = [(i, [((i * 31 + k * 17) % 97) / 97 - 0.5 for k in range(64)]) for i in ids]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet.d"))
    next((tmp_path / "embeddings.parquet.d").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got, want = against_sql(spark, tmp_path, "embeddings", "bilinear_up")
    assert want and got == want


def test_size_governor_broadcasts_nothing(spark, tmp_path):
    # few bytes of files hold rows of every part: planned by file sizes, both sides looked small enough for the driver
    parts = spark.range(0, 5000).selectExpr("id AS p_partkey")
    parts.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "part.parquet")
    df = registry.queries()["size_governor"](spark, str(tmp_path))
    got, want = against_sql(spark, tmp_path, "part", "size_governor")
    assert len(want) == 5000 and got == want
    df.toArrow()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_conversion_runs_are_many_tasks(spark):
    # few bytes, much work: adaptive execution put all runs into one task
    plan = {"quality": "draft", "type": "photo", "preset": "poster", "alpha": 0.8, "budget": 1, "saliency": False, "smooth_share": 0.0, "texture": 0.0, "glyphs": 0}
    one = [F.lit(v).alias(k) for k, v in plan.items()]
    packed = [F.lit(12).alias("width"), F.lit(12).alias("height"), F.expr("cast(repeat(chr(int(64 + id)), 432) AS binary)").alias("data"), F.lit(None).cast("binary").alias("weight")]
    runs = spark.range(12).select(F.col("id").alias("img_id"), F.lit("base").alias("candidate"), F.lit(1).alias("ord"), F.lit(1.0).alias("bias"), *one, *packed)
    tasks = convert.converge(runs).select("img_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["img_id"] for r in tasks) == list(range(12))
    assert len({r["task"] for r in tasks}) >= 6


def test_splat_run_that_follows_its_base_run_is_the_run_alone(spark):
    plan = {"quality": "draft", "type": "photo", "preset": "poster", "alpha": 0.8, "budget": 6, "saliency": False, "smooth_share": 0.0, "texture": 0.0, "glyphs": 0}
    y, x = np.mgrid[:24, :24]
    noise = np.random.default_rng(1).integers(0, 256, (24, 24, 3)).astype(np.uint8)
    dots = np.stack([255 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 30) for a, b in ((6, 7), (17, 8), (12, 18))], 2).astype(np.uint8)
    rows = [{**plan, "img_id": i, "candidate": c, "ord": o, "bias": 1.0, "width": 24, "height": 24, "data": v.tobytes(), "weight": None} for i, v in enumerate((noise, dots)) for o, c in ((1, "base"), (2, "splat"))]
    kinds = {"img_id": "long", "candidate": "string", "ord": "int", "bias": "double", "width": "int", "height": "int", "data": "binary", "weight": "binary", "budget": "int", "glyphs": "long", "saliency": "boolean", "alpha": "double", "smooth_share": "double", "texture": "double"}
    runs = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in rows[0]))
    got = {(r["img_id"], r["candidate"]): r for r in convert.converge(runs).collect()}
    assert len(got) == 4
    for r in rows:
        alone = vectorize.vectorize(np.frombuffer(r["data"], np.uint8).reshape(24, 24, 3).astype(float), r["img_id"], convert.run_plan(r, {}))
        own = got[r["img_id"], r["candidate"]]
        assert (own["svg"], own["score"], own["shapes"], own["base"]) == (alone.svg, alone.score, alone.shapes, alone.base)
        assert [h["score"] for h in own["history"]] == [h["score"] for h in alone.history]
    assert {"splats" in got[i, "splat"]["base"] for i in (0, 1)} == {False, True}
