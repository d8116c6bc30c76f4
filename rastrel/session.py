"""Getting this package to the executors' Python workers, and durable tables between stages."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch between the JVM and a Python worker; both sides hold a few at a time.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Bound the batches sent to Python workers (a setting of the session from then on), and send the package's
    sources with the application unless workers already find them on PYTHONPATH."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT.parent) in paths:
        return
    archive = Path(tempfile.mkdtemp(prefix="rastrel-")) / "rastrel_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))


#: Partitions for each core of a frame whose rows are long work.
SHARES = 8


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over many partitions by ``keys``, for rows of few bytes and much work: adaptive execution, which sees
    bytes only, would join their partitions into one task, but leaves a stated number of partitions alone."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SHARES * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


# ---------------------------------------------------------------- durable tables

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where that is
    unset, a local master gets a folder of its own; a cluster has none and must be given one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rastrel-shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, each row is computed
    once, and a lost executor costs no recomputation of what came before. The write's shuffle files go
    with it, and so do the tables of earlier cuts in ``spent``, which nothing else may read later."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/rastrel-{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.select("*").write.option("compression", "zstd").parquet(path)
    release(*spent)
    out = spark.read.schema(schema).parquet(path)
    out.rastrel_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the tables behind frames that ``cut`` returned; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("rastrel_path", None)
        if path:
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
