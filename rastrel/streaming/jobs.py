"""Conversion jobs and their progress as streams.

A submit stream is validated and kept in state with a time to live; progress events are filtered to
the run that carries previews, throttled, and reduced to the latest row per job. The same transforms
run on batch tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.pixels import decode_data_url

PHASES = ("open", "queued", "analysis", "trace", "refine", "done", "error")
# Largest upload, jobs that may wait or run, seconds until an abandoned one is dropped, jobs that run at once.
MAX_BYTES, MAX_PENDING, TTL_SECONDS, ACTIVE = 25 * 1024 * 1024, 16, 300, 2
#: The JSON body of a request, and the columns of a progress event's JSON text.
REQUEST = "image string, quality string, saliency boolean, broken string"
EVENT = ("phase", "i", "budget", "added", "score", "svg", "rmse", "dssim", "base", "improved", "run")


def validated(submits: DataFrame) -> DataFrame:
    """submits(job_id, payload, quality, ts) -> accepted rows with their bytes."""
    data = decode_data_url(F.col("payload"))
    return submits.withColumn("data", data).where("data is not null").drop("payload")


def requests(raw: DataFrame) -> DataFrame:
    """raw(..., body) -> its other columns with status, quality, saliency and, where accepted, the image's bytes.

    400: no JSON, no image, or an empty one; 413: larger than MAX_BYTES; else 200.
    """
    r = F.from_json("body", REQUEST, {"columnNameOfCorruptRecord": "broken"})
    v = raw.withColumn("_r", r)
    code = F.element_at(F.split(F.col("_r.image"), ","), -1)
    data = F.try_to_binary(code, F.lit("base64"))
    bad = F.col("_r").isNull() | F.col("_r.broken").isNotNull() | F.col("_r.image").isNull() | (F.col("_r.image") == "")
    status = F.when(bad, 400).when(F.length(code) > MAX_BYTES // 3 * 4, 413).when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, 400).otherwise(200)
    v = v.withColumn("status", status.cast("int")).withColumn("quality", F.coalesce("_r.quality", F.lit("balanced"))).withColumn("saliency", F.col("_r.saliency"))
    return v.withColumn("data", F.when(F.col("status") == 200, data)).drop("_r", "body")


def event_json(events: DataFrame) -> DataFrame:
    """(job_id, seq, data): progress events as JSON text, with the fields a client may see; only run A carries markup."""
    seen = [c for c in EVENT if c in events.columns]
    cols = [F.when(F.col("run") == "A", F.col(c)).alias(c) if c == "svg" and "run" in events.columns else F.col(c) for c in seen]
    return events.select("job_id", "seq", F.to_json(F.struct(*cols)).alias("data"))


def reap(jobs: DataFrame, now: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Batch form: jobs(job_id, created, started) not yet started and older than the time to live are dropped."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created"))
    return jobs.where(F.col("started") | (age <= ttl))


def schedule(jobs: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """jobs(server, job_id, t, work, quits) -> (server, job_id, status, position, started, ended), all times in seconds.

    In order of arrival (t, then job_id): jobs that have ended or are older than ``ttl`` are forgotten; at
    MAX_PENDING remembered ones the answer is 429. ACTIVE jobs run at once, the others wait in line, and
    position is a job's place in it (0: it starts at once). A client that quits (at second ``quits``, or
    null) while waiting never starts; one that quits while running ends there. Each answer depends on the
    ones before, so it is a fold over a server's jobs.
    """
    order = F.array_sort(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), F.col("job_id").cast("long").alias("job_id"), F.col("work").cast("long").alias("work"), F.col("quits").cast("long").alias("quits"))))
    rows = jobs.groupBy("server").agg(order.alias("jobs"))
    live = "array<struct<t:bigint,started:bigint,ended:bigint>>"
    done = "array<struct<job_id:bigint,status:int,position:int,started:bigint,ended:bigint>>"
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), ACTIVE).alias("free"), F.array().cast(live).alias("live"), F.array().cast(done).alias("done"))

    def arrive(state: Column, j: Column) -> Column:
        kept = F.filter(state["live"], lambda x: (x["ended"] > j["t"]) & (j["t"] - x["t"] <= ttl))
        free = F.array_min(state["free"])
        begins = F.greatest(j["t"], free)
        gone = j["quits"].isNotNull() & (j["quits"] <= begins) & (begins > j["t"])
        left = F.when(j["quits"].isNotNull(), F.greatest(j["quits"], begins))  # least skips nulls
        ends = F.when(gone, j["quits"]).otherwise(F.least(begins + j["work"], left))
        full = F.size(kept) >= MAX_PENDING
        place = F.when(begins > j["t"], 1 + F.size(F.filter(kept, lambda x: x["started"] > j["t"]))).otherwise(0)
        answer = F.struct(
            j["job_id"].alias("job_id"), F.when(full, 429).otherwise(200).alias("status"), F.when(~full, place).alias("position"),
            F.when(~full & ~gone, begins).alias("started"), F.when(~full, ends).alias("ended"),
        )
        # one worker of those free first takes the job
        at = F.array_position(state["free"], free).cast("int")
        taken = F.transform(state["free"], lambda f, i: F.when(~full & ~gone & (i + 1 == at), ends).otherwise(f))
        more = F.array(F.struct(j["t"].alias("t"), begins.alias("started"), ends.alias("ended")))
        return F.struct(taken.alias("free"), F.when(full, kept).otherwise(F.concat(kept, more)).alias("live"), F.concat(state["done"], F.array(answer)).alias("done"))

    return rows.select("server", F.explode(F.aggregate("jobs", start, arrive)["done"]).alias("a")).select("server", "a.*")


def queue_depth(intervals: DataFrame, key: str = "server") -> DataFrame:
    """intervals(server, job_id, t0, t1) -> active jobs after each change: a running sum of +1 and -1."""
    up = intervals.select(key, F.col("t0").alias("t"), F.lit(1).alias("d"))
    down = intervals.select(key, F.col("t1").alias("t"), F.lit(-1).alias("d"))
    net = up.unionByName(down).groupBy(key, "t").agg(F.sum("d").alias("d"))
    return net.select(key, "t", F.sum("d").over(Window.partitionBy(key).orderBy("t")).alias("active"))


def progress_latest(events: DataFrame) -> DataFrame:
    """events(job_id, seq, phase, score) -> each job's last event; a max per job, so it is one partial aggregation."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "phase", "score")).alias("e"), F.count("*").alias("n")).select("job_id", "e.seq", "e.phase", "e.score", "n")


def throttled(events: DataFrame, every: int = 10) -> DataFrame:
    """events(job_id, seq, phase, i, budget, run) -> refine events at every tenth iteration and all other phases, with ``preview``.

    A refine event of run A carries a preview when its iteration is max(20, budget / 8) or more beyond the
    last one that did (from 0), which is a fold over a job's events.
    """
    rows = events.where((F.col("phase") != "refine") | (F.col("i") % every == 0))
    of_run = (F.col("phase") == "refine") & (F.col("run") == "A")
    step = F.greatest(F.lit(20), F.floor(F.col("budget") / 8)).cast("long")
    seen = rows.where(of_run).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("i").cast("long").alias("i"), step.alias("step")))).alias("es"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    fold = F.aggregate("es", start, lambda s, e: F.when(e["i"] - s["last"] >= e["step"], F.struct(e["i"].alias("last"), F.concat(s["kept"], F.array(e["seq"].cast("long"))).alias("kept"))).otherwise(s))
    kept = seen.select("job_id", F.explode(fold["kept"]).alias("seq")).withColumn("preview", F.lit(True))
    return rows.join(kept, ["job_id", "seq"], "left").withColumn("preview", F.coalesce("preview", F.lit(False)))


def stats(events: DataFrame) -> DataFrame:
    """Active, queued and finished jobs from their last events."""
    last = progress_latest(events)
    n = lambda c: F.count_if(c).alias
    return last.agg(n(F.col("phase").isin("analysis", "trace", "refine"))("active"), n(F.col("phase").isin("open", "queued"))("queued"), n(F.col("phase").isin("done", "error"))("finished"))


STATE = "created double, phase string, events long"
LATEST = "job_id long, phase string, events long, expired boolean"


def track(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Streaming state per job over events(job_id, phase, ts): the latest phase, or expiry after ``ttl`` seconds
    of event time without news. State goes when the job is done or expires."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, phase, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], phase, n, True)], columns=["job_id", "phase", "events", "expired"])
            return
        created, phase, n = state.get if state.exists else (0.0, "open", 0)
        latest = created
        for pdf in batches:
            for ts, p in sorted(zip(pdf["ts"], pdf["phase"], strict=True)):
                n += 1
                if ts.timestamp() >= latest:
                    latest, phase = ts.timestamp(), p
        if phase in ("done", "error"):
            if state.exists:
                state.remove()
        else:
            state.update((latest, phase, n))
            # a timeout must lie past the watermark; an old event's job expires at the next trigger
            state.setTimeoutTimestamp(max(int((latest + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], phase, n, False)], columns=["job_id", "phase", "events", "expired"])

    timed = events.select(F.col("job_id").cast("long").alias("job_id"), "phase", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 minute")
    return timed.groupBy("job_id").applyInPandasWithState(update, LATEST, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_progress(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events per phase and window of event time; later ones than ``late`` are dropped when streaming."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "phase").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "phase", "n")


# ---------------------------------------------------------------- queue as a stream, cancellation

QUEUE_STATE = "jobs array<struct<job_id:bigint,t:double,active:boolean>>"
QUEUE_EVENTS = "server string, job_id long, event string, position int"


def queue_events(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Streaming admission over events(server, job_id, kind, ts); kind is submit, done or quit.

    State is each server's line of jobs. Submits are answered ``rejected`` (429), ``started`` or ``queued``
    with their place; when a running job is done or quits, or is older than ``ttl``, the next in line is started.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = [list(j) for j in (state.get[0] if state.exists else [])]
        out: list[tuple] = []

        def start_next() -> None:
            while sum(j[2] for j in line) < ACTIVE and (waiting := [j for j in line if not j[2]]):
                waiting[0][2] = True
                out.append((key[0], waiting[0][0], "started", 0))

        rows = sorted((r.ts.timestamp(), int(r.job_id), r.kind) for pdf in batches for r in pdf.itertuples())
        for t, job, kind in rows:
            line[:] = [j for j in line if t - j[1] <= ttl]
            if kind != "submit":
                line[:] = [j for j in line if j[0] != job]
            elif len(line) >= MAX_PENDING:
                out.append((key[0], job, "rejected", 0))
            else:
                line.append([job, t, False])
                if sum(j[2] for j in line) >= ACTIVE:
                    out.append((key[0], job, "queued", sum(not j[2] for j in line)))
            start_next()
        state.update(([tuple(j) for j in line],))
        yield pd.DataFrame(out, columns=["server", "job_id", "event", "position"])

    timed = events.select("server", F.col("job_id").cast("long").alias("job_id"), "kind", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("server").applyInPandasWithState(update, QUEUE_EVENTS, QUEUE_STATE, "append", GroupStateTimeout.NoTimeout)


def run_job(spark: SparkSession, job_id: str, action: Callable[[], object]) -> object:
    """Run ``action`` with all its Spark work tagged, so that ``cancel_job`` from another thread ends it."""
    spark.sparkContext.addJobTag(f"rastrel-{job_id}")
    try:
        return action()
    finally:
        spark.sparkContext.removeJobTag(f"rastrel-{job_id}")


def cancel_job(spark: SparkSession, job_id: str) -> None:
    """End a job whose client has gone; its running action raises."""
    spark.sparkContext.cancelJobsWithTag(f"rastrel-{job_id}")
