"""Substring deduplication on a de Bruijn graph of word k-mers.

A node is a sequence of 12 words, an edge a window of 13: the graph of the corpus has an edge for each
distinct window. Only edges that occur in two documents matter, so the rest is never written out.

1. Seeds. Edges are partitioned by their minimizer, the smallest hashed ``SEED_WORDS``-gram inside them;
   one that occurs in one document alone has no repeated edge. Each document's are written once; seeds
   are found by one aggregation of them and joined back.
2. Runs. A maximal run of a document's edges with one minimizer is one row (content, document, first
   word). An aggregation by content gives each distinct run its source, the smallest document with it.
3. Pieces. Where all runs of a minimizer are equal, no other run shares an edge with them: the run is a
   piece of the graph as it is. Else the distinct runs of the minimizer are broken into edges, read once
   each from its source, and equal edges meet: an edge is a piece with the smallest source of its runs.
4. Compaction. Pieces are joined at the nodes between them: a node with one piece in and one out does not
   branch. Neighbours that follow each other in one source are chained by a window over the source,
   and pointer jumping by joins, doubling the distance in each round, links chains of different
   sources: every nonbranching path is compacted to its first piece and an offset. A cycle without a
   branch is broken where its source's run through it begins.
5. Spans. Occurrences in documents beyond the source are repeats; those that follow each other on one
   path, with one shift against the source, are one span with both coordinates. Covered words are dropped.

Runs and edges are equal if two independent 64-bit hashes of their words are; ``repeated_spans`` reads
the words at both coordinates again and reports a span only if they are the same. Hot content (a line
that a third of all documents share) is reduced before each shuffle by partial aggregation, and joins
are of two plain exchanges, which adaptive execution splits.

Defined cases: null text has no words; rows without a doc_id keep all words and are no source; rows
that share a doc_id are one document; empty tables give empty results; long texts are read whole; other
columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, cut, map_slices, mix, rolling, signed, spelled

WINDOW, SEED_WORDS = 13, 5


class Edges:
    """Windows of a slice: minimizer, validity, runs of one minimizer, and two hashes of anything."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = words = Words(texts)
        self.hashes = spelled(words.data, words.starts, words.ends)
        n = max(0, len(self.hashes) - WINDOW + 1)
        self.valid = words.doc[:n] == words.doc[WINDOW - 1 :][:n]
        self.doc = words.doc[:n]
        self.low = _sliding_min(words.windows(self.hashes, SEED_WORDS)[0], WINDOW - SEED_WORDS + 1) if n else np.zeros(0, U64)

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Whether a run of chosen edges with one minimizer and document begins."""
        new = chosen.copy()
        new[1:] &= ~chosen[:-1] | (self.low[1:] != self.low[:-1]) | (self.doc[1:] != self.doc[:-1])
        return new

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first edge, edges) of the runs of chosen edges."""
        new = self.starts(chosen)
        at = np.flatnonzero(new)
        return at, np.bincount((np.cumsum(new) - 1)[chosen], minlength=len(at)) if len(at) else np.zeros(0, np.int64)

    def digests(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of words first..last-1."""
        if not hasattr(self, "second"):
            self.second = spelled(self.words.data, self.words.starts, self.words.ends, 2)
        return rolling(self.hashes, first, last, 6), rolling(self.second, first, last, 7)

    def member(self, values: np.ndarray, docs: np.ndarray, lists: pa.Array) -> np.ndarray:
        """Whether each (value, document) is in the document's list."""
        if not len(values):
            return np.zeros(0, bool)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        own = mix(np.repeat(np.arange(len(lists)), _lengths(lists)).astype(U64) + U64(5))
        return np.isin(values ^ mix(docs.astype(U64) + U64(5)), flat ^ own)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out


def _seed_rows(docs: DataFrame) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = Edges(batch.column("text"))
        at = np.flatnonzero(e.starts(e.valid))
        return pa.record_batch([signed(np.ascontiguousarray(e.low[at])), batch.column("doc_id").take(pa.array(e.doc[at]))], names=["h", "doc_id"])

    return map_slices(docs, kernel, "h long, doc_id long")


def _runs(texts: DataFrame) -> DataFrame:
    """(h, check, seed, doc_id, start, edges): the runs of seeds that two documents have."""
    rows = cut(_seed_rows(texts))
    seeds = rows.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    seeds = cut(seeds.where("low < high").select("h"))
    found = cut(rows.join(seeds, "h").groupBy("doc_id").agg(F.collect_set("h").alias("seeds")), seeds, rows)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = Edges(batch.column("text"))
        first, n = e.runs(e.valid & e.member(e.low, e.doc, batch.column("seeds")))
        h, check = e.digests(first, first + n + WINDOW - 1)
        doc = e.doc[first]
        start = (first - e.words.first[doc]).astype(np.int32)
        cols = [signed(h), signed(check), signed(np.ascontiguousarray(e.low[first])), batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(n.astype(np.int32))]
        return pa.record_batch(cols, names=["h", "check", "seed", "doc_id", "start", "edges"])

    return cut(map_slices(texts.join(found, "doc_id"), kernel, "h long, check long, seed long, doc_id long, start int, edges int"), found)


def _sourced(runs: DataFrame) -> DataFrame:
    """``runs`` that matter, with (source, at, shared, mixed): the smallest document of each and where it stands there.

    A run of a minimizer that has other runs is mixed; others matter only if two documents share them.
    """
    one = runs.groupBy("h", "check").agg(F.first("seed").alias("seed"), F.min("doc_id").alias("source"), F.min_by("start", "doc_id").alias("at"), F.max("doc_id").alias("last"))
    one = cut(one.withColumn("shared", F.col("source") < F.col("last")).drop("last"))
    many = cut(one.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed", F.lit(True).alias("mixed")))
    both = one.join(many, "seed", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    both = cut(both.where("shared or mixed").drop("seed"), one, many)
    return cut(runs.drop("seed").join(both, ["h", "check"]), runs, both)


def _pieces(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(p, check, tail, head, edges, source, at, shared, mixed): whole runs, and every edge of the mixed ones, in their sources."""
    row = F.struct(F.col("start").alias("at"), "edges", "h", "check", "shared", "mixed")
    lists = runs.where("doc_id = source and (mixed or start = at)").groupBy("doc_id").agg(F.collect_list(row).alias("runs"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, lists = Edges(batch.column("text")), batch.column("runs")
        flat = lists.flatten()
        field = lambda k: flat.field(k).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), _lengths(lists))
        first, n, mixed = e.words.first[doc] + field("at"), field("edges"), field("mixed").astype(bool)
        # a mixed run gives a row per edge, any other one row
        times = np.where(mixed, n, 1)
        own = np.repeat(np.arange(len(n)), times)
        start = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        long = np.where(mixed, 1, n)[own]
        p, check = (field(k)[own].copy() for k in ("h", "check"))
        single = mixed[own]
        edge = e.digests(start[single], start[single] + WINDOW)
        p[single], check[single] = (x.view(np.int64) for x in edge)
        node = e.words.windows(e.hashes, WINDOW - 1, 9)[0]
        at = (start - e.words.first[doc[own]]).astype(np.int32)
        cols = [pa.array(p), pa.array(check), signed(node[start]), signed(node[start + long]), pa.array(long.astype(np.int32)), batch.column("doc_id").take(pa.array(doc[own])), pa.array(at), pa.array(field("shared").astype(bool)[own]), pa.array(single)]
        return pa.record_batch(cols, names=["p", "check", "tail", "head", "edges", "source", "at", "shared", "mixed"])

    schema = "p long, check long, tail long, head long, edges int, source long, at int, shared boolean, mixed boolean"
    return cut(map_slices(texts.join(lists, "doc_id"), kernel, schema))


def _graph(pieces: DataFrame) -> DataFrame:
    """(pid, p, check, tail, head, edges, source, at): each repeated piece once, with its smallest source."""
    whole = pieces.where("not mixed").select("p", "check", "tail", "head", "edges", "source", "at")
    edges = pieces.where("mixed").groupBy("p", "check").agg(F.first("tail").alias("tail"), F.first("head").alias("head"), F.first("edges").alias("edges"), F.min_by("at", "source").alias("at"), F.max("source").alias("last"), F.bool_or("shared").alias("shared"), F.min("source").alias("source"))
    edges = edges.where("shared or source < last").select("p", "check", "tail", "head", "edges", "source", "at")
    return cut(cut(whole.unionByName(edges)).withColumn("pid", F.monotonically_increasing_id()))


def compacted(graph: DataFrame) -> DataFrame:
    """(pid, path, offset): every piece's nonbranching path, named by its first piece, and its edges before it.

    Most neighbours on a path also follow each other in their source: these chains are contracted by one
    window per source. Pointer jumping joins the chains of different sources.
    """
    into = graph.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n"), F.first("pid").alias("before"))
    out = graph.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("m"), F.first("pid").alias("pid"))
    into, out = cut(into.where("n = 1").drop("n")), cut(out.where("m = 1").drop("m"))
    links = into.join(out, "node").where("before <> pid").select("pid", "before")
    order = Window.partitionBy("source").orderBy("at", "pid")
    rows = graph.select("pid", "source", "at", "edges").join(links, "pid", "left")
    follows = (F.lag("pid").over(order) == F.col("before")) & (F.lag("at").over(order) + F.lag("edges").over(order) == F.col("at"))
    rows = rows.withColumn("new", ~F.coalesce(follows, F.lit(False)))
    begun = lambda c: F.last(F.when(F.col("new"), F.col(c)), ignorenulls=True).over(order)
    chained = rows.select("pid", "before", "edges", "new", begun("pid").alias("first"), (F.col("at") - begun("at")).cast("long").alias("offset"))
    chained = cut(chained, into, out)
    ahead = chained.select(F.col("pid").alias("before"), F.col("first").alias("to"), (F.col("offset") + F.col("edges")).alias("more"))
    joints = chained.where("new and before is not null").select("pid", "before").join(ahead, "before").where("to <> pid")
    found = _jumped(cut(joints.select("pid", F.col("to").alias("before"), F.col("more").alias("offset"))))
    far = found.select(F.col("pid").alias("first"), "path", F.col("offset").alias("more"))
    whole = chained.join(far, "first", "left").select("pid", F.coalesce("path", "first").alias("path"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    return cut(whole.where("pid <> path"), chained, found)


def _jumped(links: DataFrame) -> DataFrame:
    """(pid, path, offset) from links(pid, before, offset): the last piece that each chain of links leads to.

    Each round doubles the distance. Rows on a cycle never end and have no result.
    """
    rounds = max(1, (links.count() + 1).bit_length())
    open_, ends, written, ahead = links, [], [links], links
    for _ in range(rounds):
        step = ahead.select(F.col("pid").alias("before"), F.col("before").alias("beyond"), F.col("offset").alias("more"))
        moved = cut(open_.join(step, "before", "left"))
        written.append(moved)
        ends.append(moved.where("beyond is null").select("pid", "before", "offset"))
        open_ = moved.where("beyond is not null").select("pid", F.col("beyond").alias("before"), (F.col("offset") + F.col("more")).alias("offset"))
        ahead = reduce(DataFrame.unionByName, ends, open_)
        if not open_.head(1):
            break
    return cut(reduce(DataFrame.unionByName, ends).withColumnRenamed("before", "path"), *written)


def _occurrences(runs: DataFrame, pieces: DataFrame, graph: DataFrame) -> DataFrame:
    """(doc_id, start, edges, source, at, pid): where a document repeats a smaller one."""
    names = ["doc_id", "start", "edges", "source", "at", "pid"]
    later = runs.where("doc_id > source").join(graph.select(F.col("p").alias("h"), "check", "pid"), ["h", "check"], "left")
    # a run's own source repeats a smaller document in single edges only
    lower = graph.select("p", "check", "pid", F.col("source").alias("low"), F.col("at").alias("low_at"))
    edges = pieces.where("mixed").select("p", "check", F.col("source").alias("doc_id"), F.col("at").alias("start"), "edges").join(lower, ["p", "check"]).where("doc_id > low")
    return later.select(*names).unionByName(edges.select("doc_id", "start", "edges", F.col("low").alias("source"), F.col("low_at").alias("at"), "pid").distinct())


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, edges, source, at): spans of edges that also occur in a smaller document, at their source."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    runs = _sourced(_runs(texts))
    pieces = _pieces(texts, runs)
    graph = _graph(pieces)
    paths = compacted(graph)
    found = _occurrences(runs, pieces, graph)
    placed = found.join(paths, "pid", "left").withColumn("path", F.coalesce("path", "pid")).withColumn("offset", F.coalesce("offset", F.lit(0)))
    # neighbours on one path, one shift against the path and one against the source: one span where nothing is missing
    key = ["doc_id", "path", "source", (F.col("start") - F.col("offset")).alias("base"), (F.col("start") - F.col("at")).alias("shift")]
    part = F.struct("start", "edges")
    whole = placed.where("path is not null").groupBy(*key).agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges")).alias("end"), F.sum("edges").alias("n"), F.collect_list(part).alias("parts"))
    full = F.col("n") == F.col("end") - F.col("start")
    spans = F.when(full, F.array(F.struct("start", (F.col("end") - F.col("start")).cast("int").alias("edges")))).otherwise(F.col("parts"))
    whole = whole.select("doc_id", "source", "shift", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.edges", "source", (F.col("s.start") - F.col("shift")).alias("at"))
    single = placed.where("path is null").select("doc_id", "start", "edges", "source", "at")
    return cut(whole.unionByName(single), runs, pieces, paths, graph)


def _covered(words: Words, lists: pa.Array) -> np.ndarray:
    """Whether each word lies in one of its document's spans."""
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), _lengths(lists))
    start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "edges"))
    step = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(step, words.first[doc] + start, 1)
    np.add.at(step, words.first[doc] + start + n + WINDOW - 1, -1)
    return np.cumsum(step[:-1]) > 0


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that repeat a smaller document."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column("text"))
        gone = _covered(w, batch.column("spans"))
        raw = w.data.tobytes()
        n_removed = np.bincount(w.doc[gone], minlength=len(w.counts))
        kept = []
        for i, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
            own = raw[a:b].split()
            if n_removed[i]:
                own = [x for x, g in zip(own, gone[w.first[i] : w.first[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(own).decode())
        return pa.record_batch([batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    lists = repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    return map_slices(docs.select("doc_id", "text").join(cut(lists), "doc_id", "left"), kernel, "doc_id long, n_words long, n_removed long, kept string")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: words, removed words, and the digest of the kept text."""
    out = deduplicated(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start, n_words, source_id, source_start): repeated spans of ``least`` words or more.

    Spans whose coordinates advance together are one, however their edges were found; the words at both
    coordinates are read from the texts again, and only equal ones are reported.
    """
    spans = repeats(docs).withColumn("shift", F.col("start") - F.col("at"))
    per = Window.partitionBy("doc_id", "source", "shift").orderBy("start", "edges")
    # a span may begin anew only beyond the end of all before it
    upto = F.max(F.col("start") + F.col("edges")).over(per.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= upto, 0).otherwise(1)).over(per)
    long = spans.withColumn("island", island).groupBy("doc_id", "source", "shift", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("edges")).alias("end"))
    long = long.select("doc_id", "start", (F.col("end") - F.col("start") + WINDOW - 1).alias("n_words"), "source", (F.col("start") - F.col("shift")).alias("at")).where(F.col("n_words") >= least)
    texts = docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    long = cut(long)
    rows = long.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("source"), F.col("text").alias("other")), "source")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine, other = Words(batch.column("text")), Words(batch.column("other"))
        number = lambda k: batch.column(k).to_numpy()
        keep = []
        for i, (a, b, n) in enumerate(zip(number("start"), number("at"), number("n_words"), strict=True)):
            one, two = (w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split() for w in (mine, other))
            keep.append(one[a : a + n] == two[b : b + n])
        out = batch.filter(pa.array(keep, pa.bool_()))
        return pa.record_batch([out.column(k).cast(pa.int64()) for k in ("doc_id", "start", "n_words", "source", "at")], names=["doc_id", "start", "n_words", "source_id", "source_start"])

    return map_slices(rows.select("doc_id", "start", "n_words", "source", "at", "text", "other"), kernel, "doc_id long, start long, n_words long, source_id long, source_start long")


DEDUP_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS g
  FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i) WHERE len(w) >= 13
), firsts AS (
  SELECT g, min(doc_id) AS lo FROM windows GROUP BY g
), hits AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN firsts USING (g), (SELECT unnest(generate_series(0, 12)) AS k)
  WHERE doc_id > lo
), gone AS (
  SELECT doc_id, list(pos) AS gone_at, count(*) AS n FROM hits GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g.n IS NULL THEN w.w
         ELSE list_filter(w.w, lambda x, i: NOT list_contains(g.gone_at, i)) END, ' '), '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id)
"""
