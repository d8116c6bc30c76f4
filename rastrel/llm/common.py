"""Shared pieces of the corpus operators: durable tables, text kernels, connected components.

Text kernels work on the Arrow string column's own buffers (no Python string per word). A slice
handed to a kernel holds at most ``SLICE_BYTES`` of text, or one document if that is longer, so a
task's memory is bounded by the longest document and not by the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, release, shared_dir, ship  # noqa: F401

SLICE_BYTES = 1 << 20
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- numpy text kernels

def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).integers(0, 2**64, n, dtype=U64)


_BYTE = _table(11, 256)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _places(seed: int, n: int) -> np.ndarray:
    """A pseudo-random number for each place in a sequence, kept between calls up to a slice's length."""
    have = _PLACE.get(seed)
    if have is None or len(have) < n:
        made = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.array([seed], U64)))
        if n > SLICE_BYTES:
            return made
        have = _PLACE[seed] = made
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Order-sensitive hash of ``values[start:end]`` for each pair.

    Each value is scrambled together with its place in the sequence before the sum, so, unlike in a
    polynomial modulo 2**64, no arrangement of two letters cancels out.
    """
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
    terms = values[inside + np.repeat(starts, size)] ^ _places(seed, int(size.max(initial=0)))[inside]
    terms *= U64(0xFF51AFD7ED558CCD)
    terms ^= terms >> U64(32)
    total = np.zeros(len(terms) + 1, U64)
    np.cumsum(terms, out=total[1:])
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix(size.astype(U64)))


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of the bytes ``data[start:end]`` for each pair, read eight at a time: a few numbers for a word
    where ``rolling`` holds some for each byte. Two words of one length up to eight never hash alike."""
    size = ends - starts
    padded = np.zeros((len(data) >> 3) + 2, "<u8")
    padded.view(np.uint8)[: len(data)] = data
    long = size > 256
    out, salt = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)), mix(np.array([seed], U64))
    rows, at, left = slice(None), starts, size
    while len(at):
        shift = ((at & 7) << 3).astype(U64)
        eight = (padded[at >> 3] >> shift) | (padded[(at >> 3) + 1] << U64(1) << (U64(63) - shift))
        eight &= _FIRST_BYTES[np.minimum(left, 8)]
        out[rows] = mix(out[rows] ^ eight) if isinstance(rows, slice) else mix(out[rows] * U64(0xC2B2AE3D27D4EB4F) + mix(eight ^ salt))
        more = np.flatnonzero((left > 8) & ~long)
        rows, at, left, long = more if isinstance(rows, slice) else rows[more], at[more] + 8, left[more] - 8, long[more]
    far = np.flatnonzero(size > 256)
    if len(far):
        out[far] = rolling(_BYTE[data], starts[far], ends[far], seed)
    return out


def _joined(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    return mix(left * U64(0x9E3779B97F4A7C15) + (right ^ U64(seed)) * U64(0xC2B2AE3D27D4EB4F))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty texts."""
    if texts.type == pa.large_string():
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, as byte ranges with their document."""

    def __init__(self, texts: pa.Array) -> None:
        self.offsets, self.data = buffers(texts)
        n = len(self.data)
        inside = ~_SPACE[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cutting = self.offsets[1:-1]
        cutting = cutting[(cutting > 0) & (cutting < n)]
        begins[cutting] |= inside[cutting]
        last[cutting - 1] |= inside[cutting - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(last) + 1
        #: word index at which each document begins; one more entry than documents
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False, seed: int = 1) -> np.ndarray:
        return rolling((_LOWER_BYTE if lower else _BYTE)[self.data], self.starts, self.ends, seed)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(hash of words i..i+k-1, whether they lie in one document) for every i up to len-k."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        # runs of 1, 2, 4, ... words; those that k is made of are joined from left to right
        out, done, run, width = None, 0, hashes, 1
        while True:
            if k & width:
                part = run[done : done + n]
                out = part if out is None else _joined(out, part, seed + width)
                done += width
            if 2 * width > k:
                return out, self.doc[:n] == self.doc[k - 1 :]
            run = _joined(run[:-width], run[width:], seed + width)
            width *= 2

    def numbers(self, lower: bool = False) -> tuple[np.ndarray, int]:
        """(number of each word, how many there are): equal numbers are equal words, byte for byte."""
        data = self.data
        if lower:
            data = data.copy()
            upper = (data >= 65) & (data < 91)
            data[upper] += 32
        size = self.ends - self.starts
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        flat = data[np.arange(at[-1]) - np.repeat(at[:-1] - self.starts, size)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(flat)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)

    @staticmethod
    def joined_numbers(one: np.ndarray, n: int, k: int) -> np.ndarray:
        """A number for words i..i+k-1, for every i up to len-k: equal numbers are equal word sequences."""
        out, high = one[: max(0, len(one) - k + 1)], max(1, n)
        for j in range(1, k):
            if high * n >= 1 << 62:
                kinds, out = np.unique(out, return_inverse=True)
                high = len(kinds)
            out = out * n + one[j : j + len(out)]
            high *= n
        return out


def _offsets(values: pa.Array) -> np.ndarray:
    sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        at = 0
        offsets = _offsets(batch.column(column))
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = max(at + 1, min(to, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of at most SLICE_BYTES, or of one text."""
    batch = pa.record_batch([texts], names=["text"])
    at = 0
    for part in slices(iter([batch])):
        yield at, part.column("text")
        at += part.num_rows


def trim() -> None:
    """Give freed memory back to the system; a reused worker else keeps the peak of every earlier task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """Run ``kernel`` on bounded slices of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            out = kernel(part)
            if out is not None and out.num_rows:
                yield out
        trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---------------------------------------------------------------- graphs

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the undirected edges, for each node that has one.

    Alternating star contraction: each round points every node's larger neighbours, then its smaller
    ones, at its smallest neighbour. The edge set never grows beyond its first size, each round is
    written to the shared folder, and rounds grow with the logarithm of the longest path. A hub's
    smallest neighbour is found by partial aggregation and written before it meets the hub's edges, so
    the join is of two plain exchanges, which adaptive execution splits at a hub.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # u > v in every edge: as the larger end, the other is smaller; as the smaller end, it is not
        low = cut(e.unionByName(e.select("v", F.col("v").alias("u"))).groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        large = e.join(low, F.col("v") == F.col("k")).select("u", F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct(), low, e)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "k"))
        small = large.join(low.where("n > 1"), F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("k").alias("x"), "m"))
        e = cut(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), large, low)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first())
        if now == before or now[0] == now[2] and _flat(e):
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _flat(e: DataFrame) -> bool:
    """No root points further: every edge ends at a node without a smaller neighbour."""
    return not e.join(e.select(F.col("u").alias("r")), F.col("v") == F.col("r"), "left_semi").head(1)
