"""Packing along a space-filling curve.

Every text is tokenized once. Its tokens' hashed vectors are projected to four dimensions and
averaged; the averages, standardised over all documents, become a Hilbert key. Documents are
range-sorted by the key, laid end to end, and cut every ``CAPACITY`` ids, so neighbours on the curve
share sequences and only the last sequence of all is not full.

The order is found on narrow rows (id, key, length): a range partition by (key, row) splits a group
of equal documents like any other, each range adds up its lengths, and the ranges' totals, one row
per partition, place them. Token ids meet their place in one join on the row number.

Defined cases: null and empty texts hold the end id only; repeated rows are packed each; documents of
one key follow each other by row; long texts are cut into as many pieces as they need; an empty table
gives no pieces; other columns are never read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, mix, slices, spelled, trim

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
DIMS, BITS = 4, 10
CACHED_WORDS, CACHED_LENGTH = 300_000, 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: ids of word cores, marks and other words already encoded by this worker, by vocabulary
_CACHE: dict[str, tuple[dict[bytes, bytes], dict[bytes, bytes], dict[bytes, bytes]]] = {}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SECOND = np.zeros(256, bool)  # second bytes of the two-byte Latin letters
_SECOND[128:192] = True
_SECOND[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _bare(path: str) -> tuple:
    """The vocabulary's merges alone, for text that is normalised and byte-mapped already: (tokenizer
    split at spaces, bytes as shown, whether an id ends a word)."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    whole = _tokenizer(path)
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = WhitespaceSplit()
    # bytes of letters beyond ASCII as this vocabulary shows them: printable ones as themselves, others from 256 on
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    code = [b if b in shown else next(hidden) for b in range(256)]
    two = np.array([[0xC0 | c >> 6, 0x80 | c & 0x3F] for c in code], np.uint8)
    vocab = whole.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    return bare, two, ends


def _shown(text: bytes, two: np.ndarray) -> str:
    """The text with each byte beyond ASCII as one letter."""
    if text.isascii():
        return text.decode()
    raw = np.frombuffer(text, np.uint8)
    high = raw >= 128
    at = np.cumsum(1 + high) - 1 - high
    out = np.empty(len(raw) + int(high.sum()), np.uint8)
    out[at[~high]] = raw[~high]
    out[at[high]], out[at[high] + 1] = two[raw[high]].T
    return out.tobytes().decode()


def _encode_whole(words: list[str], path: str) -> list[bytes]:
    return [np.array(e.ids, "<u2").tobytes() for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def _encode_cores(cores: list[bytes], path: str) -> list[bytes]:
    """Ids of lower-case Latin words, by the merges alone."""
    bare, two, ends = _bare(path)
    texts = [b" ".join(cores[i : i + 512]) for i in range(0, len(cores), 512)]
    encoded = bare.encode_batch_fast([_shown(t, two) for t in texts], add_special_tokens=False)
    flat = np.concatenate([np.array(e.ids, "<u2") for e in encoded])
    stops = np.flatnonzero(ends[flat]) + 1
    if len(stops) != len(cores):
        raise ValueError("the vocabulary does not end each word once")
    raw, stops = flat.tobytes(), (2 * stops).tolist()
    return [raw[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)]


def _lookup(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes, cache: dict[bytes, bytes], encode_all) -> tuple[np.ndarray, list[bytes]]:  # noqa: ANN001
    """(index of each piece's distinct value, ids of the distinct values), through the cache."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if len(cache) > CACHED_WORDS:
        cache.clear()
    found = list(map(cache.get, keys))
    new = [k for k, v in zip(keys, found, strict=True) if v is None]
    if new:
        made = dict(zip(new, encode_all(new), strict=True))
        found = [made[k] if v is None else v for k, v in zip(keys, found, strict=True)]
        cache.update(made if max(map(len, new)) <= CACHED_LENGTH else {k: v for k, v in made.items() if len(k) <= CACHED_LENGTH})
    return back, found


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text); an end id follows each text.

    This vocabulary lower-cases, drops white space and never joins across it, so a text is the sum of
    its words. A word of Latin letters with ASCII marks behind it is two pieces, its lower-cased letters
    and its marks; any other word is one. Each distinct piece of the slice is looked up once, and
    letters go through the merges alone; pieces are kept up to a fixed number.
    """
    cores, marks, wholes = _CACHE.setdefault(path, ({}, {}, {}))
    words = Words(texts)
    data, s, e = words.data, words.starts, words.ends
    n_words, docs = len(s), len(words.counts)
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_LETTER[data] | lead | second, out=letters[1:])
    mark = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_MARK[data], out=mark[1:])
    low = _LOWER[data]
    low[second & (data < 0x9F)] += 32
    m = s + letters[e] - letters[s]
    simple = (m > s) & (letters[m] - letters[s] == m - s) & (mark[e] - mark[m] == e - m)
    sizes, begins, pool = np.zeros((2, n_words), np.int64), np.zeros((2, n_words), np.int64), [END_ID.to_bytes(2, "little")]
    at = 1
    whole = lambda keys: _encode_whole([k.decode() for k in keys], path)
    lowered, raw = low.tobytes(), data.tobytes()
    for row, pick, x, y, text, source, cache, how in (
        (0, simple, s, m, low, lowered, cores, lambda keys: _encode_cores(keys, path)),
        (0, ~simple, s, e, data, raw, wholes, whole),
        (1, simple & (e > m), m, e, data, raw, marks, whole),
    ):
        i = np.flatnonzero(pick)
        if not len(i):
            continue
        back, found = _lookup(spelled(text, x[i], y[i]), x[i], y[i], source, cache, how)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        sizes[row, i], begins[row, i] = size[back], (at + np.cumsum(size) - size)[back]
        at += int(size.sum())
        pool += found
    ids = np.frombuffer(b"".join(pool), "<u2")
    # two pieces for each word, then the end id of its text
    place = 2 * np.arange(n_words) + words.doc
    piece_size, piece_at = np.ones(2 * n_words + docs, np.int64), np.zeros(2 * n_words + docs, np.int64)
    for row in (0, 1):
        piece_size[place + row], piece_at[place + row] = sizes[row], begins[row]
    upto = np.cumsum(piece_size)
    flat = ids[np.repeat(piece_at - (upto - piece_size), piece_size) + np.arange(upto[-1] if docs else 0)]
    stops = upto[np.cumsum(2 * words.counts + 1) - 1] if docs else np.zeros(0, np.int64)
    return flat, np.diff(stops, prepend=0)


def _projection(size: int = 1 << 16) -> np.ndarray:
    """Each id's hashed vector, projected: a fixed pseudo-random row of DIMS numbers."""
    i = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64)
    u = [(mix(i + np.uint64(salt << 32)) >> np.uint64(11)).astype(np.float64) / 2**53 for salt in (1, 2)]
    return (np.sqrt(-2 * np.log(u[0] + 1e-300)) * np.cos(2 * np.pi * u[1])).astype(np.float32)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of coordinates below 2**bits."""
    x = x.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(row, doc_id, n, p0..p3, ids): one row per row of ``docs``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        table = _projection()
        for batch in slices(batches):
            flat, n = encode(batch.column("text"), path)
            at, whole = np.cumsum(n) - n, flat.tobytes()
            ids = [whole[2 * a : 2 * (a + k)] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            mean = np.zeros((len(ids), DIMS))
            for lo in range(0, len(ids), 64):  # a few documents at a time: one row of floats per id
                hi = min(lo + 64, len(ids))
                part = flat[at[lo] : at[hi - 1] + n[hi - 1]]
                mean[lo:hi] = np.add.reduceat(table[part], at[lo:hi] - at[lo], axis=0, dtype=np.float64) / n[lo:hi, None]
            rows = np.arange(row, row + len(ids), dtype=np.int64)
            row += len(ids)
            yield pa.record_batch([pa.array(rows), batch.column("doc_id"), pa.array(n), *(pa.array(mean[:, k]) for k in range(DIMS)), pa.array(ids, pa.binary())], names=["row", "doc_id", "n", *(f"p{k}" for k in range(DIMS)), "ids"])
        trim()

    return cut(docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, " + ", ".join(f"p{k} double" for k in range(DIMS)) + ", ids binary"))


def curve_order(tokens: DataFrame) -> DataFrame:
    """(row, at): where each row begins when all are laid end to end along the curve."""
    dims = [f"p{k}" for k in range(DIMS)]
    moments = tokens.agg(*(f(d) for d in dims for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([moments[2 * k] or 0.0 for k in range(DIMS)])
    std = np.array([moments[2 * k + 1] or 1.0 for k in range(DIMS)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in dims], 1)
            cell = np.clip((np.tanh((x - mean) / std / 1.5) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.record_batch([batch.column("row"), batch.column("n"), pa.array(hilbert(cell))], names=["row", "n", "key"])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.record_batch([batch.column("row"), batch.column("n"), pa.array(at), pa.array(np.full(len(n), part, np.int32))], names=["row", "n", "at", "part"])

    keys = cut(tokens.select("row", "n", *dims).mapInArrow(keyed, "row long, n long, key long"))
    ranged = keys.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    ranged = cut(ranged.mapInArrow(running, "row long, n long, at long, part int"))
    # one row per partition of the sort
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").select("row", (F.col("at") + F.col("before")).alias("at"))


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    path = path or vocabulary_path()
    tokens = tokenized(docs, path)
    placed = tokens.select("row", "doc_id", "ids").join(curve_order(tokens), "row")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out = []
            for doc, at, raw in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                n, a = len(ids), 0
                while a < n:
                    b = min(n, a + CAPACITY - (at + a) % CAPACITY)
                    out.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), n, (at + a) // CAPACITY, (at + a) % CAPACITY))
                    a = b
            cols = zip(*out, strict=True)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.select("doc_id", "at", "ids").mapInArrow(pieces, PIECES)
