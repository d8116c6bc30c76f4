"""Quality rules: base repetition rules, then divergence from language references.

Each document has two histograms: character classes, and common words of several languages (with one
bin for all other words). The references are the same histograms summed over all documents of each
language (over all documents where none has a language). A document's divergence is the smallest
over the references of the larger of its two Jensen-Shannon distances (base 2, bias of a finite
sample taken off). Below ``MIN_CHARS`` or ``MIN_WORDS`` the respective histogram is not judged.

Counts follow the words ``[^\\x20\\x09-\\x0D]+`` of the whole text. Defined cases: null, empty and blank texts
have no words and fail the base rules; repeated rows are judged each; rows without a language count only
where no row has one; with no reference at all (an empty table) nothing diverges; long texts are read
whole; distances at the limit pass; other columns are never read. Every language is a reference: the driver holds one row of BINS
numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER_BYTE, Words, map_slices, mix, rolling, slices

MIN_CHARS, MIN_WORDS = 200, 50
#: A document may lie LIMIT + SLACK / sqrt(words) from its nearest reference.
LIMIT, SLACK = 0.26, 0.5

# Common words of the reference languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "fr": "le la les de des du et en un une que qui dans pour pas sur par au aux est ce il elle ne se plus avec son sa ses nous vous leur mais ou",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "es": "el los las del y que un una por con para su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde",
}
_WORDS = sorted({w for words in COMMON.values() for w in words.split()})

_CLASS = np.zeros(256, np.int64)
for _c, _members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,", b";:!?'\"()-", b"#*$%&|<>"), 1):
    _CLASS[list(_members)] = _c
_CLASS[192:] = 10  # letters beyond ASCII, counted at their first byte
_CLASS[128:192] = 11  # later bytes: dropped below
CLASSES = 11
BINS = CLASSES + len(_WORDS) + 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _known() -> tuple[np.ndarray, np.ndarray]:
    words = Words(pa.array([" ".join(_WORDS)]))
    h = words.hashes(lower=True)
    order = np.argsort(h)
    return h[order], order


_HASHES, _PLACE = _known()
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?")] = True


def histograms(words: Words) -> np.ndarray:
    """One row of BINS counts per document: character classes, then common words, then other words."""
    n = len(words.counts)
    out = np.zeros((n, BINS), np.int64)
    kind = _CLASS[words.data]
    doc = np.repeat(np.arange(n), np.diff(words.offsets))
    out[:, :CLASSES] = np.bincount(doc * 12 + kind, minlength=12 * n).reshape(n, 12)[:, :CLASSES]
    if len(words.starts):
        last = words.ends - (_EDGE[words.data[words.ends - 1]] & (words.ends - words.starts > 1))
        h = rolling(_LOWER_BYTE[words.data], words.starts, last)
        at = np.minimum(np.searchsorted(_HASHES, h), len(_HASHES) - 1)
        place = np.where(_HASHES[at] == h, _PLACE[at], len(_WORDS))
        wide = len(_WORDS) + 1
        out[:, CLASSES:] = np.bincount(words.doc * wide + place, minlength=wide * n).reshape(n, wide)
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (base 2) of each row of counts ``p`` from counts ``q``, less its sampling bias."""
    n = p.sum(1, keepdims=True)
    a, b = p / np.maximum(n, 1), q / max(q.sum(), 1)
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        right = np.where(b > 0, b * np.log2(b / m), 0).sum(1)
    bias = ((p > 0).sum(1) - 1) / (8 * np.log(2) * np.maximum(n[:, 0], 1))
    return np.maximum(0, (left + right) / 2 - bias)


def references(docs: DataFrame) -> dict[str, np.ndarray]:
    """Summed histograms per language, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            counts = histograms(Words(batch.column("text")))
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + counts[langs == lang].sum(0)
        if sums:
            keys = [k for k in sums for _ in range(BINS)]
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(np.tile(np.arange(BINS), len(sums))), pa.array(np.concatenate(list(sums.values())))], names=["lang", "bin", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, bin long, n long")
    per = rows.groupBy("lang").pivot("bin", list(range(BINS))).agg(F.sum("n"))
    # one row of BINS numbers per language
    out = {r["lang"]: np.array([r[str(i)] or 0 for i in range(BINS)], np.int64) for r in per.collect()}
    return {k: out[k] for k in sorted(out) if k} or out


def measures(words: Words) -> dict[str, np.ndarray]:
    """The base counts of every document of a slice."""
    n = len(words.counts)
    inside = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=inside[1:])
    chars = np.bincount(words.doc, inside[words.ends] - inside[words.starts], n).astype(np.int64)
    marks = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=marks[1:])
    symbols = marks[words.offsets[1:]] - marks[words.offsets[:-1]]
    # lines: between line feeds and document bounds
    feeds = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([words.offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([words.offsets[1:], feeds]))
    doc = np.searchsorted(words.offsets[1:-1], starts, "right") if n else np.zeros(0, int)
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    line = rolling(_BYTE[words.data], starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # words in windows of three that recur in their document
    w, ok = words.windows(words.hashes(), 3)
    at = np.flatnonzero(ok)
    w = w[at] ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1))
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    hit = np.zeros(len(words.starts), bool)
    for k in range(3):
        hit[again + k] = True
    return {"n_words": words.counts.astype(np.int64), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup.astype(np.int64), "n_repeat_words": np.bincount(words.doc[hit], minlength=n).astype(np.int64)}


def distance(counts: np.ndarray, refs: dict[str, np.ndarray]) -> np.ndarray:
    """Distance of each document to its nearest reference; 0 where it is too short to judge."""
    out = np.full(len(counts), np.inf)
    c, w = counts[:, :CLASSES], counts[:, CLASSES:]
    for ref in refs.values():
        by_char = np.where(c.sum(1) >= MIN_CHARS, np.sqrt(divergence(c, ref[:CLASSES])), 0)
        by_word = np.where(w.sum(1) >= MIN_WORDS, np.sqrt(divergence(w, ref[CLASSES:])), 0)
        out = np.minimum(out, np.maximum(by_char, by_word))
    return np.where(np.isfinite(out), out, 0.0)


def judge(docs: DataFrame, refs: dict[str, np.ndarray]) -> DataFrame:
    """One row per document: base counts, base verdict, divergence and final verdict."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        m = measures(words)
        far = distance(histograms(words), refs)
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return pa.record_batch([batch.column("doc_id"), *(pa.array(m[k]) for k in names), pa.array(failed), pa.array(~failed & (far <= LIMIT + SLACK / np.sqrt(np.maximum(m["n_words"], 1)))), pa.array(far)], names=["doc_id", *names, "base_failed", "kept", "divergence"])

    return map_slices(docs.select("doc_id", "text"), kernel, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, divergence double")
