"""Language identification: family first, then one-versus-one linear SVMs within the family.

Features are hashed byte 2-grams and 3-grams of the lower-cased text with every ASCII non-letter
read as a space, averaged over the text, so a score is one histogram and a product per document. The
families are contested by one-versus-one SVMs, then the languages of the winning family are.
Languages without a known family are put into families by the nearness of their mean histograms, so
contests grow with the power 1.5 of the languages. Fitting uses at most ``PER_LANGUAGE`` labelled texts of each
language, ``SAMPLE_ROWS`` in all, each whole; every language that has one is learned.

Defined cases: null text, or text without a letter, is ``und`` with score 0; with no labelled
language at all everything is ``und``; with one language every lettered text gets it with score 1;
equal votes go to the larger summed chance, then to the first code; repeated rows are predicted each;
an empty table gives an empty result; long texts are read whole; other columns are never read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, map_slices, pieces, trim
from .training import fit_svm, fold, sigmoid

#: Bounds of the training sample: rows of one language, and of all.
PER_LANGUAGE, SAMPLE_ROWS = 500, 20_000
BUCKETS, SCALE = 1 << 12, 30.0
#: Up to so many languages without a known family are families of their own.
ALONE = 8
FOLDS, HELD = 5, 0

# Families of common languages; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document offsets, 2-gram buckets, 3-gram buckets + BUCKETS), one per byte position."""
    offsets, data = buffers(pc.utf8_lower(texts))
    b = np.concatenate([_FOLD[data], np.full(2, 32, np.uint8)]).astype(np.uint32)
    second, third = b[1:-1].copy(), b[2:].copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1
    second[last] = third[last] = third[last[last > 0] - 1] = 32  # a text ends in spaces, whatever follows it
    two = b[:-2] * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)
    three = two + third * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - 12)
    return offsets, (two * np.uint32(0x27D4EB2F)) >> shift, ((three * np.uint32(0x165667B1)) >> shift) + np.uint32(BUCKETS)


class Histograms:
    """Bucket counts of many texts, kept sparse; any rows of them as a dense matrix."""

    def __init__(self, texts: pa.Array) -> None:
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        for _, part in pieces(texts):
            offsets, two, three = gram_ids(part)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = _count(two[a:b], three[a:b])
                at = np.flatnonzero(n)
                self.at.append(at.astype(np.uint16))
                self.value.append((n[at] * (SCALE / max(1, b - a))).astype(np.float32))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 2 * BUCKETS), np.float32)
        for i, k in enumerate(rows):
            out[i, self.at[k]] = self.value[k]
        return out

    def mean(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * BUCKETS)
        for k in rows:
            out[self.at[k]] += self.value[k]
        return out / max(1, len(rows))


def _count(two: np.ndarray, three: np.ndarray) -> np.ndarray:
    n = np.bincount(two, minlength=2 * BUCKETS)
    return n + np.bincount(three, minlength=2 * BUCKETS)


def families_of(langs: list[str], means: list[np.ndarray]) -> list[str]:
    """The family of each language: the known one, or one of about the root of the others' number, by nearness."""
    out = [FAMILY.get(x, x) for x in langs]
    other = [i for i, x in enumerate(langs) if x not in FAMILY]
    if len(other) <= ALONE:
        return out
    x = np.sqrt(np.array([means[i] for i in other]))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = math.isqrt(len(other) - 1) + 1
    centre = x[:1]
    while len(centre) < k:  # mutually distant languages first
        centre = np.vstack([centre, x[np.argmin((x @ centre.T).max(1))]])
    # each family takes its nearest languages, no more than an even share of them, so none holds all
    group, room, near = np.full(len(x), -1), np.full(k, -(-len(x) // k) + 1), x @ centre.T
    for i, f in zip(*np.unravel_index(np.argsort(-near, axis=None, kind="stable"), near.shape), strict=True):
        if group[i] < 0 and room[f]:
            group[i] = f
            room[f] -= 1
    for i, f in zip(other, group, strict=True):
        out[i] = f"near {langs[other[int(np.argmin(group != f))]]}"
    return out


class Model:
    """Pairwise classifiers over families and, within each family, over languages."""

    def __init__(self, texts: pa.Array, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        of_lang = np.searchsorted(np.array(self.langs, object), np.array(langs, object)) if langs else np.zeros(0, int)
        hist = Histograms(texts)
        own = [np.flatnonzero(of_lang == i) for i in range(len(self.langs))]
        family = families_of(self.langs, [hist.mean(r) for r in own])
        self.families = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == name] for name in self.families]
        self.contests: list[tuple[str, int, int]] = [("f", a, b) for a, b in combinations(range(len(self.families)), 2)]
        self.contests += [("l", a, b) for m in self.members for a, b in combinations(m, 2)]
        self.weights = np.zeros((2 * BUCKETS, len(self.contests)), np.float32)
        self.bias = np.zeros(len(self.contests), np.float32)
        for k, (level, a, b) in enumerate(self.contests):  # one contest's rows at a time
            sides = [self._family_rows(own, side) for side in (a, b)] if level == "f" else [own[a], own[b]]
            y = np.repeat([1.0, -1.0], [len(r) for r in sides])
            w, bias = fit_svm(hist.dense(np.concatenate(sides)), y, c=5.0, rounds=20)
            self.weights[:, k], self.bias[k] = w * SCALE, bias

    def _family_rows(self, own: list[np.ndarray], family: int) -> np.ndarray:
        """Rows of a family for its contests: as many of each of its languages, two languages' worth in all."""
        members = self.members[family]
        share = max(1, 2 * PER_LANGUAGE // len(members))
        return np.sort(np.concatenate([own[m][:share] for m in members]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        offsets, two, three = gram_ids(texts)
        n, size = len(texts), np.maximum(1, np.diff(offsets))
        margin = np.zeros((n, len(self.contests)))
        for lo in range(0, n if self.contests else 0, 128):  # a few documents at a time
            hi = min(n, lo + 128)
            x = np.stack([_count(two[a:b], three[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
            margin[lo:hi] = (x / size[lo:hi, None]).astype(np.float32) @ self.weights + self.bias
        chance = sigmoid(4 * margin)
        family, p_family = self._vote("f", list(range(len(self.families))), chance, n)
        lang, p_lang = np.zeros(n, int), np.ones(n)
        for f, members in enumerate(self.members):
            won, p = self._vote("l", members, chance, n)
            here = family == f
            lang[here], p_lang[here] = won[here], p[here]
        return [self.langs[i] for i in lang], p_family * p_lang

    def _vote(self, level: str, members: list[int], chance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The member with most won contests (ties: larger summed chance, then first) and its mean chance."""
        votes, total = np.zeros((n, len(members))), np.zeros((n, len(members)))
        place = {m: i for i, m in enumerate(members)}
        for k, (kind, a, b) in enumerate(self.contests):
            if kind == level and a in place and b in place:
                i, j = place[a], place[b]
                votes[:, i] += chance[:, k] >= 0.5
                votes[:, j] += chance[:, k] < 0.5
                total[:, i] += chance[:, k]
                total[:, j] += 1 - chance[:, k]
        best = np.argmax(votes * len(members) + total, axis=1)
        if len(members) == 1:
            return np.full(n, members[0]), np.ones(n)
        return np.array(members)[best], total[np.arange(n), best] / (len(members) - 1)


def fit(docs: DataFrame) -> Model | None:
    """A model from the labelled rows outside the held-out fold; None if there are none."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), FOLDS, HELD))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rows = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    # a hashed share that leaves few rows over, then exactly the first of them
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (1.3 * rows + 20) / n))])
    u = F.pmod(F.col("order"), F.lit(1 << 20)) / float(1 << 20)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text"))
    sample = known.where(u < share[F.col("lang")]).withColumn("place", first).where(F.col("place") <= rows)
    sample = sample.select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    model = Model(sample["text"].combine_chunks(), sample["lang"].to_pylist()) if len(sample) else None
    del sample
    trim()
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = batch.column("text"), sent.value
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool)
        if model is None:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        else:
            langs, scores = model.predict(texts)
            langs = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
            scores = np.where(lettered, scores, 0.0)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"))
    return map_slices(rows, kernel, "doc_id long, held_out boolean, lang_pred string, score double")
