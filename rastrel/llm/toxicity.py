"""Toxicity: a subsequence string-kernel SVM over words with Nyström landmarks.

The kernel counts common letter triples that may have gaps: a triple of span s weighs DECAY**s, spans
up to SPAN letters. It is normalised by word length, which keeps it positive semidefinite. Landmarks
are the words whose sentences are labelled toxic far more often than not, and common words of clean
sentences; the SVM also learns the toxic ones with a letter inserted. The SVM is linear in the Nyström map, so its decision on a word collapses to one
table over letter triples, and scoring is exact: gaps and inserted letters only lower a triple's
weight. Non-letters inside a word are skipped (look-alike digits read as letters), and runs of
single letters are read as one word.

Toxic texts may also be marked by a stem with changing endings (or an ending with changing stems), no
single word of which is common. Such units, whole words among them, are judged by their own evidence: the toxic and
clean texts that hold one, against what is expected within groups of texts with similar letter pairs,
beyond what chance makes of all units tried. A second SVM of the same kernel, which keeps accents apart and
marks where a word begins, learns words that hold a unit. A document's score is a logistic function of its numbers
of both kinds of toxic words and, where it has none of the first, of how near its nearest word comes.

Fitting uses at most ``training.MAX_ROWS`` labelled rows, each text whole; every text is scored whole.
Defined cases: null and empty texts have no words and get the score of a document without positive
words; without a toxic landmark every score is the toxic share of the training rows (0 if there are
none); a score of exactly THRESHOLD predicts 1; repeated rows are scored each; an empty table gives an
empty result; other columns are never read, and ``drop_toxic`` returns them as they were.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_slices, mix, pieces, rolling, trim
from .training import fit_logistic, fit_svm, fold, labelled_sample, sigmoid

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
DECAY, SPAN, LONGEST = 0.8, 6, 24
TOXIC_LANDMARKS, CLEAN_LANDMARKS, CLEAN_WORDS = 64, 96, 1500
#: A toxic landmark is in at least this share of the number of toxic texts that the commonest one is in.
LEAST_SHARE = 0.2
#: A word counts as toxic above this SVM margin; disguised toxic words are fitted to margins near 1.
MARGIN = 0.65

_LETTER = np.full(256, 255, np.uint8)
_LETTER[97:123] = np.arange(26)
_LETTER[65:91] = np.arange(26)
_LETTER[128:192] = 26 + (np.arange(64) & 31)  # a code for each letter beyond ASCII, of its last byte without case
for _digit, _letter in zip(b"01345", b"oieas", strict=True):
    _LETTER[_digit] = _letter - 97
#: Codes of plain words (all letters beyond ASCII are one) and of marked ones (they differ, and a code begins the word).
PLAIN, BEGIN, MARKED = 27, 58, 59
#: A stem is in this many times the toxic texts expected, by chance in fewer than one of 1 / CHANCE samples.
LIFT, CHANCE = 3, 0.01
GROUPS, STEM, STEM_WORDS, STEM_LANDMARKS = 8, range(3, 9), 1200, 160
_PAIRS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def _norms() -> np.ndarray:
    n = [1.0, 1.0, 1.0]
    for length in range(3, LONGEST + 2):
        n.append(sum((length - k) * (k - 1) * DECAY ** (2 * k) for k in range(2, min(SPAN, length - 1) + 1)))
    return np.sqrt(np.array(n))


_NORM = _norms()


def codes(words: list[str]) -> np.ndarray:
    """Letter codes, one row per word, padded with 255."""
    out = np.full((len(words), LONGEST), 255, np.uint8)
    for i, w in enumerate(words):
        c = _LETTER[np.frombuffer(w.encode(), np.uint8)]
        c = c[c != 255][:LONGEST]
        out[i, : len(c)] = c
    return out


def plain(matrix: np.ndarray) -> np.ndarray:
    return np.where(matrix == 255, matrix, np.minimum(matrix, PLAIN - 1))


def marked(matrix: np.ndarray) -> np.ndarray:
    return np.hstack([np.full((len(matrix), 1), BEGIN, np.uint8), matrix])


def triple_sums(matrix: np.ndarray, table: np.ndarray, letters: int = PLAIN) -> np.ndarray:
    """For each row, the decayed sum of ``table`` over its gapped triples, by length norm."""
    length = (matrix != 255).sum(1)
    out = np.zeros((len(matrix), *table.shape[1:]))
    wide = matrix.astype(np.int32)
    for first in range(matrix.shape[1] - 2):
        live = np.flatnonzero(length > first + 2)
        if not len(live):
            break
        a = wide[live, first] * letters**2
        for j, k in _PAIRS:
            if first + k >= matrix.shape[1]:
                continue
            c = wide[live, first + k]
            ok = c != 255
            rows = live[ok]
            out[rows] += DECAY**k * table[a[ok] + wide[rows, first + j] * letters + c[ok]]
    norm = _NORM[length]
    return out / (norm if out.ndim == 1 else norm[:, None])


def profile(word: np.ndarray, letters: int = PLAIN) -> np.ndarray:
    """The feature vector of one word (a row of codes) over all letter triples."""
    out = np.zeros(letters**3)
    w = word[word != 255].astype(int)
    for i in range(len(w)):
        for j, k in _PAIRS:
            if i + k < len(w):
                out[w[i] * letters**2 + w[i + j] * letters + w[i + k]] += DECAY**k
    return out / _NORM[len(w)]


def _disguised(word: str) -> list[str]:
    """The word with one letter inserted at each inner place, two letters in turn."""
    return [word[:i] + chr(97 + (7 * i + 11 * k + ord(word[i])) % 26) + word[i:] for i in range(1, len(word)) for k in (0, 1)]


def similar_groups(texts: list[str], y: np.ndarray) -> np.ndarray:
    """A group for each text: spherical k-means of letter-pair profiles from mutually distant texts.

    A group that is mostly toxic is told by toxicity itself: its texts join the nearest other group.
    """
    x = np.zeros((len(texts), 1024), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int64)
        x[i] = np.sqrt(np.bincount((b[:-1] * 31 + b[1:] * 257) % 1024, minlength=1024))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    centre = x.mean(0, keepdims=True)
    for _ in range(min(GROUPS, len(texts)) - 1):
        centre = np.vstack([centre, x[np.argmin((x @ centre.T).max(1))]])
    for _ in range(10):
        group = (x @ centre.T).argmax(1)
        centre = np.array([x[group == g].sum(0) if (group == g).any() else centre[g] for g in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    near = x @ centre.T
    group = near.argmax(1)
    mostly = np.bincount(group, y, len(centre)) > 0.5 * np.bincount(group, minlength=len(centre))
    if mostly.any() and not mostly.all():
        group = np.where(mostly, -2.0, near).argmax(1)
    return group


def _units(word: str) -> list[str]:
    return [f"^{word}$", *(f"^{word[:k]}" for k in STEM if k <= len(word)), *(f"{word[-k:]}$" for k in STEM if k <= len(word))]


def _tail(n: int, mean: float) -> float:
    """The logarithm of a bound of the chance that a Poisson count of this mean reaches n."""
    return 0.0 if n <= mean else n - mean - n * math.log(n / max(mean, 1e-9))


def stem_words(texts: list[str], y: np.ndarray, skip: set[str]) -> tuple[list[str], list[str]]:
    """(words that hold a toxic unit, other words), each by falling number of texts."""
    ids: dict[str, int] = {}
    held: list[list[int]] = []
    for i, text in enumerate(texts):
        for w in sorted({w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= LONGEST and w not in skip}):
            k = ids.setdefault(w, len(held))
            if k == len(held):
                held.append([])
            held[k].append(i)
    words, posts = list(ids), [np.array(h, np.int32) for h in held]
    group = similar_groups(texts, y)
    rate = (np.bincount(group, y) / np.maximum(np.bincount(group), 1))[group]
    toxic = y.astype(bool)
    often: Counter = Counter()
    for w, p in zip(words, posts, strict=True):
        n = int(toxic[p].sum())
        if n:
            often.update(dict.fromkeys(_units(w), n))
    often = Counter({u: n for u, n in often.items() if n >= 3})
    members: dict[str, list[int]] = {u: [] for u in often}
    for k, w in enumerate(words):
        for u in _units(w):
            if u in members:
                members[u].append(k)
    taken = np.zeros(len(words), bool)
    limit = math.log(CHANCE / max(3 * len(members), 1))

    def evidence(unit: str) -> float:
        left = [posts[k] for k in members[unit] if not taken[k]]
        if not left:
            return 0.0
        at, distinct = np.unique(np.concatenate(left), return_counts=True)
        best = 0.0
        for least in (1, 2, 3):  # texts with so many words of the unit: a toxic text may hold several, a clean one by chance
            some = at[distinct >= least]
            n, mean = int(toxic[some].sum()), float(rate[some].sum())
            if n < 3:
                break
            if n >= LIFT * mean:
                best = min(best, _tail(n, mean))
        return best

    heap = [(e, u) for u in members if (e := evidence(u)) < limit]
    heapq.heapify(heap)
    chosen: list[str] = []
    while heap:  # the strongest unit first; others are judged by the words it leaves
        _, u = heapq.heappop(heap)
        e = evidence(u)
        if heap and e > heap[0][0]:
            if e < limit:
                heapq.heappush(heap, (e, u))
        elif e < limit:
            chosen.append(u)
            taken[members[u]] = True
    # shorter stems of a chosen one: only these few are tried, so less evidence in their other words is enough
    around = sorted({v for u in chosen for v in members if len(v) < len(u) and (u.startswith(v) or u.endswith(v))}, key=lambda v: (-len(v), v))
    for u in around:
        if evidence(u) < math.log(CHANCE / (3 * len(around))):
            taken[members[u]] = True
    order = sorted(range(len(words)), key=lambda k: (-len(posts[k]), words[k]))
    return [words[k] for k in order if taken[k]], [words[k] for k in order if not taken[k]]


class Model:
    def __init__(self, texts: list[str], y: np.ndarray) -> None:
        self.table, self.stems = np.zeros(PLAIN**3, np.float32), np.zeros(MARKED**3, np.float32)
        self.bias, self.stem_bias, share = -1.0, -1.0, float(y.mean()) if len(y) else 0.0
        self.final = np.array([0.0, 0.0, 0.0, 0.0, math.log((share + 1e-4) / (1 - share + 1e-4))])
        if not y.any() or y.all():
            return
        bad = self._fit_words(texts, y)
        found = self._fit_stems(*stem_words(texts, y, set(bad)))
        if bad or found:
            x = np.concatenate([self.features(part) for _, part in pieces(pa.array(texts, pa.string()))])
            self.final = fit_logistic(x, y.astype(float))

    def _fit_stems(self, held: list[str], other: list[str]) -> bool:
        if not held or not other:
            return False
        held, other = held[:STEM_WORDS], other[: 8 * CLEAN_WORDS]
        matrix = marked(codes(held + other))
        first = np.arange(0, len(held), max(1, len(held) // STEM_LANDMARKS))
        near = triple_sums(matrix[len(held) :], sum(profile(matrix[i], MARKED) for i in first), MARKED)
        hard = len(held) + np.argsort(-near, kind="stable")[: CLEAN_WORDS // 2]
        picked = np.unique(np.concatenate([hard, len(held) + np.arange(len(other))[: CLEAN_WORDS // 2]]))
        rows = np.concatenate([np.arange(len(held)), picked])
        landmarks = np.concatenate([first, hard[: STEM_LANDMARKS]])
        sums = np.zeros((len(rows), len(landmarks)))
        for i in range(0, len(landmarks), 16):  # few profiles at a time: they are long
            part = np.stack([profile(matrix[j], MARKED) for j in landmarks[i : i + 16]], 1)
            sums[:, i : i + 16] = triple_sums(matrix[rows], part, MARKED)
        inner = sums[np.searchsorted(rows, landmarks)]
        value, vector = np.linalg.eigh(inner + 1e-6 * np.eye(len(inner)))
        whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        w, self.stem_bias = fit_svm(sums @ whiten, np.where(rows < len(held), 1.0, -1.0), c=20.0)
        for j, weight in zip(landmarks, whiten @ w, strict=True):
            self.stems += np.float32(weight) * profile(matrix[j], MARKED)
        return True

    def _fit_words(self, texts: list[str], y: np.ndarray) -> list[str]:
        toxic, clean, toxic_texts, clean_texts = Counter(), Counter(), Counter(), Counter()
        for text, label in zip(texts, y, strict=True):
            within = Counter()
            for sentence in _SENTENCE.split(text.lower()):
                within.update({w for w in (re.sub(r"[^a-z]", "", w) for w in sentence.split()) if 3 <= len(w) <= LONGEST})
            (toxic if label else clean).update(within)
            (toxic_texts if label else clean_texts).update(within.keys())
        # a landmark stands in labelled sentences of several toxic texts, hardly in clean ones, and
        # recurs about as the strongest does, which words that are toxic by chance do not
        bad = [w for w, n in toxic_texts.items() if n >= 3 and n >= 5 * clean_texts[w]]
        bad = sorted(bad, key=lambda w: (-toxic_texts[w], w))[:TOXIC_LANDMARKS]
        bad = [w for w in bad if toxic_texts[w] >= max(3, LEAST_SHARE * toxic_texts[bad[0]])]
        if not bad or not clean:
            return []
        common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: 4 * CLEAN_WORDS] if w not in bad]
        matrix = plain(codes(bad + common + [v for w in bad for v in _disguised(w)]))
        spelled = len(bad) + len(common)
        bad_profiles = np.array([profile(r) for r in matrix[: len(bad)]])
        near = triple_sums(matrix[len(bad) : spelled], np.ascontiguousarray(bad_profiles.T)).max(1)
        hard = np.argsort(-near, kind="stable")[: CLEAN_WORDS // 2]
        usual = np.arange(len(common))[: CLEAN_WORDS // 2]
        picked = len(bad) + np.unique(np.concatenate([hard, usual]))
        landmarks = np.concatenate([np.arange(len(bad)), len(bad) + usual[: CLEAN_LANDMARKS // 2], len(bad) + hard[: CLEAN_LANDMARKS // 2]])
        landmarks = np.unique(landmarks)
        profiles = np.array([profile(matrix[i]) for i in landmarks])
        inner = profiles @ profiles.T
        value, vector = np.linalg.eigh(inner + 1e-6 * np.eye(len(inner)))
        whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
        rows = np.concatenate([np.arange(len(bad)), np.arange(spelled, len(matrix)), picked])
        nystrom = triple_sums(matrix[rows], np.ascontiguousarray(profiles.T)) @ whiten
        w, self.bias = fit_svm(nystrom, np.where(np.arange(len(rows)) < len(rows) - len(picked), 1.0, -1.0), c=20.0)
        self.bias -= MARGIN
        self.table = (profiles.T @ (whiten @ w)).astype(np.float32)
        return bad

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, score, stem score) of every word with at least 3 letters and every spelled-out run."""
        words = Words(texts)
        letter = _LETTER[words.data]
        keep = letter != 255
        at = np.concatenate([[0], np.cumsum(keep)])
        a, b = at[words.starts], at[words.ends]
        compact = letter[keep]
        doc, single = words.doc, (b - a == 1) & (words.ends - words.starts <= 2)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        runs = [(i, j) for i, j in zip(edge[::2], edge[1::2], strict=True) if j - i >= 3]
        starts, ends, docs = [a], [b], [doc]
        for i, j in runs:  # single letters in a row within one document
            cuts = [i, *(np.flatnonzero(np.diff(doc[i:j])) + i + 1), j]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                starts.append(a[p : p + 1])
                ends.append(b[q - 1 : q])
                docs.append(doc[p : p + 1])
        a, b, doc = np.concatenate(starts), np.concatenate(ends), np.concatenate(docs)
        long = b - a > LONGEST
        if long.any():  # a long word is read in overlapping pieces
            pa_, pb, pd = [], [], []
            for s, e, d in zip(a[long], b[long], doc[long], strict=True):
                cut = np.arange(s, e, LONGEST // 2)
                pa_.append(cut)
                pb.append(np.minimum(cut + LONGEST, e))
                pd.append(np.full(len(cut), d))
            a, b, doc = np.concatenate([a[~long], *pa_]), np.concatenate([b[~long], *pb]), np.concatenate([doc[~long], *pd])
        ok = b - a >= 3
        a, b, doc = a[ok], b[ok], doc[ok]
        if not len(a):
            return doc, np.zeros(0), np.zeros(0)
        values = mix(compact.astype(np.uint64) + np.uint64(77))
        _, first, back = np.unique(rolling(values, a, b), return_index=True, return_inverse=True)
        a, b = a[first], b[first]
        matrix = np.full((len(a), LONGEST), 255, np.uint8)
        column = np.arange(LONGEST)
        inside = column < (b - a)[:, None]
        matrix[inside] = compact[(a[:, None] + column)[inside]]
        stem = triple_sums(marked(matrix), self.stems, MARKED) if self.stems.any() else np.zeros(len(matrix))
        return doc, (triple_sums(plain(matrix), self.table) + self.bias)[back], (stem + self.stem_bias)[back]

    def features(self, texts: pa.Array) -> np.ndarray:
        doc, f, stem = self.words(texts)
        top, hits, stems = np.full(len(texts), -2.0), np.zeros(len(texts)), np.zeros(len(texts))
        np.maximum.at(top, doc, f)
        np.add.at(hits, doc, f > 0)
        np.add.at(stems, doc, stem > 0)
        return np.stack([np.clip(top, -2.0, 0.0), np.log1p(hits), np.log1p(stems), stems > 0], 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts)
        return sigmoid(x @ self.final[:-1] + self.final[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD)
    model = Model(sample["text"].to_pylist(), sample["y"].to_numpy())
    del sample
    trim()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.score(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"))
    return map_slices(rows, kernel, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.score(batch.column("text")) < THRESHOLD))

    return map_slices(docs, kernel, docs.schema)
