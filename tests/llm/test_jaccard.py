"""The Jaccard join against brute force on planted groups."""

import random
import re

from rastrel.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k))))


def brute(rows, k=3, percent=90):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(seed, groups=6, size=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 30, 120, 300]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                at = rng.randrange(len(text))
                how = rng.random()
                if how < 0.5:
                    text[at] = rng.choice(words)
                elif how < 0.75 and len(text) > 1:
                    del text[at]
                else:
                    text.insert(at, rng.choice(words))
            if rng.random() < 0.2:
                base = text  # drift: chains whose ends are far apart
            rows.append((n, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed) + [(1000, ""), (1001, None), (1002, "one"), (1003, "one"), (1004, "one two"), (1005, "  \n")]
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()}
        assert got == brute(rows)


def test_linked_pairs_share_enough_signatures():
    import numpy as np
    import pyarrow as pa

    rows = planted(3, groups=8, size=12)
    for rule in (jaccard.Rule(3, 90), jaccard.Rule(5, 80), jaccard.Rule(2, 60)):
        sets = jaccard.Sets(pa.array([t for _, t in rows]), rule.shingle)
        sign, owner = jaccard.signatures(sets, rule)
        signs = [set(sign[owner == i].tolist()) for i in range(len(rows))]
        need = jaccard.spare(jaccard.kinds(sets.sizes, rule)[0], rule)
        each, linked = sets.each(), 0
        for i in range(len(each)):
            for j in range(i):
                both, either = len(np.intersect1d(each[i], each[j])), len(np.union1d(each[i], each[j]))
                if 100 * both >= rule.percent * either:
                    linked += 1
                    assert len(signs[i] & signs[j]) >= min(need[i], need[j])
        assert linked > 20


def test_unrelated_sets_share_no_signature():
    import pyarrow as pa

    rng = random.Random(7)
    for n in (9, 100, 1000):
        texts = [" ".join(str(rng.random()) for _ in range(n)) for _ in range(200)]
        for rule in (jaccard.RULE, jaccard.Rule(5, 80)):
            sign, owner = jaccard.signatures(jaccard.Sets(pa.array(texts), rule.shingle), rule)
            pairs = set(zip(sign.tolist(), owner.tolist(), strict=True))
            assert len({s for s, _ in pairs}) == len(pairs)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_texts_that_polynomials_confuse_stay_apart(spark):
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, one), (2, other), (3, " ".join(one)), (4, " ".join(other)), (5, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} and got[2] == 2


def test_kept_rows_keep_clashing_columns(spark):
    names = ["__kept", "id", "row", "order", "node", "a b"]
    rows = [(i, "same words in all of these rows", *(10 * i + k for k in range(len(names)))) for i in (1, 2, 3)] + [(4, "other words", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]


def test_edge_cases_and_kept_rows(spark):
    rows = [(2, "a b c d", None, None, None), (1, "A b c D", "en", "s", 7), (1, "A b c D", "en", "s", 7), (None, "a b c d", "en", "s", 7), (3, None, "en", "s", 0), (4, "x " * 20000, "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", node long")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in jaccard.classes(docs).collect() if r["doc_id"] is not None)
    assert [(a, b) for _, a, b in got] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    empty = docs.limit(0)
    assert jaccard.classes(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_stage_equals_brute_force_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rows = planted(4, groups=5, size=16) + [(1000, ""), (1001, None), (1002, "one"), (1003, "one"), (1004, "one two"), (1005, "one two three four")]
    want = brute(rows, 5, 80)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, corpus_pipeline.NEAR).collect()}
    assert got == want
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i} and len(kept) < len({c for _, c in brute(rows).values()})


def test_unrelated_texts_with_a_passage_in_common(spark):
    """A hot passage, near copies of several kinds and chains of them, at both rules in use."""
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(5000)}"
    passage = [word() for _ in range(14)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join([word() for _ in range(rng.randrange(4, 40))] + passage + [word() for _ in range(rng.randrange(0, 30))])))
    base = [word() for _ in range(60)]
    for i in range(150, 260):
        text = list(base) + (passage if i % 3 == 0 else [])
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for rule in (jaccard.RULE, jaccard.Rule(5, 80), jaccard.Rule(2, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, rule).collect()}
        assert got == brute(rows, *rule)
