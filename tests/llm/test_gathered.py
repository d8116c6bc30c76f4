"""Operators that compare documents: substring dedup and packing, and the pipeline."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from rastrel.llm import common, packing, queries, substrings

from .helpers import CLASHES, ODD, WORD, docs


# ---------------------------------------------------------------- substring dedup
def brute_dedup(rows):
    words = {}
    for i, t in rows:
        words.setdefault(i, []).append(WORD.findall(t or ""))
    first = {}
    for i in sorted(words):
        for w in words[i]:
            for k in range(len(w) - 12):
                first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (13, 14, 20, 60, 200)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) - 11)
            text += p[a:] if rng.random() < 0.6 else p[: len(p) - a]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rng.shuffle(rows)
    return rows


def test_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed) + [(500, None), (501, ""), (502, "short text"), (503, "a " * 12), (504, "a " * 40)]
        got = sorted(tuple(r) for r in substrings.dedup_report(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == brute_dedup(rows)


def test_dedup_edge_cases(spark):
    odd = docs(spark, ODD, CLASHES)
    out = substrings.deduplicated(odd).collect()
    assert len(out) == len(ODD) and sum(r["n_removed"] for r in out) == 0
    assert substrings.deduplicated(odd.limit(0)).count() == 0


def test_repeated_spans_have_true_coordinates(spark):
    rows = planted(3)
    texts = {i: WORD.findall(t) for i, t in rows}
    spans = substrings.repeated_spans(docs(spark, rows), 50).collect()
    assert spans
    for r in spans:
        a, b = texts[r["doc_id"]], texts[r["source_id"]]
        assert r["n_words"] >= 50 and a[r["start"] : r["start"] + r["n_words"]] == b[r["source_start"] : r["source_start"] + r["n_words"]]


def test_shared_passages_are_reported_whole(spark):
    rng = random.Random(11)
    word = lambda: f"u{rng.randrange(10**9)}"
    rows, want = [], set()
    for k, n in enumerate((50, 51, 55, 60, 75, 120, 400)):
        passage = [word() for _ in range(n)]
        for j in range(3):
            before = [word() for _ in range(rng.randrange(0, 40))]
            rows.append((10 * k + j, " ".join(before + passage + [word() for _ in range(rng.randrange(0, 40))])))
            if j:
                want.add((10 * k + j, len(before), n, 10 * k))
    got = {(r["doc_id"], r["start"], r["n_words"], r["source_id"]) for r in substrings.repeated_spans(docs(spark, rows), 50).collect()}
    assert got == want


def test_words_that_polynomials_confuse_are_kept(spark):
    from .test_jaccard import thue_morse

    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, "x " * 12 + one), (2, "x " * 12 + other), (3, " ".join(one)), (4, " ".join(other)), (5, " ".join(one) + " end")]
    got = sorted(tuple(r) for r in substrings.dedup_report(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_dedup(rows) and got[1][2] == 0


def test_paths_are_nonbranching_and_whole(spark):
    """Compaction against a walk over the same pieces in plain Python."""
    texts = docs(spark, planted(5)).select("doc_id", "text").where("text is not null")
    pieces = substrings._pieces(texts, substrings._sourced(substrings._runs(texts)))
    graph = substrings._graph(pieces)
    rows = {r["pid"]: r for r in graph.collect()}
    into, out = {}, {}
    for i, r in rows.items():
        into.setdefault(r["head"], []).append(i)
        out.setdefault(r["tail"], []).append(i)
    before = {i: into[r["tail"]][0] for i, r in rows.items() if len(into.get(r["tail"], [])) == 1 and len(out[r["tail"]]) == 1}
    want = {}
    for i in before:
        at, n, seen = i, 0, set()
        while at in before and at not in seen:
            seen.add(at)
            at = before[at]
            n += rows[at]["edges"]
        if at not in before:  # not on a cycle
            want[i] = (at, n)
    got = {r["pid"]: (r["path"], r["offset"]) for r in substrings.compacted(graph).collect()}
    for i in set(got) - set(want):  # a cycle's pieces are one path up to where it is broken
        at, n = i, 0
        while at != got[i][0]:
            at = before[at]
            n += rows[at]["edges"]
        assert n == got.pop(i)[1]
    assert got == want and len(set(p for p, _ in got.values())) > 3 and max(n for _, n in got.values()) > 100


def test_seeds_and_runs_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, " ".join(f"w{j}" for j in range(i % 7, 40 + i % 7)), None, None) for i in range(60)]
    texts = docs(spark, rows).select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    assert substrings._runs(texts).where("edges > 0").count() >= 60
    assert read.value == 2 * 60


# ---------------------------------------------------------------- packing
def test_ids_equal_the_whole_tokenizer():
    path = packing.vocabulary_path()
    texts = ["Hello, World!! it's don't 'S re3al", "ÀÉß çà İstanbul ΣΑΣ x́ é a b a\u0085b", "<|endoftext|>a <|startoftext|>", "$$$the%%% ab's ''s' 12", "日本語 テスト!", "a\x1cb\x0bd", "", None, "Œ ÿ µ ª º × ÷ ŉ ǅ ﬁ"]
    flat, n = packing.encode(pa.array(texts), path)
    at = np.cumsum(n) - n
    for t, a, k in zip(texts, at, n):
        assert flat[a : a + k].tolist() == packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids + [2]


def test_tokenizing_holds_few_numbers_for_each_byte():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}rd" for i in range(500)]
    text = " ".join(words[(i * i + 7 * i) % 500] for i in range(1500))
    texts, path = pa.array([f"{text} {i}" for i in range(60)]), packing.vocabulary_path()
    packing.encode(texts, path)  # fills the cache
    tracemalloc.start()
    packing.encode(texts, path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * texts.nbytes


def test_words_are_told_apart_by_their_bytes():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("ab\0é", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(3000)) for _ in range(2)]
    texts += ["", "x", "a\0", "a", "a" * 8, "a" * 9, "a" * 8 + "\0", "a" * 300, "a" * 299 + "b", None]
    words = common.Words(pa.array(texts))
    own = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    for seed in (1, 2):
        hashes = common.spelled(words.data, words.starts, words.ends, seed).tolist()
        assert len(set(own)) == len(set(hashes)) == len(set(zip(own, hashes)))


def test_hilbert_curve_is_a_path():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_packing(rows, pieces):
    path = packing.vocabulary_path()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids + [2])
    found = {}
    for p in pieces:
        found.setdefault(p["sequence_id"], []).append(p)
        own = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        part = lambda x: zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())  # noqa: B023, E731
        assert any(part(x) == p["ids_crc32"] for x in own)
    assert sorted(found) == list(range(len(found)))
    for k, ps in found.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == packing.CAPACITY or k == len(found) - 1
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in ids.values() for x in v)


def test_packing_is_a_round_trip(spark):
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + i, f"some words {i} " * (i % 40)) for i in range(200)]
    check_packing(rows, packing.pack(docs(spark, [(i, t, None, None) for i, t in rows], CLASHES)).collect())
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_packing_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(rows, queries.op3_packing(spark, sf_dir).collect())


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toArrow())
            counts.append(docs.count())
        if name == "toxicity":
            assert not docs.where("text rlike '(idiot|moron|scum)'").count()
        if name == "near_duplicates":
            from rastrel.llm import jaccard

            classes = jaccard.classes(docs)
            assert classes.select("component_id").distinct().count() == docs.count()
        if name == "secrets":
            from rastrel.llm import secrets

            # what is left would be found again only where masking joined two ends
            assert sum(bool(secrets.scan(r["text"])[0]) for r in docs.select("text").collect()) <= 1
    kept = docs.collect()
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage against plain Python on what the stage before it kept."""
    from rastrel.llm import mixing, secrets, toxicity

    from .test_jaccard import brute
    from .test_mapped import fill

    stages = dict(corpus_pipeline.STAGES)
    table = lambda df: sorted(map(tuple, df.collect()), key=repr)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in table(docs) if model.score(pa.array([r[1]]))[0] < toxicity.THRESHOLD]
    docs = stages["toxicity"](spark, docs, sf_dir)
    assert table(docs) == want

    docs = spark.createDataFrame(docs.toArrow())
    classes = brute([(r[0], r[1]) for r in want], *corpus_pipeline.NEAR)
    want = [r for r in want if classes[r[0]][1] == r[0]]
    docs = spark.createDataFrame(stages["near_duplicates"](spark, docs, sf_dir).toArrow())
    assert table(docs) == want

    masked = [(r[0], secrets.mask(r[1]), r[2], r[3]) for r in want]
    want = [(*m, r[4] if m[1] == r[1] else len(m[1])) for m, r in zip(masked, want)]
    docs = spark.createDataFrame(stages["secrets"](spark, docs, sf_dir).toArrow())
    assert table(docs) == want

    size = {r[0]: len(WORD.findall(r[1] or "")) for r in want}
    sums = {}
    for r in want:
        sums[r[3]] = sums.get(r[3], 0) + size[r[0]]
    target, mixed = fill(sums), []
    for r in want:
        rate = target[r[3]] / sums[r[3]] if sums[r[3]] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        mixed += [r] * min(3, int(rate) + (u < rate - int(rate)))
    docs = spark.createDataFrame(stages["mixing"](spark, docs, sf_dir).toArrow())
    assert table(docs) == sorted(mixed, key=repr)

    check_packing([(r[0], r[1]) for r in mixed], stages["packing"](spark, docs, sf_dir).collect())


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """No odd row is toxic or secret; of rows 6 and 7 (one text) the smallest stays, once; columns keep their values."""
    odd = docs(spark, ODD, CLASHES)
    clean = sorted({str(r[0]): r for r in ODD if r[0] != 7})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        if name == "packing":
            check_packing([(r[0], r[1]) for r in ODD], out.collect())
        else:
            assert out.columns == odd.columns
            rows = out.collect()
            assert all(r[c.split()[0]] == 7 for r in rows for c in CLASHES.split(", "))
            ids = sorted(str(r["doc_id"]) for r in rows)
            assert name == "mixing" or ids == (clean if name == "near_duplicates" else sorted(str(r[0]) for r in ODD))
            assert {(r["doc_id"], r["text"]) for r in rows} <= {(r[0], r[1]) for r in ODD}
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
