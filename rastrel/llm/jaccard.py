"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one node. Similar nodes are partitioned into groups, group
token unions bound what a query can share with a group, and only qualifying groups are opened.

Shingle length and threshold are a ``Rule``; the numbers below are those of ``RULE``, the query's.

1. Signatures. Sets whose Jaccard similarity is at least 0.9 differ in at most (|A|+|B|)/19 tokens.
   A set's tokens are dealt by hash into more parts than that; a part without tokens says nothing and
   is dropped, and a set with too few parts left is dealt again (the last dealing makes each token a
   part), so of two linked sets one has ``spare`` filled parts more than they may differ in, and they
   agree on so many. A signature is a conjunction of all tokens of a part: a token that a third of all
   documents hold costs nothing. Blocks of documents send each signature once, packed, to its bucket
   and get back which of them occur elsewhere.
2. A document that shares fewer signatures than ``spare`` with all others together links with none.
   What is left is pruned again against itself.
3. Groups. Every node is first compared with one other, exactly: of the leaders of its signatures'
   groups (the node with most shared signatures in each) with the strongest. If they link, that is its
   root, else it is its own. Then in rounds: the strongest root in a signature's group leads it, the
   nodes under other roots are compared with it, and those that link to it are its ball, as are those
   under it. They leave the group. As Jaccard distance is a metric, one that links to a node of the
   ball, but not to the leader, is no further from it than twice the allowed distance: it is a query of
   the ball. The rest of the group goes to the next round, pruned as in 2; a group under one root is
   connected and done. After ``ROUNDS`` rounds what is left are mostly unrelated nodes with a passage in common; each component of them is a group, too.
4. Token-group matrix. Nodes are coded by their difference from their group's leader, members with the
   same rarest difference token form a row of the matrix, and the row holds the union of their tokens. A link
   with a query needs more shared difference tokens the further both lie from the leader; with tokens
   ordered by rarity that bounds the prefix of a node that must meet the matrix and the places where
   they may first meet, and the row's token union must hold enough of the query's tokens for its
   members to be opened and compared, exactly.
5. Components of all links give the classes.

Candidates are found by hashes; every link is decided on the words themselves. Equal sets are told by
128 bits. Nothing is emitted per pair of a group: 3 is one row per node, 4 is limited to queries.

Defined cases: null text and text without words have an empty set and link with nothing; rows that
share a doc_id are one document (of different texts one counts, the same in every run); rows without a
doc_id have no component; empty tables give empty results; other columns, whatever their names, are
never read, and ``keep_one`` returns them as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import U64, Words, components, cut, map_slices, mix, release, rolling, signed, slices, trim


class Rule(NamedTuple):
    """Links need 100 * intersection >= percent * union, of shingles of so many words.

    That is (100 + percent) * difference <= (100 - percent) * (|A| + |B|).
    """

    shingle: int = 3
    percent: int = 90

    @property
    def part(self) -> float:
        """Linked sets differ in at most (|A| + |B|) / part tokens."""
        return (100 + self.percent) / (100 - self.percent)

    @property
    def gap(self) -> float:
        """Sets linked to one of n tokens differ from it in at most n * gap tokens."""
        return (100 - self.percent) / self.percent


    def most(self, size: np.ndarray) -> np.ndarray:
        """The largest size of a set that may link to one of ``size`` tokens."""
        return size * 100 // self.percent

    def apart(self, size: np.ndarray) -> np.ndarray:
        """In how many tokens linked sets of so many tokens together may differ."""
        return size * (100 - self.percent) // (100 + self.percent)


RULE = Rule()
#: Rounds of leaders before what is left goes to the matrix, and members of a matrix row; any numbers give the same links.
ROUNDS, SLOT = 3, 64
#: Each size class ends at so many times its beginning. At least the inverse of any threshold in use.
WIDTH = 1.7
#: A set is dealt at most so often; the last time each token is a part of its own.
DEALINGS = 6
#: Bytes of text whose signatures a task gathers before sending them, and bytes of signatures in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Buckets of a block that go to the JVM at once.
SEND = 16


class Sets:
    """The distinct hashed shingles of every text of a slice, one after the other."""

    def __init__(self, texts: pa.Array, k: int = RULE.shingle) -> None:
        words = Words(texts)
        h = words.hashes(lower=True)
        grams, _ = words.windows(h, k)
        each = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= k:
                each.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                each.append(rolling(h, np.array([a]), np.array([b]), 5))
            else:
                each.append(np.zeros(0, U64))
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.tokens = np.concatenate([*each, np.zeros(0, U64)])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def each(self) -> list[np.ndarray]:
        return [self.tokens[a:b] for a, b in zip(self.first[:-1], self.first[1:], strict=True)]

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as two numbers."""
        out = []
        for salt in (0, 0x5851F42D4C957F2D):
            total = np.zeros(len(self.tokens) + 1, U64)
            np.cumsum(mix(self.tokens ^ U64(salt)), out=total[1:])
            out.append(mix((total[self.first[1:]] - total[self.first[:-1]]) ^ mix(self.sizes.astype(U64) + U64(salt))))
        return out[0], out[1]


def exact_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingles of every text as numbers; within this call equal numbers are equal words."""
    words = Words(texts)
    one, n = words.numbers(lower=True)
    grams = words.joined_numbers(one, n, k)
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(np.array([-1 - short.setdefault(tuple(one[a:b].tolist()), len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


@lru_cache(maxsize=8)
def size_classes(limit: int = 1 << 33) -> np.ndarray:
    """Upper ends of the size classes: sizes of linked sets lie in one class or in two neighbours."""
    out, low = [], 1
    while low < limit:
        out.append(max(low, int(low * WIDTH)))
        low = out[-1] + 1
    return np.array(out)


def spare(kind: np.ndarray, rule: Rule) -> np.ndarray:
    """How many signatures linked sets share at least, in the dealing of a size class."""
    return 1 + rule.apart(2 * size_classes()[kind]) // 8


def kinds(sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(size class, whether a set of the next class may link) of each size."""
    own = np.searchsorted(size_classes(), sizes)
    return own, rule.most(sizes) > size_classes()[own]


def signatures(sets: Sets, rule: Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of its set) of all sets; the lowest bit of a signature tells odd size classes."""
    own, also = kinds(sets.sizes, rule)
    signs, owners = [], []
    for up in (0, 1):
        some = np.flatnonzero((sets.sizes > 0) & (also if up else True))
        for dealing in range(DEALINGS):
            if not len(some):
                break
            size, kind = sets.sizes[some], own[some] + up
            end = size_classes()[kind]
            j = spare(kind, rule)
            parts = ((rule.apart(2 * end) + j) * 106 + 99) // 100 + 1
            at = np.cumsum(size) - size
            token = sets.tokens[np.arange(size.sum()) + np.repeat(sets.first[some] - at, size)]
            salt = mix((kind * 64 + dealing).astype(U64) + U64(1 << 32))
            if dealing < DEALINGS - 1:
                base = np.cumsum(parts) - parts
                where = (mix(token ^ np.repeat(salt, size)) % np.repeat(parts, size).astype(U64)).astype(np.int64) + np.repeat(base, size)
                total = np.zeros(int(parts.sum()), U64)
                np.add.at(total, where, mix(token + U64(7)))
                filled = np.flatnonzero(np.bincount(where, minlength=len(total)))
                owner = np.repeat(np.arange(len(some)), parts)[filled]
                total = total[filled] ^ mix((filled - base[owner]).astype(U64))
                count = np.bincount(owner, minlength=len(some))
                again = count < rule.apart(size + np.minimum(end, rule.most(size))) + j
            else:
                total, owner, again = token, np.repeat(np.arange(len(some)), size), np.zeros(len(some), bool)
            signs.append(mix(total ^ salt[owner]) & ~U64(1) | (kind[owner] & 1).astype(U64))
            owners.append(some[owner])
            some = some[again]
    return np.concatenate([*signs, np.zeros(0, U64)]), np.concatenate([*owners, np.zeros(0, np.int64)])


def sets_table(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, n_shingles, kind, need0, need1, node) for every row.

    The node is the smallest document with the same set; kind is the size class, and need0 and need1 are
    the signatures to share in its dealing and in the next class's.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(batch.column("text"), rule.shingle)
        one, two = sets.identity()
        kind = kinds(sets.sizes, rule)[0]
        cols = [batch.column("doc_id"), pa.array(sets.sizes), signed(one), signed(two), pa.array(kind), *(pa.array(spare(kind + up, rule)) for up in (0, 1))]
        return pa.record_batch(cols, names=["doc_id", "n_shingles", "one", "two", "kind", "need0", "need1"])

    rows = cut(map_slices(docs.select("doc_id", "text"), kernel, "doc_id long, n_shingles long, one long, two long, kind long, need0 long, need1 long"))
    same = rows.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    same = cut(same.where("low < high").drop("high"))
    named = rows.join(same, ["one", "two"], "left")
    return cut(named.select("doc_id", "n_shingles", "kind", "need0", "need1", F.when(F.col("n_shingles") > 0, F.coalesce("low", "doc_id")).alias("node")), rows, same)


_PACKED = "bucket int, sigs binary, lowest long, ids binary, marks binary, known binary, known_ids binary"


def _packed(docs: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Signatures by bucket (their highest bits), packed by block of documents.

    A signature found once in a block goes to its bucket with its document. One found more often is
    shared already: a mark tells its bucket, and its rows go to any bucket, by turns.
    """
    n = 1 << bits

    def block(signs: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, owner = np.concatenate(signs), np.concatenate(ids)
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        new = np.ones(len(sig) + 1, bool)
        np.not_equal(sig[1:], sig[:-1], out=new[1:-1])
        lone, head = new[:-1] & new[1:], new[:-1] & ~new[1:]
        lowest = int(owner.min())
        owner = owner - lowest
        owner = owner.astype("<u4" if owner.max(initial=0) < 1 << 32 else "<i8")
        turn = int(sig[0] & U64(n - 1))
        bounds = (np.arange(n, dtype=object) << (64 - bits)).astype(U64)
        one, one_ids, marks, many, many_ids = sig[lone], owner[lone], sig[head], sig[~lone], owner[~lone]
        at = [np.append(np.searchsorted(x, bounds), len(x)) for x in (one, marks, many)]
        kinds = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 4)
        for first in range(0, n, SEND):
            rows = []
            for b in range(first, min(n, first + SEND)):
                k = (b + turn) % n
                i, j, m = slice(at[0][b], at[0][b + 1]), slice(at[1][b], at[1][b + 1]), slice(at[2][k], at[2][k + 1])
                if i.start < i.stop or j.start < j.stop or m.start < m.stop:
                    rows.append((b, one[i].tobytes(), lowest, one_ids[i].tobytes(), marks[j].tobytes(), many[m].tobytes(), many_ids[m].tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])
        trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, ids, size, seen = [], [], 0, set()
        for batch in slices(batches):
            sets = Sets(batch.column("text"), rule.shingle)
            fresh = np.zeros(len(sets.sizes), bool)
            for i, key in enumerate(zip(*(x.tolist() for x in sets.identity()), strict=True)):
                fresh[i] = key not in seen
                seen.add(key)
            sig, owner = signatures(sets, rule)
            keep = fresh[owner]
            signs.append(sig[keep])
            ids.append(batch.column("doc_id").to_numpy()[owner[keep]])
            size += batch.column("text").nbytes
            if size > BLOCK_BYTES:
                if sum(map(len, signs)):
                    yield from block(signs, ids)
                signs, ids, size, seen = [], [], 0, set()
        if sum(map(len, signs)):
            yield from block(signs, ids)
        trim()

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, _PACKED)


def _shared_rows(packed: DataFrame) -> DataFrame:
    """(sig, doc_id): the signatures found in more than one place, with their documents."""

    def numbers(column: pa.ChunkedArray, kind: str = "<u8") -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    def ids(lowest: list[int], raw: list[bytes], sigs: list[bytes]) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, "<u4" if 2 * len(x) == len(s) else "<i8").astype(np.int64) + low for low, x, s in zip(lowest, raw, sigs, strict=True)])

    def reduce(table: pa.Table) -> pa.Table:
        lowest = table["lowest"].to_pylist()
        sig, marks = numbers(table["sigs"]), numbers(table["marks"])
        order = np.argsort(sig, kind="stable")
        ordered = sig[order]
        same = np.zeros(len(sig) + 1, bool)
        np.equal(ordered[1:], ordered[:-1], out=same[1:-1])
        again = np.zeros(len(sig), bool)
        again[order] = same[:-1] | same[1:]
        again |= np.isin(sig, marks)
        owner = ids(lowest, table["ids"].to_pylist(), table["sigs"].to_pylist())[again]
        known = ids(lowest, table["known_ids"].to_pylist(), table["known"].to_pylist())
        trim()
        return pa.table({"sig": signed(np.concatenate([sig[again], numbers(table["known"])])), "doc_id": np.concatenate([owner, known])})

    return packed.groupBy("bucket").applyInArrow(reduce, "sig long, doc_id long")


def _survivors(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, kind, need0, need1, sig): what nodes share that may link with any other."""
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(6, int(total * 6 // BUCKET_BYTES).bit_length())
    held = _shared_rows(_packed(docs, rule, bits)).groupBy("doc_id").agg(F.collect_list("sig").alias("sigs"))
    per_node = [F.min_by(c, "doc_id").alias(c) for c in ("kind", "need0", "need1", "sigs")]
    held = nodes.where("node is not null and doc_id is not null").join(held, "doc_id").groupBy("node").agg(*per_node)
    rows = cut(_enough(held, "sigs"))
    # equal sets are one node from here on
    shared = cut(rows.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sig"))
    return cut(_enough(_per_node(rows.join(shared, "sig"), F.col("sig")), "sigs"), rows, shared)


def _per_node(rows: DataFrame, value: Column, *more: str) -> DataFrame:
    """One row per node with the list of ``value``; no longer than the node's text."""
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("kind", "need0", "need1", *more)), F.collect_list(value).alias("sigs"))


def _enough(held: DataFrame, name: str, sig: Callable[[Column], Column] = lambda e: e, *more: str) -> DataFrame:
    """The list's entries, exploded as ``sig``, of the classes in which a node shares enough signatures."""
    for up in (0, 1):
        part = F.filter(name, lambda e: sig(e).bitwiseAND(F.lit(1)) == (F.col("kind") + up) % 2)  # noqa: B023
        held = held.withColumn(f"part{up}", F.when(F.size(part) >= F.col(f"need{up}"), part))
    both = F.concat(*(F.coalesce(f"part{up}", F.filter(name, lambda _: F.lit(False))) for up in (0, 1)))
    return held.select("node", "kind", "need0", "need1", *more, F.explode(F.array_distinct(both)).alias("sig"))


def _node_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, text): the text of each node in ``members``."""
    rows = docs.select("doc_id", "text").join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return cut(rows.groupBy(F.col("doc_id").alias("node")).agg(F.min("text").alias("text")))


def _compared(pairs: DataFrame, texts: DataFrame, diffs: bool, rule: Rule) -> DataFrame:
    """Compare ``a`` with ``b`` word for word: (a, b, family, size, size_b, difference, linked), and with
    ``diffs`` also the hashed tokens that only one of them has."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b")
    schema = "a long, b long, family string, size long, size_b long, difference long, linked boolean" + ", tokens array<long>" * diffs

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column("b").to_pylist()
        first: dict[int, int] = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        place = {k: len(keys) + i for i, k in enumerate(first)}
        kind = pa.large_string()
        texts = pa.concat_arrays([batch.column("text_a").cast(kind), batch.column("text_b").cast(kind).take(pa.array(list(first.values())))])
        sets = exact_sets(texts, rule.shingle)
        hashed = Sets(texts, rule.shingle).each() if diffs else []
        size, other, gap, tokens = [], [], [], []
        for i, k in enumerate(keys):
            s, t = sets[i], sets[place[k]]
            size.append(len(s))
            other.append(len(t))
            gap.append(len(s) + len(t) - 2 * len(np.intersect1d(s, t, assume_unique=True)))
            tokens.append(np.setxor1d(hashed[i], hashed[place[k]], assume_unique=True).view(np.int64) if diffs else None)
        size, other, gap = (np.array(x, np.int64) for x in (size, other, gap))
        cols = [batch.column(n) for n in ("a", "b", "family")] + [pa.array(size), pa.array(other), pa.array(gap), pa.array((100 + rule.percent) * gap <= (100 - rule.percent) * (size + other))]
        names = ["a", "b", "family", "size", "size_b", "difference", "linked"]
        if diffs:
            cols, names = [*cols, pa.array(tokens, pa.list_(pa.int64()))], [*names, "tokens"]
        return pa.record_batch(cols, names=names)

    return map_slices(rows.select("a", "b", "family", "text_a", "text_b"), kernel, schema, "text_a")


def _ball(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("node").alias("a"), "b", F.concat(F.lit("ball "), F.col("b").cast("string")).alias("family"))


def _rooted(rows: DataFrame, texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comparisons, rows with root and strength, weight of each node): every node against its strongest leader."""
    weight = cut(rows.groupBy("node").agg(F.count("*").alias("weight")))
    lead = rows.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("l"))
    lead = cut(lead.select("sig", F.col("l.node").alias("b"), F.col("l.weight").alias("strength")))
    best = cut(rows.join(lead, "sig").groupBy("node").agg(F.max_by("b", F.struct("strength", "b")).alias("b")), lead)
    compared = cut(_compared(_ball(best.where("node <> b")), texts, diffs=False, rule=rule), best)
    linked = compared.where("linked").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = weight.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    strength = weight.select(F.col("node").alias("root"), F.col("weight").alias("strength"))
    roots = cut(roots.join(strength, "root"))
    return compared, cut(rows.join(roots, "node"), roots), weight


def _balls(rows: DataFrame, texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(what lies in balls or near them, rows left over, tables to release): rounds of leaders.

    The first has (a, b, family, linked): ``a`` compared with the leader ``b``.
    """
    near = rule.percent * F.col("difference") <= (100 - rule.percent) * (F.col("size") + F.col("size_b"))
    compared, alive, weight = _rooted(rows, texts, rule)
    kept, spent = [compared, weight], [alive]
    found = [compared.where(near).select("a", "b", "family", "linked")]
    for _ in range(ROUNDS):
        lead = alive.groupBy("sig").agg(F.max_by("root", F.struct("strength", "root")).alias("b"), F.max("strength").alias("power"), F.min("root").alias("low"), F.max("root").alias("high"))
        lead = cut(lead.where("low < high").select("sig", "b", "power"))
        # of the groups that still have two roots, the rows of nodes with enough signatures
        led = _enough(_per_node(alive.join(lead, "sig"), F.struct("sig", "b", "power"), "root", "strength"), "sigs", lambda e: e["sig"], "root", "strength")
        led = cut(led.select("node", "kind", "need0", "need1", "root", "strength", "sig.*").where("root <> b"), lead, *spent)
        spent = [led]
        compared = cut(_compared(_ball(led.where("node <> b").select("node", "b").distinct()), texts, diffs=False, rule=rule))
        kept.append(compared)
        found.append(compared.where(near).select("a", "b", "family", "linked"))
        linked = compared.where("linked").select(F.col("a").alias("node"), "b")
        moved = led.join(linked, ["node", "b"], "left_semi").groupBy("node").agg(F.max_by("b", F.struct("power", "b")).alias("to"), F.max("power").alias("more"))
        moved = cut(moved)
        kept.append(moved)
        alive = led.where("node <> b").join(linked, ["node", "b"], "left_anti").join(moved, "node", "left")
        better = F.coalesce(F.col("more") > F.col("strength"), F.lit(False))
        alive = alive.select("node", "kind", "need0", "need1", F.when(better, F.col("to")).otherwise(F.col("root")).alias("root"), F.when(better, F.col("more")).otherwise(F.col("strength")).alias("strength"), "sig")
        if not alive.head(1):
            break
    left = cut(alive.join(weight, "node"), *spent)
    return reduce(DataFrame.unionByName, found), left, [*kept, left]


def _rest(alive: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, family, linked) of what the rounds left over: components, each compared with its leader."""
    shared = cut(alive.groupBy("sig").agg(F.min("node").alias("low"), F.min("root").alias("one"), F.max("root").alias("two")).where("one < two").select("sig", "low"))
    stars = alive.join(shared, "sig").where("node <> low").select("node", "low").distinct()
    families = components(stars, "node", "low").join(alive.select("node", "weight").distinct(), "node")
    families = cut(families.select("node", F.concat(F.lit("rest "), F.col("root").cast("string")).alias("family"), "weight"), shared)
    leader = cut(families.groupBy("family").agg(F.max_by("node", F.struct("weight", "node")).alias("b")))
    pairs = families.select(F.col("node").alias("a"), "family").join(leader, "family").where("a <> b")
    return cut(_compared(pairs, texts, diffs=False, rule=rule).select("a", "b", "family", "linked"), families, leader)


def _query_links(balls: DataFrame, rest: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links between queries and members that do not lead their group, by the token-group matrix: (a, b)."""
    met = balls.withColumn("member", F.col("linked")).unionByName(rest.withColumn("member", F.lit(True)))
    # groups that have a query, and someone else it may link to
    open_ = met.groupBy("family").agg(F.bool_or(~F.col("linked")).alias("asks"), F.bool_or("member").alias("has"), F.count("*").alias("n"))
    open_ = cut(open_.where("asks and has and n > 1").select("family"))
    pairs = cut(met.join(open_, "family", "left_semi"), open_)
    coded = _compared(pairs.select("a", "b", "family"), texts, diffs=True, rule=rule)
    coded = coded.join(pairs.select("a", "family", "member"), ["a", "family"])
    coded = cut(coded.withColumn("cluster", F.when(F.col("linked"), F.col("b")).otherwise(F.col("a"))), pairs)
    tokens = coded.select("family", F.col("a").alias("node"), "cluster", "size", "size_b", "difference", "linked", "member", F.explode("tokens").alias("token"))
    often = cut(tokens.groupBy("family", "token").agg(F.count("*").alias("freq"), F.count_if("member").alias("members"), F.count_if(~F.col("linked")).alias("queries")))
    # only tokens that a query and some other member have can be shared
    tokens = cut(tokens.join(often.where("freq > 1 and members > 0 and queries > 0").select("family", "token", "freq"), ["family", "token"]), coded, often)
    # Order of a node's tokens: rare ones first. A pair links only if it shares r = (d + e - (|q| + |y|)/19) / 2
    # tokens (d, e: differences from the leader). So its first shared token, at places i and j among those that
    # can be shared, u and v in number, leaves room for r: 2 (1 + u - i) >= 2 r and 2 (1 + v - j) >= 2 r.
    d, size = F.col("difference"), F.col("size") / rule.part
    per = Window.partitionBy("family", "node")
    place = F.row_number().over(per.orderBy("freq", "token"))
    placed = tokens.withColumn("left", 2 * (1 + F.count("*").over(per) - place)).withColumn("room", F.col("left") - d + size).withColumn("reach", d - size)
    # against a query e - (|y| - leader)/19 bounds 2 r from below, against any node 2 r is over 2 (d - |q|/9)
    least = F.greatest((d - (F.col("size") - F.col("size_b")) / rule.part), 2 * d - F.col("size") * 2 * rule.gap)
    slack = F.lit(1e-3)  # above the rounding of these fractions; more would only open more
    prefix = cut(placed.where(F.col("member") & (F.col("left") + slack >= least)))
    # rows by cluster and rarest prefix token, of some SLOT members each; a row bounds its members' room and reach
    group = cut(prefix.groupBy("family", "node", "cluster").agg(F.min_by("token", F.struct("freq", "token")).alias("first")))
    slots = cut(group.groupBy("family", "cluster", "first").agg(F.ceil(F.count("*") / SLOT).alias("slots")))
    group = cut(group.join(slots, ["family", "cluster", "first"]).select("family", "node", F.xxhash64("cluster", "first", F.pmod(F.xxhash64("node"), "slots")).alias("grp")), group, slots)
    matrix = cut(prefix.join(group, ["family", "node"]).groupBy("family", "token", "grp", "cluster").agg(F.max("room").alias("room"), F.min("reach").alias("reach")), prefix)
    q = placed.where(~F.col("linked") & (F.col("left") + slack >= 2 * d - F.col("size") * 2 * rule.gap)).select("family", "token", F.col("node").alias("query"), F.col("cluster").alias("q_cluster"), F.col("room").alias("q_room"), F.col("reach").alias("q_reach"))
    met = q.join(matrix, ["family", "token"]).where((F.col("cluster") != F.col("q_cluster")) & (F.col("room") + slack >= F.col("q_reach")) & (F.col("q_room") + slack >= F.col("reach")))
    met = cut(met.select("family", "query", "grp").distinct(), matrix)
    # open only rows whose union of tokens holds enough of the query's
    union = cut(tokens.where("member").join(group, ["family", "node"]).groupBy("family", "grp").agg(F.collect_set("token").alias("union"), F.min(d - size).alias("reach")))
    own = cut(tokens.where("not linked").groupBy("family", F.col("node").alias("query")).agg(F.collect_list("token").alias("own"), F.first(d - size).alias("q_reach")))
    bound = met.join(own, ["family", "query"]).join(union, ["family", "grp"])
    opened = bound.where(2 * F.size(F.array_intersect("own", "union")) + slack >= F.col("q_reach") + F.col("reach")).select("family", "query", "grp")
    found = opened.join(group, ["family", "grp"]).where("node <> query")
    found = cut(found.select(F.least("query", "node").alias("a"), F.greatest("query", "node").alias("b"), F.lit("").alias("family")).distinct(), met, union, own, tokens, group)
    return cut(_compared(found, texts, diffs=False, rule=rule).where("linked").select("a", "b"), found)


def classes(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of links by ``rule``."""
    nodes = sets_table(docs, rule)
    rows = _survivors(docs, nodes, rule)
    texts = _node_texts(docs, rows)
    balls, left, kept = _balls(rows, texts, rule)
    rest = _rest(left, texts, rule)
    direct = balls.unionByName(rest).where("linked").select("a", "b")
    roots = components(direct.unionByName(_query_links(balls, rest, texts, rule)))
    placed = cut(nodes.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id")), nodes)
    release(texts, rows, rest, *kept)
    return placed


def keep_one(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest doc_id; columns unchanged.

    Rows without a doc_id stay. Repeated rows of a kept doc_id become one, the same in every run.
    Columns may have any names: a row travels as one struct.
    """
    kept = cut(classes(docs, rule).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct())
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    whole = docs.select(F.col("doc_id").alias("id"), F.xxhash64(*plain).alias("order"), F.struct("*").alias("row"))
    named = whole.where("id is not null").join(kept, "id", "left_semi").groupBy("id").agg(F.min_by("row", "order").alias("row"))
    return named.select("row.*").unionByName(whole.where("id is null").select("row.*"))


CLASSES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: list_slice(w, i, i + 2)) END) AS g
  FROM words
), numbered AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY g) AS t FROM sets
), sizes AS (
  SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM numbered x JOIN numbered y ON x.t = y.t AND x.doc_id <> y.doc_id
  JOIN sizes a ON a.doc_id = x.doc_id JOIN sizes b ON b.doc_id = y.doc_id
  WHERE 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = w.doc_id
GROUP BY w.doc_id, s.n
"""
