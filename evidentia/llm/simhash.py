"""SimHash near-duplicates through a self-join of binary tries (operator 6).

A text's fingerprint has 64 bits, or several times 64, each the majority of that bit over the texts' hashed word
shingles. Fingerprints link when at most ``budget`` bits differ. Distinct fingerprints are joined with themselves as
tries: pairs of nodes are traversed together, adding up differing bits, and a pair is dropped once they exceed the budget.

The first step is relational. A fingerprint is turned to begin at several places (Search.offsets), and the turned ones
meet that agree in their first ``width`` bits, which is a node of the trie of that turn; below it the walk goes on bit by
bit. With 64 bits and budget + 1 disjoint blocks no link can be missed, as one block must be equal. With more bits the
number of turns follows from the wanted recall. Nodes are dealt to tasks by hash, many small ones to a task. A node of
more than GROUP_ROWS fingerprints is split by node pairs STEP_BITS further down (exact search), or by equality of further
bits (search by recall), as often as needed; so a task is bounded. It gives links that span components, not all pairs.

Defined results: a text without words (null, empty, white space) has the zero fingerprint and links like any other; with
fewer words than a shingle the whole sequence is the one shingle; equal rows fall in one component; a null id is larger
than any other: a group of rows without ids only has a null component_id; an empty table gives no rows; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import components, prefixes, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: A node of more distinct fingerprints is split, by so many bits; a task takes nodes of about so many in all.
GROUP_ROWS, STEP_BITS, TASK_ROWS = 8_000, 8, 30_000
#: Node pairs that a task keeps open at once, and node sizes below which pairs are compared directly.
OPEN_PAIRS, LEAF = 200_000, 4
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _majorities(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def _again(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of the same shingles."""
    x = (h ^ np.uint64(k * MIX[0] & (1 << 64) - 1)) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[0])
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included."""
    found = WORD.findall((text or "").translate(UPPER) if text else "")
    xxh = xxhash.xxh64_intdigest
    if not found:
        hashes = []
    elif len(found) <= words:
        hashes = [xxh(" ".join(found), seed)]
    elif words == 3:
        hashes = [xxh(f"{a} {b} {c}", seed) for a, b, c in zip(found, found[1:], found[2:])]
    elif words == 5:
        hashes = [xxh(f"{a} {b} {c} {d} {e}", seed) for a, b, c, d, e in zip(found, found[1:], found[2:], found[3:], found[4:])]
    else:
        hashes = [xxh(" ".join(found[i : i + words]), seed) for i in range(len(found) - words + 1)]
    return np.array(hashes, dtype="<u8")


def _fingerprint(h: np.ndarray, parts: int) -> int:
    if not len(h):
        return 0
    out = int(_majorities(h)[0])
    for k in range(1, parts):
        out = out << 64 | int(_majorities(_again(h, k))[0])
    return out


def fingerprint(text: str | None, words: int = 3, seed: int = 42, parts: int = 1) -> int:
    """The first 64 bits, or with parts > 1 that many times 64, the first of them highest."""
    return _fingerprint(shingles(text, words, seed), parts)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, parts: int = 1, similarity: float | None = None) -> DataFrame:
    """doc_id, digest (of the text), fp (binary, 8 bytes for each part, the highest bit first).

    With a similarity also the set of shingles: sig, n (its size), prefix (binary, 8 bytes for each).
    """
    order = None if similarity is None else prefixes.order_of(df, text_col, lambda t: shingles(t, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sigs, sizes, firsts = [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py(), words)
                fps.append(_fingerprint(h, parts).to_bytes(8 * parts, "big"))
                if order is not None:
                    h = np.unique(h)
                    sigs.append(prefixes.signature(h))
                    sizes.append(len(h))
                    firsts.append(prefixes.prefix(h, order, similarity).tobytes())
            cols = [b.column(0), b.column(1), pa.array(fps, pa.binary())]
            if order is not None:
                cols += [pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "fp", "sig", "n", "prefix"][: len(cols)])

    few = df.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, "doc_id long, digest long, fp binary" + ("" if order is None else ", sig long, n int, prefix binary"))


def digest(text_col: str):
    return F.xxhash64(F.col(text_col))


@dataclass(frozen=True)
class Search:
    """How fingerprints of 64 * parts bits meet. offsets: where each turn begins; width: bits that are equal there.

    The walk goes over the 64 bits from there and drops a pair beyond ``window`` differing ones; a link has at most
    ``budget`` in all.
    """

    parts: int
    budget: int
    window: int
    width: int
    offsets: tuple[int, ...]
    exact: bool


def exact_search(budget: int) -> Search:
    """64 bits; of budget + 1 blocks one is equal in any link."""
    width = 64 // (budget + 1)
    return Search(1, budget, budget, width, tuple(range(0, width * (budget + 1), width)), True)


def similar_search(rows: int, similarity: float = 0.8, parts: int = 4, miss: float = 0.02) -> Search:
    """Links from a similarity (Jaccard) of the shingles on. Two such texts differ in ``p`` of their bits on average.

    A pair just at the similarity passes by two standard deviations. The width follows the number of fingerprints, so
    that nodes stay small; the number of turns follows from the width and from how often no turn may join such a pair.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = lambda n: math.floor(n * p + 2 * math.sqrt(n * p * (1 - p)))
    width = min(40, max(12, math.ceil(math.log2(max(1, rows) / 1024))))
    turns = math.ceil(math.log(miss) / math.log(1 - (1 - p) ** width))
    bits = 64 * parts
    step = max(1, bits // turns) if turns <= bits else 1
    return Search(parts, limit(bits), limit(64), width, tuple(k * step % bits for k in range(min(turns, bits))), False)


def windows(words: np.ndarray, offset: int) -> np.ndarray:
    """The 64 bits of each fingerprint (rows of words, highest first) from a place on, going round at the end."""
    k, r = divmod(offset, 64)
    x = words[:, k]
    return x if not r else (x << np.uint64(r)) | (words[:, (k + 1) % words.shape[1]] >> np.uint64(64 - r))


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, error: int, budget: int, nodes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (into left, into right) whose fingerprints differ in at most ``budget`` bits.

    Both are sorted. right=None: pairs within each of left's nodes (where each begins, and the end; one node if None), in
    which the first ``depth`` bits agree. Otherwise left and right are a node each, and ``error`` of those bits differ
    between them. Pairs of nodes are ranges of both; the stack holds batches of them.
    """
    same = right is None
    other = left if same else right
    ends = lambda x: np.array([0, len(x)], dtype=np.int64)
    at, to = (ends(left) if nodes is None else nodes), (ends(other) if nodes is None else nodes)
    stack = [(depth, at[:-1], at[1:], to[:-1], to[1:], np.full(len(at) - 1, error, np.int64))]
    while stack:
        d, a0, a1, b0, b1, e = stack.pop()
        small = ((a1 - a0) <= LEAF) & ((b1 - b0) <= LEAF) | (d >= 64)
        if small.any():
            for k in range(0, int(small.sum()), 50_000):
                s0, s1, t0, t1 = (x[small][k : k + 50_000] for x in (a0, a1, b0, b1))
                for i in range(int((s1 - s0).max())):
                    for j in range(int((t1 - t0).max())):
                        p, q = s0 + i, t0 + j
                        ok = (p < s1) & (q < t1)
                        if same:
                            ok &= p < q
                        p, q = p[ok], q[ok]
                        near = np.bitwise_count(left[p] ^ other[q]) <= budget
                        if near.any():
                            yield p[near], q[near]
            keep = ~small
            a0, a1, b0, b1, e = a0[keep], a1[keep], b0[keep], b1[keep], e[keep]
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        below = bit - np.uint64(1)
        # where each node's one-child begins
        am = np.clip(np.searchsorted(left, (left[a0] & ~(bit | below)) | bit), a0, a1)
        bm = np.clip(np.searchsorted(other, (other[b0] & ~(bit | below)) | bit), b0, b1)
        parts = []
        for (p0, p1), (q0, q1), more, mirrored in (((a0, am), (b0, bm), 0, False), ((am, a1), (bm, b1), 0, False), ((a0, am), (bm, b1), 1, False), ((am, a1), (b0, bm), 1, True)):
            ok = (p1 > p0) & (q1 > q0) & (e + more <= budget)
            if same and mirrored:
                ok &= a0 != b0  # a node with itself: its two children meet once
            parts.append((p0[ok], p1[ok], q0[ok], q1[ok], e[ok] + more))
        p0, p1, q0, q1, err = (np.concatenate(x) for x in zip(*parts))
        for k in range(0, len(p0), OPEN_PAIRS):
            stack.append((d + 1, *(x[k : k + OPEN_PAIRS] for x in (p0, p1, q0, q1, err))))


def _span(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and their components' first places, for those that aren't first. Pairs within a component, which are nearly
    all in a crowd of copies, are dropped as arrays; at most n - 1 others join two components."""
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            i = int(up[i])
        return i

    for p, q in pairs:
        a, b = up[p], up[q]
        apart = a != b
        if apart.any():
            code = np.unique(np.minimum(a, b)[apart] * n + np.maximum(a, b)[apart])
            for i, j in zip((code // n).tolist(), (code % n).tolist()):
                i, j = root(i), root(j)
                if i != j:
                    up[max(i, j)] = min(i, j)
            while (up[up] != up).any():
                up = up[up]
    places = np.flatnonzero(up != np.arange(n))
    return places, up[places]


def _node_pairs(rows: pa.Table, search: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places of a task's rows. Nodes that meet themselves are walked together, others pair by pair."""
    x = rows.column("x").to_numpy().view(np.uint64)
    words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), ">u8").reshape(len(x), search.parts).astype(np.uint64)
    turn, depth, side, u, v, e = (rows.column(c).to_numpy() for c in ("turn", "depth", "side", "u", "v", "e"))

    def true(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if search.parts == 1:
            return p, q
        near = np.bitwise_count(words[p] ^ words[q]).sum(1) <= search.budget
        return p[near], q[near]

    own = np.flatnonzero(side == 2)
    for t, d in sorted({*zip(turn[own].tolist(), depth[own].tolist())}):
        some = own[(turn[own] == t) & (depth[own] == d)]
        some = some[np.argsort(x[some], kind="stable")]
        node = x[some] >> np.uint64(64 - d) if d < 64 else x[some]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        for p, q in trie_links(x[some], None, d, 0, search.window, np.append(starts, len(some))):
            yield true(some[p], some[q])
    rest = np.flatnonzero(side != 2)
    if len(rest):
        rest = rest[np.lexsort((x[rest], side[rest], v[rest], u[rest], depth[rest], turn[rest]))]
        key = np.stack([turn[rest], depth[rest], u[rest], v[rest]], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for some in np.split(rest, cuts):
            a, b = some[side[some] == 0], some[side[some] == 1]
            if len(a) and len(b):
                for p, q in trie_links(x[a], x[b], int(depth[a[0]]), int(e[a[0]]), search.window):
                    yield true(a[p], b[q])


def links(fps: DataFrame, search: Search, group_rows: int = GROUP_ROWS) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (binary column fp) within the search's budget."""
    width = search.width

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(b.num_rows, search.parts).astype(np.uint64)
            for t, offset in enumerate(search.offsets):
                x = windows(words, offset)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(x.view(np.int64)), pa.array((x >> np.uint64(64 - width)).view(np.int64)), b.column(0)], ["turn", "x", "u", "fp"])

    # u, v: the first bits of the two nodes; side: which of them a row is under (2: both are one node)
    rows = fps.select("fp").distinct().mapInArrow(turned, "turn int, x long, u long, fp binary")
    rows = rows.select("turn", "x", "fp", "u", F.col("u").alias("v"), F.lit(2).alias("side"), F.lit(0).alias("e"))
    depth, ready, total = width, None, 0
    while True:
        rows = shared.save(rows, "trie")
        size = rows.groupBy("turn", "u", "v").agg(F.count(F.lit(1)).alias("n"))
        # saved and broadcast: there is at most one of them to group_rows rows, and the rows needn't be shuffled to find theirs
        large = shared.save(size.filter(F.col("n") > group_rows).select("turn", "u", "v"), "large")
        step = min(STEP_BITS, 64 - depth)
        done = step <= 0 or not large.take(1)
        large = F.broadcast(large)
        part = (rows if done else rows.join(large, ["turn", "u", "v"], "left_anti")).withColumn("depth", F.lit(depth))
        ready, total = part if ready is None else ready.unionByName(part), total + rows.count()
        if done:
            break
        deep = rows.join(large, ["turn", "u", "v"], "left_semi")
        node = F.expr(f"shiftrightunsigned(x, {64 - depth - step})")
        if not search.exact:  # a pair of a hot node must agree a little further to meet in this turn
            rows = deep.select("turn", "x", "fp", node.alias("u"), node.alias("v"), "side", "e")
            depth += step
            continue
        masks = F.explode(F.array(*[F.lit(sum(1 << i for i in c)) for k in range(min(search.window, step) + 1) for c in combinations(range(step), k)])).alias("mask")
        deep = deep.select("turn", "x", "fp", "side", "e", node.alias("node"), F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("u")).alias("partner"), masks)
        other = F.expr(f"((partner << {step}) | (node & {(1 << step) - 1})) ^ mask")
        deep = deep.withColumn("other", other).withColumn("e", F.col("e") + F.bit_count("mask").cast("int")).filter(F.col("e") <= search.window)
        one = (F.col("side") == 2) & (F.col("mask") == 0)
        swap = F.when(F.col("side") == 2, F.expr("node > other")).otherwise(F.col("side") == 1)
        rows = deep.select("turn", "x", "fp", F.when(swap, F.col("other")).otherwise(F.col("node")).alias("u"), F.when(swap, F.col("node")).otherwise(F.col("other")).alias("v"), F.when(one, 2).when(swap, 1).otherwise(0).alias("side"), "e")
        depth += step

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = _span(group.num_rows, _node_pairs(group, search))
        fp = group.column("fp").combine_chunks()
        return pa.table({"a": fp.take(pa.array(a)), "b": fp.take(pa.array(b))})

    # an explicit number of tasks: their work grows faster than their bytes, by which Spark would join them
    each = max(1, math.ceil(total / len(search.offsets) / TASK_ROWS))
    dealt = ready.withColumn("task", F.col("turn") * each + F.pmod(F.xxhash64("depth", "u", "v"), F.lit(each)))
    return dealt.repartition(each * len(search.offsets), "task").groupBy("task").applyInArrow(run, "a binary, b binary")


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, budget: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, fp) and classes (fp, component_id, and the first row of the component: none, doc_id, digest)."""
    parts = 1 if similarity is None else 4
    docs = shared.save(fingerprints(df, id_col, text_col, words, parts, similarity), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    firsts = shared.save(docs.groupBy("fp").agg(F.min(row).alias("first")), "firsts")
    search = exact_search(budget) if similarity is None else similar_search(firsts.count(), similarity, parts)
    found = components.connected_components(links(firsts, search), "a", "b")
    labelled = firsts.join(found, firsts.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    if similarity is not None:
        labelled = shared.save(labelled, "labelled")
        more = components.connected_components(_rest(df, docs, labelled, id_col, text_col, words, similarity), "a", "b")
        labelled = labelled.join(more, labelled.component == more.node, "left").select("fp", "first", F.coalesce(more.component, labelled.component).alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("first"))
    return docs, shared.save(labelled.drop("first").join(smallest, "component").select("fp", F.col("first.doc_id").alias("component_id"), "first"), "classes")


def _rest(df: DataFrame, docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """a, b: components that the tries left apart although texts of them have the similarity, or one set of shingles."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    rows = docs.join(labelled.select("fp", "component"), "fp").withColumn("comp", F.xxhash64("component"))
    pairs = shared.save(prefixes.candidates(rows, similarity), "pairs")
    sets = docs.drop("prefix").join(labelled.select("fp", "component"), "fp").groupBy("sig").agg(F.min(row).alias("first"), F.collect_set("component").alias("all"))
    sets = shared.save(sets, "sets")
    near = prefixes.similar(pairs, sets, df, id_col, text_col, digest(text_col), lambda t: shingles(t, words), similarity)
    of = sets.select("sig", F.array_min("all").alias("c"))
    apart = near.join(of.select(F.col("sig").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("sig").alias("b"), F.col("c").alias("cb")), "b")
    equal = sets.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return apart.select(F.col("ca").alias("a"), F.col("cb").alias("b")).union(equal)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links, itself included).

    Without a similarity: 64 bits, all links of at most ``budget`` differing ones. With it: wider fingerprints, and all
    links of texts whose sets of shingles are so similar (Jaccard) or more. The tries find most of them, and some of texts
    a little less similar; those they leave apart are found by prefixes of the sets and checked on the sets.
    """
    docs, classes = _classes(df, id_col, text_col, words, budget, similarity)
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One whole row of each group of near copies: the one with the smallest id, rows without an id coming last.

    Of rows with that id, the text with the smallest digest; of rows equal in both, any one. Rows to go are few against
    those that stay, so it is these that the texts are held against.
    """
    docs, classes = _classes(df, id_col, text_col, words, 0, similarity)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    told = docs.join(classes.select("fp", "first"), "fp")
    key = [F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")]
    gone = shared.save(told.filter(row != F.col("first")).select(*key).distinct(), "gone")
    again = shared.save(docs.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "again")
    marked = df.withColumn("__k", F.col(id_col).cast("long")).withColumn("__d", digest(text_col))
    on = F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest"))
    left = marked.join(gone, on, "left_anti")
    if not again.take(1):
        return left.select(*df.columns)
    return left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates(["__k", "__d"])).select(*df.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
