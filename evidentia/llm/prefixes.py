"""Pairs of texts whose shingle sets have a Jaccard similarity of at least a bound, none left out: prefix filter and check.

All shingles get one order, rare ones first. Two sets of similarity t or more share one of the first n - ceil(t * n) + 1
shingles of each, whatever the order, so the order decides on cost alone and may come from a sample. Postings of these
prefixes meet in tasks by hash of the shingle; a pair goes on if its sizes and its places there allow the similarity, and
the sets themselves decide. Rows already in one component aren't paired, which keeps crowds of copies from growing as
their square.

A shingle is its 64-bit hash, and a set is named by a 64-bit hash of its hashes (sig).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import shared

#: Documents (about) that the order is taken from, how often a shingle must be in them to be common, common ones at most.
SAMPLE, OFTEN, COMMON = 20_000, 3, 100_000
#: Postings to a task; pairs it tries at once; sets to check that are broadcast to the texts at most.
TASK_POSTINGS, TRY_PAIRS, FEW_SETS = 1_000_000, 4_000_000, 400_000
#: A posting's columns: part of the shingle's hash, set, component, size of the set, place in the order (or 65535 if beyond).
POSTING = (("h", "<u4"), ("sig", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("pos", "<u2"))
SLACK = 1e-9

Shingles = Callable[[str | None], np.ndarray]


def signature(shingle_set: np.ndarray) -> int:
    """Of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingle_set.tobytes())).astype(np.int64))


def order_of(df: DataFrame, text_col: str, shingles: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles (sorted) and how often they are in a sample of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                got = [np.unique(shingles(t.as_py())) for t in b.column(0).slice(k, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["h"])

    part = min(1.0, SAMPLE / max(1, df.count()))
    some = df.select(text_col) if part == 1 else df.select(text_col).filter(F.rand(42) < part)
    seen = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    got = seen.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    at = np.argsort(h)
    return h[at].copy(), n[at].copy()


def prefix(shingle_set: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the order: those not common by hash, then common ones by number and hash."""
    n = len(shingle_set)
    if not n:
        return shingle_set
    common, often = order
    keep = n - math.ceil(similarity * n - SLACK) + 1
    if not len(common):
        return shingle_set[:keep]
    at = np.minimum(np.searchsorted(common, shingle_set), len(common) - 1)
    rank = np.where(common[at] == shingle_set, often[at], 0)
    return shingle_set[np.argsort(rank, kind="stable")[:keep]]


def _pack(cols: list[np.ndarray]) -> bytes:
    return b"".join(c.astype(t).tobytes() for c, (_, t) in zip(cols, POSTING))


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(np.dtype(t).itemsize for _, t in POSTING), 0, []
    for _, t in POSTING:
        out.append(np.frombuffer(blob, t, n, at))
        at += out[-1].nbytes
    return out


def _meetings(h: np.ndarray, sig: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of sets (rows a, b) of different components that share a shingle where the similarity is still possible."""
    at = np.lexsort((sig, comp, h))
    h, sig, comp, n, pos = (x[at] for x in (h, sig, comp, n.astype(np.int64), pos.astype(np.int64)))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (comp[1:] != comp[:-1]) | (sig[1:] != sig[:-1])
    h, sig, comp, n, pos = (x[new] for x in (h, sig, comp, n, pos))
    size = len(h)

    def ends(begins: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.concatenate([[True], begins]))
        return np.repeat(np.append(first[1:], size), np.diff(np.append(first, size)))

    other_h = h[1:] != h[:-1]
    start = ends(other_h | (comp[1:] != comp[:-1]))  # partners follow a row's own component, up to its shingle's end
    count = ends(other_h) - start
    rows = np.flatnonzero(count)
    out = [np.empty((0, 2), np.int64)]
    total = np.cumsum(count[rows])
    cuts = np.searchsorted(total, np.arange(TRY_PAIRS, (total[-1] if len(total) else 0) + 1, TRY_PAIRS)) + 1
    for some in np.split(rows, cuts):
        if not len(some):
            continue
        c = count[some]
        i = np.repeat(some, c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[some], c)
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - SLACK
        i, j = i[fits], j[fits]
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        fits = (most >= similarity / (1 + similarity) * (n[i] + n[j]) - SLACK) & (sig[i] != sig[j])
        i, j = i[fits], j[fits]
        if len(i):
            out.append(np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b (sig): pairs to check. rows: sig, n, prefix (bytes), comp (long, of the row's component)."""
    total = rows.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_POSTINGS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, size, comp = (b.column(c).to_numpy() for c in ("sig", "n", "comp"))
            each = [len(p) // 8 for p in b.column("prefix").to_pylist()]
            h = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(each)), each)
            pos = np.minimum(np.arange(len(h)) - np.repeat(np.cumsum(each) - each, each), 65_535)
            task = (h % np.uint64(tasks)).astype(np.int64)
            at = np.argsort(task, kind="stable")
            for some in np.split(at, np.flatnonzero(np.diff(task[at])) + 1):
                r = row[some]
                blob = _pack([h[some] >> np.uint64(32), sig[r], comp[r], size[r], pos[some]])
                yield pa.RecordBatch.from_arrays([pa.array([int(task[some[0]])], pa.int32()), pa.array([blob], pa.binary())], ["task", "postings"])

    def meet(group: pa.Table) -> pa.Table:
        cols = [np.concatenate(c) for c in zip(*(_unpack(p.as_py()) for p in group.column("postings")))]
        got = _meetings(*cols, similarity)
        return pa.table({"a": got[:, 0].copy(), "b": got[:, 1].copy()})

    dealt = rows.select("sig", "n", "comp", "prefix").mapInArrow(deal, "task int, postings binary")
    return dealt.repartition(tasks, "task").groupBy("task").applyInArrow(meet, "a long, b long").distinct()


def parities(shingle_set: np.ndarray) -> bytes:
    """Of four or more buckets to a shingle, a power of two of them, whether the number of shingles in each is odd."""
    buckets = 1 << max(6, (4 * len(shingle_set) - 1).bit_length())
    count = np.bincount((shingle_set >> np.uint64(20) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits(count & 1 == 1, bitorder="little").tobytes()


def _may_be_near(x: bytes, y: bytes, m: int, n: int, similarity: float) -> bool:
    """Each odd bucket of the symmetric difference holds one of it at least, so the odd ones can't be more than it may have."""
    x, y = (np.frombuffer(s, np.uint64) for s in (x, y))
    few = min(len(x), len(y))  # the larger is folded to the buckets of the smaller
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, few), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= (m + n) * (1 - similarity) / (1 + similarity) + SLACK


def _are_near(x: bytes, y: bytes, m: int, n: int, similarity: float) -> bool:
    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return both / (m + n - both) >= similarity


def similar(pairs: DataFrame, sets: DataFrame, df: DataFrame, id_col: str, text_col: str, digest, shingles: Shingles, similarity: float) -> DataFrame:
    """The pairs (a, b) that have the similarity. sets: sig, first (none, doc_id, digest: a row of df that has the set).

    Parities, a sixteenth of a set or so, rule out nearly all pairs that haven't; the sets are compared for the others.
    """
    for code, test in ((parities, _may_be_near), (np.ndarray.tobytes, _are_near)):
        pairs = shared.save(_tested(pairs, sets, df, id_col, text_col, digest, shingles, similarity, code, test), "near")
    return pairs


def _tested(pairs: DataFrame, sets: DataFrame, df: DataFrame, id_col: str, text_col: str, digest, shingles: Shingles, similarity: float, code: Callable, test: Callable) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                got = [np.unique(shingles(t.as_py())) for t in b.column(0).slice(k, 1024)]
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in got], pa.int64()), pa.array([len(s) for s in got], pa.int32()), pa.array([code(s) for s in got], pa.binary())], ["sig", "n", "code"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, m, n = (b.column(c).to_pylist() for c in ("x", "y", "m", "n"))
            keep = [test(*row, similarity) for row in zip(x, y, m, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    wanted = shared.save(sets.join(wanted, "sig").select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest")).distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= FEW_SETS else wanted
    texts = df.select(F.col(id_col).cast("long").alias("__k"), digest.alias("__d"), F.col(text_col).alias("text"))
    texts = texts.join(few, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__d").eqNullSafe(F.col("__digest"))), "left_semi")
    codes = shared.save(texts.select("text").mapInArrow(read, "sig long, n int, code binary").dropDuplicates(["sig"]), "codes")
    one = codes.select(F.col("sig").alias("a"), F.col("n").alias("m"), F.col("code").alias("x"))
    two = codes.select(F.col("sig").alias("b"), "n", F.col("code").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(check, "a long, b long")
