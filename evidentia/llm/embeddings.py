"""Embedding near-duplicates by random-hyperplane sign hashing in several tables (operator 1).

Equal vectors are one class. A class's sketch is its signs against BITS random hyperplanes; each table takes some of them,
and a class falls in the table's bucket of these signs. Buckets of more than CHUNK classes are dealt into chunks by a hash
of the class, and each pair of chunks is a task of its own, so no task holds an unbounded group.

Classes meet twice. First by sketch alone: a task finds which of its rows have a partner whose sketch differs in no more
bits than a pair at the threshold may. Only these rows then fetch their vectors and meet again, compared exactly, by
cosine in double precision. So what every table shuffles is a key and BITS bits, whatever the vectors' length, and
vectors move only where they have a likely partner. A pair counts in the first table where it meets. Pairs are counted,
not emitted: a task returns a number of links and one link to its component's root per class. Components are joined
across tasks by distributed label steps.

The number of tables follows from the threshold: a pair just at it is missed with probability MISS, closer pairs less.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are
kept; vectors of unequal length do not link; rows with equal ids count as vectors of their own; an empty table gives no
rows; columns with clashing names are ignored; a row without an id links like any other, and a component of such rows
alone has no id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import components, shared

#: Bits of a sketch; classes that a bucket should hold about, the fewest bits of a table, classes of a task's chunk, and
#: the chance of a miss.
BITS, BUCKET, LEAST_BITS, CHUNK, MISS = 256, 2048, 4, 1536, 1e-4


def _differing(p: float) -> np.ndarray:
    """Probability of each number of differing bits between two sketches, if each bit differs with probability p."""
    n = np.arange(BITS + 1)
    log = math.lgamma(BITS + 1) - np.array([math.lgamma(k + 1) + math.lgamma(BITS - k + 1) for k in n])
    return np.exp(log + n * math.log(p) + (BITS - n) * math.log1p(-p))


def plan(classes: int, threshold: float, miss: float = MISS) -> tuple[int, int, int]:
    """Bits of a table, tables, and the most differing bits of a sketch. The bits follow the number of classes, the tables
    the bits."""
    bits = min(31, max(LEAST_BITS, math.ceil(math.log2(max(1, classes) / BUCKET))))
    chance = _differing(min(0.5, max(1e-6, math.acos(threshold) / math.pi)))
    n = np.arange(BITS + 1)
    same = np.prod([np.clip(BITS - n - i, 0, None) / (BITS - i) for i in range(bits)], axis=0)
    tables = 2
    while (chance * (1 - same) ** tables).sum() > miss:
        tables += 1
    return bits, tables, int(np.searchsorted(np.cumsum(chance), 1 - miss / 100))


def planes(size: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size]).normal(size=(size, BITS))


def choices(bits: int, tables: int, seed: int = 12) -> np.ndarray:
    """Which bits of a sketch each table takes: of one shuffling of them as many tables as it has room for."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < tables:
        out += np.split(rng.permutation(BITS)[: BITS // bits * bits], BITS // bits)
    return np.array(out[:tables])


def buckets(sketches: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Each sketch's bucket in each table. sketches: rows of BITS / 64 words."""
    ones = np.unpackbits(np.ascontiguousarray(sketches).view(np.uint8), axis=1, bitorder="little")
    weights = 1 << np.arange(taken.shape[1], dtype=np.int64)
    return np.stack([ones[:, t] @ weights for t in taken], 1).astype(np.int64)


def alike(x: np.ndarray, y: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches of x, and which of y (None: x itself), have a partner on the other side."""
    other = x if y is None else y
    bits = np.zeros((len(x), len(other)), np.uint16)
    for k in range(x.shape[1]):
        bits += np.bitwise_count(x[:, k, None] ^ other[None, :, k])
    near = bits <= most
    if y is None:
        np.fill_diagonal(near, False)
    return near.any(1), near.any(0)


def compare(x: np.ndarray, y: np.ndarray | None, sx: np.ndarray, sy: np.ndarray | None, table: int, threshold: float) -> np.ndarray:
    """Links between rows of x and y (None: x itself, each pair twice), without pairs that met in an earlier table."""
    other, so = (x, sx) if y is None else (y, sy)
    near = x @ other.T
    near /= np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(other, axis=1)[None]
    near = near >= threshold
    if y is None:
        np.fill_diagonal(near, False)
    if table:
        if near.sum() < near.size // 50:
            i, j = np.nonzero(near)
            met = (sx[i, :table] == so[j, :table]).any(1)
            near[i[met], j[met]] = False
        else:
            for t in range(table):
                near &= sx[:, t, None] != so[None, :, t]
    return near


def roots(near: np.ndarray, square: bool) -> np.ndarray:
    """For each row (and then each column, if not square) a number of its component, by whole rows of the matrix."""
    n, m = near.shape
    label = np.full(n if square else n + m, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = i
        front = np.array([i])
        while len(front):
            cols = np.flatnonzero(near[front].any(0))
            if square:
                front = cols[label[cols] < 0]
                label[front] = i
            else:
                cols = cols[label[n + cols] < 0]
                label[n + cols] = i
                back = np.flatnonzero(near[:, cols].any(1)) if len(cols) else np.array([], int)
                front = back[label[back] < 0]
                label[front] = i
    return label


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    kind = df.select(vector_col).schema[0].dataType.elementType.simpleString()
    real, bytes_ = ("float", "<f4") if kind == "float" else ("double", "<f8")
    v = F.col(vector_col).cast(f"array<{real}>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    good = F.expr(f"v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < cast('Infinity' AS {real})) AND exists(v, x -> x <> 0)")
    plus = F.transform("v", lambda x: (x + F.lit(0.0).cast(real)))  # no negative zeros
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("good"), plus))
    rows = rows.select("vec_id", "v", "good", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    keys = rows.filter("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("c"), F.count(F.lit(1)).alias("mult"))
    # one vector for each class; rows with equal ids and equal vectors would double it
    on = F.col("vec_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    firsts = rows.filter("good").join(keys.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("c"), "mult"), on).select("c", "k1", "k2", "mult", "v").dropDuplicates(["k1", "k2"])

    def sketch(batches):
        for b in batches:
            vectors = b.column(4).to_pylist()
            for size in sorted({len(x) for x in vectors}):
                mine = [i for i, x in enumerate(vectors) if len(x) == size]
                x = np.array([vectors[i] for i in mine], dtype=bytes_)
                wide = x.astype(float)
                signs = np.packbits(wide / np.abs(wide).max(1, keepdims=True) @ planes(size) >= 0, axis=1, bitorder="little")
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(4)], pa.array([size] * len(mine), pa.int32()), pa.array([r.tobytes() for r in signs], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], ["c", "k1", "k2", "mult", "size", "sketch", "x"])

    classes = shared.save(firsts.mapInArrow(sketch, "c long, k1 long, k2 long, mult long, size int, sketch binary, x binary"), "classes")
    bits, tables, most = plan(classes.count(), threshold, miss)
    taken = choices(bits, tables)
    words = BITS // 64
    none = F.when(F.col("c").isNull(), True).when(F.col("c").isNotNull(), False)  # nullable, as Arrow gives it back
    named = F.struct(none.alias("none"), "c", "k1", "k2").alias("cls")  # classes without an id come last

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)

    def place(batches):
        for b in batches:
            at = buckets(matrix(b.column(3)), taken)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(at[:, t].copy()), b.column(2), b.column(0), b.column(1), b.column(3)], ["t", "bucket", "size", "k1", "k2", "sketch"])

    placed = classes.select("k1", "k2", "size", "sketch").mapInArrow(place, "t int, bucket long, size int, k1 long, k2 long, sketch binary")
    cells = ["t", "bucket", "size"]
    large = shared.save(placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select(*cells, F.ceil(F.col("n") / CHUNK).cast("int").alias("m")), "buckets")
    dealt = placed.join(large, cells, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "k1", "k2"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select(*cells, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "k1", "k2", "sketch")

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        a, b = int(group.column("a")[0].as_py()), int(group.column("b")[0].as_py())
        own = group.column("own").to_numpy()
        return (np.arange(len(own)), None) if a == b else (np.flatnonzero(own == a), np.flatnonzero(own == b))

    def likely(group: pa.Table) -> pa.Table:
        left, right = sides(group)
        x = matrix(group.column("sketch"))
        some, others = alike(x[left], None if right is None else x[right], most)
        found = left[some] if right is None else np.concatenate([left[some], right[others]])
        return group.select([*cells, "a", "b", "own", "k1", "k2"]).take(pa.array(found))

    names = "t int, bucket long, size int, a int, b int, own int, k1 long, k2 long"
    cand = shared.save(dealt.groupBy(*cells, "a", "b").applyInArrow(likely, names), "likely")
    fetched = cand.join(classes.drop("size"), ["k1", "k2"])
    fetched = fetched.select(*cells, "a", "b", "own", named, "mult", "sketch", "x")

    def meet(group: pa.Table) -> pa.Table:
        t = int(group.column("t")[0].as_py())
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), bytes_).reshape(group.num_rows, -1).astype(float)
        x /= np.abs(x).max(1, keepdims=True)
        sig = buckets(matrix(group.column("sketch")), taken[: t + 1])
        mult = group.column("mult").to_numpy()
        left, right = sides(group)
        if right is None:
            order = left
            near = compare(x, None, sig, None, t, threshold)
            n, label = near @ mult, roots(near, True)
        else:
            order = np.concatenate([left, right])
            near = compare(x[left], x[right], sig[left], sig[right], t, threshold)
            n, label = np.concatenate([near @ mult[right], near.T @ mult[left]]), roots(near, False)
        some = np.flatnonzero(n)
        cls = group.column("cls").combine_chunks()
        return pa.table({"cls": cls.take(pa.array(order[some])), "root": cls.take(pa.array(order[label[some]])), "n": pa.array(n[some], pa.int64())})

    item = "struct<none: boolean, c: bigint, k1: bigint, k2: bigint>"
    met = fetched.groupBy(*cells, "a", "b").applyInArrow(meet, f"cls {item}, root {item}, n long")
    met = shared.save(met, "met")
    counts = met.groupBy("cls").agg(F.sum("n").alias("n"))
    parts = components.connected_components(met.select("cls", "root"), "cls", "root")
    per_class = classes.select(named, "mult").join(counts, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left")
    per_class = shared.save(per_class.select("cls.k1", "cls.k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").getField("c").alias("component_id")), "per-class")
    ids = rows.select("vec_id", F.when(F.col("good"), F.col("k1")).alias("k1"), F.when(F.col("good"), F.col("k2")).alias("k2"))
    out = ids.join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of all labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
