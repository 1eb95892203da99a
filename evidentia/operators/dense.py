"""Dense vectors: normalisation, embedders, exact top-k."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import tokens
from evidentia.functions.text import MARKED, PLAIN, spaced_terms

SMALL_NORM = 1e-12
DIMENSIONS = 64
#: Vectors that a block of queries, and of the searched table, has at most.
QUERY_BLOCK, VECTOR_BLOCK = 1_000, 10_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; vectors of (nearly) no length become zero."""
    n = norm(v)
    return F.when(n <= SMALL_NORM, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


class Embedder(Protocol):
    """Any object with a name that encodes texts as rows of a matrix. It is copied to each task."""

    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class BadVectors(ValueError):
    """An embedder gave another number of rows than texts, rows of another length, or numbers that aren't finite."""


def checked(matrix, texts: int, dimension: int | None = None) -> np.ndarray:
    """Unit rows of an embedder's matrix; rows of (nearly) no length become zero."""
    m = np.asarray(matrix, dtype=float)
    if m.ndim != 2 or len(m) != texts or dimension is not None and m.shape[1] != dimension:
        raise BadVectors(f"wanted {texts} rows{'' if dimension is None else f' of {dimension}'}, got {m.shape}")
    if not np.isfinite(m).all():
        raise BadVectors("a vector isn't finite")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n <= SMALL_NORM, 0.0, m / np.maximum(n, SMALL_NORM))


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """id and embedding of every text. An embedder that has its own plan (rows) uses it; others encode batches in tasks."""
    if hasattr(embedder, "rows"):
        return embedder.rows(df, id_col, text_col)
    few = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                m = checked(embedder.encode(part.column(1).to_pylist()), part.num_rows, size)
                size = m.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "embedding"])

    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, embedding array<double>")


class HashedWords:
    """Deterministic stand-in for a model: counts of terms, hashed to DIMENSIONS places by their MD5, at unit length."""

    name = "hashed-words"

    def encode(self, texts: list[str]) -> np.ndarray:
        """The same for a list of texts, outside Spark."""
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts):
            for t in re.findall(r"[^\W_]+", (text or "").lower().translate(str.maketrans(MARKED, PLAIN))):
                row[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % DIMENSIONS] += 1
        return checked(out, len(texts))

    def rows(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The same as a plan, from terms as Spark finds them; texts without terms have no row, those of one id count
        together. Only 64 counts a text are shuffled, to bring equal ids together."""
        some = df.select(F.col(id_col).alias("id"), spaced_terms(text_col).alias("words"))
        kind = some.schema["id"].dataType.simpleString()
        size = DIMENSIONS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in tokens.pieces(batches, 1):
                distinct, text, code = tokens.split(b.column(1))
                places = np.array([int.from_bytes(hashlib.md5(t.as_buffer()).digest()[:4]) % size for t in distinct], np.int64)
                n = np.bincount(text * size + places[code], minlength=b.num_rows * size).astype("<i4").reshape(-1, size)
                there = np.flatnonzero(n.any(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(there)), pa.array([x.tobytes() for x in n[there]], pa.binary())], ["id", "n"])

        def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    n = np.frombuffer(b"".join(b.column(1).flatten().to_pylist()), "<i4").astype(float).reshape(-1, size)
                    n = np.add.reduceat(n, b.column(1).offsets.to_numpy()[:-1] - b.column(1).offsets[0].as_py())
                    v = n / np.sqrt((n * n).sum(1, keepdims=True))
                    ends = pa.array(np.arange(0, v.size + 1, size, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))], ["id", "embedding"])

        counted = some.mapInArrow(count, f"id {kind}, n binary").groupBy("id").agg(F.collect_list("n").alias("n"))
        return counted.mapInArrow(unit, f"id {kind}, embedding array<double>")


def _packed(df: DataFrame, id_col: str, vector_col: str, most: int, ids: str, matrix: str) -> DataFrame:
    """Rows of up to ``most`` vectors each: their ids, and the vectors as one matrix."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                v = part.column(1)
                same = v.flatten().null_count == 0 and len(set(pc.list_value_length(v).unique().to_pylist())) == 1
                x = v.flatten().to_numpy() if same else np.array(v.to_pylist(), dtype=float)  # other lengths fail there
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, part.column(0)), pa.array([x.tobytes()], pa.binary())], [ids, matrix])

    some = df.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return some.mapInArrow(run, f"{ids} array<{kind}>, {matrix} binary")


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "passage_id", query_col: str = "claim_id", vector_col: str = "embedding") -> DataFrame:
    """query, passage, dense_score, dense_rank of each query's k best by dot product, exactly.

    Both sides are packed into blocks, and every block of queries meets every block of vectors once, as two matrices; each
    such pair gives its own best k of a query, ties by id. So no vector passes the driver but what Spark broadcasts by
    size, nothing runs while the plan is made, and the shuffle is k rows for each query and block.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    kinds = {"q": queries.schema[query_col].dataType.simpleString(), "p": vectors.schema[id_col].dataType.simpleString()}
    pairs = _packed(vectors, id_col, vector_col, VECTOR_BLOCK, "__p", "__pm").crossJoin(_packed(queries, query_col, vector_col, QUERY_BLOCK, "__q", "__qm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p, q = b.column(0)[i].values, b.column(2)[i].values
                x, y = (np.frombuffer(b.column(c)[i].as_py()).reshape(n, -1) for c, n in ((1, len(p)), (3, len(q))))
                if x.shape[1] != y.shape[1]:
                    raise BadVectors(f"queries have {y.shape[1]} numbers, vectors {x.shape[1]}")
                by_id = pc.sort_indices(p).to_numpy()
                scores = np.round(y @ x[by_id].T, 6)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(scores, order, 1)
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.RecordBatch.from_arrays([q.take(pa.array(rows)), p.take(pa.array(by_id[order.reshape(-1)])), pa.array(best.reshape(-1))], [query_col, id_col, "dense_score"])

    out = pairs.mapInArrow(run, f"{query_col} {kinds['q']}, {id_col} {kinds['p']}, dense_score double")
    w = Window.partitionBy(query_col).orderBy(F.desc("dense_score"), id_col)
    return out.withColumn("dense_rank", F.row_number().over(w).cast("long")).filter(F.col("dense_rank") <= k)


def check_consistency(vectors: DataFrame, passages: DataFrame, id_col: str = "passage_id") -> DataFrame:
    """One row: eligible passages, vectors, and those without their counterpart. A consistent index has none of these."""
    p, v = passages.select(id_col), vectors.select(id_col)
    both = p.withColumn("a", F.lit(1)).join(v.withColumn("b", F.lit(1)), id_col, "full_outer")
    return both.agg(F.count("a").alias("passages"), F.count("b").alias("vectors"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))
