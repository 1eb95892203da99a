"""Token ids as wavelet matrices, one file per shard (operator 5).

Texts are dealt by ranges of doc_id, encoded, and every shard's ids become one file: a succinct bit plane per bit of
the ids with counts every 512 bits, besides the documents' ids and starts. From a file alone a token can be read at any
place (access), counted up to any place (rank), and its n-th place found (select).

File, little-endian: ``EWM1``, u64 tokens, u32 documents, u8 planes; for each plane u64 zeros; documents' ids (i64), their
null marks (u8), their starts (u64, one more than documents); for each plane its bits (u8, padded to 64 bytes) and the
counts of ones before each block of 512 bits (u32).

Defined results: null text counts as empty (its end id alone); equal rows are stored once each, ordered by doc_id, then
text; empty tables make no file and no rows; other columns are ignored, whatever their names; null doc_ids come first.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evidentia.llm import shared, tokens

BLOCK = 512
#: A shard is closed at so many tokens.
SHARD_TOKENS = 3_000_000
#: Partitions whose shards' starts are summed in one task.
SHARD_RUN = 1_000
HEAD = "<4sQIB"


def _planes(x: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    zeros, planes = [], []
    x = x.astype(np.uint16 if not len(x) or x.max() < 65_536 else np.uint32)
    for level in range(int(x.max()).bit_length() - 1 if len(x) else -1, -1, -1):
        ones = (x >> np.array(level, x.dtype)) & np.array(1, x.dtype)
        ones = ones.astype(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        low = x[~ones]
        zeros.append(len(low))
        x = np.concatenate([low, x[ones]])
    return zeros, planes


def build(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The bytes of a shard. starts: where each document begins, and the end."""
    zeros, planes = _planes(ids)
    out = [struct.pack(HEAD, b"EWM1", len(ids), len(doc_ids), len(planes)), np.array(zeros, "<u8").tobytes()]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), starts.astype("<u8").tobytes()]
    for p in planes:
        p = np.concatenate([p, np.zeros(-len(p) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(p.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        out += [p.tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes()]
    return b"".join(out)


class Shard:
    """Reads one file's bytes; nothing is expanded before it is asked for."""

    def __init__(self, data: bytes):
        magic, self.n, docs, levels = struct.unpack_from(HEAD, data)
        if magic != b"EWM1":
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.zeros = take("<u8", levels).astype(np.int64).tolist()
        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        blocks = -(-self.n // BLOCK)
        self.bits, self.ones = [], []
        for _ in range(levels):
            self.bits.append(take("u1", blocks * BLOCK // 8))
            self.ones.append(take("<u4", blocks + 1))

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        b = i // BLOCK
        part = self.bits[level][b * BLOCK // 8 : -(-i // 8)]
        if i % 8 and len(part):
            part = part.copy()
            part[-1] &= (1 << i % 8) - 1
        return int(self.ones[level][b]) + int(np.bitwise_count(part).sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.ones[level]
        before = (lambda b: int(ones[b])) if bit else (lambda b: b * BLOCK - int(ones[b]))
        b = bisect_right(range(len(ones)), k, key=before) - 1
        found = np.flatnonzero(np.unpackbits(self.bits[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little") == bit)
        return b * BLOCK + int(found[k - before(b)])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            one = self.bits[level][i // 8] >> (i % 8) & 1
            r = self.rank1(level, i)
            value, i = value << 1 | int(one), z + r if one else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's own run begins in the last order, and how often it stands before place i."""
        lo, hi = 0, i
        if token >> len(self.zeros):
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (z + a, z + b) if token >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi - lo

    def rank(self, token: int, i: int) -> int:
        """How often a token stands before place i."""
        return self._range(token, i)[1]

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def find(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0."""
        lo, n = self._range(token, self.n)
        if not 0 <= k < n:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def places(self, token: int) -> np.ndarray:
        """All places of a token. A frequent one goes up through whole planes, level by level, a rare one by select."""
        lo, n = self._range(token, self.n)
        if n * BLOCK < self.n:
            return np.array(sorted(self.find(token, k) for k in range(n)), dtype=np.int64)
        at = np.arange(lo, lo + n)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - level) & 1
            where = np.flatnonzero(np.unpackbits(self.bits[level], count=self.n, bitorder="little") == one)
            at = where[at - self.zeros[level] if one else at]
        return np.sort(at)

    def tokens(self) -> np.ndarray:
        """All ids in order, from the planes upwards."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k, level in enumerate(range(len(self.zeros) - 1, -1, -1)):
            ones = np.unpackbits(self.bits[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, kind)
            up[~ones] = x[: self.zeros[level]]
            up[ones] = x[self.zeros[level] :] | kind(1 << k)
            x = up
        return x


class Store:
    """The shards of one written table."""

    def __init__(self, spark: SparkSession, path: str, manifest: DataFrame):
        self.spark, self.path, self.manifest = spark, path, manifest

    def _shards(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.ewm").load(self.path).select(F.regexp_extract("path", r"([^/]+)\.ewm$", 1).alias("shard"), "content")

    def _starts(self) -> DataFrame:
        """Where each shard begins among all ids. Sums are made within runs of SHARD_RUN partitions' shards, and then over
        the runs, which are a row each."""
        m = self.manifest.select("shard", "tokens", F.floor(F.substring("shard", 1, 8).cast("long") / SHARD_RUN).alias("run"))
        runs = m.groupBy("run").agg(F.sum("tokens").alias("all"))
        before = F.coalesce(F.sum("all").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        within = F.coalesce(F.sum("tokens").over(Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return m.withColumn("within", within).join(runs.select("run", before.alias("before")), "run").select("shard", (F.col("before") + F.col("within")).alias("shard_start"))

    def _each(self, fn, schema: str) -> DataFrame:
        """Rows of fn(shard) for every file, with the shard's start."""
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, data in zip(*b.columns):
                    for rows in fn(Shard(data.as_py())):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows[0])), *rows], ["shard", *names])

        if not self.manifest.take(1):
            return self.spark.createDataFrame([], f"shard string, {schema}, shard_start long")
        return self._shards().mapInArrow(run, f"shard string, {schema}").join(self._starts(), "shard")

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every document, read from the files."""

        def rows(s: Shard):
            ids = s.tokens().astype("<u4")
            for k in range(0, len(s.doc_ids), 500):
                a = s.starts[k : k + 501]
                yield [pa.array(s.doc_ids[k : k + 500], pa.int64()), pa.array(a[:-1]), pa.array(np.diff(a)), pa.array([ids[i:j].tobytes() for i, j in zip(a, a[1:])], pa.binary())]

        got = self._each(rows, "doc_id long, at long, n_tokens long, ids binary")
        return got.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids")

    def counts(self, wanted: list[int]) -> DataFrame:
        """token, n: how often each wanted id stands in all documents."""

        def rows(s: Shard):
            yield [pa.array(wanted, pa.int64()), pa.array([s.count(t) for t in wanted], pa.int64())]

        return self._each(rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def occurrences(self, token: int) -> DataFrame:
        """place, doc_id: every place of an id among all ids."""

        def rows(s: Shard):
            places = s.places(token)
            docs = np.searchsorted(s.starts, places, side="right") - 1
            yield [pa.array(places), pa.array([s.doc_ids[d] for d in docs], pa.int64())]

        got = self._each(rows, "at long, doc_id long")
        return got.select((F.col("shard_start") + F.col("at")).alias("place"), "doc_id")


def write_documents(df: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> Store:
    """Encode whole texts, end each with end_id, and write shards in ascending order of the (integer) id column."""
    spark = df.sparkSession
    if not isinstance(df.select(id_col).schema[0].dataType, IntegralType):
        raise TypeError(f"column {id_col} must be of an integer type, as files are in its order and hold it as one")
    path = path or tokens.default_path("word_bpe_49k.json")
    bad, end, out = tokens.unreachable(path), int(end_id).to_bytes(4, "little"), out or shared.new_path(spark, "wavelet")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, bad).encode
        part, ids, parts, size, k = TaskContext.get().partitionId(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])])
            name = f"{part:08d}-{k:06d}"
            shared.write_file(f"{out}/{name}.ewm", build(np.frombuffer(b"".join(parts), "<u4"), ids, starts))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(starts[-1])])], ["shard", "tokens"])

        for b in batches:
            for doc, text in zip(*b.columns):
                ids.append(doc.as_py())
                parts.append(encode(text.as_py()) + end)
                size += len(parts[-1]) // 4
                if size >= SHARD_TOKENS:
                    yield close()
                    ids, parts, size, k = [], [], 0, k + 1
        if parts:
            yield close()

    return Store(spark, out, shared.save(rows.mapInArrow(run, "shard string, tokens long"), "wavelet-manifest"))


def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents, read the files back."""
    store = write_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return store.documents().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
