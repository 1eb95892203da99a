"""Stupid-backoff scores of documents against the rest of their corpus (operator 2).

Blocks of documents give their distinct n-grams, as 64-bit hashes, with how often they have each. These are dealt by a
hash of the n-gram, exploded to a row for each n-gram of a block, and counted: every part is a count table of its n-grams,
whose totals are joined back to the rows, where they lie already. Totals of n-grams that other blocks have as well return
to their block (of the others it knows the total), which sums its documents' scores. Counts cover the whole corpus. A
document's own n-grams are taken off before it is scored, so it is judged by the others.

score: mean over a document's words of ln S(w | v) with S = c(v w) / c(v) if c(v w) > 0, else BACKOFF * c(w) / N, where
counts leave the document out; a word found nowhere else counts UNSEEN. Higher orders back off one word at a time.

A frequent n-gram costs a block one row however often it occurs, so no part of the table is hot. Parts grow in number
with the input. The input is scanned twice and must give the same rows in the same partitions; if not, the job fails.
N-grams are told apart by their hashes alone: of n distinct ones about n * n / 2**65 pairs share a hash and are counted
together, which is none in a billion and some 27,000 pairs in a million million.

Defined results: a text without words (null, empty) has n_words 0 and a null score; equal rows are scored once each and
count for one another; an empty table gives no rows; columns with clashing names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm import shared
from evidentia.llm.wordtable import BUCKET_BYTES, LEAST_BUCKETS, blocks, pack, size_of, unpack

ORDER, BACKOFF, UNSEEN = 2, 0.4, 0.5
#: Text bytes of a block. Its n-grams are held as arrays of 64-bit numbers, so it is smaller than elsewhere.
GRAM_BLOCK_BYTES = 5_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Parts at most, which grow from there on, and buckets for each part, so that parts are about even.
MOST_PARTS, BUCKETS_EACH = 50_000, 4
#: A place among a block's n-grams of a part and a total, in one number.
TOTAL_BITS = 40


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from its first words' hash and its last word's."""
    x = (a * K1) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


class Grams:
    """A block's n-grams of every order: distinct hashes and their counts, one order after the other, and for each order
    the places where one ends and which distinct one it is."""

    def __init__(self, places: list[np.ndarray], hashes: np.ndarray, order: int):
        self.lengths = np.array([len(p) for p in places], dtype=np.int64)
        flat = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(places)), self.lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        word = hashes[flat] if len(flat) else np.zeros(0, np.uint64)
        gram, self.where, keys, self.ids, counts, base = word, [], [], [], [], 0
        for n in range(1, order + 1):
            if n > 1:
                gram = np.concatenate([np.zeros(1, np.uint64), _mix(gram[:-1], word[1:])])[: len(word)]
            ok = at >= n - 1  # places at which an n-gram of the document ends
            own, inverse, count = np.unique(gram[ok], return_inverse=True, return_counts=True)
            self.where.append(np.flatnonzero(ok))
            self.ids.append(inverse + base)
            keys.append(own)
            counts.append(count)
            base += len(own)
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts)

    def own(self, n: int) -> np.ndarray:
        """How often the n-gram of each place of where[n] stands in its own document."""
        code = self.doc[self.where[n]] * max(1, len(self.keys)) + self.ids[n]
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
        return counts[inverse]

    def parts(self, buckets: int) -> dict[int, np.ndarray]:
        """The distinct n-grams of each part of the table."""
        bucket = (self.keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        return dict(zip(used.tolist(), np.split(order, first[1:])))


@contextmanager
def within_parts(spark: SparkSession):
    """Joins on more columns than the input is dealt by need no further shuffle; for the jobs that run meanwhile."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def totals(asked: DataFrame, parts: int) -> DataFrame:
    """asked: block, bucket, keys, counts. Gives block, bucket, more: place and total of its n-grams that others have too.

    The one shuffle is by bucket, which an n-gram belongs to. Both the count table, without n-grams of one block alone,
    and its join to the exploded n-grams stay within the part.
    """
    rows = asked.repartition(parts, "bucket").select("block", "bucket", F.posexplode(F.arrays_zip("keys", "counts")).alias("pos", "x"))
    rows = rows.select("block", "bucket", "pos", F.col("x.keys").alias("gram"), F.col("x.counts").alias("n"))
    # both sides read the same columns, so that they share the shuffle
    counts = rows.groupBy("bucket", "gram").agg(F.sum("n").alias("total"), F.min("block").alias("a"), F.max("block").alias("b"))
    table = counts.filter("a <> b").drop("a", "b")
    packed = F.shiftleft(F.col("pos").cast("long"), TOTAL_BITS) + F.col("total")
    return rows.join(table.hint("shuffle_hash"), ["bucket", "gram"]).filter("total > n").groupBy("block", "bucket").agg(F.collect_list(packed).alias("more"))


def ngram_scores(df: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_backoff (words whose full n-gram is found nowhere else), score."""
    few = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = min(MOST_PARTS, max(LEAST_BUCKETS, size_of(few) // BUCKET_BYTES))
    buckets = parts * BUCKETS_EACH
    id_type = few.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    def hashed(distinct: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in (x.encode("utf-8", "surrogatepass") for x in distinct)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, places, distinct in blocks(batches, GRAM_BLOCK_BYTES, words_of):
            g = Grams(places, hashed(distinct), order)
            for bucket, some in g.parts(buckets).items():
                ends = pa.array([0, len(some)], pa.int32())
                keys, counts = pa.array(g.keys[some].view(np.int64)), pa.array(g.counts[some].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket]), pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, counts)], ["block", "bucket", "keys", "counts"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, places, distinct in blocks(batches, GRAM_BLOCK_BYTES, words_of):
            lengths, flat = pack(np.array([len(p) for p in places])), pack(np.concatenate(places))
            data = pa.record_batch([pa.array([lengths], pa.binary()), pa.array([flat], pa.binary()), pa.array([hashed(distinct).astype("<u8").tobytes()], pa.binary()), pa.array([ids], pa.list_(id_arrow))], ["lengths", "flat", "hashes", "ids"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema) as w:
                w.write_batch(data)
            payload = zstandard.compress(sink.getvalue().to_pybytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1]), pa.array([None], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["block", "bucket", "more", "docs"])

    def score(group: pa.Table) -> pa.Table:
        own = [x for x in group.column("docs").to_pylist() if x is not None]
        if len(own) != 1:
            raise ValueError("a block's words and places do not match: the input changed between two scans")
        data = pa.ipc.open_stream(zstandard.decompress(own[0])).read_all().to_pylist()[0]
        lengths, flat = unpack(data["lengths"]).astype(np.int64), unpack(data["flat"]).astype(np.int64)
        places = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
        g = Grams(places, np.frombuffer(data["hashes"], "<u8"), order)
        total, dealt = g.counts.astype(np.int64), g.parts(buckets)
        for bucket, more in zip(group.column("bucket").to_pylist(), group.column("more")):
            if more.is_valid:
                packed = more.values.to_numpy()
                total[dealt[bucket][packed >> TOTAL_BITS]] = packed & (1 << TOTAL_BITS) - 1
        left = []  # for each order, at each place: how often the n-gram ending there stands in other documents
        for n in range(order):
            x = np.zeros(len(flat), np.int64)
            x[g.where[n]] = total[g.ids[n]] - g.own(n)
            left.append(x)
        done, logs, unigram = np.zeros(len(flat), bool), np.zeros(len(flat)), np.zeros(len(flat), bool)
        backed = np.zeros(len(flat), bool)
        for n in range(order - 1, -1, -1):
            steps = (order - 1 - n) * np.log(BACKOFF)
            if n:
                context = np.concatenate([[0], left[n - 1][:-1]])
                hit = ~done & (left[n] > 0) & (context > 0)
                logs[hit] = steps + np.log(left[n][hit]) - np.log(context[hit])
            else:
                hit = ~done
                unigram |= hit
                logs[hit] = steps + np.log(np.maximum(left[0][hit], UNSEEN))
            done |= hit
            if n == order - 1:
                backed = ~done
        m = len(lengths)
        sums = np.bincount(g.doc, logs, m)
        return pa.table({"doc_id": pa.array(data["ids"], id_arrow), "n_words": pa.array(lengths), "n_backoff": pa.array(np.bincount(g.doc, backed, m).astype(np.int64)), "n_unigram": pa.array(np.bincount(g.doc, unigram, m).astype(np.int64)), "logs": pa.array(sums)})

    answered = totals(few.mapInArrow(ask, "block long, bucket long, keys array<long>, counts array<int>"), parts)
    both = few.mapInArrow(positions, "block long, bucket long, more array<long>, docs binary").unionByName(answered.withColumn("docs", F.lit(None).cast("binary")))
    scored = both.groupBy("block").applyInArrow(score, f"doc_id {id_type.simpleString()}, n_words long, n_backoff long, n_unigram long, logs double")
    with within_parts(df.sparkSession):
        got = shared.save(scored, "ngram-scores")
    total = got.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(1), F.lit(total) - F.col("n_words"))
    return got.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, (F.col("logs") - F.col("n_unigram") * F.ln(others)) / F.col("n_words")).alias("score"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by the n-grams of all others."""
    got = ngram_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_backoff", F.round("score", 6).alias("score"))


OP2_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, w, CASE WHEN i > 1 THEN lag(w) OVER (PARTITION BY doc_id ORDER BY i) END AS v FROM p),
u AS (SELECT w, count(*) AS c FROM g GROUP BY w), ud AS (SELECT doc_id, w, count(*) AS c FROM g GROUP BY doc_id, w),
b AS (SELECT v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY v, w),
bd AS (SELECT doc_id, v, w, count(*) AS c FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
n AS (SELECT count(*) AS n FROM g), nd AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT g.doc_id, coalesce(b.c - bd.c, 0) AS cb, coalesce(uv.c - udv.c, 0) AS cv, u.c - ud.c AS cw, greatest(1, n.n - nd.n) AS others
  FROM g CROSS JOIN n JOIN nd USING (doc_id) JOIN u ON u.w = g.w JOIN ud ON ud.doc_id = g.doc_id AND ud.w = g.w
  LEFT JOIN b ON b.v = g.v AND b.w = g.w LEFT JOIN bd ON bd.doc_id = g.doc_id AND bd.v = g.v AND bd.w = g.w
  LEFT JOIN u uv ON uv.w = g.v LEFT JOIN ud udv ON udv.doc_id = g.doc_id AND udv.w = g.v),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE NOT (cb > 0 AND cv > 0)) AS n_backoff,
  avg(CASE WHEN cb > 0 AND cv > 0 THEN ln(cb) - ln(cv) ELSE ln({BACKOFF}) + ln(greatest(cw, {UNSEEN})) - ln(others) END) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_words, 0) AS n_words, coalesce(r.n_backoff, 0) AS n_backoff, round(r.score, 6) AS score
FROM documents d LEFT JOIN r USING (doc_id)
"""
