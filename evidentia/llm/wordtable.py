"""BPE encoding and decoding through a table of distinct words (operator 9).

Spark splits texts at single spaces. A block of documents keeps each document's words as places in the block's own list
of distinct words. The lists are dealt by a hash of the word; where they meet, each distinct word is encoded once, and its
ids go back to every block that has it, which joins them by position. Decoding joins each document's ids, by position
again, to the vocabulary's id-to-piece table, which is as large as the vocabulary and part of the plan. Neither texts nor
a word's occurrences are shuffled, only a block's distinct words and packed places, so a frequent word costs one entry
per block.

Defined results: null text counts as empty (no ids, empty decoded text); equal rows are encoded once each; empty tables
give no rows; other columns are ignored, whatever their names; null ids stay null. The input is scanned twice and must
give the same rows in the same partitions, as any table on disk does; if it does not, the job fails rather than mixing
documents.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm import tokens

#: Text bytes of a block; input bytes for which there is one bucket of words, and the fewest buckets.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 16_000_000, 16_000_000, 64
#: Documents of a batch whose words are looked up at once.
SLICE = 256


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of bytes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return struct.pack("<Q", len(x)) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<Q", data)[0]
    return np.frombuffer(zstandard.decompress(data[8:]), np.uint8).reshape(4, n).T.copy().view("<u4").reshape(-1)


class Index(dict):
    """Places of words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def encoded(column: pa.Array, index: Index, split) -> Iterator[tuple[list[np.ndarray], int]]:
    """A batch's documents in slices: each document's words as places in the index, and the slice's bytes.

    Arrow finds the distinct words of a slice of word lists, so only these become Python objects.
    """
    if split is not None:
        for text in column:
            text = text.as_py()
            yield [np.array(array("I", map(index.__getitem__, split(text))), np.uint32)], len(text)
        return
    for at in range(0, len(column), SLICE):
        part = column.slice(at, SLICE)
        flat = part.flatten()
        found = flat.dictionary_encode()
        place = np.fromiter(map(index.__getitem__, found.dictionary.to_pylist()), np.uint32, len(found.dictionary))
        ends = np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))
        yield np.split(place[found.indices.to_numpy()], ends[:-1]), flat.nbytes - 3 * len(flat)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, split=None) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """batches: id, and words, or texts for ``split``. Gives block id, documents' ids, their words as places, the distinct
    words."""
    part, k = TaskContext.get().partitionId(), 0
    ids, places, index, size = [], [], Index(), 0

    def close():
        words = list(index)
        seal = xxhash.xxh64(struct.pack("<QQ", part, k))
        seal.update(repr(ids).encode() + np.array([len(p) for p in places], "<u4").tobytes())
        seal.update(" ".join(words).encode("utf-8", "surrogatepass"))
        return seal.intdigest() - (1 << 63), ids, places, words

    for b in batches:
        docs = iter(b.column(0).to_pylist())
        at = 0
        while at < b.num_rows:
            for some, n in encoded(b.column(1).slice(at), index, split):
                ids += [next(docs) for _ in some]
                places += some
                size += n
                at += len(some)
                if size >= limit:  # the index begins anew, and so do the slices
                    break
            if size >= limit:
                yield close()
                ids, places, index, size, k = [], [], Index(), 0, k + 1
    if ids:
        yield close()


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's input bytes; costs no job. Where it knows none, as if each shuffle partition had
    a bucket's bytes."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else BUCKET_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encode_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (text); full=False: their SHA-256 instead."""
    path = path or tokens.default_path("word_bpe_49k.json")
    bad = tokens.unreachable(path)
    few = df.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), " ").alias("words"))
    buckets = max(LEAST_BUCKETS, size_of(few) // BUCKET_BYTES)
    id_type = few.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, distinct in blocks(batches):
            data = [w.encode("utf-8", "surrogatepass") for w in distinct]
            bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in data], dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            used, at = np.unique(bucket[order], return_index=True)
            parts = np.split(order, at[1:])
            rows = [zstandard.compress(b" ".join(data[i] for i in p.tolist()), 3) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(used)), pa.array(used), pa.array([pack(np.diff(p, prepend=0)) for p in parts]), pa.array(rows)], ["block", "bucket", "places", "payload"])

    def encode(group: pa.Table) -> pa.Table:
        e = tokens.encoder(path, bad)
        memo: dict[bytes, bytes] = {}
        out = []
        for row in group.column("payload"):
            got = []
            for w in zstandard.decompress(row.as_py()).split(b" "):
                ids = memo.get(w)
                if ids is None:
                    ids = memo[w] = e._chunk(w.decode("utf-8", "surrogatepass"))
                got.append(ids)
            counts = np.fromiter(map(len, got), np.uint32, len(got)) // 4
            out.append(struct.pack("<Q", len(c := pack(counts))) + c + pack(np.frombuffer(b"".join(got), "<u4")))
        return pa.table({"block": group.column("block"), "places": group.column("places"), "payload": pa.array(out, pa.binary()), "docs": pa.array([None] * len(out), pa.binary())})

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, places, _ in blocks(batches):
            lengths = pack(np.array([len(p) for p in places]))
            flat = np.concatenate(places)
            sink = pa.BufferOutputStream()
            table = pa.record_batch([pa.array(ids, id_arrow)], ["doc_id"])
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_batch(table)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lengths]), pa.array([pack(flat)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "places", "payload", "docs"])

    def join(group: pa.Table) -> pa.Table:
        own = [r for r in group.to_pylist() if r["docs"] is not None]
        answers = [r for r in group.to_pylist() if r["docs"] is None]
        if len(own) != 1:
            raise ValueError("a block's words and places do not match: the input changed between two scans")
        table: list[bytes] = []
        at = []
        for r in answers:
            n = struct.unpack_from("<Q", r["payload"])[0]
            ends = np.cumsum(unpack(r["payload"][8 : 8 + n])).tolist()
            data = unpack(r["payload"][8 + n :]).tobytes()
            at.append(np.cumsum(unpack(r["places"]), dtype=np.uint32))
            table += [data[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]
        back = np.argsort(np.concatenate(at)).tolist() if at else []
        table = [table[i] for i in back]
        flat = unpack(own[0]["payload"]).tolist()
        if flat and max(flat) >= len(table):
            raise ValueError("a block's words and places do not match: the input changed between two scans")
        ids = pa.ipc.open_stream(own[0]["docs"]).read_all().column(0).combine_chunks()
        parts, i = [], 0
        for length in unpack(own[0]["places"]).tolist():
            mine = flat[i : i + length]
            i += length
            parts.append(b"".join([table[k] for k in mine]))
        n = np.array([len(x) // 4 for x in parts], np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        coded = pa.array(parts, pa.binary()) if full else pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n), "coded": coded, "flat": flat})

    asked = few.mapInArrow(words, "block long, bucket long, places binary, payload binary")
    packed = "block long, places binary, payload binary, docs binary"
    answered = asked.groupBy("bucket").applyInArrow(encode, packed)
    both = few.mapInArrow(positions, packed).unionByName(answered)
    got = both.groupBy("block").applyInArrow(join, f"doc_id {id_type.simpleString()}, n_tokens long, coded {'binary' if full else 'string'}, flat array<int>")
    table = F.from_json(F.lit(json.dumps(pieces(path))), "array<string>")  # folded to one constant
    decoded = F.array_join(F.transform("flat", lambda i: F.get(table, i)), " ")
    if full:
        return got.select("doc_id", "n_tokens", F.col("coded").alias("ids"), decoded.alias("decoded"))
    return got.select("doc_id", "n_tokens", F.col("coded").alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def pieces(path: str) -> list[str]:
    """The vocabulary's id-to-piece table: one entry per id, fixed by the vocabulary file."""
    names = {i: s for s, i in tokens.library(path).get_vocab(with_added_tokens=True).items()}
    return [names.get(i, "") for i in range(max(names) + 1)]


def op9_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, encoded and decoded; given as digests."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), full=False)
