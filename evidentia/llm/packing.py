"""Packing of token sequences by vector bin packing (operator 3).

Every example asks for three things at once: tokens, one segment, and loss-bearing tokens. A sequence has a limit on
each. The dot-product heuristic repeatedly places the example whose demand vector has the largest dot product with the
open sequence's remaining capacity, both measured in parts of the limits. When nothing fits whole, the best example is
cut so that it fills the sequence; what is left in the end goes into sequences whose lengths are powers of two.

Defined results: null text counts as empty (its end id alone); equal rows are packed once each; empty tables give no
rows; columns other than the id and the text are ignored, whatever their names; null ids stay null.
Examples are packed within blocks of a partition, so no row moves between machines, and a block is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import tokens

CAPACITY = 1024
MAX_SEGMENTS = 128
#: A block ends at so many examples or tokens, whichever comes first.
BLOCK_EXAMPLES, BLOCK_TOKENS = 4096, 4_000_000

PIECES = "sequence_id long, offset long, start long, length long, loss_tokens long, doc_tokens long, ids binary"


def pack_block(lengths: np.ndarray, losses: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length); the last ``losses`` tokens of an example bear loss. Cuts freely."""
    limits = np.array([capacity, max_segments, max_loss], dtype=float)
    at = np.zeros(len(lengths), dtype=np.int64)  # tokens of each example that are placed
    classes: dict[tuple[int, int], list[int]] = {}

    def loss_of(i: int, n: int) -> int:
        """Loss-bearing tokens among the next n of an example."""
        return int(max(0, at[i] + n - max(at[i], lengths[i] - losses[i])))

    def put_back(i: int) -> None:
        left = int(lengths[i] - at[i])
        if left:
            classes.setdefault((left, loss_of(i, left)), []).append(i)

    for i in range(len(lengths)):  # whole sequences first
        while lengths[i] - at[i] >= capacity and loss_of(i, capacity) <= max_loss:
            yield [(i, int(at[i]), capacity)]
            at[i] += capacity
        put_back(i)

    keys = np.array(sorted(classes), dtype=np.int64).reshape(-1, 2)
    known = {tuple(k): j for j, k in enumerate(keys.tolist())}
    counts = np.array([len(classes[tuple(k)]) for k in keys.tolist()], dtype=np.int64)
    left_tokens = int((lengths - at).sum())
    last: list[tuple[int, int, int]] = []
    while left_tokens:
        room, bin_, full = np.array([capacity, max_segments, max_loss], dtype=np.int64), [], False
        while left_tokens and not full:
            weight = room / limits / limits
            score = keys[:, 0] * weight[0] + weight[1] + keys[:, 1] * weight[2]
            fits = (counts > 0) & (keys[:, 0] <= room[0]) & (keys[:, 1] <= room[2])
            if room[1] == 1:  # the last segment should fill the sequence
                fits &= keys[:, 0] == room[0]
            if fits.any():
                j = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(keys[j, 0])
            else:
                j = int(np.argmax(np.where(counts > 0, score, -1.0)))
                n = int(min(keys[j, 0], room[0]))
            i = classes[tuple(keys[j].tolist())].pop()
            counts[j] -= 1
            while n and loss_of(i, n) > room[2]:
                n -= loss_of(i, n) - int(room[2])
            if n <= 0:
                put_back(i)
                counts[j] += 1
                break
            used = loss_of(i, n)
            bin_.append((i, int(at[i]), n))
            at[i] += n
            left_tokens -= n
            room -= (n, 1, used)
            rest = int(lengths[i] - at[i])
            if rest:
                key = (rest, loss_of(i, rest))
                put_back(i)
                if key in known:
                    counts[known[key]] += 1
                else:
                    known[key] = len(keys)
                    keys, counts = np.vstack([keys, key]), np.append(counts, 1)
            full = room[0] == 0 or room[1] == 0 or room[2] == 0
        if room[0] and not left_tokens:
            last = bin_
        else:
            yield bin_
    yield from powers(last)


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The same tokens in sequences whose lengths are falling powers of two: nothing of them is padding."""
    left = sum(n for _, _, n in pieces)
    pieces = list(reversed(pieces))
    while left:
        size = room = 1 << (left.bit_length() - 1)
        out = []
        while room:
            i, s, n = pieces.pop()
            take = min(n, room)
            out.append((i, s, take))
            if take < n:
                pieces.append((i, s + take, n - take))
            room -= take
        yield out
        left -= size


def _rows(examples: Iterable[tuple[object, bytes, int]], id_type: pa.DataType, capacity: int, max_segments: int, max_loss: int) -> Iterator[pa.RecordBatch]:
    """examples: id, ids as little-endian unsigned 32-bit bytes, loss-bearing tokens at the end."""
    names = ["doc_id", "sequence_id", "offset", "start", "length", "loss_tokens", "doc_tokens", "ids"]
    schema = pa.schema([(names[0], id_type), *((n, pa.int64()) for n in names[1:-1]), (names[-1], pa.binary())])
    sequence = TaskContext.get().partitionId() << 40
    block: list[tuple[object, bytes, int]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        lengths = np.array([len(b) // 4 for _, b, _ in block], dtype=np.int64)
        losses = np.minimum(np.array([x for _, _, x in block], dtype=np.int64), lengths)
        cols: list[list] = [[] for _ in names]
        for pieces in pack_block(lengths, losses, capacity, max_segments, max_loss):
            offset = 0
            for i, s, n in pieces:
                key, data, loss = block[i]
                total = int(lengths[i])
                for c, v in zip(cols, (key, sequence, offset, s, n, max(0, s + n - max(s, total - int(losses[i]))), total, data[4 * s : 4 * (s + n)])):
                    c.append(v)
                offset += n
            sequence += 1
            if len(cols[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
                cols = [[] for _ in names]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    for x in examples:
        if not x[1]:
            continue
        block.append(x)
        size += len(x[1]) // 4
        if len(block) >= BLOCK_EXAMPLES or size >= BLOCK_TOKENS:
            yield from flush()
            block, size = [], 0
    if block:
        yield from flush()


def check(capacity: int, max_segments: int, max_loss: int) -> None:
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("capacity, max_segments and max_loss must be at least 1")


def pack_examples(df: DataFrame, id_col: str, ids_col: str, loss_col: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pack tokenized examples (ids: array of int). loss_col: how many tokens at the end bear loss; without it all do.

    Empty or null id lists take no place. Returns a row per piece.
    """
    max_loss = capacity if max_loss is None else max_loss
    check(capacity, max_segments, max_loss)
    loss = F.coalesce(F.col(loss_col).cast("long"), F.lit(0)) if loss_col else F.size(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))).cast("long")
    few = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"), loss.alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples():
            for b in batches:
                yield from ((k.as_py(), np.asarray(v.as_py(), dtype="<u4").tobytes(), n.as_py()) for k, v, n in zip(*b.columns))

        yield from _rows(examples(), id_arrow, capacity, max_segments, max_loss)

    id_type = few.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)
    return few.mapInArrow(run, f"doc_id {id_type.simpleString()}, {PIECES}")


def pack_documents(df: DataFrame, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Tokenize whole texts, end each with end_id, and pack them. All tokens bear loss, so max_loss binds below capacity only."""
    max_loss = capacity if max_loss is None else max_loss
    check(capacity, max_segments, max_loss)
    path = path or tokens.default_path("byte_bpe_50k.json")
    bad = tokens.unreachable(path)
    end = int(end_id).to_bytes(4, "little")
    few = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = few.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, bad).encode

        def examples():
            for b in batches:
                for k, v in zip(*b.columns):
                    ids = encode(v.as_py()) + end
                    yield k.as_py(), ids, len(ids) // 4

        yield from _rows(examples(), id_arrow, capacity, max_segments, max_loss)

    return few.mapInArrow(run, f"doc_id {id_type.simpleString()}, {PIECES}")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed with the production limits; ids are given as a checksum."""
    return query(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
