"""Terms of many texts at once, as Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are taken apart at once.
PIECE = 8 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about so many bytes in a column of texts, and one row at least."""
    for b in batches:
        if b.num_rows:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                yield b.slice(i, j - i)


def split(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Of texts whose terms stand between single spaces: the distinct terms, and for each term in order the number of its
    text and of itself among the distinct ones."""
    parts = pc.split_pattern(words, " ")
    flat, text = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not some.all():  # a text without terms
        flat, text = flat.filter(pa.array(some)), text[some]
    coded = flat.dictionary_encode()
    return coded.dictionary, text, coded.indices.to_numpy().astype(np.int64)


def ends(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where the lists of n owners begin and end, from each element's owner, in order."""
    return np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=n))]).astype(np.int32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, and so on."""
    upto = np.cumsum(counts)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - counts), counts)


def with_grams(df: DataFrame, words: str) -> DataFrame:
    """df with a hash of every three terms in a row (g) instead of words, its text with terms between single spaces."""
    mixed = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1], np.uint64)
    kept = [f for f in df.schema if f.name != words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(kept)):
            distinct, text, code = split(b.column(len(kept)))
            h = pd.util.hash_array(np.array(distinct.to_pylist(), dtype=object), categorize=False)[code]
            own = np.flatnonzero(text[:-2] == text[2:])
            g = (h[own] * mixed[0] + h[own + 1] * mixed[1] + h[own + 2] * mixed[2]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends(text[own], b.num_rows)), pa.array(g))], [*(f.name for f in kept), "g"])

    return df.select(*[f.name for f in kept], words).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", g array<bigint>")
