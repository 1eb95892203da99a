"""Language identification by a small convolutional network over bytes (operator 8).

A window of bytes is embedded, filters of several widths run over it, each filter's maximum over the window feeds a
softmax. The network is trained in numpy on the driver from a bounded sample of labelled texts (TRAIN_DOCS of each
language, TRAIN_TOTAL in all, which many languages share evenly) and then applied to every window of every text; a
text's probabilities are its windows' means, weighted by their bytes.

Defined results: ``und`` with score 0 if a text is null, empty or has no letter, or if nothing could be learned; equal
rows get equal results; empty tables give no rows; other columns are ignored, whatever their names. Rows without a
language (or text) are not learned from. Ties between languages go to the one that sorts first. A row without an id is
not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled texts of each language, of all of them, and characters of each text: the sample's documented bounds.
TRAIN_DOCS, TRAIN_TOTAL, TRAIN_CHARS = 900, 60_000, 700
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 6, 8
SPAN = max(WIDTHS)
#: Windows that are computed at once.
BATCH = 256
EPOCHS, STEP, MINIBATCH = 8, 0.01, 64


def windows(data: bytes) -> np.ndarray:
    """All of a text's bytes as rows of WINDOW bytes, the last one filled with zeros."""
    rows = -(-len(data) // WINDOW)
    return np.frombuffer(data + bytes(rows * WINDOW - len(data)), np.uint8).reshape(rows, WINDOW)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((SPAN, EMBED, n), np.float32)  # a narrow filter sees the first bytes of its span only
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(SPAN * EMBED, n)
        self.filters = (rng.normal(0, 1 / np.sqrt(SPAN * EMBED), self.mask.shape) * self.mask).astype(np.float32)
        self.shift = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each window. The windows are laid end to end, each followed by SPAN-1 zeros or
        more; for each offset within a span the spans do not overlap, so they need no copies."""
        width = -(-(WINDOW + SPAN - 1) // SPAN) * SPAN
        wide = np.zeros((len(x) + 1, width), np.uint8)
        wide[:-1, :WINDOW] = x
        flat = self.embed[wide.reshape(-1)]
        spans, best = width // SPAN, None
        for r in range(SPAN):
            part = flat[r : r + len(x) * width].reshape(len(x) * spans, SPAN * EMBED) @ self.filters
            top = part.reshape(len(x), spans, -1)[:, : spans - 1].max(1)
            best = top if best is None else np.maximum(best, top, out=best)
        return np.maximum(best + self.shift, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (self.pooled(x) @ self.dense + self.bias).astype(np.float64)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        weight = 1 / np.bincount(y, minlength=len(self.languages)).clip(1)[y]
        weight = (weight / weight.mean()).astype(np.float32)
        params = [self.embed, self.filters, self.shift, self.dense, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        places = WINDOW - SPAN + 1
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), MINIBATCH):
                some = order[at : at + MINIBATCH]
                w = x[some].copy()
                for row, n in enumerate(rng.integers(12, 2 * WINDOW, len(some))):  # short texts are learned too
                    w[row, n:] = 0
                e = self.embed[w]
                spans = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(w), places, SPAN * EMBED)
                conv = spans @ self.filters
                where = conv.argmax(1)
                raw = np.take_along_axis(conv, where[:, None], 1)[:, 0] + self.shift
                feats = np.maximum(raw, 0)
                z = feats @ self.dense + self.bias
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(w)), y[some]] -= 1
                g *= weight[some][:, None] / len(w)
                back = (g @ self.dense.T) * (raw > 0)
                own = np.take_along_axis(spans, where[:, :, None], 1)  # examples, filters, span
                d_filters = np.einsum("bf,bfs->sf", back, own) * self.mask
                d_embed = np.zeros_like(self.embed)
                seen = w[np.arange(len(w))[:, None, None], where[:, :, None] + np.arange(SPAN)]
                np.add.at(d_embed, seen, (back[:, :, None] * self.filters.T[None]).reshape(*seen.shape, EMBED))
                d_embed[0] = 0
                t += 1
                rate = STEP * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for p, d, a, b in zip(params, (d_embed, d_filters, back.sum(0), feats.T @ g, g.sum(0)), m, v):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= rate * a / (np.sqrt(b) + 1e-8)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = TRAIN_DOCS) -> Network | None:
    """Train on a sample: of each language about docs_per_language texts, chosen by a hash of their ids; of each some
    TRAIN_CHARS characters at a place that the hash gives."""
    rows = labelled.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & (F.col("l") != "und"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    docs_per_language = max(1, min(docs_per_language, TRAIN_TOTAL // len(counts)))
    most = len(counts) * docs_per_language * 2
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, int((1 << 30) * docs_per_language / n) + 1))])
    place = (1 + F.pmod(F.xxhash64("k", F.lit(1)), F.greatest(F.lit(1), F.length("t") - TRAIN_CHARS))).cast("int")
    chosen = rows.filter(draw < F.coalesce(F.try_element_at(share, F.col("l")), F.lit(0))).select("l", F.xxhash64("k", F.lit(2)).alias("h"), F.substring("t", place, F.lit(TRAIN_CHARS)).alias("t"))
    got = chosen.orderBy("h", "l", "t").limit(most).collect()
    languages = sorted({r["l"] for r in got})
    if not languages:
        return None
    x, y = [], []
    for r in got:
        if any(map(str.isalpha, r["t"])):
            w = windows(r["t"].encode())
            w = w[: max(1, len(w) - 1)]
            x.append(w)
            y += [languages.index(r["l"])] * len(w)
    if not x:
        return None
    net = Network(languages)
    net.train(np.concatenate(x), np.array(y))
    return net


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id and the columns in ``keep``, with lang_pred and score, for every row."""
    few = df.select(F.col(id_col), *[F.col(c) for c in keep if c not in (id_col, text_col)], F.col(text_col).alias("__text"))
    again = text_col in keep
    kinds = [f for f in few.schema if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ([f"`{text_col}` string"] if again else []) + ["lang_pred string", "score double"])

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        waiting: list[tuple[int, np.ndarray, int]] = []
        sums: dict[int, np.ndarray] = {}

        def run():
            if waiting:
                p = net.probabilities(np.concatenate([w for _, w, _ in waiting]))
                at = 0
                for k, w, n in waiting:
                    share = np.full(len(w), WINDOW, float)
                    if n % WINDOW:
                        share[-1] = n % WINDOW
                    sums[k] = sums.get(k, 0) + (p[at : at + len(w)] * share[:, None]).sum(0)
                    at += len(w)
                waiting.clear()

        rows = 0
        for k, text in enumerate(texts):
            if net is None or not text or not any(map(str.isalpha, text)):
                continue
            data = text.encode("utf-8", "replace")
            for at in range(0, len(data), BATCH * WINDOW):  # a long text goes in parts
                part = data[at : at + BATCH * WINDOW]
                w = windows(part)
                waiting.append((k, w, len(part)))
                rows += len(w)
                if rows >= BATCH:
                    run()
                    rows = 0
        run()
        for k, s in sums.items():
            s = s / s.sum()
            best = int(s.argmax())
            langs[k], scores[k] = net.languages[best], float(s[best])
        return langs, scores

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = score(b.column(b.num_columns - 1).to_pylist())
            cols = [*b.columns[:-1], *([b.columns[-1]] if again else []), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*[f.name for f in kinds], *([text_col] if again else []), "lang_pred", "score"])

    return few.mapInArrow(apply, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labelled documents that are not held out; predict all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs.filter(~held_out()))
    got = predict(docs, net)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
