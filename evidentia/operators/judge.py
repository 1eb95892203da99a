"""Reranking and verification stages, verdicts and evidence."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, closing, nullcontext
from math import exp
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import col, query_terms, terms

#: The verdict labels, and the label of an answer that can't be read.
LABELS = ("DIRECT_SUPPORT", "PARTIAL_SUPPORT", "CONTRADICTS", "RELATED_ONLY", "NOT_MENTIONED")
ERROR_LABEL = "VERIFICATION_ERROR"
VERDICT = "struct<label:string,evidence_tags:array<string>,reason:string,raw_output:string,parse_success:boolean>"


class Reranker(Protocol):
    """rerank(claim, passages) gives (probability, logit) for each passage, in order. close() frees it."""

    name: str

    def rerank(self, claim: str, passages: list[str]) -> list[tuple[float, float]]: ...

    def close(self) -> None: ...


class Verifier(Protocol):
    """verify(claim, numbered sentences) gives the model's raw answer. close() frees it."""

    name: str

    def verify(self, claim: str, numbered: str) -> str: ...

    def close(self) -> None: ...


def overlap(claim: Column | str, passage: Column | str) -> Column:
    """Share of a claim's distinct terms that a passage has: the deterministic reranker's probability."""
    q = query_terms(claim, fold_first=True)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, terms(passage))) / F.size(q))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def two_class(no: float, yes: float) -> tuple[float, float]:
    """Probability of yes by softmax over two logits, and their difference: what a language-model reranker returns."""
    d = yes - no
    return (1 / (1 + exp(-d)) if d >= 0 else exp(d) / (1 + exp(d))), d


def require_device(device: str) -> None:
    """To be called where a model is made: a CUDA device that isn't there is an error."""
    if device.startswith("cuda"):
        try:
            import torch

            there = torch.cuda.is_available()
        except ImportError:
            there = False
        if not there:
            raise RuntimeError(f"device {device} was asked for, but CUDA isn't available")


def use(model) -> AbstractContextManager:
    """A model's life in a task: one that is made here, by a function, is closed at the end; a given one is left open."""
    return closing(model()) if callable(model) else nullcontext(model)


def rank_reranked(scored: DataFrame, by: str = "rerank_score") -> DataFrame:
    w = Window.partitionBy("claim_id").orderBy(F.desc(F.coalesce(by, F.lit(0.0))), "fusion_rank")
    return scored.withColumn("rerank_rank", F.row_number().over(w).cast("long"))


def rerank_overlap(candidates: DataFrame, k: int = 30) -> DataFrame:
    """candidates: claim_id, claim, passage_id, text, fusion_rank. The k best by fused rank, reranked by overlap."""
    some = candidates.filter(F.col("fusion_rank") <= k)
    p = F.round(overlap("claim", "text"), 6)
    return rank_reranked(some.withColumn("rerank_score", p).withColumn("rerank_logit", F.round(logit(F.col("rerank_score")), 6)))


def rerank_model(candidates: DataFrame, make_reranker, k: int = 30, by: str = "rerank_score") -> DataFrame:
    """The same with any Reranker, or a function that makes one in each task; it sees only the k best. by: what ranks them,
    rerank_score or rerank_logit."""
    some = candidates.filter(F.col("fusion_rank") <= k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with use(make_reranker) as model:
            for frame in frames:
                for _, group in frame.groupby("claim_id", sort=False):
                    got = model.rerank(group["claim"].iloc[0], group["text"].tolist())
                    if len(got) != len(group):
                        raise ValueError("a reranker gave another number of scores than passages")
                    yield group.assign(rerank_score=[float(p) for p, _ in got], rerank_logit=[float(x) for _, x in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema) + ", rerank_score double, rerank_logit double"
    return rank_reranked(some.mapInPandas(run, schema), by)


def numbered_sentences(passage_sentences: DataFrame) -> DataFrame:
    """passage_sentences: passage_id, position, sentence_id, text. Gives numbered text and the tags' sentence ids."""
    g = passage_sentences.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("position", "sentence_id", "text"))).alias("s"))
    return g.select("passage_id", numbered_text(F.transform("s", lambda x: x["text"])).alias("numbered"), F.map_from_entries(F.transform("s", lambda x, i: F.struct(_tag(i), x["sentence_id"]))).alias("tags"), F.transform("s", lambda x: x["sentence_id"]).alias("sentence_ids"))


def _tag(i: Column) -> Column:
    return F.concat(F.lit("S"), (i + 1).cast("string"))


def numbered_text(texts: Column) -> Column:
    """A passage's sentences, given in order, each on a line after its tag."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), _tag(i), F.lit("] "), t)), "\n")


def parse_verdict(raw: Column | str) -> Column:
    """A verdict from a model's answer: the JSON from the first brace to the last. Anything unreadable is an error verdict."""
    raw = col(raw)
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    as_map = F.from_json(body, "label string, reason string, evidence string")
    label = F.upper(F.trim(F.coalesce(as_map["label"], F.lit(""))))
    ok = F.coalesce(F.try_parse_json(body).isNotNull() & label.isin(*LABELS), F.lit(False))
    tags = F.coalesce(F.from_json(as_map["evidence"], "array<string>"), F.array().cast("array<string>"))
    tags = F.when(as_map["evidence"].rlike(r"^\s*\["), tags).otherwise(F.array().cast("array<string>"))
    reason = F.when(body == "", "no JSON object").when(F.try_parse_json(body).isNull(), "malformed JSON").otherwise(F.concat(F.lit("invalid label: "), label))
    return F.struct(
        F.when(ok, label).otherwise(ERROR_LABEL).alias("label"),
        F.when(ok, F.transform(tags, lambda t: F.upper(F.trim(t)))).otherwise(F.array().cast("array<string>")).alias("evidence_tags"),
        F.when(ok, F.trim(F.coalesce(as_map["reason"], F.lit("")))).otherwise(reason).alias("reason"),
        raw.alias("raw_output"),
        ok.alias("parse_success"),
    ).cast(VERDICT)


def rule_answer(claim: Column | str, text: Column | str, numbered: Column | str) -> Column:
    """The deterministic verifier's raw answer: by the share of the claim's terms that the passage has, with the sentences that have any."""
    p = overlap(claim, text)
    label = F.when(p >= 0.95, "DIRECT_SUPPORT").when(p >= 0.6, "PARTIAL_SUPPORT").when(p >= 0.2, "RELATED_ONLY").otherwise("NOT_MENTIONED")
    q = query_terms(claim, fold_first=True)
    lines = F.split(col(numbered), "\n")
    hit = F.filter(lines, lambda x: F.size(F.array_intersect(q, terms(x))) * 2 >= F.size(q))
    tags = F.transform(hit, lambda x: F.regexp_extract(x, r"^\[(S\d+)\]", 1))
    return F.to_json(F.struct(label.alias("label"), F.when(p >= 0.2, tags).otherwise(F.array().cast("array<string>")).alias("evidence"), F.concat(F.lit("share of terms "), F.format_string("%.2f", p)).alias("reason")))


def verify_rule(candidates: DataFrame, k: int = 10) -> DataFrame:
    """candidates: claim, text, numbered, rerank_rank. The k best with their verdict; the order is kept, nothing is dropped."""
    some = candidates.filter(F.col("rerank_rank") <= k)
    return some.withColumn("verdict", parse_verdict(rule_answer("claim", "text", "numbered")))


def verify_model(candidates: DataFrame, make_verifier, k: int = 10) -> DataFrame:
    """The same with any Verifier, or a function that makes one in each task."""
    some = candidates.filter(F.col("rerank_rank") <= k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with use(make_verifier) as model:
            for frame in frames:
                yield frame.assign(raw=[model.verify(c, n) for c, n in zip(frame["claim"], frame["numbered"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema) + ", raw string"
    return some.mapInPandas(run, schema).withColumn("verdict", parse_verdict("raw")).drop("raw")


def evidence(tags: Column, ids: Column, distinct: bool = False) -> Column:
    """Sentence ids of known tags, in the answer's order; unknown tags are dropped, repeated ones kept unless asked."""
    known = F.filter(tags, lambda t: F.map_contains_key(ids, t))
    return F.transform(F.array_distinct(known) if distinct else known, lambda t: F.element_at(ids, t))


def evidence_or_all(chosen: Column, all_ids: Column) -> Column:
    """Without any chosen sentence the whole passage is the evidence."""
    return F.when(F.size(F.coalesce(chosen, F.array())) > 0, chosen).otherwise(all_ids)
