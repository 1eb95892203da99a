"""Retrieval and verification of a batch of claims."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import dense, fusion, judge, lexical, review
from evidentia.plans.corpus import Corpus, CorpusError, silent

#: Rerankers and verifiers by name, for corpora that name theirs: functions that make one in each task. None is the
#: built-in one, which needs no model. Callers may add their own, or pass one.
RERANKERS: dict[str, Callable | None] = {"overlap": None}
VERIFIERS: dict[str, Callable | None] = {"rule": None}


def check_depths(**depths: int) -> None:
    for name, k in depths.items():
        if k <= 0:
            raise ValueError(f"{name} must be positive")


def hybrid(index: lexical.LexicalIndex, vectors: DataFrame, claims: DataFrame, embedder: dense.Embedder, candidate_k: int = 100) -> DataFrame:
    """Fused candidates of every claim: claim_id, passage_id, ranks and scores of both sides, fusion_rank."""
    asked = dense.embed(claims, "claim_id", "claim", embedder).select(F.col("id").alias("claim_id"), "embedding")
    d = dense.search(vectors, asked, candidate_k)
    return fusion.fuse(d, lexical.search(index, claims, candidate_k))


def passage_records(passages: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """What a search shows of a passage: its ids and texts, page, document and end-matter mark."""
    p = pages.select("document_id", "page_index", "page_number")
    d = documents.select("document_id", "title", "filename", "stored_path", "citation_key", "doi")
    own = passages.select(F.col("display_id").alias("passage_id"), "document_id", "page_index", "source_text", "normalized_text", "content_type", "word_count")
    return own.join(p, ["document_id", "page_index"]).join(d, "document_id").withColumn("name", review.display_name())


def candidates_with_text(fused: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims' and passages' texts, joined once after the candidates are few. Texts meet the candidates first: these are
    known to be small, as joined with claims they aren't, so that Spark can leave the texts where they are."""
    met = passages.select("passage_id", "text").join(fused, "passage_id").join(claims.select("claim_id", "claim"), "claim_id")
    return met.select("passage_id", *[c for c in fused.columns if c != "passage_id"], "claim", "text")


def verdicts(fused: DataFrame, claims: DataFrame, passages: DataFrame, passage_sentences: DataFrame, rerank_k: int = 30, verify_k: int = 10, reranker=None, verifier=None) -> DataFrame:
    """Rerank, verify, resolve evidence. passage_sentences: passage_id, position, sentence_id, text.

    reranker, verifier: models or functions that make them; None for the built-in ones.
    """
    candidates = candidates_with_text(fused, claims, passages)
    ranked = judge.rerank_overlap(candidates, rerank_k) if reranker is None else judge.rerank_model(candidates, reranker, rerank_k)
    some = ranked.filter(F.col("rerank_rank") <= verify_k)
    texts = judge.numbered_sentences(passage_sentences.join(some.select("passage_id").distinct(), "passage_id", "left_semi"))
    shown = some.join(texts, "passage_id")
    judged = judge.verify_rule(shown, verify_k) if verifier is None else judge.verify_model(shown, verifier, verify_k)
    chosen = judge.evidence(F.col("verdict.evidence_tags"), F.col("tags"))
    return judged.withColumn("evidence", chosen).withColumn("shown", judge.evidence_or_all(chosen, F.col("sentence_ids")))


def _named(registry: dict, name: str, what: str):
    if name not in registry:
        raise CorpusError(f"no {what} is registered as {name}; pass one")
    return registry[name]


def verify_claims(
    corpus: Corpus,
    claims: DataFrame,
    candidate_k: int = 100,
    rerank_k: int = 30,
    verify_k: int = 10,
    allow_stale: bool = True,
    embedder: dense.Embedder | None = None,
    reranker=None,
    verifier=None,
    progress: Callable[[str], None] = silent,
) -> tuple[str, str | None, DataFrame]:
    """Run the whole chain and write the audit. Gives the batch's run, a warning if the index is stale, and the verdicts.

    claims: claim_id, claim. Models are those that the corpus names, unless given: an embedder, and a reranker and a
    verifier, each a model or a function that makes one in each task (judge.use says who closes it). A failure is written
    to the audit and raised again.
    """
    check_depths(candidate_k=candidate_k, rerank_k=rerank_k, verify_k=verify_k)
    if claims.filter("claim IS NULL OR trim(claim) = ''").take(1):
        raise ValueError("a claim is empty")
    lexical.require_terms(claims)
    warning = corpus.stale_warning()
    if warning and not allow_stale:
        raise CorpusError(warning)
    cfg = corpus.config
    embedder = embedder or corpus.embedder()
    names = [embedder.name, getattr(reranker, "name", None) or cfg.reranker_model, getattr(verifier, "name", None) or cfg.verifier_model]
    reranker = reranker if reranker is not None else _named(RERANKERS, cfg.reranker_model, "reranker")
    verifier = verifier if verifier is not None else _named(VERIFIERS, cfg.verifier_model, "verifier")
    index, vectors = corpus.index(embedder)
    corpus.touch()
    run, at = uuid.uuid4().hex[:12], F.current_timestamp()
    conf = json.dumps({"candidate_k": candidate_k, "rerank_k": rerank_k, "verify_k": verify_k, "prompt_version": 1})
    models = [F.lit(n).alias(c) for n, c in zip(names, ("embedding_model", "reranker_model", "verifier_model"))]
    base = claims.select(F.concat(F.lit(f"{run}-"), F.col("claim_id").cast("string")).alias("run_id"), "claim_id", "claim", *models, F.lit(conf).alias("configuration"), F.lit(warning).cast("string").alias("warning"))

    def event(status: str, error: str | None = None) -> None:
        corpus.append("verification_runs", f"{run}-{status}", base.withColumns({"status": F.lit(status), "error_message": F.lit(error).cast("string"), "at": at}))

    event("running")
    try:
        passages = corpus.table("passages").select(F.col("display_id").alias("passage_id"), F.col("source_text").alias("text"))
        progress("searching")
        path = f"{corpus.root}/verdicts/run={run}"
        hybrid(index, vectors, claims, embedder, candidate_k).write.parquet(f"{path}/fused")
        fused = corpus.spark.read.parquet(f"{path}/fused")
        parts = corpus.table("passage_sentences").select(F.col("passage").alias("passage_id"), "position", F.col("sentence").alias("sentence_id"))
        parts = parts.join(corpus.table("sentences").select(F.col("display_id").alias("sentence_id"), F.col("source_text").alias("text")), "sentence_id")
        progress("judging")
        verdicts(fused, claims, passages, parts, rerank_k, verify_k, reranker, verifier).write.parquet(f"{path}/judged")
        judged = corpus.spark.read.parquet(f"{path}/judged")
        run_id = F.concat(F.lit(f"{run}-"), F.col("claim_id").cast("string")).alias("run_id")
        told = judged.select("claim_id", "passage_id", "rerank_rank", "rerank_score", "rerank_logit", F.col("verdict.label").alias("verifier_label"), F.col("verdict.reason").alias("verifier_reason"), F.col("verdict.raw_output").alias("verifier_raw_output"), F.col("verdict.parse_success").alias("verifier_parse_success"))
        corpus.append("verification_candidates", run, fused.join(told, ["claim_id", "passage_id"], "left").withColumn("run_id", run_id))
        corpus.append("verification_evidence", run, judged.select(run_id, "passage_id", F.posexplode("evidence").alias("position", "sentence_id")).withColumn("position", F.col("position").cast("long") + 1))
    except Exception as e:
        event("failed", str(e)[:2000])
        raise
    event("completed")
    progress("done")
    return run, warning, judged
