"""Weighted reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DENSE_WEIGHT, BM25_WEIGHT, RRF_K = 2.0, 1.0, 60.0


def fuse(dense: DataFrame, lexical: DataFrame, dense_weight: float = DENSE_WEIGHT, bm25_weight: float = BM25_WEIGHT, rrf_k: float = RRF_K) -> DataFrame:
    """Candidates of both sides with their ranks (null: not retrieved) and the fused rank.

    Ties keep the order in which candidates came: dense first, then lexical.
    """
    both = dense.join(lexical, ["claim_id", "passage_id"], "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("fusion_score", F.round(part(dense_weight, "dense_rank") + part(bm25_weight, "bm25_rank"), 9))
    w = Window.partitionBy("claim_id").orderBy(F.desc("fusion_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "passage_id")
    return scored.withColumn("fusion_rank", F.row_number().over(w).cast("long"))
