"""Corpora on disk: finding them, their size, and deleting those that nobody uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import report
from evidentia.plans.corpus import Corpus, CorpusError

SCHEMA = "root string, last_accessed_at string, valid boolean, bytes bigint"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def size(spark: SparkSession, root: str) -> int:
    """Bytes of all files below a folder, as the store tells them; links aren't followed."""
    at, fs = _fs(spark, root)
    return fs.getContentSummary(at).getLength()


def described(spark: SparkSession, roots: list[str]) -> DataFrame:
    """root, last_accessed_at, valid (it holds a corpus), bytes; sorted by path."""
    rows = []
    for root in sorted(set(roots)):
        try:
            state = Corpus.open(spark, root).state
            rows.append((root, state.get("last_accessed_at"), True, size(spark, root)))
        except CorpusError:
            rows.append((root, None, False, None))
    return spark.createDataFrame(rows, SCHEMA)


def below(spark: SparkSession, scan_root: str) -> list[str]:
    """The corpora right below a folder."""
    at, fs = _fs(spark, scan_root)
    found = [f.getPath().toString() for f in fs.listStatus(at) if f.isDirectory()]
    return sorted(p for p in found if Corpus(spark, p)._newest()[1] is not None)


def _inside(path: str, root: str) -> bool:
    clean = lambda p: p.split(":", 1)[-1].replace("//", "/").rstrip("/")
    return clean(path).startswith(clean(root) + "/") and ".." not in path.split("/")


def cleanup(spark: SparkSession, scan_root: str, roots: list[str] | None = None, unused_for: int | None = None, apply: bool = False) -> DataFrame:
    """root, status, outcome, bytes of the named corpora, or of those unused for so many days. Nothing is deleted without
    apply, and nothing at all if one target isn't a corpus below scan_root."""
    if (roots is None) == (unused_for is None):
        raise ValueError("name corpora, or a number of days, not both")
    if roots is None:
        targets = report.inactive(described(spark, below(spark, scan_root)), unused_for)
    else:
        inside = F.array(*[F.lit(r) for r in roots if _inside(r, scan_root)]).cast("array<string>")
        targets = described(spark, roots).withColumn("status", F.when(F.col("valid") & F.array_contains(inside, F.col("root")), "ready").otherwise("invalid"))
    rows = report.cleanup_outcomes(targets, apply).select("root", "status", "outcome", "bytes").orderBy("root").collect()  # a row per corpus
    for r in rows:
        if r["outcome"] == "deleted":
            at, fs = _fs(spark, r["root"])
            fs.delete(at, True)
    return spark.createDataFrame(rows, "root string, status string, outcome string, bytes bigint")
