"""Streams: ingestion without repeats, numbers across micro-batches, last access."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import report
from evidentia.plans.corpus import Corpus
from evidentia.sources import readers
from evidentia.streaming import live


def test_ingest_stream_takes_each_content_once(spark, tmp_path):
    rows = readers.from_texts(spark.createDataFrame([("a", "A text of some eight words about red foxes."), ("b", "A text of some eight words about red foxes."), ("c", "Another one.")], "id string, t string"), "id", "t")
    rows.write.parquet(str(tmp_path / "in"))
    corpus = Corpus.create(spark, f"file://{tmp_path}/corpus")
    for _ in range(2):  # started again it finds nothing new
        live.ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), corpus, str(tmp_path / "check")).awaitTermination(120)
    assert corpus.table("documents").count() == 2 and len(corpus.state["batches"]) == 1


@pytest.fixture
def one_part(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_numbers_go_on_across_batches(spark, tmp_path, one_part):
    schema = "document_id string, page_index bigint, sentences bigint"
    batches = [[("a", 0, 3), ("b", 0, 1), ("a", 1, 2)], [("b", 1, 4), ("a", 2, 5)]]
    out = str(tmp_path / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = live.number_pages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        got.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 0, 0), ("a", 1, 3), ("a", 2, 5), ("b", 0, 0), ("b", 1, 1)]


def test_last_access_feeds_retention(spark):
    events = spark.sql("SELECT 'r' AS root, timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT 'r', timestamp'2024-01-05 00:00:00' UNION ALL SELECT 's', timestamp'2024-01-30 00:00:00'")
    got = report.inactive(live.last_access(events).withColumn("valid", F.lit(True)), 20, F.to_timestamp(F.lit("2024-01-31T00:00:00+00:00"))).collect()
    assert [(r["root"], r["last_accessed_at"], r["status"]) for r in got] == [("r", "2024-01-05T00:00:00+00:00", "ready")]
