"""The pipeline's stages on a small table, with what each must drop and keep."""

import corpus_pipeline
from evidentia.llm import simhash


def test_stages(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    junk = spark.createDataFrame([(90001, None, "en", "s", None), (90002, "", "en", "s", 0), (90003, "12 !!", None, None, 5), (90004, "too short", "en", "s", 9)], src.schema)
    copy = src.filter("doc_id = 1")
    docs = src.union(junk).union(copy)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        ids = [r[0] for r in docs.select("doc_id").collect()]
        if k < 3:
            assert docs.columns == columns
            same = [c for c in columns if c != "lang" or name != "language_id"]
            assert docs.join(before, same, "left_anti").count() <= before.filter("source IS NULL OR lang IS NULL").count()
        if name == "language_id":
            assert not {90001, 90002, 90003} & set(ids)
        if name == "quality_rules":
            assert 90004 not in ids
        if name == "near_dedup":
            groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(before, words=5, similarity=0.8).collect()}
            assert sorted(ids) == sorted({c for c in groups.values()})
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} <= {r[0] for r in src.select("doc_id").collect()}


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
