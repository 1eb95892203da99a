import sqlite3

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.operators import chunk, dense, judge, lexical, review
from evidentia.plans import verify
from evidentia.plans.corpus import Corpus, CorpusError
from evidentia.queries import documents as queries
from evidentia.sources import readers


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=30), st.integers(1, 200), st.integers(0, 3))
def test_passages_cover_all_sentences(counts, most, overlap):
    got = chunk.spans(counts, most, overlap)
    assert {i for a, b in got for i in range(a, b)} == set(range(len(counts)))
    for a, b in got:
        assert b == a + 1 or sum(counts[a:b]) <= most
    for (a, b), (c, _) in zip(got, got[1:]):
        assert a < c and b - c <= overlap


def test_passage_fixtures():
    assert chunk.spans([100, 100, 100], 180, 1) == [(0, 1), (1, 2), (2, 3)]
    assert chunk.spans([90, 80, 150], 180, 1) == [(0, 2), (1, 2), (2, 3)]
    assert chunk.spans([200, 10], 180, 1) == [(0, 1), (1, 2)]
    with pytest.raises(ValueError):
        chunk.check(0, 1)


def test_bm25_equals_sqlite(spark):
    texts = ["alpha beta gamma", "alpha alpha delta epsilon zeta", "beta beta beta", "éclair naïve test foo", "omega"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize = 'unicode61 remove_diacritics 1')")
    con.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts, 1)))
    want = dict(con.execute("select rowid, bm25(f) from f where f match 'alpha OR gamma OR beta OR eclair'").fetchall())
    p = spark.createDataFrame(list(enumerate(texts, 1)), "passage_id bigint, text string")
    c = spark.createDataFrame([(1, "alpha gamma beta Éclair")], "claim_id bigint, claim string")
    got = {r["passage_id"]: r["bm25_score"] for r in lexical.search(lexical.build(p), c, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_terms_that_fold_alike_count_twice(spark):
    c = spark.createDataFrame([(1, "êré éré")], "claim_id bigint, claim string")
    assert [(r["term"], r["times"]) for r in lexical.claim_terms(c).collect()] == [("ere", 2)]
    assert [(r["term"], r["times"]) for r in lexical.claim_terms(c, fold_first=True).collect()] == [("ere", 1)]


def test_zero_vector_stays_zero(spark):
    got = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(dense.normalize(F.col("v")).alias("u")).collect()
    assert [list(r["u"]) for r in got] == [[0.0, 0.0], [0.6, 0.8]]


def test_depths_are_checked(spark):
    with pytest.raises(ValueError):
        verify.check_depths(candidate_k=0)
    with pytest.raises(ValueError):
        lexical.search(None, None, 0)


def test_missing_sentences_fail_the_whole_request(spark):
    s = spark.createDataFrame([("a",), ("b",)], "display_id string")
    asked = spark.createDataFrame([(["b", "b", "x"],)], "ids array<string>")
    assert [r["display_id"] for r in review.in_request_order(asked, s, "display_id").collect()] == ["b"]
    with pytest.raises(review.MissingRows):
        review.require_all(asked, s, "display_id")


class Fixed:
    name = "fixed"
    closed = 0

    def rerank(self, claim, passages):
        return [(1 / (i + 1), -float(i)) for i in range(len(passages))]

    def verify(self, claim, numbered):
        return '{"label": "DIRECT_SUPPORT", "evidence": ["S1"], "reason": "x"}'

    def close(self):
        pass


def test_models_see_only_the_best(spark):
    rows = [(1, "c", k, f"t{k}", k) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "claim_id bigint, claim string, passage_id bigint, text string, fusion_rank bigint")
    got = judge.rerank_model(df, Fixed, 3)
    assert got.count() == 3
    v = judge.verify_model(got.withColumn("numbered", F.lit("[S1] a")), Fixed, 2).select("verdict.label").collect()
    assert [r[0] for r in v] == ["DIRECT_SUPPORT"] * 2


def test_corpus_from_sources_to_audit(spark, tmp_path):
    c = Corpus.create(spark, str(tmp_path / "corpus"))
    text = "The red fox jumps over the lazy dog near the river. It was seen by nine people on Monday.\nSecond block with eight words is right here now.\nReferences Foo"
    src = spark.createDataFrame([(1, text), (2, "Another document about green turtles that swim in the warm sea."), (3, text)], "id int, t string")
    sources = readers.from_texts(src, "id", "t")
    bad = spark.createDataFrame([("table/9", "9", 1, "ff", bytearray(b"\xff"))], "source_path string, filename string, byte_size bigint, sha256 string, content binary")
    status = {r["source_path"]: r["status"] for r in c.ingest(sources.union(bad), "discard").collect()}
    assert sorted(status.values()) == ["added", "added", "discarded", "failed"]
    assert c.table("documents").count() == 2 and c.table("ingestion_errors").count() == 1
    assert c.state["index_status"] == "empty"
    claims = spark.createDataFrame([(1, "The red fox jumps over the lazy dog")], "claim_id bigint, claim string")
    with pytest.raises(CorpusError):
        verify.verify_claims(c, claims)
    assert c.rebuild_index() > 0 and c.state["index_status"] == "ready"
    run, warning, judged = verify.verify_claims(c, claims)
    best = judged.orderBy("rerank_rank").first()
    assert warning is None and best["verdict"]["label"] == "DIRECT_SUPPORT" and best["evidence"]
    assert {r["status"] for r in c.table("verification_runs").collect()} == {"running", "completed"}
    assert c.table("verification_candidates").count() >= judged.count() and c.table("verification_evidence").count() > 0
    more = readers.from_texts(spark.createDataFrame([(4, "A later document of more than eight words about the red fox.")], "id int, t string"), "id", "t")
    c.ingest(more, "discard")
    assert c.state["index_status"] == "rebuild_required" and c.stale_warning()
    with pytest.raises(CorpusError):
        verify.verify_claims(c, claims, allow_stale=False)
    again = [r["status"] for r in c.ingest(more, "replace").collect()]
    assert again == ["replaced"] and c.table("documents").count() == 3 and c.state["index_status"] == "rebuild_required"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\nno json\n{"id": 2}\n')
    with pytest.raises(readers.BadLine, match="line 3"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int")
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int", strict=False).count() == 2
    assert readers.json_lines_or_empty(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, seq int")
    assert readers.last_by_id(rows, "id", "seq").first()["v"] == "b"


def test_top_k_plan_is_bounded(spark):
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "passage_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "claim_id bigint, embedding array<double>")
    plan = dense.search(e, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dense_ties_end_at_the_id(spark):
    """Equal vectors give k rows a query, those with the smallest ids, whatever their batches."""
    e = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40, 0, -1)], "passage_id bigint, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "claim_id bigint, embedding array<double>")
    got = sorted((r["claim_id"], r["dense_rank"], r["passage_id"]) for r in dense.search(e, q, 3).collect())
    assert got == [(c, k, k) for c in (1, 2) for k in (1, 2, 3)]
    assert dense.search(e, q.filter("claim_id > 5"), 3).count() == 0 and dense.search(e.filter("passage_id > 99"), q, 3).count() == 0
    with pytest.raises(Exception, match="numbers"):
        dense.search(e, q.withColumn("embedding", F.array(F.lit(1.0))), 3).count()


def test_vectors_are_checked():
    assert dense.checked([[3.0, 4.0], [0.0, 0.0]], 2).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    for bad, n, size in (([[1.0]], 2, None), ([1.0], 1, None), ([[float("nan")]], 1, None), ([[1.0]], 1, 2)):
        with pytest.raises(dense.BadVectors):
            dense.checked(bad, n, size)


def test_written_index_equals_plans(spark, tmp_path):
    texts = [(1, "alpha beta alpha"), (2, ""), (3, None), (4, "Beta gamma"), (5, "--")]
    p = spark.createDataFrame(texts, "passage_id bigint, text string")
    a, b = lexical.build(p), lexical.write(p, str(tmp_path / "index"))
    for x, y in ((a.postings, b.postings), (a.term_stats, b.term_stats), (a.stats, b.stats)):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))
    with pytest.raises(lexical.NoTerms):
        lexical.require_terms(spark.createDataFrame([(1, "a"), (2, "?!")], "claim_id bigint, claim string"))


def test_two_classes_and_devices():
    p, d = judge.two_class(-1.0, 1.0)
    assert abs(p - 0.880797) < 1e-6 and d == 2.0 and abs(judge.two_class(1000.0, -1000.0)[0]) < 1e-9
    judge.require_device("cpu")
    with pytest.raises(RuntimeError):
        judge.require_device("cuda:0")


def test_sentences_are_reranked_with_their_context(spark):
    parts = spark.createDataFrame([("p", k, f"s{k}", t) for k, t in enumerate(["The fox ran.", "It was red.", "Nobody saw it."])], "passage_id string, position bigint, sentence_id string, text string")
    some = parts.selectExpr("1L AS claim_id", "'red fox' AS claim", "sentence_id", "text", "passage_id", "1L AS passage_rank", "position")
    plain = review.rerank_sentences(some, parts, k=2).orderBy("rerank_rank").collect()
    assert [r["sentence_id"] for r in plain] == ["s0", "s1"] and [r["rerank_score"] for r in plain] == [0.5, 0.5]
    wide = review.rerank_sentences(some, parts, k=3, context=1).orderBy("rerank_rank").collect()
    assert [(r["sentence_id"], r["rerank_score"]) for r in wide] == [("s0", 1.0), ("s1", 1.0), ("s2", 0.5)] and wide[0]["context"] == "The fox ran. It was red."
    model = review.rerank_sentences(some, parts, Fixed, k=1).collect()
    assert [(r["sentence_id"], r["rerank_logit"]) for r in model] == [("s0", 0.0)]


def test_stream_windows(spark, tmp_path):
    from evidentia.streaming import live

    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a', 2.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(stream, "ts", "kind").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["n"] for r in spark.table("win").collect()] == [1]


def test_recall_counts_short_claims(spark, tmp_path):
    """Claims of no term to six terms, some cut within words, against the oracle."""
    from tests.compare import rows

    docs = [(1, "Alpha beta gamma delta epsilon zeta eta theta."), (2, "alphabet soup, beta gamma -- delta!"), (3, ""), (4, None), (5, "beta gamma beta gamma"), (6, "¿? -- ... Ärger über Öl")]
    claims = ["", "--", "...", "a", "beta", "beta gamma", "gamma delta epsilon", "lpha beta gamma delt", "beta gamma delta epsilon", "beta gamma delta epsilon zet", "pha beta gamma delta epsilon zeta et", "Ärger über", "nowhere", None]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(claims)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE["recall_at_k"])
    got = queries.recall_at_k(spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(rel.columns, rel.fetchall())
    pairs = {(c, k) for k, t in docs for c, x in enumerate(claims) if t is not None and x is not None and x in t}
    got = queries.verbatim(queries.claims(spark, str(tmp_path)), queries.documents(spark, str(tmp_path))).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs


def test_sentence_candidates_reach_thirty_fused_passages(spark):
    """The registered query gives all sentences of all thirty passages, by brute force over the fused ranks."""
    d = "/root/testdata/sf0.001"
    top = queries.fused(spark, d).filter("fusion_rank <= 30").select("claim_id", "passage_id", "fusion_rank").collect()
    of: dict = {}
    for r in queries.sentences(spark, d).collect():
        of.setdefault(r["document_id"], []).append(r["source_text"])
    want: dict = {}
    for r in top:
        for t in of.get(r["passage_id"], []):
            key = (r["claim_id"], t)
            want[key] = min(want.get(key, (99, 0)), (r["fusion_rank"], r["passage_id"]))
    got = queries.QUERIES["sentence_candidates_fused"](spark, d).collect()
    assert max(r["passage_rank"] for r in got) == 30
    assert len(got) == len(want) and {(r["claim_id"], r["sentence"]): (r["passage_rank"], r["passage_id"]) for r in got} == want


def test_search_in_small_blocks_equals_one_by_one(spark, monkeypatch):
    """Blocks, and candidates dropped on the way, change nothing; equal texts tie by id. No pair of claim and passage is shuffled."""
    import math

    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    texts = [(n, " ".join(words[(n * m) % 6] for m in range(1, 2 + n % 5))) for n in range(40)] + [(90, "?"), (91, None), (92, "cd ab"), (93, "cd ab")]
    asked = [(c, " ".join(words[c % 6 : c % 6 + 2])) for c in range(9)] + [(9, "zz"), (10, "!")]
    terms = {p: (t or "").replace("?", "").split() for p, t in texts}
    df, mean = {w: sum(w in t for t in terms.values()) for w in words}, sum(map(len, terms.values())) / len(terms)

    def part(w, t):
        raw = math.log((len(terms) - df[w] + 0.5) / (df[w] + 0.5))
        return -(raw if raw > 0 else 1e-6) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))

    want = set()
    for c, claim in asked:
        found = sorted((round(sum(part(w, t) for w in claim.split() if w in t), 6), p) for p, t in terms.items() if set(t) & set(claim.split()))
        want |= {(c, p, s, r) for r, (s, p) in enumerate(found[:4], 1)}
    for name, n in (("PASSAGE_BLOCK", 3), ("CLAIM_BLOCK", 2), ("HELD", 6)):
        monkeypatch.setattr(lexical, name, n)
    index = lexical.build(spark.createDataFrame(texts, "passage_id bigint, text string").repartition(3))
    got = lexical.search(index, spark.createDataFrame(asked, "claim_id bigint, claim string"), 4)
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "claim_id" in x and "passage_id" in x]
    by_postings = lexical.LexicalIndex(index.postings, index.term_stats, index.stats)
    assert {tuple(r) for r in lexical.search(by_postings, spark.createDataFrame(asked, "claim_id bigint, claim string"), 4).collect()} == want


def test_index_is_built_without_dealing_out_postings(spark):
    p = spark.createDataFrame([(1, "a b a"), (2, None)], "passage_id bigint, text string")
    i = lexical.build(p)
    assert "Exchange" not in i.postings._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in i.postings.collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3)]
    assert sorted((r[0], r[1], list(r[2]), list(r[3])) for r in i.counts.collect()) == [(1, 3, ["a", "b"], [2, 1]), (2, 0, [], [])]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_words_shuffle_counts_once(spark, monkeypatch):
    """Texts of one id count together, those without terms have no row, pieces don't matter."""
    monkeypatch.setattr(dense.tokens, "PIECE", 8)
    texts = [(1, "red fox"), (2, "?"), (1, "fox"), (3, None), (4, "ein Öl"), (5, "fox fox red")]
    got = dense.HashedWords().rows(spark.createDataFrame(texts, "k bigint, t string").repartition(3), "k", "t")
    assert plan(got).count("hashpartitioning") == 1
    found = {r["id"]: r["embedding"] for r in got.collect()}
    assert sorted(found) == [1, 4, 5] and found[1] == found[5]
    assert [found[1], found[4]] == dense.HashedWords().encode(["fox red fox", "ein ol"]).tolist()


def test_candidates_are_tables_and_texts_stay(spark):
    """Searches' candidates are read from a table; only their texts are cut; texts are joined without a shuffle."""
    d = "/root/testdata/sf0.001"
    assert queries.fused(spark, d).inputFiles() == queries.fused(spark, d).inputFiles() and all("fused-" in f for f in queries.fused(spark, d).inputFiles())
    assert all("hits-" in f for f in queries.hits(spark, d).inputFiles())
    for name in ("sentence_candidates", "sentence_candidates_fused", "sentence_rerank"):
        assert "LeftSemi" in plan(queries.QUERIES[name](spark, d))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # less than the documents
    try:
        assert "SortMergeJoin" not in plan(queries.reranked(spark, d))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verbatim_reads_no_text_twice_for_a_match(spark):
    c = spark.createDataFrame([(1, "a b c d e"), (2, "b c")], "claim_id bigint, claim string")
    docs = spark.createDataFrame([(1, "xa b c d e f"), (2, "b c d, b c d"), (3, None)], "doc_id bigint, text string")
    got = queries.verbatim(c, docs)
    assert "hashpartitioning" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (2, 2)]


ODD = ["", "  \t", "One. Two e.g. three.\n\n \nFour et al. [1] Five! 'Six?' A. Seven.[2] Eight\x1f nine", "x" * 12 + ". " + "Ein Satz. " * 1200, "\n".join(f"No. {k} is here. Dr. X. came." for k in range(30)), None, "\x1f", "fig. \n approx. \r Sects. end.\x0b\f  Last"]


def test_sentences_within_rows_equal_those_of_blocks(spark):
    """Whatever the texts, numbering within a document's row gives what windows over its blocks give, without a shuffle."""
    from evidentia.operators import chunk, segment

    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").repartition(2)
    got, want = segment.document_sentences(docs), segment.sentences(segment.blocks(docs))
    assert got.schema.simpleString() == want.schema.simpleString() and "hashpartitioning" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1200
    a, b = chunk.of_blocks(segment.page_blocks(segment.pages(docs)), 20), chunk.passages(want, 20)
    assert "hashpartitioning" not in plan(a)
    assert sorted(map(str, a.drop("parts").collect())) == sorted(map(str, b.collect()))


def test_texts_are_cut_once(spark):
    d = "/root/testdata/sf0.001"
    for name in ("page_context", "passage_context", "numbered_sentences", "render_plan", "classification_report", "passage_summary"):
        p = plan(queries.QUERIES[name](spark, d))
        assert p.count("[.!?…]") <= 1 and p.count("SortMergeJoin") == 0, name
        assert name in ("classification_report", "passage_summary") or "hashpartitioning" not in p, name


def test_ends_tell_abbreviations_in_long_texts(spark):
    from evidentia.operators import segment

    texts = [("word " * 500 + end, want) for end, want in (("et al.", True), ("approx. \t", True), ("A.", True), ("aA.", False), ("Fig.", True), ("end.", False))] + [("A.", True), ("aA.", False), ("", False)]
    df = spark.createDataFrame(texts, "t string, want boolean")
    assert df.filter(segment.looks_like_abbreviation("t") != df["want"]).count() == 0


def test_one_pass_over_headings_equals_two(spark):
    from evidentia.operators import classify

    rows = [(d, p, 5, p, t, True) for d, texts in enumerate([["Body.", "x", "Text. More", "References", "y"], ["a", "b", "c", "Long text goes here. Then. Funding", "z"], ["References", "b", "c", "d", "e"], ["a", "b", "ACKNOWLEDGMENTS: thanks", "Data availability", "t"]]) for p, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "document_id int, page_index bigint, page_count bigint, idx bigint, source_text string, retrieval_eligible boolean")
    want = classify.classify(p, classify.heading_cutoffs(p))
    got = classify.classify_by_headings(p)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.filter("content_type = 'end_matter'").count() == 6
