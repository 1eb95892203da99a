"""A corpus from files to verdicts: models, failures, duplicates, commands, cleanup."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.operators import dense
from evidentia.plans import chain, cleanup, verify
from evidentia.plans.corpus import Corpus, CorpusError, DuplicateDocument
from evidentia.queries import fixtures
from evidentia.sources import readers

TEXTS = {"a": "The red fox crossed the frozen river at night. Nobody saw it there but two hunters.", "b": "Green turtles swim far out in the warm sea all year. They come back to the beach."}


class Letters:
    """An embedder without a plan of its own: counts of letters."""

    name = "letters"

    def encode(self, texts):
        return np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], float)


class Last:
    """A reranker that likes later passages, and a verifier that supports everything."""

    name = "last"

    def __init__(self, log=None):
        self.log = log

    def rerank(self, claim, passages):
        return [(0.1 * (i + 1), float(i)) for i in range(len(passages))]

    def verify(self, claim, numbered):
        return '{"label": "PARTIAL_SUPPORT", "evidence": ["S1", "S1", "S77"], "reason": "made up"}'

    def close(self):
        if self.log:
            with open(self.log, "a") as f:
                f.write("closed\\n")


class Broken(Last):
    def verify(self, claim, numbered):
        raise RuntimeError("the model broke")


def write(folder, texts, suffix=".txt"):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}{suffix}").write_text(text)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    write(root / "files", TEXTS)
    c = Corpus.create(spark, f"file://{root}/one")
    c.ingest(readers.files(spark, f"file://{root}/files", "*.txt"), given={"journal": "Journal of Foxes", "authors": ["A", "B"]})
    c.rebuild_index(Letters())
    return c


def claims(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "claim_id bigint, claim string")


def test_given_models_are_used_and_owned(spark, corpus, tmp_path):
    log, said = str(tmp_path / "log"), []
    run, warning, judged = verify.verify_claims(corpus, claims(spark, "a red fox", "turtles"), embedder=Letters(), reranker=Last(log), verifier=lambda: Last(log), progress=said.append)
    rows = judged.orderBy("claim_id", "rerank_rank").collect()
    assert warning is None and len(rows) == 4 and {r["verdict"]["label"] for r in rows} == {"PARTIAL_SUPPORT"}
    assert rows[0]["rerank_score"] == 0.2 and all(len(r["evidence"]) == 2 for r in rows)
    assert "closed" in open(log).read() and said == ["searching", "judging", "done"]
    runs = corpus.table("verification_runs").filter(F.col("run_id").startswith(run)).collect()
    assert {(r["embedding_model"], r["reranker_model"], r["status"]) for r in runs} == {("letters", "last", "running"), ("letters", "last", "completed")}


def test_a_failing_model_marks_the_run(spark, corpus):
    with pytest.raises(Exception, match="the model broke"):
        verify.verify_claims(corpus, claims(spark, "a red fox"), embedder=Letters(), reranker=Last(), verifier=Broken())
    last = corpus.table("verification_runs").filter("status = 'failed'").collect()
    assert len(last) == 1 and "the model broke" in last[0]["error_message"]


def test_what_cannot_be_asked(spark, corpus):
    with pytest.raises(CorpusError, match="letters"):
        verify.verify_claims(corpus, claims(spark, "a red fox"))
    with pytest.raises(ValueError, match="without a term"):
        verify.verify_claims(corpus, claims(spark, "fox", "?!"), embedder=Letters())
    with pytest.raises(ValueError, match="empty"):
        verify.verify_claims(corpus, claims(spark, " "), embedder=Letters())

    class Wrong(Letters):
        def encode(self, texts):
            return super().encode(texts)[:, :5]

    with pytest.raises(Exception, match="numbers"):
        verify.verify_claims(corpus, claims(spark, "a red fox"), embedder=Wrong())


def test_documents_and_bytes(spark, corpus):
    docs = {r["filename"]: r for r in corpus.table("documents").collect()}
    assert set(docs) == {"a.txt", "b.txt"} and docs["a.txt"]["journal"] == "Journal of Foxes" and docs["a.txt"]["authors"] == ["A", "B"]
    assert corpus.source(docs["a.txt"]["sha256"]) == TEXTS["a"].encode() and docs["a.txt"]["stored_path"].endswith(".txt")
    assert corpus.manifest()["dimension"] == 26 and corpus.manifest()["content_types"] == ["body"]
    with pytest.raises(DuplicateDocument) as e:
        corpus.require_new(readers.from_texts(spark.createDataFrame([("x", TEXTS["b"])], "id string, t string"), "id", "t"))
    assert e.value.document["filename"] == "b.txt"
    with pytest.raises(ValueError, match="unknown metadata"):
        corpus.ingest(corpus.table("documents"), given={"colour": "red"})
    records = verify.passage_records(corpus.table("passages"), corpus.table("pages"), corpus.table("documents")).collect()
    assert {(r["name"], r["page_number"]) for r in records} == {("a.txt", 1), ("b.txt", 1)}


def test_embedder_without_spark_equals_its_plan(spark):
    texts = ["The Red fox, été", "", "123 fox fox"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    e = dense.HashedWords()
    got = {r["id"]: r["embedding"] for r in e.rows(df, "k", "t").collect()}
    for k, row in enumerate(e.encode(texts)):
        assert np.allclose(got.get(k, [0.0] * dense.DIMENSIONS), row)


def test_two_writers(spark, tmp_path):
    a, b = Corpus.create(spark, f"file://{tmp_path}/c"), Corpus.open(spark, f"file://{tmp_path}/c")
    with pytest.raises(CorpusError, match="another writer"):
        a._set(lambda _: b.touch() or {"index_status": "ready"})
    assert a.state["index_status"] == "empty"
    for _ in range(25):
        a.touch()
    assert len(a._numbers()) <= 21
    newest = a._numbers()[0]
    (tmp_path / "c" / "state" / f"{newest + 1:010d}.json").write_text('{"index_st')  # a writer that was cut off
    assert a.state["index_status"] == "empty"
    a.touch()
    assert a._numbers()[0] == newest + 2


def test_commands(spark, tmp_path):
    said = []
    run = lambda *argv, ask=None: cli.run(cli.parser().parse_args([str(x) for x in argv]), spark, ask, said.append)
    write(tmp_path / "in", TEXTS)
    root = tmp_path / "corpora" / "one"
    assert run("init-db", root) == 0
    assert run("add-directory", root, tmp_path / "in", "--decoder", "text", "--pattern", "*.txt", "--rebuild", "--title", "Both") == 0
    assert "2 added" in said[-2] and said[-1] == "2 passages indexed"
    assert run("add-pdf", root, tmp_path / "in" / "a.txt", "--decoder", "text") == 1 and "DuplicateDocument" in said[-1]
    write(tmp_path / "in", {"c": TEXTS["a"]})
    assert run("add-pdf", root, tmp_path / "in" / "c.txt", "--decoder", "text", ask=lambda _: "r") == 0 and "1 replaced" in said[-1]
    assert run("verify-claim", root, "the red fox crossed the river", "--verbose") == 0
    assert "DIRECT_SUPPORT" in said[-1] and "fox crossed" in said[-1] and "dense 1" in said[-1]
    sid = Corpus.open(spark, cli._uri(str(root))).table("sentences").orderBy("display_id").first()["display_id"]
    assert run("show-sentences", root, sid, "--context", "1") == 0 and said[-1].startswith("page 1 of")
    assert run("build-files", tmp_path / "in", tmp_path / "out", "--decoder", "text", "--pattern", "*.txt") == 0 and said[-1].startswith("3 documents")
    assert run("cleanup-databases", "--root", tmp_path / "corpora", root) == 0 and "preview" in said[-1] and root.exists()
    assert run("cleanup-databases", "--root", tmp_path / "corpora", root, tmp_path / "in", "--apply") == 2 and root.exists()
    assert run("cleanup-databases", "--root", tmp_path / "corpora", root, "--apply") == 0 and "deleted" in said[-1] and not root.exists()


def test_cleanup_by_age_keeps_what_is_used(spark, tmp_path):
    c = Corpus.create(spark, f"file://{tmp_path}/a")
    Corpus.create(spark, f"file://{tmp_path}/b")
    c._set(lambda _: {"last_accessed_at": "2020-01-01T00:00:00+00:00"})
    assert cleanup.size(spark, f"file://{tmp_path}/a") > 0
    done = cleanup.cleanup(spark, f"file://{tmp_path}", unused_for=30, apply=True).collect()
    assert [r["outcome"] for r in done] == ["deleted"] and not (tmp_path / "a").exists() and (tmp_path / "b").exists()
    outside = cleanup.cleanup(spark, f"file://{tmp_path}/b", [f"file://{tmp_path}/b"], apply=True).collect()
    assert [r["outcome"] for r in outside] == ["invalid"] and (tmp_path / "b").exists()
    with pytest.raises(ValueError):
        cleanup.cleanup(spark, f"file://{tmp_path}")


def test_files(spark, tmp_path):
    write(tmp_path, {"a": "x"}, ".PDF")
    assert readers.one_file(spark, str(tmp_path / "a.PDF")).first()["filename"] == "a.PDF"
    with pytest.raises(FileNotFoundError):
        readers.one_file(spark, str(tmp_path / "b.pdf"))
    with pytest.raises(ValueError):
        readers.one_file(spark, str(tmp_path / "b.txt"))
    assert readers.in_folder(str(tmp_path), "a.PDF").endswith("/a.PDF")
    with pytest.raises(FileNotFoundError):
        readers.in_folder(str(tmp_path), "b.PDF")


def test_chain_reads_words(spark, tmp_path):
    sources = readers.from_texts(spark.createDataFrame([("p", fixtures.paged_document()), ("q", "{")], "id string, t string"), "id", "t")
    assert chain.build_files(sources, f"file://{tmp_path}/out", readers.JsonDecoder) == "1 documents, 6 sentences, 4 passages, 2 to be searched"
    assert spark.read.json(f"file://{tmp_path}/out/errors").count() == 1


def test_main_tells_errors(spark, tmp_path, capsys):
    assert cli.main(["rebuild-index", str(tmp_path / "none")]) == 2 and "no corpus" in capsys.readouterr().err
    assert cli.main(["cleanup-databases", "--root", str(tmp_path)]) == 2
    assert sys.stdin is not None
