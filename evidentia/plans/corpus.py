"""A corpus: a folder of tables, a configuration, numbered states, and versions of its index that a state points to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import chunk, classify, dense, geometry, lexical, segment
from evidentia.plans import ingest
from evidentia.schemas import TABLES
from evidentia.sources import readers


class CorpusError(Exception):
    """A corpus can't do what was asked."""


class DuplicateDocument(CorpusError):
    """The corpus has this content already; document is the row it has."""

    def __init__(self, document: dict):
        super().__init__(f"the corpus has this content already, as {document.get('filename')}: {document.get('sha256')}")
        self.document = document


@dataclass
class Config:
    embedding_model: str = "hashed-words"
    reranker_model: str = "overlap"
    verifier_model: str = "rule"
    max_words: int = chunk.MAX_WORDS
    overlap_sentences: int = chunk.OVERLAP


#: Embedders by name, for corpora that name theirs. Callers may add their own, or pass one.
EMBEDDERS: dict[str, Callable[[], dense.Embedder]] = {"hashed-words": dense.HashedWords}
#: States kept behind the newest one.
KEPT_STATES = 20


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def silent(message: str) -> None:
    """Progress that nobody sees."""


class Corpus:
    """Tables are appended to in batches; a batch counts once a state names it.

    States are numbered files that are only ever created, so a crash leaves the last whole one, and of two writers that
    begin from the same state one is refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files through Hadoop's interface, so that any store will do
    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, value: dict) -> None:
        path, fs = self._at(name)
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise CorpusError(f"another writer changed {self.root} meanwhile; try again") from e
            raise
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def _read(self, name: str) -> dict | None:
        path, fs = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:  # the writer didn't get to its end
            return None

    def _numbers(self) -> list[int]:
        path, fs = self._at("state")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)

    def _newest(self) -> tuple[int, dict | None]:
        numbers = self._numbers()
        for n in numbers:
            state = self._read(f"state/{n:010d}.json")
            if state is not None:
                return numbers[0], state
        return (numbers[0] if numbers else -1), None

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Corpus:
        """Make a corpus, or open it: nothing that is there is overwritten."""
        c = cls(spark, root)
        last, state = c._newest()
        if state is None:
            c._create(f"state/{last + 1:010d}.json", {"index_status": "empty", "indexed_passages": 0, "index": None, "batches": [], "audit": {}, "replaced": False, "last_indexed_at": None, "last_accessed_at": now()})
        if c._read("config.json") is None:
            c._create("config.json", asdict(Config()))
        return c

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Corpus:
        c = cls(spark, root)
        if c._newest()[1] is None:
            raise CorpusError(f"no corpus at {root}")
        return c

    @property
    def state(self) -> dict:
        state = self._newest()[1]
        if state is None:
            raise CorpusError(f"no corpus at {self.root}")
        return state

    @property
    def config(self) -> Config:
        return Config(**self._read("config.json"))

    def _set(self, change: Callable[[dict], dict]) -> None:
        last, state = self._newest()
        self._create(f"state/{last + 1:010d}.json", state | change(state))
        for n in self._numbers()[KEPT_STATES:]:
            path, fs = self._at(f"state/{n:010d}.json")
            fs.delete(path, False)

    def touch(self) -> None:
        self._set(lambda _: {"last_accessed_at": now()})

    def mark_rebuild_required(self) -> None:
        self._set(_stale)

    def table(self, name: str) -> DataFrame:
        """All published batches of a table. Of documents that were replaced the last version counts."""
        state = self.state
        batches = state["audit"].get(name, []) if name.startswith("verification_") else state["batches"]
        if not batches:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{name}/batch={b}" for b in batches])
        if name != "documents" or not state["replaced"]:
            return rows
        return rows.groupBy("document_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("d")).select("d.*")

    def _write(self, name: str, batch: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        path = f"{self.root}/{name}/batch={batch}"
        df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]).write.parquet(path)
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def append(self, name: str, batch: str, df: DataFrame) -> None:
        """Add a batch to an audit table."""
        self._write(name, batch, df)
        self._set(lambda s: {"audit": s["audit"] | {name: [*s["audit"].get(name, []), batch]}})

    def source(self, sha256: str) -> bytes:
        """The stored bytes of a document."""
        found = self.table("sources").filter(F.col("sha256") == sha256).select("content").first()
        if found is None:
            raise CorpusError(f"no source {sha256}")
        return bytes(found[0])

    def require_new(self, sources: DataFrame) -> None:
        """Raise DuplicateDocument with the row the corpus has, if it has one of these contents."""
        have = self.table("documents").join(sources.select("sha256").distinct(), "sha256", "left_semi").orderBy("source_path").limit(1).collect()
        if have:
            raise DuplicateDocument(have[0].asDict(recursive=True))

    def ingest(self, sources: DataFrame, policy: str = "ask", make_decoder=readers.TextDecoder, given: dict | None = None, progress: Callable[[str], None] = silent) -> DataFrame:
        """Extract, segment, chunk and classify new sources. Gives each source's status; failures don't stop the others.

        Equal contents in a batch are one document, that of the smallest path. Replaced documents take path, name, size
        and given metadata from the last of their sources; they keep their text and don't make the index stale.
        """
        if policy not in ingest.POLICIES:
            raise ValueError(f"unknown duplicate policy: {policy}")
        extra = ingest.overrides(given)
        batch, at = uuid.uuid4().hex[:12], F.lit(now()).cast("timestamp")
        work = f"{self.root}/work/batch={batch}"

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{work}/{name}")
            return self.spark.read.parquet(f"{work}/{name}")

        known = self.table("documents")
        named = save(sources.select("source_path", "filename", "byte_size", "sha256").distinct(), "named")
        # each new content is decoded once, whatever its copies; the result is saved before anything reads it
        fresh = sources.join(known.select("sha256"), "sha256", "left_anti")
        progress("extracting")
        rows = save(readers.extract_rows(ingest.exact_dedup(fresh)[0].dropDuplicates(["sha256"]), make_decoder), "extracted")
        bad = readers.errors_of(rows)
        told = named.join(bad.select("sha256", "error_type", "error_message"), "sha256", "left")
        status = save(ingest.outcomes(told, known, policy), "outcomes")
        added = status.filter("status = 'added'").select("source_path", "sha256")
        pages = readers.pages_of(rows)
        version = len(self.state["batches"])

        suffix = F.regexp_extract("filename", r"(\.[^.]*)$", 1)
        per = rows.filter("error_type IS NULL").groupBy("sha256").agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.max_by("metadata", F.col("metadata").isNotNull()).alias("metadata"))
        new = named.join(added, ["source_path", "sha256"], "left_semi").join(per, "sha256")
        new = new.withColumns({"document_id": F.substring("sha256", 1, 16), "stored_path": F.concat(F.lit("sources/"), "sha256", suffix), "raw_metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")), "added_at": at, "updated_at": at, "version": F.lit(version)} | ingest.metadata("metadata", given))
        new = new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in self.spark.createDataFrame([], TABLES["documents"]).columns])
        replaced = status.filter("status = 'replaced'").select("source_path", "sha256")
        changes = named.join(replaced, ["source_path", "sha256"], "left_semi").withColumns(extra)
        old = known.join(replaced.select("sha256").distinct(), "sha256", "left_semi").withColumn("version", F.lit(version).cast("long"))
        documents = self._write("documents", batch, ingest.replace_metadata(new.unionByName(old.select(*new.columns)), changes, at))
        self._write("sources", batch, fresh.join(added, ["source_path", "sha256"], "left_semi").dropDuplicates(["sha256"]).join(new.select("sha256", "stored_path"), "sha256"))
        self._write("pages", batch, pages.withColumns({"extracted_text": F.col("text"), "extraction_method": F.lit(make_decoder.name)}))

        progress("cutting sentences")
        lines = pages.filter("words IS NULL").select("document_id", "page_index", F.posexplode(F.split("text", "\n")).alias("logical_block_index", "block")).withColumn("logical_block_index", F.col("logical_block_index").cast("long"))
        words = readers.words_of(pages)
        placed, boxes = geometry.cut(words)
        sentences = self._write("sentences", batch, segment.number(segment.cut(lines).unionByName(placed.select(*segment.cut(lines).columns))))
        key = ["document_id", "page_index", "logical_block_index"]
        named_boxes = boxes.join(sentences.select(*key, F.col("block_sentence_index").alias("pos"), "display_id"), [*key, "pos"])
        boxes = self._write("sentence_boxes", batch, named_boxes)

        progress("making passages")
        cfg = self.config
        passages = classify.numbered(chunk.passages(sentences, cfg.max_words, cfg.overlap_sentences))
        passages = save(passages.join(documents.select("document_id", "page_count"), "document_id"), "passages")
        parts = self._write("passage_sentences", batch, chunk.passage_sentences(passages))
        rules = classify.rule_cutoffs(classify.rule_candidates(readers.drawings_of(pages), pages), words, documents.select("document_id", "page_count"))
        edges = geometry.top_edges(boxes, parts).withColumnRenamed("passage", "display_id")
        self._write("passages", batch, classify.classify(passages.join(edges, "display_id", "left"), classify.heading_cutoffs(passages), rules))
        errors = told.join(status, ["source_path", "sha256"]).filter("status = 'failed'")
        again = F.lit("the corpus has this content already")
        self._write("ingestion_errors", batch, errors.select("source_path", "filename", F.coalesce("error_type", F.lit(DuplicateDocument.__name__)).alias("error_type"), F.coalesce("error_message", again).alias("error_message"), at.alias("created_at")))
        status.write.parquet(f"{self.root}/outcomes/batch={batch}")
        any_new, any_replaced = bool(added.take(1)), bool(replaced.take(1))
        self._set(lambda s: {"batches": [*s["batches"], batch], "replaced": s["replaced"] or any_replaced} | (_stale(s) if any_new else {}))
        path, fs = self._at(f"work/batch={batch}")
        fs.delete(path, True)
        progress("done")
        return self.spark.read.parquet(f"{self.root}/outcomes/batch={batch}")

    def embedder(self) -> dense.Embedder:
        """The embedder that the configuration names."""
        name = self.config.embedding_model
        if name not in EMBEDDERS:
            raise CorpusError(f"no embedder is registered as {name}; pass one, or add it to EMBEDDERS")
        return EMBEDDERS[name]()

    def rebuild_index(self, embedder: dense.Embedder | None = None, progress: Callable[[str], None] = silent) -> int:
        """Build both indexes as one new version and point to it. Without eligible passages the index is empty, and ready.

        A failure leaves the old version in place.
        """
        embedder = embedder or self.embedder()
        version = uuid.uuid4().hex[:12]
        at = f"{self.root}/index/v={version}"
        text = F.coalesce("normalized_text", "source_text").alias("text")
        eligible = self.table("passages").filter(F.coalesce("retrieval_eligible", F.lit(True)))
        progress("indexing words")
        lexical.write(eligible.select(F.col("display_id").alias("passage_id"), text), f"{at}/lexical")
        progress("indexing vectors")
        vectors = dense.embed(eligible.select(F.col("display_id").alias("passage_id"), text), "passage_id", "text", embedder)
        vectors.withColumnRenamed("id", "passage_id").write.parquet(f"{at}/vectors")
        got = self.spark.read.parquet(f"{at}/vectors").agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if got[1] != got[2]:
            raise CorpusError("the embedder gave vectors of several lengths")
        types = eligible.agg(F.array_sort(F.collect_set("content_type"))).first()[0]
        n = eligible.count()
        self._create(f"index/v={version}/manifest.json", {"embedding_model": embedder.name, "dimension": got[1], "vectors": got[0], "passages": n, "content_types": types, "created_at": now()})
        self._set(lambda _: {"index": version, "index_status": "ready", "indexed_passages": n, "embedding_model": embedder.name, "last_indexed_at": now()})
        return n

    def manifest(self) -> dict:
        """What the current index was built with; an empty one is an error."""
        state = self.state
        if state["index"] is None or not state["indexed_passages"]:
            raise CorpusError("the index is empty; rebuild it first")
        return self._read(f"index/v={state['index']}/manifest.json")

    def index(self, embedder: dense.Embedder | None = None) -> tuple[lexical.LexicalIndex, DataFrame]:
        """The current version. An embedder other than the one it was built with is an error."""
        manifest = self.manifest()
        if embedder is not None and embedder.name != manifest["embedding_model"]:
            raise CorpusError(f"the index was built with {manifest['embedding_model']}, not {embedder.name}; rebuild it")
        if manifest["dimension"] is None:
            raise CorpusError("the index has no vectors; rebuild it")
        at = f"{self.root}/index/v={self.state['index']}"
        return lexical.read(self.spark, f"{at}/lexical"), self.spark.read.parquet(f"{at}/vectors")

    def stale_warning(self) -> str | None:
        return None if self.state["index_status"] == "ready" else "documents were added after the index was built; they are not searched"


def _stale(state: dict) -> dict:
    return {"index_status": "rebuild_required" if state["indexed_passages"] else "empty"}
