"""Reading sources: files of bytes, texts, JSON lines; extraction into pages. Errors become rows, not failures."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidentia.functions.text import document_id, extraction_status, word_count


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """All files below a folder whose name fits (case-sensitive), as bytes with their digest."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return raw.select(F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def is_pdf_name(path: str) -> bool:
    """A single file is accepted whatever the case of its ending."""
    return path.lower().endswith(".pdf")


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A single PDF file as a source. ``~`` is the home folder; anything else than a file with that ending is refused."""
    if not is_pdf_name(path):
        raise ValueError(f"not a PDF file: {path}")
    local = "://" not in path
    whole = str(Path(os.path.expanduser(path)).resolve()) if local else path
    if local and not os.path.isfile(whole):
        raise FileNotFoundError(whole)
    return files(spark, Path(whole).as_uri() if local else whole, "*")


def in_folder(folder: str, relative: str, check: bool = True) -> str:
    """The path of a document below its folder; a missing file is an error if checked."""
    path = os.path.join(os.path.expanduser(folder), relative)
    if check and not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path


def from_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table of texts as sources: the text's bytes, the id as the name."""
    name = F.concat(F.col(id_col).cast("string"), F.lit(".txt"))
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.concat(F.lit("table/"), name).alias("source_path"), name.alias("filename"), F.length(content).cast("long").alias("byte_size"), F.sha2(content, 256).alias("sha256"), content.alias("content"))


class BadLine(ValueError):
    """A line that isn't a JSON object of the schema."""


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object per line; blank lines are skipped. strict: a malformed line is an error with its file and number.

    The numbers are counted only once a line is known to be bad.
    """
    rows = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    bad = rows.select("*", F.col("_metadata.file_path").alias("file")).filter("__bad IS NOT NULL").limit(1).collect()
    if bad:
        for n, line in enumerate(spark.read.text(bad[0]["file"]).toLocalIterator(), 1):
            if line[0] == bad[0]["__bad"]:
                raise BadLine(f"{bad[0]['file']}, line {n}: not a JSON object of the schema")
    return rows.drop("__bad")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, in files below the path, which must not exist."""
    df.write.json(path)


def json_lines_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines, not strict; a missing path is an empty table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return json_lines(spark, path, schema, strict=False) if there else spark.createDataFrame([], schema)


def last_by_id(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per id; of repeated ids the last in order wins."""
    names = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.max_by(F.struct(*names), order_col).alias("r")).select(id_col, "r.*")


@dataclass
class Page:
    """words: (text, x0, y0, x1, y1, block_no, line_no) in native order, None if the decoder knows no words, and then each
    line is a block. drawings: (kind, x0, y0, x1, y1)."""

    text: str
    words: list[tuple] | None = None
    drawings: list[tuple] = field(default_factory=list)
    width: float | None = None
    height: float | None = None
    rotation: int = 0
    block_count: int | None = None


@dataclass
class Decoded:
    pages: list[Page]
    metadata: dict[str, str] = field(default_factory=dict)


class Decoder(Protocol):
    """decode(bytes) gives one document, or raises. It is made in each task."""

    name: str

    def decode(self, content: bytes) -> Decoded: ...


class TextDecoder:
    """UTF-8 text; a form feed ends a page."""

    name = "text"

    def decode(self, content: bytes) -> Decoded:
        return Decoded([Page(t, block_count=t.count("\n") + 1) for t in content.decode("utf-8").split("\f")])


class JsonDecoder:
    """A document as JSON, {"metadata": {}, "pages": [{"text", "words", "drawings", "width", "height", ...}]}: what any
    other extractor may hand over."""

    name = "json"

    def decode(self, content: bytes) -> Decoded:
        d = json.loads(content)
        pages = [Page(p.get("text", ""), None if p.get("words") is None else [tuple(w) for w in p["words"]], [tuple(x) for x in p.get("drawings", [])], p.get("width"), p.get("height"), p.get("rotation", 0), p.get("block_count")) for p in d["pages"]]
        return Decoded(pages, {k: str(v) for k, v in d.get("metadata", {}).items() if v is not None})


class PdfDecoder:
    """PDF files, by PyMuPDF where it is installed. Words, blocks and text come in the file's own order."""

    name = "pdf"

    def decode(self, content: bytes) -> Decoded:
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as doc:
            if doc.needs_pass:
                raise ValueError("the document is protected by a password")
            return Decoded([self._page(p) for p in doc], {k: v for k, v in (doc.metadata or {}).items() if v})

    @staticmethod
    def _page(page) -> Page:
        words = [(w[4], *(round(x, 3) for x in w[:4]), w[5], w[6]) for w in page.get_text("words", sort=False)]
        drawings = []
        for d in page.get_drawings():
            for item in d["items"]:
                if item[0] == "l":
                    drawings.append(("line", item[1].x, item[1].y, item[2].x, item[2].y))
                elif item[0] == "re":
                    drawings.append(("rect", item[1].x0, item[1].y0, item[1].x1, item[1].y1))
        blocks = sum(b[6] == 0 for b in page.get_text("blocks", sort=False))
        return Page(page.get_text("text", sort=False), words, drawings, page.rect.width, page.rect.height, page.rotation, blocks)


EXTRACTED = (
    "source_path string, filename string, sha256 string, page_index bigint, text string, width double, height double, rotation int, block_count bigint,"
    " words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,block_no:bigint,line_no:bigint>>,"
    " drawings array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>, metadata map<string,string>, error_type string, error_message string"
)


def extract_rows(sources: DataFrame, make_decoder=TextDecoder) -> DataFrame:
    """A row for each page (metadata on the first one), or one with the error. sources: source_path, filename, sha256, content."""
    schema = to_arrow_schema(StructType.fromDDL(EXTRACTED))
    word, drawing = ("text", "x0", "y0", "x1", "y1", "block_no", "line_no"), ("kind", "x0", "y0", "x1", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = make_decoder()
        for b in batches:
            for r in b.to_pylist():
                base = {"source_path": r["source_path"], "filename": r["filename"], "sha256": r["sha256"]}
                try:
                    d = decoder.decode(r["content"])
                    out = [
                        base | {"page_index": k, "text": p.text, "width": p.width, "height": p.height, "rotation": p.rotation, "block_count": p.block_count,
                                "words": None if p.words is None else [dict(zip(word, w)) for w in p.words], "drawings": [dict(zip(drawing, x)) for x in p.drawings],
                                "metadata": list(d.metadata.items()) if k == 0 else None}
                        for k, p in enumerate(d.pages)
                    ]
                    made = pa.RecordBatch.from_pylist(out, schema)
                except Exception as e:  # any decoder's failure is that source's own
                    made = pa.RecordBatch.from_pylist([base | {"error_type": type(e).__name__, "error_message": str(e)}], schema)
                yield made

    return sources.select("source_path", "filename", "sha256", "content").mapInArrow(run, EXTRACTED)


def pages_of(rows: DataFrame) -> DataFrame:
    """The pages of extracted rows."""
    return rows.filter("error_type IS NULL").select(
        F.substring("sha256", 1, 16).alias("document_id"), "source_path", "sha256", "page_index", (F.col("page_index") + 1).alias("page_number"), "text", "width", "height", "rotation", "block_count", "words", "drawings",
        extraction_status("text").alias("extraction_status"), F.length("text").cast("long").alias("character_count"), word_count("text").alias("word_count"),
    )


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.filter("error_type IS NOT NULL").select("source_path", "filename", "sha256", "error_type", "error_message")


def extract(sources: DataFrame, make_decoder=TextDecoder) -> tuple[DataFrame, DataFrame]:
    """Pages and errors; each runs the decoder, so save extract_rows() where both are used."""
    rows = extract_rows(sources, make_decoder)
    return pages_of(rows), errors_of(rows)


def words_of(pages: DataFrame) -> DataFrame:
    """A row for each word with its place in the page, for geometry. Pages without words have none."""
    return pages.select("document_id", "page_index", F.posexplode("words").alias("pos", "w")).select("document_id", "page_index", F.col("pos").cast("long").alias("pos"), "w.*")


def drawings_of(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_index", F.posexplode("drawings").alias("seq", "d")).select("document_id", "page_index", F.col("seq").cast("long").alias("seq"), "d.*")


__all__ = ["Decoded", "Decoder", "JsonDecoder", "Page", "PdfDecoder", "TextDecoder", "document_id", "drawings_of", "errors_of", "extract", "extract_rows", "files", "from_texts", "in_folder", "is_pdf_name", "json_lines", "json_lines_or_empty", "last_by_id", "one_file", "pages_of", "words_of", "write_json_lines"]
