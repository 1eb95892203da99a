"""Commands over a corpus: python -m evidentia.cli COMMAND. Exit codes: 0, 1 if a source failed, 2 for what can't be done."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia import reports
from evidentia.operators import review
from evidentia.plans import chain, cleanup, ingest, verify
from evidentia.plans.corpus import Corpus, CorpusError, silent
from evidentia.sources import readers

DECODERS = {d.name: d for d in (readers.PdfDecoder, readers.TextDecoder, readers.JsonDecoder)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidentia")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        return c

    command("init-db", "root")
    for name in ("add-pdf", "add-directory"):
        c = command(name, "root", "path")
        c.add_argument("--on-duplicate", choices=ingest.POLICIES, default="ask")
        when = c.add_mutually_exclusive_group()
        when.add_argument("--rebuild", action="store_true")
        when.add_argument("--defer-rebuild", action="store_true")
        c.add_argument("--decoder", choices=sorted(DECODERS), default="pdf")
        c.add_argument("--pattern", default="*.pdf")
        c.add_argument("--quiet", action="store_true")
        for m in ingest.METADATA:
            c.add_argument("--" + m.replace("_", "-"), type=int if m == "publication_year" else str, action="append" if m == "authors" else "store")
    command("rebuild-index", "root").add_argument("--quiet", action="store_true")
    c = command("verify-claim", "root", "claim")
    for k, n in (("candidate", 100), ("rerank", 30), ("verify", 10)):
        c.add_argument(f"--{k}-k", type=int, default=n)
    for flag in ("--verbose", "--quiet", "--allow-stale-index"):
        c.add_argument(flag, action="store_true")
    c = command("cleanup-databases")
    c.add_argument("paths", nargs="*")
    c.add_argument("--unused-for", type=int)
    c.add_argument("--root", required=True)
    c.add_argument("--apply", action="store_true")
    c = command("show-sentences", "root")
    c.add_argument("ids", nargs="+")
    c.add_argument("--context", type=int, default=0)
    c = command("build-files", "path", "out")
    c.add_argument("--decoder", choices=sorted(DECODERS), default="pdf")
    c.add_argument("--pattern", default="*.pdf")
    c.add_argument("--max-words", type=int, default=180)
    c.add_argument("--overlap-sentences", type=int, default=1)
    return p


def _uri(path: str) -> str:
    return path if "://" in path else Path(path).expanduser().resolve().as_uri()


def _policy(corpus: Corpus, sources, policy: str, ask: Callable[[str], str] | None) -> str:
    """The policy ask asks once, if there is anything to ask and anyone to answer."""
    if policy != "ask" or ask is None:
        return policy
    have = corpus.table("documents").join(sources.select("sha256").distinct(), "sha256", "left_semi").count()
    if not have:
        return policy
    answer = ask(f"{have} of these documents are in the corpus. Discard or replace? [d/r] ").strip().lower()
    return "replace" if answer.startswith("r") else "discard"


def run(args: argparse.Namespace, spark: SparkSession, ask: Callable[[str], str] | None = None, say: Callable[[str], None] = print) -> int:
    quiet = getattr(args, "quiet", False)
    progress = silent if quiet or not sys.stderr.isatty() else lambda m: print(m, file=sys.stderr)
    if args.command == "init-db":
        say(f"corpus at {Corpus.create(spark, _uri(args.root)).root}")
        return 0
    if args.command == "cleanup-databases":
        roots = [_uri(p) for p in args.paths] or None
        rows = cleanup.cleanup(spark, _uri(args.root), roots, args.unused_for, args.apply).collect()
        say(reports.cleanup(rows))
        return 2 if any(r["status"] == "invalid" for r in rows) else 0
    if args.command == "build-files":
        say(chain.build_files(readers.files(spark, _uri(args.path), args.pattern), _uri(args.out), DECODERS[args.decoder], args.max_words, args.overlap_sentences))
        return 0
    corpus = Corpus.open(spark, _uri(args.root))
    if args.command in ("add-pdf", "add-directory"):
        one = args.command == "add-pdf"
        sources = readers.one_file(spark, args.path) if one and args.decoder == "pdf" else readers.files(spark, _uri(args.path), "*" if one else args.pattern)
        given = {m: getattr(args, m) for m in ingest.METADATA if getattr(args, m) is not None}
        policy = _policy(corpus, sources, args.on_duplicate, ask)
        done = corpus.ingest(sources, policy, DECODERS[args.decoder], given, progress).collect()
        failed = [r["source_path"] for r in done if r["status"] == "failed"]
        errors = corpus.table("ingestion_errors").filter(F.col("source_path").isin(failed)).collect() if failed else []
        say(reports.ingestion(done, errors))
        if args.rebuild or not args.defer_rebuild and ask is not None and any(r["status"] == "added" for r in done) and ask("Rebuild the index now? [y/n] ").strip().lower().startswith("y"):
            say(f"{corpus.rebuild_index(progress=progress)} passages indexed")
        return 1 if failed else 0
    if args.command == "rebuild-index":
        say(f"{corpus.rebuild_index(progress=progress)} passages indexed")
        return 0
    if args.command == "verify-claim":
        claims = spark.createDataFrame([(0, args.claim)], "claim_id bigint, claim string")
        warning = corpus.stale_warning()
        stale_ok = args.allow_stale_index or warning is None or ask is not None and ask(f"{warning}. Go on? [y/n] ").strip().lower().startswith("y")
        name, warning, judged = verify.verify_claims(corpus, claims, args.candidate_k, args.rerank_k, args.verify_k, stale_ok, progress=progress)
        rows = judged.collect()  # verify_k of them
        shown = sorted({s for r in rows for s in r["shown"]})
        texts = {r[0]: r[1] for r in corpus.table("sentences").filter(F.col("display_id").isin(shown)).select("display_id", "source_text").collect()}
        say(reports.verification(name, warning, rows, texts, args.verbose))
        return 0
    requested = spark.createDataFrame([(args.ids,)], "ids array<string>")
    sentences = corpus.table("sentences")
    review.require_all(requested, sentences, "display_id")
    context = review.page_context(sentences, requested.select(F.explode("ids").alias("display_id")), args.context)
    for r in context.orderBy("target", "page_sentence_index").collect():
        say(f"{'>' if r['is_target'] else ' '} {r['display_id']}: {r['source_text']}")
    for r in review.render_plan(requested, sentences, corpus.table("documents")).orderBy("first").collect():
        say(f"page {r['page_index'] + 1} of {r['stored_path']}: {r['output']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "cleanup-databases" and bool(args.paths) == (args.unused_for is not None):
        print("name corpora, or --unused-for DAYS, not both", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("evidentia").getOrCreate()
    try:
        return run(args, spark, input if sys.stdin.isatty() else None)
    except (CorpusError, ValueError, LookupError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
