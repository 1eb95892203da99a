"""Reports as text, from rows that are few: of one command's outcomes, corpora or verdicts."""

from __future__ import annotations

from collections.abc import Iterable


def _size(n: int | None) -> str:
    if n is None:
        return "-"
    for unit, step in (("B", 1), ("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        if n < step * 1024 or unit == "GiB":
            return f"{n} B" if step == 1 else f"{n / step:.1f} {unit}"
    return ""


def ingestion(outcomes: Iterable, errors: Iterable = ()) -> str:
    """Sources by status, then each failure."""
    counts = {s: 0 for s in ("added", "discarded", "replaced", "failed")}
    for r in outcomes:
        counts[r["status"]] += 1
    lines = [", ".join(f"{n} {s}" for s, n in counts.items())]
    lines += [f"failed: {r['filename']}: {r['error_type']}: {r['error_message']}" for r in sorted(errors, key=lambda r: r["filename"])]
    return "\n".join(lines)


def cleanup(rows: Iterable) -> str:
    rows = sorted(rows, key=lambda r: r["root"])
    if not rows:
        return "no corpus to clean up"
    lines = [f"{r['outcome']}: {r['root']} ({_size(r['bytes'])})" for r in rows]
    freed = sum(r["bytes"] or 0 for r in rows if r["outcome"] in ("preview", "deleted"))
    return "\n".join([*lines, f"{_size(freed)} in all" + ("" if any(r["outcome"] == "deleted" for r in rows) else "; nothing was deleted")])


def rank(value: int | None) -> str:
    return "not retrieved" if value is None else str(value)


def verification(run: str, warning: str | None, rows: Iterable, sentences: dict[str, str], verbose: bool = False) -> str:
    """Each claim's verdicts in order, with the sentences shown for them; verbose: where each passage was found."""
    lines = [f"run {run}"] + ([f"warning: {warning}"] if warning else [])
    for r in sorted(rows, key=lambda r: (str(r["claim_id"]), r["rerank_rank"])):
        lines.append(f"[{r['rerank_rank']}] {r['verdict']['label']} {r['passage_id']}: {r['verdict']['reason']}")
        if verbose:
            lines.append(f"    dense {rank(r['dense_rank'])}, words {rank(r['bm25_rank'])}, fused {rank(r['fusion_rank'])}, reranked {r['rerank_score']:.3f}")
        lines += [f"    {s}: {sentences.get(s, '')}" for s in r["shown"]]
    return "\n".join(lines)
