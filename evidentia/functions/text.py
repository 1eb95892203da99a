"""Scalar text functions, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
#: White space as patterns know it.
SPACE = " \t\n\x0b\f\r"


def _single_marks() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that are a plain letter with one mark, and the plain letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(d) == 2 and unicodedata.combining(d[1]) and d[0].isascii():
            marked.append(c)
            plain.append(d[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _single_marks()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Lower case without single diacritics; letters that are no letter with a mark (ß, ø) stay."""
    return F.translate(F.lower(col(text)), MARKED, PLAIN)


def terms(text: Column | str) -> Column:
    """A text's index terms in order, repeats included."""
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0))


def spaced_terms(text: Column | str) -> Column:
    """A text's index terms in order between single spaces; empty without any. For functions that split many texts at once."""
    return F.trim(F.regexp_replace(fold(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def query_terms(text: Column | str, fold_first: bool = False) -> Column:
    """A claim's terms: case-folded (ß becomes ss), each distinct one once, in order, and folded after that.

    Terms that differ only in their marks therefore count twice. fold_first=True counts them once and keeps ß.
    """
    if fold_first:
        return F.array_distinct(terms(text))
    found = F.array_distinct(F.regexp_extract_all(F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss")), F.lit(TERM), F.lit(0)))
    return F.transform(found, lambda t: F.translate(t, MARKED, PLAIN))


def trim(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(col(text), F.lit(SPACE))


def word_count(text: Column | str) -> Column:
    """Tokens between white space."""
    return F.regexp_count(col(text), F.lit(r"\S+")).cast("long")


def falsy(*cols: Column | str) -> Column:
    """The first of the columns that is neither null nor empty, else an empty string; trimmed."""
    return trim(F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit("")))


def extraction_status(text: Column | str) -> Column:
    """empty, sparse (under 100 characters) or ok."""
    n = F.length(trim(F.coalesce(col(text), F.lit(""))))
    return F.when(n == 0, "empty").when(n < 100, "sparse").otherwise("ok")


def document_id(content: Column | str) -> Column:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return F.substring(F.sha2(col(content), 256), 1, 16)


def needs_space(before: Column | str, after: Column | str, new_line: Column) -> Column:
    """Whether two neighbouring words are joined with a space."""
    before, after = col(before), col(after)
    return (
        F.when(F.coalesce(before, F.lit("")) == "", False)
        .when(new_line & before.rlike("-$"), False)
        .when(after.rlike("^[,.;:!?%)\\]}»”’]"), False)
        .when(before.rlike("[(\\[{«“‘]$"), False)
        .otherwise(True)
    )


def human_size(n: Column | str) -> Column:
    """Bytes with a unit of 1024."""
    n = col(n).cast("double")
    return F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1024**2, F.format_string("%.1f KiB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2)).otherwise(F.format_string("%.1f GiB", n / 1024**3))


def html_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
