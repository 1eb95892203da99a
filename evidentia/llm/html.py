"""Main text of web pages from flat text blocks and a decision tree (operator 10).

A page is cut into flat blocks of text at block-level tags. Each block has its word count and link density, those of its
two neighbours, and what its containers say about it. A decision tree, trained on the small labelled table below, keeps
or drops the block. Kept blocks are joined in page order.

Defined results: null or empty html gives empty text; equal rows give equal results; empty tables give no rows; columns
with clashing names are ignored. Unclosed and cut-off tags, comments and scripts end with the page.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article", "heading")

#: The labelled table: one block per row, in the order of FEATURES, then whether it is main text. links is the share of
#: words inside links; aside says that a container is a menu, header, footer, sidebar, notice, advert, form or comments;
#: article that a container is the article or main part.
LABELLED = (
    # paragraphs and headings of an article
    (60, 0.00, 12, 0.00, 80, 0.00, 0, 1, 0, 1),
    (110, 0.02, 60, 0.00, 45, 0.00, 0, 1, 0, 1),
    (45, 0.00, 110, 0.02, 9, 0.00, 0, 1, 0, 1),
    (9, 0.00, 45, 0.00, 130, 0.05, 0, 1, 0, 1),
    (1, 0.00, 80, 0.00, 70, 0.00, 0, 1, 0, 1),
    (3, 0.00, 90, 0.00, 15, 0.00, 0, 1, 0, 1),
    (2, 0.00, 12, 0.00, 16, 0.00, 0, 1, 0, 1),
    (12, 0.00, 7, 0.00, 60, 0.00, 0, 1, 1, 1),
    (4, 0.00, 70, 0.00, 66, 0.00, 0, 1, 1, 1),
    (10, 0.00, 1, 1.00, 3, 0.00, 0, 1, 1, 1),
    (300, 0.01, 10, 0.00, 2, 0.00, 0, 1, 0, 1),
    (900, 0.00, 10, 0.00, 14, 0.00, 0, 1, 0, 1),
    (25, 0.20, 40, 0.00, 33, 0.00, 0, 1, 0, 1),
    (30, 0.35, 22, 0.00, 41, 0.10, 0, 1, 0, 1),
    (14, 0.00, 9, 0.00, 0, 0.00, 0, 1, 0, 1),
    (70, 0.00, 8, 0.00, 0, 0.00, 0, 1, 0, 1),
    (8, 0.00, 6, 0.00, 7, 0.00, 0, 1, 0, 1),
    (6, 0.25, 8, 0.00, 9, 0.00, 0, 1, 0, 1),
    (9, 0.00, 4, 0.00, 11, 0.00, 0, 1, 1, 1),
    (5, 0.00, 3, 0.00, 6, 0.00, 0, 1, 1, 1),
    (7, 0.00, 2, 0.00, 5, 0.00, 0, 1, 0, 1),
    (2, 0.00, 1, 0.00, 3, 0.00, 0, 1, 0, 1),
    (1, 0.00, 3, 0.00, 2, 0.00, 0, 1, 0, 1),
    (4, 0.00, 2, 0.00, 0, 0.00, 0, 1, 0, 1),
    (6, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1),
    (1, 0.00, 0, 0.00, 4, 0.00, 0, 1, 1, 1),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 1, 1, 1),
    (5, 0.00, 1, 1.00, 7, 0.90, 0, 1, 0, 1),
    (11, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0, 1),
    (40, 0.00, 3, 0.00, 2, 1.00, 0, 1, 0, 1),
    (2, 0.00, 60, 0.00, 3, 1.00, 0, 1, 0, 1),
    (8, 0.00, 2, 0.00, 1, 1.00, 0, 1, 0, 1),
    # link lists, tags and buttons inside an article
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 1, 0, 0),
    (3, 1.00, 70, 0.00, 2, 1.00, 0, 1, 0, 0),
    (5, 0.90, 45, 0.00, 4, 1.00, 0, 1, 0, 0),
    (8, 0.80, 3, 1.00, 6, 0.90, 0, 1, 0, 0),
    (12, 1.00, 60, 0.00, 10, 1.00, 0, 1, 0, 0),
    (20, 0.95, 15, 1.00, 20, 0.95, 0, 1, 0, 0),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments, also inside an article
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0),
    (2, 1.00, 1, 1.00, 8, 0.00, 1, 0, 0, 0),
    (3, 0.00, 1, 1.00, 12, 0.00, 1, 0, 0, 0),
    (7, 0.00, 1, 1.00, 10, 0.00, 1, 0, 0, 0),
    (16, 0.00, 1, 1.00, 11, 0.00, 1, 0, 0, 0),
    (16, 0.00, 80, 0.00, 0, 0.00, 1, 0, 0, 0),
    (24, 0.00, 120, 0.00, 0, 0.00, 1, 0, 0, 0),
    (9, 0.30, 60, 0.00, 0, 0.00, 1, 0, 0, 0),
    (60, 0.00, 70, 0.00, 30, 0.10, 1, 0, 0, 0),
    (40, 0.00, 5, 0.50, 44, 0.00, 1, 0, 0, 0),
    (110, 0.00, 6, 0.00, 90, 0.00, 1, 0, 0, 0),
    (35, 0.00, 90, 0.00, 50, 0.00, 1, 1, 0, 0),
    (80, 0.00, 12, 0.00, 75, 0.00, 1, 1, 0, 0),
    (12, 0.00, 80, 0.00, 90, 0.00, 1, 1, 0, 0),
    (4, 0.00, 80, 0.00, 20, 0.00, 1, 1, 1, 0),
    (5, 0.00, 9, 0.00, 30, 0.00, 1, 0, 1, 0),
    (2, 0.50, 40, 0.00, 2, 1.00, 1, 1, 0, 0),
    (18, 0.10, 200, 0.00, 6, 0.00, 1, 0, 0, 0),
    (150, 0.00, 20, 0.00, 10, 0.00, 1, 1, 0, 0),
    # pages without an article element: running text
    (60, 0.00, 6, 0.00, 80, 0.00, 0, 0, 0, 1),
    (130, 0.03, 60, 0.00, 45, 0.00, 0, 0, 0, 1),
    (45, 0.00, 110, 0.02, 70, 0.00, 0, 0, 0, 1),
    (22, 0.00, 50, 0.00, 64, 0.05, 0, 0, 0, 1),
    (14, 0.00, 72, 0.00, 55, 0.00, 0, 0, 0, 1),
    (6, 0.00, 64, 0.00, 41, 0.00, 0, 0, 0, 1),
    (30, 0.10, 3, 1.00, 38, 0.00, 0, 0, 0, 1),
    (48, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 1),
    (250, 0.02, 3, 1.00, 4, 0.50, 0, 0, 0, 1),
    (9, 0.00, 3, 1.00, 88, 0.00, 0, 0, 1, 1),
    (5, 0.00, 71, 0.00, 77, 0.00, 0, 0, 1, 1),
    (7, 0.00, 0, 0.00, 35, 0.00, 0, 0, 1, 1),
    (20, 0.30, 66, 0.00, 59, 0.00, 0, 0, 0, 1),
    # pages without an article element: what surrounds it
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0),
    (2, 1.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 60, 0.00, 0, 0, 0, 0),
    (6, 0.60, 70, 0.00, 3, 1.00, 0, 0, 0, 0),
    (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0),
    (3, 0.00, 4, 0.00, 2, 1.00, 0, 0, 0, 0),
    (5, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0),
    (2, 0.00, 3, 0.00, 4, 0.00, 0, 0, 0, 0),
    (7, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 0),
    (9, 0.50, 8, 0.60, 6, 0.70, 0, 0, 0, 0),
    (25, 0.90, 3, 1.00, 20, 0.80, 0, 0, 0, 0),
    (12, 1.00, 60, 0.00, 11, 1.00, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 1, 0),
)

#: Elements whose content is no text, elements that begin a block, and container names that speak for
#: boilerplate or for the article.
HIDDEN = "script|style|noscript|template|title|svg|math|iframe|object|canvas|select|textarea|button|audio|video|map"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog header".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar status".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommended|more-?links|widget|toolbar|copyright|legal|disclaimer|pagination|pager|tagcloud|skip)(?:$|[\s_-])"
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body-?text)(?:$|[\s_-])")

#: Attributes as a browser reads them: a quote counts only where a value begins, and one that never closes is a character
#: like others. Possessive, so that each tag is read once and ends at its own > or with the page, however long it is.
ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({HIDDEN})(?=[\s/>]){ATTRS}(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRS})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: One attribute: its whole name, then its value in double quotes, in single quotes or in none.
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")


def _says(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """What a container says of its text: aside, article. A header within an article is its own."""
    aside, article = tag in ASIDE_TAGS and not (tag == "header" and inside), tag in ("article", "main")
    if attrs and not attrs.isspace():
        for name, *values in ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                aside |= bool(ASIDE_NAMES.search(value)) and tag not in ("body", "html", "article", "main")
                article |= bool(ARTICLE_NAMES.search(value)) and tag not in ("body", "html", "a", "span")
            elif name == "role":
                aside |= value in ASIDE_ROLES
                article |= value in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                aside = True
    return aside, article


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """Flat blocks: text, share of words in links, aside, article, heading."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    runs: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # containers with what holds inside them
    aside = article = link = heading = False

    def close() -> None:
        nonlocal runs
        if runs:
            text = " ".join("".join(r for r, _ in runs).split())
            if text:
                linked = sum(len(r.split()) for r, a in runs if a)
                out.append((text, min(1.0, linked / max(1, text.count(" ") + 1)), aside, article, heading))
            runs = []

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            runs.append((charrefs.unescape(page[at : m.start()]), link))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m[2]), m[4]
        if tag == "br":
            runs.append((" ", link))
            continue
        if tag == "a":
            link = not ends
        block = tag in BLOCKS
        if block:
            close()
            link = False
            heading = not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if ends:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    close()
                    del open_[k:]
                    aside, article = open_[-1][1:] if open_ else (False, False)
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            a, b = _says(tag, attrs, article)
            if a or b or tag in ("div", "section", "span", "article", "main", "nav", "footer", "aside", "form", "ul", "ol", "table"):
                if a and not aside or b and not article:
                    close()
                aside, article = aside or a, article or b
                open_.append((tag, aside, article))
    if at < len(page):
        runs.append((charrefs.unescape(page[at:]), link))
    close()
    return out


def features(found: list[tuple[str, float, bool, bool, bool]]) -> np.ndarray:
    words = np.array([0, *[t.count(" ") + 1 for t, *_ in found], 0], float)
    links = np.array([0, *[x for _, x, *_ in found], 0], float)
    own = np.array([x[2:] for x in found], float).reshape(-1, 3)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own])


class Tree:
    """A binary decision tree by Gini impurity; of equal splits the first feature and lowest threshold win."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.value = bool(2 * y.sum() >= len(y))
        self.feature = None
        if depth == 0 or y.min() == y.max():
            return
        best = (self._gini(y) * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) < least:
                    continue
                score = self._gini(y[left]) * left.sum() + self._gini(y[~left]) * (~left).sum()
                if score < best[0] - 1e-12:
                    best = (score, f, cut)
        if best[1] is None:
            return
        self.feature, self.cut = best[1], best[2]
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def train() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1].astype(int))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n".join(t for (t, *_), k in zip(found, keep) if k)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and text: the page's main text."""
    tree = train()
    few = df.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema[:-1] if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py(), tree) for h in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*b.schema.names[:-1], "text"])

    return few.mapInArrow(run, f"{schema}, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
