"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into flat blocks.  Each block has its word count and link density,
those of its neighbours, and what its enclosing elements say (a menu, footer, advert, form or comments; the
article's own element, or outside it on a page that has one).  A small classification tree, grown by Gini impurity on the labelled table
below, keeps or drops each block.  Kept blocks are joined in page order by a blank line.

Edge cases: null or empty html gives an empty text; unclosed elements, comments and cut-off tags or
references at the end are tolerated; a page of any length is read whole; ``br`` is white space; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import table

#: Elements that end a text block, elements without content, elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script style textarea title iframe xmp noembed noframes".split()
HIDDEN_TAGS = frozenset("svg math template noscript select option optgroup datalist button object audio video canvas".split())
#: Elements, roles and words of class or id that mark what is no article text, and what is.
AWAY_TAGS = frozenset("nav aside form fieldset dialog menu footer".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs masthead"
    " footer comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations widget widgets toolbar pagination pager search copyright".split()
)
HEAD_WORDS = frozenset("header topbar".split())
HOME_WORDS = frozenset("article articlebody post postbody entry story maincontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    away: bool
    home: bool
    heading: bool


@lru_cache(maxsize=4096)
def _marks(rest: str) -> tuple[bool, bool, bool, bool]:
    """(away, head, home, hidden) as an element's attributes tell."""
    away = head = home = hidden = False
    for name, *values in _ATTRIBUTE.findall(rest):
        value, name = "".join(values), name.lower()
        if name in ("class", "id"):
            words = {w.lower() for w in _PIECES.findall(value)} | {w.lower() for w in value.split()}
            away |= not words.isdisjoint(AWAY_WORDS)
            head |= not words.isdisjoint(HEAD_WORDS)
            home |= not words.isdisjoint(HOME_WORDS) or {"main", "content"} <= words
        elif name == "role":
            away |= value.lower() in AWAY_ROLES
            home |= value.lower() in ("main", "article")
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        else:
            hidden |= value.lower() == "true"
    return away, head, home, hidden


def text_blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, away, home, hidden: as inherited
    away = home = hidden = heading = False
    parts: list[str] = []
    links: list[str] = []
    in_link = False

    def close() -> None:
        if parts:
            words = html_module.unescape("".join(parts)).split()
            if words:
                linked = len(html_module.unescape(" ".join(links)).split()) if links else 0
                blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), away, home, heading))
            parts.clear()
            links.clear()

    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            if not hidden:
                parts.append(text)
                if in_link:
                    links.append(text)
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            if token["raw"] and token["raw"].lower() in ("title", "textarea"):
                close()
            continue
        tag = tag.lower()
        ends = bool(token["end"] or token["end2"])
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            continue
        rest = (token["rest"] if token["tag"] else token["rest2"]) or ""
        block = tag in BLOCK_TAGS
        if not block and tag not in HIDDEN_TAGS:
            continue
        if block:
            close()
            in_link = in_link and not ends
        if tag == "hr":
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if block and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == tag:
                stack.pop()
            _, was_away, was_home, was_hidden = stack[-1] if stack else ("", False, False, False)
            if rest:
                marked, head, mine, gone = _marks(rest)
            else:
                marked = head = mine = gone = False
            is_home = was_home or mine or tag in ("article", "main")
            is_away = was_away or marked or tag in AWAY_TAGS or (tag == "header" or head) and not was_home
            if tag in ("body", "html"):
                is_away = is_home = False
            if not rest.rstrip().endswith("/"):
                stack.append((tag, is_away, is_home, was_hidden or gone or tag in HIDDEN_TAGS))
        _, away, home, hidden = stack[-1] if stack else ("", False, False, False)
        heading = any(s[0] in HEADINGS for s in stack[-2:])
    close()
    return blocks


# ---- the classifier ------------------------------------------------------------------------------

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "away", "home", "outside", "heading")

#: The labelled table: 1 for article text, then the features in their order (links in per cent of the words).
LABELLED = """
0 1 100 0 0 1 100 1 0 1 0
0 2 100 1 100 2 100 1 0 1 0
0 12 0 2 100 9 0 1 0 1 0
0 25 4 30 0 40 0 1 0 1 0
0 60 0 80 0 70 0 1 1 0 0
0 9 0 55 0 0 0 1 0 1 0
0 30 10 45 0 6 50 1 1 0 0
0 7 0 40 0 80 0 1 1 0 1
0 120 0 90 0 20 0 1 0 0 0
0 15 0 60 0 3 100 1 0 0 0
0 3 66 0 0 4 75 1 0 0 0
0 5 0 0 0 60 0 1 0 0 1
1 5 0 12 0 60 0 0 1 0 1
1 60 0 5 0 80 0 0 1 0 0
1 80 2 60 0 1 0 0 1 0 0
1 1 0 80 2 45 0 0 1 0 0
1 45 0 1 0 7 0 0 1 0 0
1 7 0 45 0 0 0 0 1 0 0
1 200 1 9 0 12 0 0 1 0 0
1 9 0 9 0 9 0 0 1 0 0
1 2 0 3 0 2 0 0 1 0 0
1 14 21 60 0 90 0 0 1 0 0
1 6 100 70 0 66 0 0 1 0 0
1 30 40 50 0 60 5 0 1 0 0
0 3 100 70 0 4 100 0 1 0 0
0 4 100 3 100 5 100 0 1 0 0
0 5 100 4 100 0 0 0 1 0 0
0 2 100 2 100 3 100 0 1 0 0
0 40 0 50 0 9 0 0 0 1 0
0 8 0 9 0 60 0 0 0 1 0
0 4 0 0 0 5 0 0 0 1 1
0 3 100 4 100 2 100 0 0 1 0
0 90 0 60 0 60 0 0 0 1 0
0 20 10 60 0 0 0 0 0 1 0
1 40 0 30 0 50 0 0 0 0 0
1 25 4 60 0 40 0 0 0 0 0
1 90 2 5 0 4 50 0 0 0 0
1 18 0 3 100 70 0 0 0 0 0
1 30 8 2 100 3 100 0 0 0 0
1 4 0 60 0 55 0 0 0 0 0
1 9 0 40 2 30 0 0 0 0 0
1 5 0 3 100 60 0 0 0 0 1
1 4 0 40 0 35 5 0 0 0 1
1 6 0 2 0 45 0 0 0 0 1
0 4 0 2 100 5 0 0 0 0 0
0 6 0 5 0 3 60 0 0 0 0
0 3 0 4 100 2 100 0 0 0 1
0 5 0 4 0 6 0 0 0 0 1
0 8 0 60 0 0 0 0 0 0 0
0 7 0 0 0 5 0 0 0 0 0
0 20 80 15 90 18 85 0 0 0 0
0 3 100 2 100 4 100 0 0 0 0
0 12 60 40 0 10 70 0 0 0 0
0 30 60 25 50 30 70 0 0 0 0
0 5 100 60 0 40 0 0 0 0 0
1 19 0 0 0 0 0 0 0 0 0
1 40 0 3 0 1 0 0 0 0 0
1 26 0 1 0 40 0 0 0 0 0
1 16 5 4 0 3 100 0 0 0 0
1 35 0 0 0 5 0 0 0 0 0
1 1 0 40 0 30 0 0 0 0 0
0 5 0 30 0 4 100 0 0 0 0
1 150 3 2 0 0 0 0 0 0 0
0 14 0 0 0 2 100 0 0 0 0
0 9 0 3 100 6 0 0 0 0 0
1 20 0 14 0 13 0 0 0 0 0
1 13 0 22 0 18 0 0 0 0 0
1 4 0 30 0 5 100 0 1 0 0
1 6 0 8 0 3 100 0 1 0 0
1 2 0 2 0 6 100 0 1 0 0
1 3 0 50 0 4 100 0 1 0 1
1 11 0 3 100 9 80 0 1 0 0
1 1 0 1 100 1 100 0 1 0 0
1 8 0 40 0 2 100 0 1 0 0
1 5 0 0 0 3 100 0 1 0 0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return rows[:, 1:], rows[:, 0].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A classification tree: (label,) or (feature, threshold, tree for <=, tree for >)."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return (int(2 * ones >= len(y)),)
    best = (1e9, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(len(part) * (p := part.mean()) * (1 - p) for part in (y[low], y[~low]))
            best = min(best, (round(impurity, 9), f, float(t)))
    if best[0] == 1e9:
        return (int(2 * ones >= len(y)),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    return grow(*labelled_table())


def keeps(node: tuple, row: tuple) -> bool:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node[0])


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a blank line."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    has_home = any(b.home and not b.away for b in blocks)
    sizes = [(b.words, 100 * b.linked / b.words) for b in blocks]
    padded = [(0, 0.0), *sizes, (0, 0.0)]
    kept, root = [], tree()
    for k, b in enumerate(blocks):
        row = (*padded[k + 1], *padded[k], *padded[k + 2], b.away, b.home, has_home and not b.home, b.heading)
        if keeps(root, row):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
