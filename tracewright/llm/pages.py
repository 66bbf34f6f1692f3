"""Main-text extraction: flat text blocks, classified by a decision tree trained on a small labelled table.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density, those of the
block before and of the block after, the plain words and link density of the container that it stands in, and what
encloses it: elements that HTML gives to page furniture, names of classes that speak of furniture (a number, more for a
plainer name), the article element, a heading. The tree is grown from the labelled blocks below, once per worker.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: tags that end a text block; tags whose content is never text; tags that stand for page furniture.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select button title head datalist audio video noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer form menu dialog fieldset".split())
CONTENT = frozenset("article main".split())
_ROLE_FURNITURE = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
# Words of class names and ids that speak of what is no article (3: of the thing itself; 2: of a place that
# may hold it; 1: of what articles hold as well), of what is one, and that turn a name into its contrary.
HINTS = {
    3: frozenset("ad ads advert adverts advertisement adsense sponsor sponsored sponsors promo comment comments commentlist disqus replies reply respond cookie cookies consent gdpr newsletter subscribe signup breadcrumb breadcrumbs pagination pager nav navbar navigation menu footer".split()),
    2: frozenset("banner sidebar rail widget widgets related recommended recommendations search login popup modal toolbar masthead topbar notification".split()),
    1: frozenset("share sharing social header legal disclaimer copyright notice alert tags skip foot".split()),
}
_ARTICLE_WORDS = frozenset("article content entry post story body text main".split())
_CONTRARY = frozenset("has no with without is not non".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^<>]*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Labelled blocks, hand-made from ordinary page layouts: words, link density; the same of the block before and of the block
# after; plain words and link density of the container; inside furniture; hint; inside the article; heading; and last 1 if
# the block is main text.
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "container words", "container density", "furniture", "hint", "article", "heading")
LABELLED = [
    # inside furniture elements, whatever they hold
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 1.0, 1, 0, 0, 0, 0), (20, 0.0, 1, 1.0, 60, 0.0, 20, 0.0, 1, 0, 0, 0, 0),
    (45, 0.0, 30, 0.0, 2, 0.0, 75, 0.0, 1, 0, 0, 0, 0), (120, 0.0, 90, 0.0, 40, 0.0, 250, 0.0, 1, 0, 0, 0, 0), (300, 0.0, 20, 0.0, 90, 0.0, 410, 0.0, 1, 0, 0, 0, 0),
    (55, 0.0, 50, 0.0, 50, 0.0, 160, 0.0, 1, 0, 1, 0, 0), (12, 0.0, 60, 0.0, 70, 0.0, 12, 0.0, 1, 0, 1, 0, 0), (5, 0.0, 20, 0.0, 20, 0.0, 40, 0.0, 1, 0, 0, 1, 0),
    (18, 0.0, 2, 1.0, 0, 0.0, 18, 0.0, 1, 0, 0, 0, 0), (9, 0.0, 80, 0.0, 90, 0.0, 200, 0.0, 1, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 25, 0.0, 30, 0.0, 1, 0, 1, 1, 0),
    (30, 0.0, 40, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0, 0, 0), (8, 0.0, 60, 0.0, 60, 0.0, 8, 0.0, 1, 3, 1, 0, 0), (3, 0.0, 1, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1, 0, 0),
    (6, 0.0, 5, 0.0, 30, 0.0, 6, 0.0, 1, 0, 1, 0, 0), (40, 0.0, 2, 0.0, 3, 0.0, 40, 0.0, 1, 0, 1, 0, 0), (1, 0.0, 60, 0.0, 0, 0.0, 1, 0.0, 1, 0, 1, 0, 0),
    (90, 0.0, 3, 0.0, 40, 0.0, 130, 0.0, 1, 0, 1, 0, 0), (14, 0.0, 9, 0.0, 10, 0.0, 40, 0.0, 1, 0, 1, 0, 0), (200, 0.0, 0, 0.0, 0, 0.0, 200, 0.0, 1, 0, 0, 0, 0),
    # under names of comments, adverts, notices of the site, menus
    (60, 0.0, 60, 0.0, 0, 0.0, 200, 0.0, 0, 3, 0, 0, 0), (14, 0.0, 80, 0.0, 20, 0.0, 60, 0.0, 0, 3, 1, 0, 0), (150, 0.0, 90, 0.0, 70, 0.0, 500, 0.0, 0, 3, 0, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 9, 0.0, 0, 3, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1.0, 0, 3, 0, 0, 0), (25, 0.1, 60, 0.0, 30, 0.0, 25, 0.1, 0, 3, 1, 0, 0),
    (40, 0.0, 40, 0.0, 40, 0.0, 300, 0.0, 0, 3, 1, 0, 0), (6, 0.0, 50, 0.0, 12, 0.0, 40, 0.0, 0, 3, 1, 1, 0), (35, 0.0, 5, 0.0, 0, 0.0, 35, 0.0, 0, 3, 0, 0, 0),
    # under names of places: mostly furniture, but an article may stand there
    (20, 0.0, 60, 0.0, 2, 1.0, 24, 0.0, 0, 2, 0, 0, 0), (4, 1.0, 3, 1.0, 4, 1.0, 0, 1.0, 0, 2, 0, 0, 0), (12, 0.0, 40, 0.0, 12, 0.0, 50, 0.2, 0, 2, 1, 0, 0),
    (45, 0.0, 4, 0.0, 2, 1.0, 60, 0.1, 0, 2, 0, 0, 0), (30, 0.0, 90, 0.0, 20, 0.0, 80, 0.0, 0, 2, 1, 0, 0), (5, 0.0, 60, 0.0, 20, 0.0, 25, 0.0, 0, 2, 0, 1, 0),
    (90, 0.0, 80, 0.0, 70, 0.0, 600, 0.01, 0, 2, 0, 0, 1), (12, 0.0, 70, 0.0, 80, 0.0, 500, 0.02, 0, 2, 0, 0, 1), (60, 0.05, 50, 0.0, 9, 0.0, 450, 0.03, 0, 2, 1, 0, 1),
    # under names that articles have as well
    (60, 0.0, 50, 0.0, 40, 0.0, 60, 0.0, 0, 1, 0, 0, 1), (40, 0.0, 8, 0.0, 55, 0.0, 200, 0.0, 0, 1, 0, 0, 1), (25, 0.0, 60, 0.0, 60, 0.0, 25, 0.0, 0, 1, 1, 0, 1),
    (8, 0.0, 60, 0.0, 40, 0.0, 8, 0.0, 0, 1, 1, 0, 1), (7, 0.0, 0, 0.0, 60, 0.0, 7, 0.0, 0, 1, 1, 1, 1), (45, 0.0, 30, 0.0, 0, 0.0, 45, 0.0, 0, 1, 1, 0, 1),
    (6, 0.0, 60, 0.0, 0, 0.0, 6, 0.0, 0, 1, 0, 0, 0), (9, 0.0, 1, 1.0, 3, 0.0, 9, 0.0, 0, 1, 0, 0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 1.0, 0, 1, 0, 0, 0),
    (4, 0.0, 50, 0.0, 2, 1.0, 4, 0.5, 0, 1, 0, 0, 0), (2, 1.0, 50, 0.0, 2, 1.0, 0, 1.0, 0, 1, 1, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 1.0, 0, 1, 1, 0, 0),
    # paragraphs, headings and lists of an article element, long and short
    (9, 0.0, 12, 0.0, 40, 0.0, 150, 0.0, 0, 0, 1, 1, 1), (40, 0.0, 9, 0.0, 55, 0.0, 300, 0.0, 0, 0, 1, 0, 1), (120, 0.05, 40, 0.0, 80, 0.0, 300, 0.02, 0, 0, 1, 0, 1),
    (1, 0.0, 60, 0.0, 70, 0.0, 200, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 30, 0.0, 7, 0.0, 100, 0.0, 0, 0, 1, 0, 1), (10, 0.4, 30, 0.0, 20, 0.0, 90, 0.1, 0, 0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 40, 0.0, 120, 0.03, 0, 0, 1, 0, 1), (15, 0.0, 80, 0.0, 8, 1.0, 95, 0.1, 0, 0, 1, 0, 1), (300, 0.0, 1, 1.0, 8, 0.0, 310, 0.0, 0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0.0, 0, 0, 1, 0, 1), (2, 1.0, 3, 1.0, 60, 0.0, 60, 0.2, 0, 0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1.0, 0, 0, 1, 0, 1),
    (8, 0.0, 1, 1.0, 3, 0.0, 11, 0.0, 0, 0, 1, 1, 1), (4, 0.0, 4, 0.0, 1, 1.0, 8, 0.1, 0, 0, 1, 0, 1), (30, 0.9, 2, 0.0, 9, 0.0, 14, 0.8, 0, 0, 1, 0, 1),
    (9, 0.0, 9, 0.0, 9, 0.0, 18, 0.0, 0, 0, 1, 1, 1), (14, 0.0, 8, 0.0, 14, 0.0, 28, 0.0, 0, 0, 1, 1, 1), (4, 0.0, 20, 0.0, 3, 0.0, 7, 0.0, 0, 0, 1, 0, 1),
    (5, 0.0, 12, 0.0, 20, 0.0, 5, 0.0, 0, 0, 1, 0, 1), (12, 0.0, 3, 0.0, 12, 0.0, 24, 0.0, 0, 0, 1, 1, 1), (3, 0.0, 9, 0.0, 3, 0.0, 6, 0.0, 0, 0, 1, 1, 1),
    (3, 0.0, 3, 0.0, 16, 0.0, 6, 0.0, 0, 0, 1, 0, 1), (17, 0.0, 17, 0.0, 10, 0.0, 34, 0.0, 0, 0, 1, 0, 1), (16, 0.0, 1, 1.0, 4, 0.0, 20, 0.0, 0, 0, 1, 0, 1),
    # no article element: in one container with the other paragraphs
    (60, 0.0, 8, 0.0, 70, 0.0, 300, 0.02, 0, 0, 0, 0, 1), (35, 0.1, 3, 1.0, 50, 0.0, 200, 0.05, 0, 0, 0, 0, 1), (90, 0.0, 60, 0.0, 6, 0.0, 250, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 60, 0.0, 3, 1.0, 250, 0.02, 0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 2, 0.0, 150, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 40, 0.0, 0, 0.0, 90, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 5, 0.0, 2, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 40, 0.0, 40, 0.0, 200, 0.03, 0, 0, 0, 0, 1), (5, 0.4, 30, 0.0, 30, 0.0, 180, 0.02, 0, 0, 0, 0, 1),
    (9, 0.0, 2, 1.0, 80, 0.0, 220, 0.02, 0, 0, 0, 1, 1), (4, 0.0, 70, 0.0, 60, 0.0, 300, 0.0, 0, 0, 0, 1, 1), (2, 0.0, 70, 0.0, 4, 1.0, 140, 0.02, 0, 0, 0, 0, 1),
    # each paragraph in a container of its own
    (12, 0.0, 40, 0.0, 60, 0.0, 12, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 80, 0.0, 90, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 45, 0.0, 18, 0.0, 0, 0, 0, 0, 1),
    (13, 0.0, 45, 0.0, 50, 0.0, 13, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (45, 0.05, 2, 1.0, 2, 1.0, 43, 0.05, 0, 0, 0, 0, 1),
    (50, 0.0, 3, 0.0, 50, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (20, 0.2, 25, 0.1, 25, 0.0, 16, 0.2, 0, 0, 0, 0, 1), (40, 0.0, 30, 0.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 1),
    (24, 0.0, 30, 0.0, 28, 0.0, 24, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 1, 1.0, 60, 0.0, 8, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 40, 0.0, 50, 0.0, 5, 0.0, 0, 0, 0, 1, 1),
    (7, 0.0, 6, 0.0, 45, 0.0, 7, 0.0, 0, 0, 0, 1, 1), (250, 0.02, 0, 0.0, 0, 0.0, 245, 0.02, 0, 0, 0, 0, 1),
    (20, 0.0, 14, 0.0, 12, 0.0, 20, 0.0, 0, 0, 0, 0, 1), (22, 0.0, 18, 0.0, 16, 0.0, 22, 0.0, 0, 0, 0, 0, 1), (15, 0.0, 35, 0.0, 30, 0.0, 15, 0.0, 0, 0, 0, 0, 1),
    # the same sizes among links
    (20, 0.0, 14, 1.0, 12, 1.0, 20, 0.0, 0, 0, 0, 0, 0), (22, 0.0, 20, 0.9, 18, 0.1, 22, 0.0, 0, 0, 0, 0, 0), (24, 0.0, 30, 0.9, 28, 0.9, 24, 0.0, 0, 0, 0, 0, 0),
    (12, 0.0, 40, 0.9, 60, 0.0, 12, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 40, 0.0, 60, 0.9, 12, 0.0, 0, 0, 0, 0, 0), (26, 0.0, 30, 0.0, 25, 0.9, 26, 0.0, 0, 0, 0, 0, 0),
    (18, 0.0, 50, 0.9, 45, 0.9, 18, 0.0, 0, 0, 0, 0, 0), (16, 0.0, 25, 0.0, 30, 0.8, 16, 0.0, 0, 0, 0, 0, 0), (23, 0.0, 28, 0.8, 35, 0.0, 23, 0.0, 0, 0, 0, 0, 0),
    # teasers between links, scraps, datelines, last lines of a page, link lists
    (12, 0.0, 1, 1.0, 1, 1.0, 12, 0.0, 0, 0, 0, 0, 0), (20, 0.0, 2, 1.0, 3, 1.0, 20, 0.0, 0, 0, 0, 0, 0), (25, 0.0, 3, 1.0, 2, 1.0, 25, 0.0, 0, 0, 0, 0, 0),
    (12, 0.0, 3, 0.0, 2, 0.0, 12, 0.0, 0, 0, 0, 0, 0), (14, 0.0, 5, 0.0, 4, 0.0, 14, 0.0, 0, 0, 0, 0, 0), (16, 0.0, 1, 1.0, 4, 0.0, 16, 0.0, 0, 0, 0, 0, 0),
    (10, 0.0, 2, 1.0, 50, 0.0, 10, 0.0, 0, 0, 0, 0, 0), (13, 0.0, 3, 0.0, 50, 0.0, 13, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 50, 0.0, 0, 0.0, 8, 0.0, 0, 0, 0, 0, 0),
    (10, 0.0, 60, 0.0, 2, 1.0, 10, 0.0, 0, 0, 0, 0, 0), (12, 0.5, 40, 0.0, 3, 1.0, 6, 0.5, 0, 0, 0, 0, 0), (4, 0.0, 1, 1.0, 2, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 1.0, 0, 0, 0, 0, 0), (25, 0.9, 4, 1.0, 30, 0.8, 8, 0.9, 0, 0, 0, 0, 0), (15, 0.8, 60, 0.0, 12, 0.9, 5, 0.8, 0, 0, 0, 0, 0),
    (6, 1.0, 60, 0.0, 60, 0.0, 0, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 30, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0, 1, 0), (4, 0.0, 60, 0.0, 6, 1.0, 4, 0.0, 0, 0, 0, 1, 0),
    (5, 0.0, 1, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0, 1, 0), (2, 0.0, 6, 0.0, 5, 0.0, 2, 0.0, 0, 0, 0, 0, 0),
]


def grow(rows: list[tuple], depth: int = 12) -> tuple | float:
    """A binary decision tree by Gini impurity: (feature, threshold, low branch, high branch), or a leaf's share of label 1."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            at = (a + b) / 2
            sides = [r for r in rows if r[f] <= at], [r for r in rows if r[f] > at]
            impurity = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, at, sides
    if best is None:
        return share
    return best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1)


@cache
def tree() -> tuple | float:
    """The tree of the labelled table."""
    return grow(LABELLED)


def _classify(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node >= 0.5


class Element:
    """An open element: what it says of the blocks inside, and the words of the blocks that stand in it directly."""

    __slots__ = ("article", "container", "hint", "links", "out", "parent", "tag", "words")

    def __init__(self, tag: str, parent: Element | None, out: bool = False, hint: int = 0, article: bool = False):
        self.tag, self.parent, self.out, self.hint, self.article = tag, parent, out, hint, article
        self.container = tag not in _NO_CONTAINER
        self.words = self.links = 0

    def chain(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


_NO_CONTAINER = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre hgroup table tbody thead tfoot tr td th caption figure figcaption a b i em strong span small u s sub sup code font mark abbr cite q label time".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """A flat run of text and what it stands in."""

    __slots__ = ("article", "container", "furniture", "heading", "hints", "link_words", "text", "words")

    def __init__(self, text: str, words: int, link_words: int, within: Element):
        self.text, self.words, self.link_words = text, words, link_words
        around = list(within.chain())
        self.furniture = any(e.out for e in around)
        self.article = any(e.article for e in around)
        self.heading = any(e.tag in _HEADINGS for e in around)
        self.hints = [e for e in around if e.hint]
        self.container = next(e for e in around if e.container)
        self.container.words += words
        self.container.links += link_words

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def hint_of(names: str, in_content: bool, tag: str) -> int:
    """How plainly class names and ids speak of furniture: 0 to 3. A name counts as a whole, by its first or its last part."""
    worst, article = 0, False
    for name in re.findall(r"[^\s]+", names):
        parts = [p for p in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if not parts or parts[0] in _CONTRARY:
            continue
        level = max((n for n, words in HINTS.items() if {"-".join(parts), parts[0], parts[-1]} & words), default=0)
        worst = max(worst, level)
        article |= level == 0 and parts[-1] in _ARTICLE_WORDS
    if in_content and tag == "header" and worst == 1:
        return 0
    return max(0, worst - article)


def _element(tag: str, attrs: str, parent: Element, in_content: bool) -> Element | None:
    """What an element says of its text; None if its content is no text at all."""
    if tag in SILENT:
        return None
    names, role, hidden = "", "", False
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value) is not None
        if name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            names += " " + html.unescape(value)
    if tag in ("body", "html"):
        return Element(tag, parent, hidden)
    article = tag in CONTENT or role in ("article", "main")
    out = hidden or tag in FURNITURE or role in _ROLE_FURNITURE or tag == "header" and not in_content
    hint = hint_of(names, in_content, tag)
    if article and hint == 3:  # a comment marked up as an article
        return Element(tag, parent, out, hint)
    return Element(tag, parent, out, 0 if article else hint, article and not out)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order; unclosed and truncated markup is tolerated."""
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    root = Element("", None)
    stack: list[Element] = [root]
    within = root
    links = articles = 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, len(" ".join(linked).split()), within))
            pieces.clear()
            linked.clear()

    def add(raw: str) -> None:
        nonlocal within
        if raw and not raw.isspace():
            if not pieces or not any(p.strip() for p in pieces):
                within = stack[-1]
            if links:
                linked.append(raw)
        if raw:
            pieces.append(raw)

    def pop() -> None:
        nonlocal links, articles
        gone = stack.pop()
        links -= gone.tag == "a"
        articles -= gone.article

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            add(" ")
        if close:
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in SILENT and tag != "head":
            end = _end_of(tag).search(page, at)
            at = n if end is None else end.start()
            continue
        # a new paragraph, item or cell ends an open one
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].tag == tag:
            pop()
        new = _element(tag, attrs, stack[-1], articles > 0) if tag != "head" else Element(tag, stack[-1])
        if new.article:  # what holds an article is no furniture, whatever its name
            for e in stack:
                e.hint = 0
        stack.append(new)
        links += tag == "a"
        articles += new.article
    flush()
    return out


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![\w-])", re.I)


def main_text(page: str | None) -> str:
    """The article's text: its blocks in page order, joined by one space; empty if there is none."""
    found = blocks(page or "")
    # in a page with an article element, what stands outside it is judged as furniture
    has_article = any(b.article and not b.furniture and max((e.hint for e in b.hints), default=0) < 3 for b in found)
    sizes = [(0, 0.0), *((b.words, b.density) for b in found), (0, 0.0)]
    kept = []
    for before, b, after in zip(sizes, found, sizes[2:], strict=False):
        c = b.container
        around = (c.words - c.links, c.links / c.words if c.words else 0.0)
        out = b.furniture or has_article and not b.article
        if _classify((b.words, b.density, *before, *after, *around, int(out), max((e.hint for e in b.hints), default=0), int(b.article), int(b.heading))):
            kept.append(b.text)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row.

    Defined cases: null or empty html gives the empty text and 0; markup cut off anywhere gives what stands before the
    cut; repeated rows are each extracted; a null page_id or url stays null; other columns are not read. No shuffle.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
