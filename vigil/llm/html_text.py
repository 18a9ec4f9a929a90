"""Main text of web pages: flat text blocks, judged by a decision tree on word counts and link density of a block and its neighbours, and
on the elements and class names around it. The tree grows from the blocks of the labelled pages of `html_labels`."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, byte_lengths, ship_code, strings
from .html_labels import PAGES

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Fixed names of elements: whose content is no text; that don't end a block; without content; that hold the article; that hold other parts.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
OTHER = frozenset("nav footer aside dialog menu button".split())
FORM = frozenset("form fieldset label".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Fixed words in class, id and role that mark parts which aren't the article.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus discussion replies reply "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar related recommended share sharing social subscribe subscription newsletter signup login search toolbar complementary contentinfo tags".split()
)
_PART = re.compile(r"[a-z]+|\d+")
#: Elements and words that mark other parts even where an article lies within.
CLOSED = frozenset("nav footer aside dialog menu".split())
CLOSED_WORDS = frozenset("related recommended sponsor sponsored promo promotion advert adverts advertisement advertising comment comments disqus discussion replies reply".split())
#: Words that make a cue the state of a page's layout: no-sidebar, comments-open. Classes, and a style, of what isn't shown.
STATE = frozenset("no has with without open closed on off enabled disabled".split())
UNSEEN = frozenset("hidden sr-only visually-hidden screen-reader-text d-none".split())
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Features of a block, in order: words and link density of itself, the block before, the block after; inside an element of another part; class
#: names say so (1 a part of a name, 2 a whole one); a page's article elsewhere; inside the article; heading.
N_FEATURES = 11


def cue(value: str) -> int:
    """How strongly a class, id or role marks another part: 2 a whole name or a part of the page that is never the article, 1 a part of a name."""
    found = 0
    for token in value.split():
        words = set(_PART.findall(token))
        if not words & STATE and words & CUES:
            found = max(found, 2 if token in CUES or words & CLOSED_WORDS else 1)
    return found


def grow(x: np.ndarray, y: np.ndarray) -> tuple | int:
    """A decision tree by Gini impurity: (feature, cut, tree below or at the cut, tree above) or a class."""
    if y.min() == y.max() or len(y) < 4:
        return int(y.mean() >= 0.5)
    found = (np.inf,)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            cost = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[left], y[~left]))
            if cost < found[0] - 1e-12:
                found = (cost, f, float(cut), left)
    if len(found) == 1:
        return int(y.mean() >= 0.5)
    _, f, cut, left = found
    return (f, cut, grow(x[left], y[left]), grow(x[~left], y[~left]))


def labelled(pages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the blocks of labelled pages."""
    x, y = [], []
    for page in pages:
        found = blocks(re.sub(r"\[(\d+)\]", lambda m: "word " * int(m[1]), page))
        x += features(found)
        y += [int(b[0].startswith("¶")) for b in found]
    return np.array(x, float), np.array(y)


@functools.cache
def tree() -> tuple | int:
    return grow(*labelled(PAGES))


def judge(features: tuple) -> int:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, other part, cue, article, heading) of each flat text block, in page order."""
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int, int, bool]] = []  # element, in another part, cue, in the article, in a part where no article counts
    opened: dict[str, int] = {}  # elements on the stack by name, so that an end tag without a start looks no further
    low = page.lower()
    closed_names = {n for n in CLOSED if f"</{n}" in low}  # one that is never closed can't be told from the rest of the page
    links = heading = 0

    def flush() -> None:
        nonlocal parts
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(html.unescape(" ".join(p for p, a in parts if a)).split())
            n = len(text.split())
            out.append((text, n, min(1.0, linked / n), *(stack[-1][1:4] if stack else (0, 0, 0)), int(heading > 0)))
        parts = []

    def leave(i: int) -> None:
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]

    at, end = 0, len(page)
    last_form = low.rfind("</form")

    def around(at: int) -> bool:
        """Whether a form that begins here holds half of the page or never ends: it says nothing about its content then."""
        return at > last_form or low.find("</form", at) - at > end / 2

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if not m[1] and name in RAW and name != "head" and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br":
            parts.append((" ", False))
        if name == "a":
            links = 0 if m[1] else 1
        if name not in INLINE:
            flush()
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = 0 if m[1] else 1
        if name in VOID:
            continue
        if m[1]:
            if opened.get(name):
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if m[3].endswith("/"):
            continue
        ended = "li" if name == "li" else "p"
        if (name in ENDS_P or name == "li") and opened.get(ended):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == ended:
                    leave(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        other, marked, main, closed = stack[-1][1:] if stack else (0, 0, 0, False)
        if name in MAIN:
            main = 1
            if not closed:
                other = marked = 0
        if name in OTHER or name == "header" and not main:
            other, closed = 1, closed or name in closed_names
        if name in FORM and (name != "form" or not around(at)):
            marked = max(marked, 1)
        if m[3] and name not in ("html", "body"):
            for key, *values in _ATTRIBUTE.findall(m[3]):
                key, value = key.lower(), "".join(values).lower()
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _NOT_SHOWN.search(value) or key == "class" and UNSEEN & set(value.split()):
                    other, closed = 1, True
                elif key in ("class", "id", "role") and name not in MAIN:
                    found = cue(value)
                    marked, closed = max(marked, found, int(not main and "header" in value and name != "h1")), closed or found == 2
        stack.append((name, other, marked, main, closed))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def features(found: list[tuple]) -> list[tuple]:
    """Of each block, what the tree looks at."""
    has_article = any(b[5] for b in found)
    out = []
    for i, (_, words, density, other, marked, main, heading) in enumerate(found):
        before, after = found[i - 1][1:3] if i else (0, 0.0), found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        out.append((words, density, *before, *after, other, marked, int(has_article and not main), main, heading))
    return out


def main_text(page: str) -> str:
    """The main blocks of a page, joined by blank lines."""
    found = blocks(page)
    return "\n\n".join(b[0] for b, x in zip(found, features(found)) if judge(x))


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html. A null or empty page, and one without main text, gives
    an empty text; broken markup is read as far as it goes; repeated rows are read each; an empty table gives an empty
    result. One narrow stage; a page is read in one pass, so a very long one only takes its own time."""
    ship_code(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for a, b in by_bytes(byte_lengths(batch.column(0)), 4 << 20):
                text = [main_text(p) for p in strings(batch.column(0).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(html_col, *keep).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
