"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element.  A line weighs its text outside links, times the
factors of the parts that it is in: menus, footers, forms, adverts, readers' comments and the like have small
ones, and so has what stands outside an article on a page that has one.  None of them is 0, so a part that only
looks like an advert counts if it holds much text.

1. The weights are summed over sliding windows of lines, apart for each part that has a factor.
2. The surge level comes from the page: a share of the sum that half of the page's weight reaches, at most a
   few lines of prose, and at least a small share of the peak.
3. A stretch goes from a surge, a sum of that level, as long as sums stay above the dive level, half of it.
   Its first and last heavy lines are its ends: what is between them is content.
4. The holder of a heavy line (a division, say) is content as a whole, short lines at its ends too, and so is its article but for parts with
   factors; in the page's body itself the lines of the stretch are.  Lists of links are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.kernels import extended

#: Elements that break lines.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements whose text is markup or none of the article's.
SKIPPED = frozenset("nav header footer aside form head select button textarea iframe object svg canvas template noscript dialog menu".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that hold others and are closed by name.
HOLDERS = SKIPPED | frozenset("article main section div html body table ul ol dl figure blockquote details fieldset".split())
#: Words in class, id or role that parts outside the article have.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus notice cookie cookies consent newsletter subscribe share sharing social related popup modal complementary contentinfo search".split()
)
COMMENTS = frozenset(("comment", "comments", "disqus"))
#: Words that make a class or id tell a state ("no-comments", "comments-open").
STATES = frozenset("has no with without is not hide hides show shows open opened close closed enabled disabled".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A tag at which a page breaks off.
_OPEN = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_WORD = re.compile(r"[A-Za-z]+")
#: Lines of a window.
WINDOW = 3
#: Factors: of elements that hold no article, of readers' comments, of marked and doubtful parts, of what is outside the article.
ELEMENT, COMMENT, MARKED, DOUBTFUL, OUTER = 0.02, 0.02, 0.25, 0.6, 0.1
#: An article is the page's if its largest sum is at least so large a share of what is outside.
TEASER = 0.125
#: The surge level is so large a share of the sum that half of the weight reaches, but at most so many characters, and at least so large a share of the peak.
SURGE, PROSE, PEAK = 0.25, 120, 0.05
#: What the peak's factors must at least be, so that a page of menus alone has no content.
LEAST = 0.1


def _mark(rest: str) -> str:
    """What class, id and role say: "out", "comments", "maybe" or ""."""
    found = ""
    if "=" in rest:
        for m in _MARK.finditer(rest):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                words = _WORD.findall(token)
                if token in COMMENTS or words and words[0] in COMMENTS and not STATES & set(words):
                    return "comments"
                if token in OUTSIDE:
                    found = "out"
                elif OUTSIDE & set(words):
                    found = found or "maybe"
    return found


class Line(NamedTuple):
    """A line's text, its characters outside links, its factor, the article that it is in (0: none), the outermost part with a factor (0: none), its holder and whether that is the page's body."""

    text: str
    plain: int
    factor: float
    article: int
    part: int
    holder: int
    root: bool


def lines(html: str) -> list[Line]:
    """The lines of a page in order."""
    out: list[Line] = []
    stack: list[tuple[str, float, int, bool]] = []  # open holders: name, factor, number, whether an article
    text: list[str] = []
    plain: list[str] = []  # of it, what is outside links
    link, number = False, 0

    def say(part: str) -> None:
        text.append(part)
        if not link:
            plain.append(part)

    def flush() -> None:
        nonlocal link
        link = False
        if text:
            line, weight = (" ".join(unescape("".join(x)).split()) for x in (text, plain))
            text.clear()
            plain.clear()
            if line:
                factor = 1.0
                for x in stack:
                    factor *= x[1]
                named = [x for x in stack if x[0] not in ("", "html", "body")]
                out.append(Line(line, len(weight), factor, next((x[2] for x in stack if x[3]), 0), next((x[2] for x in stack if x[1] < 1), 0), named[-1][2] if named else 0, not named))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            say(_OPEN.sub("", html[at:]))
            break
        say(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name, closing = m["name"].lower(), bool(m["end"])
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name not in BLOCKS and name not in HOLDERS:
            if name == "a":
                link = not closing
            elif name in ("br", "td", "th", "img"):
                say(" ")
            continue
        flush()
        if name not in HOLDERS:
            continue
        if closing:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if m["rest"].rstrip().endswith("/"):
            continue
        number += 1
        mark = _mark(m["rest"]) if name not in ("html", "body") else ""
        factor = {"comments": COMMENT, "out": MARKED, "maybe": DOUBTFUL}.get(mark, 1.0)
        within = any(x[3] for x in stack)
        if name in ("article", "main"):
            if any(x[1] == COMMENT and x[0] not in SKIPPED for x in stack):
                stack.append((name, factor, number, False))
            else:
                if mark == "comments":  # a reader's, unless the page's text is in it
                    factor = DOUBTFUL
                if not within:  # an article ends what was left open before it
                    stack = [x for x in stack if x[1] in (1.0, DOUBTFUL)]
                stack.append((name, factor, number, True))
        elif name == "body":
            stack = [x for x in stack if x[0] == "html"] + [(name, 1.0, number, False)]
        elif name == "header" and within:  # the article's own
            stack.append((name, factor, number, False))
        else:
            stack.append((name, min(factor, ELEMENT) if name in SKIPPED else factor, number, False))
    flush()
    return out


def windows(weights: np.ndarray) -> np.ndarray:
    """Sums of a line and those before and after it, WINDOW in all."""
    return np.convolve(weights, np.ones(WINDOW), "same") if len(weights) >= WINDOW else np.full(len(weights), weights.sum())


def surge_level(weights: np.ndarray, sums: np.ndarray, prose: float = PROSE) -> float:
    """The level of the page: see the module."""
    order = np.argsort(-sums, kind="stable")
    half = np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)
    return max(min(SURGE * sums[order[min(half, len(order) - 1)]], prose), PEAK * sums.max())


def stretches(sums: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """(first, behind the last) of each run of sums of at least the dive level, half of surge, that has a surge."""
    above = np.concatenate(([False], sums >= surge / 2, [False]))
    edges = np.flatnonzero(above[1:] != above[:-1])
    return [(i, j) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if (sums[i:j] >= surge).any()]


def main_text(html: str | None, prose: float = PROSE) -> str:
    """The text of the page's content, blocks joined by two line breaks; '' if there is none."""
    page = lines(html or "")
    if not page:
        return ""
    plain = np.array([x.plain for x in page], float)
    if not plain.any():  # links alone
        plain = np.array([len(x.text) for x in page], float)
    factors = np.array([x.factor for x in page])
    articles = np.array([x.article for x in page])
    marks, parts = factors, np.array([x.part for x in page])
    groups = [np.flatnonzero(parts == p) for p in dict.fromkeys(parts.tolist())]

    def summed(own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(page))
        for g in groups:
            out[g] = windows(own[g])
        return out

    within = articles > 0
    if within.any() and (top := summed(plain * marks * within).max()) and top >= TEASER * summed(plain * marks * ~within).max():
        factors = np.where(within, factors, factors * OUTER)
    weights = plain * factors
    sums = summed(weights)
    peak = int(np.argmax(sums))
    if not sums[peak] or marks[parts == parts[peak]].max() < LEAST:
        return ""
    surge = surge_level(weights, sums, prose)
    kept = np.zeros(len(page), bool)
    holders, told = set(), set()
    for own in groups:
        for i, j in stretches(sums[own], surge):
            heavy = own[i:j][weights[own[i:j]] >= surge / (2 * WINDOW)]
            if len(heavy):
                kept[own[(own >= heavy[0]) & (own <= heavy[-1])]] = True
                holders |= {page[k].holder for k in heavy if not page[k].root}
                told |= {page[k].article for k in heavy} - {0}
                kept[[k for k in own[i:j] if page[k].root]] = True
    kept |= np.array([x.holder in holders and not x.root or x.article in told and not x.part for x in page])
    # a holder most of whose text is links is a list of them, unless it is an article
    linked: dict[int, list[int]] = {}
    for x, n in zip(page, plain.tolist(), strict=True):
        share = linked.setdefault(x.holder, [0, 0])
        share[0] += n
        share[1] += len(x.text)
    listed = np.array([not n and x.holder != x.article and 2 * linked[x.holder][0] < linked[x.holder][1] for x, n in zip(page, plain.tolist(), strict=True)])
    return "\n\n".join(x.text for x, k in zip(page, kept & ~listed, strict=True) if k)


def extract(pages: DataFrame, prose: float = PROSE) -> DataFrame:
    """Every column of pages (it has html), with main_text (string, replaced if there).

    A null or empty page, or one without text, has ''.  Tags may be left open, and a page may break
    off: an article ends parts left open before it, and a comment or script without end takes the rest.
    """
    pages = pages.drop("main_text")
    columns = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x, prose) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), texts], names=[*columns, "main_text"])

    return pages.mapInArrow(run, extended(pages.schema, "main_text string"))
