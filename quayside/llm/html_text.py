"""Main text of web pages by text-to-tag ratios (operator 1).

A page is read as a stream of the standard library's parser events and cut into lines at
block tags. Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian and
lines over the threshold are seeds. The elements that hold the seeds are the content region,
and all their lines are the text, short ones too, save furniture. Tags such as ``nav`` are
furniture always; class and id names only say so of an element that does not hold the
page's, or its article's, text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.selectors import LinearParser
from .common import texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is never shown as text, those that never hold the article's, and headings.
UNSEEN = frozenset("head title script style noscript template svg iframe object canvas audio video select textarea datalist".split())
FURNITURE = frozenset("nav header footer aside menu button dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name furniture.
NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead footer sidebar aside ad ads adv advert adverts advertisement "
    "adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "breadcrumb breadcrumbs disqus discussion share sharing social related recommended newsletter subscribe "
    "subscription signup login pagination pager toolbar widget skip print".split()
)
#: The words of readers' comments, which can be <article> elements too.
COMMENT = frozenset(
    "comment comments commenter commentlist reply replies respond responses disqus reactions kommentar kommentare "
    "commentaire commentaires comentario comentarios opiniones commenti reacties".split()
)
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that a following start tag closes.
CLOSES = {k: frozenset(v.split()) | {"p"} for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
PARAGRAPH = frozenset(["p"])
#: Blocks that hold one piece of a text, never all of it.
LEAVES = HEADINGS | frozenset("p li dt dd td th pre blockquote".split())
#: What an element is, by itself.
PLAIN, NAMED, COMMENTS, HARD, HIDDEN = range(5)
#: So many like elements, one after the other, are a thread of replies if each begins with a line this short.
THREAD, BYLINE = 3, 60
#: A heading at most so many lines before the text is its own.
NEAR = 3
#: A named element, or one of comments, that holds this share of the text around it is not furniture.
MOST, NEARLY_ALL = 0.8, 0.95


def _kind(tag: str, attrs: dict[str, str | None]) -> int:
    if tag in UNSEEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or UNSHOWN.search(attrs.get("style") or ""):
        return HIDDEN
    if tag in FURNITURE:
        return HARD
    if tag in ("html", "body", "main"):
        return PLAIN
    words = [x.lower() for x in NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")]
    names = {x for before, x in zip(["", *words], words, strict=False) if before not in ("has", "with", "no", "without")}
    if not names.isdisjoint(COMMENT):
        return COMMENTS
    if tag == "article":
        return PLAIN
    return NAMED if tag == "form" or (attrs.get("role") or "").lower() in ROLES or not names.isdisjoint(NAMES) else PLAIN


class _Page(LinearParser):
    """Elements (tag, kind, parent, which comes before them) and lines (text, tags, characters in
    links, innermost element). Every step takes constant time, but for what it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.kinds, self.parents, self.classes = [""], [PLAIN], [-1], [""]
        self.open = [0]  # element ids
        self.at: dict[str, list[int]] = {}  # where in ``open`` each tag stands
        self.blocks: list[int] = []  # where in it blocks stand
        self.text: list[str] = []
        self.count, self.linked, self.links = 0, 0, 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.menus: list[int] = []  # links of each line

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.count, self.linked, self.open[-1]))
            self.menus.append(self.links)
            self.count = 0
        self.text, self.linked, self.links = [], 0, 0

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            self.at[self.tags[self.open.pop()]].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        said = dict(attrs)
        kind, block = _kind(tag, said), tag not in INLINE
        if block or kind:
            self.line()
        self.count += 1
        self.links += tag == "a"
        if tag in VOID:
            return
        if block and self.blocks and self.tags[self.open[self.blocks[-1]]] in CLOSES.get(tag, PARAGRAPH):
            self.pop_to(self.blocks[-1])
        self.parents.append(self.open[-1])
        self.tags.append(tag)
        self.classes.append(said.get("class") or "")
        self.kinds.append(HIDDEN if self.kinds[self.open[-1]] == HIDDEN else kind)
        self.at.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        # the slash means nothing on HTML elements, save inside svg and math
        if tag not in VOID and self.kinds[self.open[-1]] == HIDDEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        where = self.at.get(tag)
        # an inline element's end does not reach out of the block it is in
        if where and not (tag in INLINE and self.blocks and where[-1] < self.blocks[-1]):
            if tag not in INLINE or self.kinds[self.open[where[-1]]]:
                self.line()
            self.pop_to(where[-1])
        self.count += 1

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.at.get("a"):
            self.linked += len(data.strip())


def read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    page.line()
    return page


def _under(parents: list[int], own: list[float]) -> list[float]:
    """Sums over each element and all in it; parents come before their children."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def threads(page: _Page) -> list[bool]:
    """Elements that are replies by their structure, whatever they are called: at least three of one tag
    and class under one parent, without headings, each a short line and then a longer one, after
    other text outside that parent."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    like: dict[tuple, list[int]] = {}
    for i in range(1, n):
        if tags[i] in ("div", "li", "article", "section") and (page.classes[i] or tags[i] == "article"):
            like.setdefault((parents[i], tags[i], page.classes[i]), []).append(i)
    groups = {k: v for k, v in like.items() if len(v) >= THREAD}
    out = [False] * n
    if not groups:
        return out
    member = {i: k for k, v in groups.items() for i in v}
    above = [0] * n  # the nearest element around each, or itself, that is one of many alike
    for i in range(1, n):
        above[i] = i if i in member else above[parents[i]]
    headed, first, longer, before, written = [False] * n, {}, set(), {}, 0
    for i in range(1, n):
        if tags[i] in HEADINGS and above[i]:
            headed[above[i]] = True
    for text, _, linked, at in page.lines:
        i = above[at]
        if i:
            before.setdefault(member[i], written)
            if i not in first:
                first[i] = len(text)
            elif len(text) > first[i]:
                longer.add(i)
        elif linked < len(text) / 2 and tags[at] in ("p", "blockquote", "pre"):
            written += len(text)
    for k, v in groups.items():
        said = [i for i in v if i in first]
        reply = [i for i in said if first[i] <= BYLINE and i in longer and not headed[i]]
        if len(reply) >= THREAD and len(reply) == len(said) and before.get(k, 0) > 0:
            for i in v:
                out[i] = True
    return out


def furniture(page: _Page) -> list[bool]:
    """Whether each element is furniture or in some.

    A named element is none if it holds most of the text of the article it is in. Outside
    articles it is none if it holds all the page's articles, or most of the text of a page that
    has none. Of a header in an article the headings stay.
    """
    n, tags, parents, replies = len(page.tags), page.tags, page.parents, threads(page)
    kinds = [COMMENTS if r and k in (PLAIN, NAMED) else k for k, r in zip(page.kinds, replies, strict=True)]
    hard, comments, scope = [False] * n, [False] * n, [0] * n
    core = [0.0] * n
    for i in range(1, n):
        p = parents[i]
        scope[i] = p if tags[p] in ("article", "main") and not comments[p] else scope[p]
        comments[i] = comments[p] or kinds[i] == COMMENTS
        hard[i] = hard[p] or kinds[i] >= HARD
    own = [0.0] * n
    for text, _, _, at in page.lines:
        if not hard[at]:
            own[at] += len(text)
    size = _under(parents, own)
    for i in range(1, n):
        core[i] = float(tags[i] in ("article", "main") and size[i] > 0 and not hard[i] and not comments[i])
    cores = _under(parents, core)
    out, header = [False] * n, [False] * n
    for i in range(1, n):
        p, kind = parents[i], kinds[i]
        if out[p]:
            out[i] = not (header[p] and tags[i] in HEADINGS)
            header[i] = header[p]
            continue
        if kind >= HARD:
            out[i] = True
            header[i] = tags[i] == "header" and kind == HARD and scope[i] > 0
        elif kind:
            around = size[scope[i]]
            share = size[i] / around if around else 1.0
            if scope[i] or kind == COMMENTS:
                out[i] = share < (MOST if kind == NAMED else NEARLY_ALL)
            else:
                out[i] = cores[0] > cores[i] or not cores[i] and share < MOST
    return out


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian of ``sigma`` lines, cut at three sigma; edges repeat."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, r, mode="edge"), k / k.sum(), mode="valid")


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.85) -> str:
    """The article's text: blocks in page order, one space between words.

    Null, empty or without any text outside menus and the like: ''. Characters in links do not
    count for a line's ratio. Of several <article> elements all that hold a seed are taken; if
    they, or else <main>, hold too little of what the ratios point to, the region is the smallest
    element with ``share`` of it, and lines of two or more links only, and runs of three or more
    lines that are only links, are left out there. The nearest headings just before the text
    belong to it, even outside its element. What a page opens and never closes is text.
    """
    if not html:
        return ""
    page = read(html)
    out, parents, tags = furniture(page), page.parents, page.tags
    if not page.lines:
        return ""
    size = np.array([max(0, len(t) - linked) for t, _, linked, _ in page.lines], float)
    kept = np.array([not out[at] for *_, at in page.lines])
    smoothed = smooth(size / np.maximum(1, [n for _, n, _, _ in page.lines]), sigma)
    low = min(smoothed.std(), smoothed.mean())
    seeds = kept & (smoothed >= low)
    if not seeds.any():
        seeds = kept
    own = [0.0] * len(tags)
    for (*_, at), n, seed in zip(page.lines, size, seeds, strict=True):
        own[at] += n * seed
    weight = _under(parents, own)
    inside = [False] * len(tags)
    for kind in ("article", "main"):
        tops, held = [False] * len(tags), 0.0
        for i in range(1, len(tags)):
            tops[i] = tops[parents[i]] or tags[i] == kind and weight[i] > 0 and not out[i]
            held += weight[i] if tops[i] and not tops[parents[i]] else 0.0
        if held >= 0.3 * weight[0] and held:
            inside = tops
            break
    if not any(inside):
        region = max((i for i in range(len(tags)) if weight[i] >= share * weight[0] and tags[i] not in INLINE and tags[i] not in LEAVES), default=0)
        inside[region] = True
        for i in range(region + 1, len(tags)):
            inside[i] = inside[parents[i]]
        links = np.array([linked >= 0.9 * len(t.replace(" ", "")) for t, _, linked, _ in page.lines])
        for run in np.split(np.arange(len(links)), np.flatnonzero(np.diff(links)) + 1):
            if links[run[0]]:
                kept[run] = (len(run) <= 2) & (np.array(page.menus)[run] < 2)
    told = kept & np.array([inside[at] for *_, at in page.lines])
    return " ".join(page.lines[k][0] for k in np.flatnonzero(with_headings(page, kept, told)))


def with_headings(page: _Page, kept: np.ndarray, told: np.ndarray) -> np.ndarray:
    """``told`` with the headings just before its first line, and the few lines between."""
    under = [False] * len(page.tags)
    for i in range(1, len(under)):
        under[i] = under[page.parents[i]] or page.tags[i] in HEADINGS
    before = np.flatnonzero(kept[: np.argmax(told)])[::-1] if told.any() else []
    top, between = None, 0
    for k in before:
        if under[page.lines[k][3]]:
            top, between = k, 0
        elif (between := between + 1) > NEAR or top is not None:
            break
    out = told.copy()
    if top is not None:
        out[before[before >= top]] = True
    return out


def text_of(html: Column | str, sigma: float = 1.0, share: float = 0.85) -> Column:
    """``main_text`` of a column of pages."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(x, sigma, share) for x in texts_of(pages)], pa.string())

    return arrow_udf(run, "string")(html)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, whatever its html.

    Null and empty html give an empty text; repeated rows each give one row.
    """
    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
