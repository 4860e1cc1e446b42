"""Main text of web pages by tag-path ratios.

A page's text is taken apart into units: the text that one block element holds itself. Units are gathered by the path of
block tags above them. For each root-to-leaf path, length of text and number of punctuation marks per unit are
aggregated (text to tag path ratio, punctuation to tag path ratio) and fused as their geometric mean. It is smoothed over
neighbours in page order, the more the nearer their paths are in the tree, so that headings and list items among
paragraphs share in these, and weighted with the path's share of link text and with what the names and kinds of its
elements say. Paths that reach a share of the best one's score are the content, and units are selected by their paths.

The element that holds most of these paragraphs is the story's. What else stands in it without a name or kind of its own, such as a list of
linked sources or lines in bare divs, is part of it between its paragraphs, and below a heading of its own.

Names (class, id, role) are a weight: the threshold is relative, a name that only partly speaks of something else counts
little, one of an element that holds nearly all of the page's text counts nothing, and one of a paragraph or another part of
text counts only where its ratio is low, unless it says that readers wrote it. Inline elements have no path, whatever their names, but for those that
aren't shown and those whose whole name is an advert's. What HTML itself keeps for other things (navigation, footers, asides, buttons, scripts) holds no content wherever it
stands: a pull quote in an aside is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp title textarea".split())
#: Elements that hold no content, wherever they stand.
NEVER = frozenset("nav footer aside button select menu canvas svg object video audio map head option datalist".split())
#: Elements that mostly hold none; a header within an article is that article's.
RARELY = {"header": 0.03, "form": 0.03, "dialog": 0.03, "fieldset": 0.03, "label": 0.03}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BLOCKS = frozenset(
    "html body main article section div p ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre address hr details summary search center figure figcaption".split()
) | HEADINGS | NEVER | RARELY.keys()
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - frozenset(["html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "button", "label", "select", "option", "canvas", "svg", "object", "video", "audio", "map", "head"])
#: An element of the left kind ends an open one of the right kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}
#: Words in class, id or role that speak against content.
NOT_CONTENT = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead topbar footer bottombar sidebar aside widget related recommended recommendations share sharing social "
    "cookie cookies consent notice gdpr popup modal overlay newsletter "
    "subscribe subscription signup login search pagination pager tags toolbar hidden skip complementary contentinfo dialog "
    "alert disclaimer copyright legal form".split()
)
#: Whole names of inline adverts.
ADVERTS = frozenset("ad ads advert advertisement adsense sponsored".split())
#: Words that mark what readers wrote.
READERS = frozenset("comment comments comentarios kommentare respond disqus reply replies".split())
#: Words that say nothing of what an element is for.
NEUTRAL = frozenset("area article articles bar block body bottom box column container content element group inner item items left link links list main module page panel post posts region right row section site text title top widget wrap wrapper".split())
#: Units that are paragraphs, headings, items or cells by their tag take part in their neighbours' text whole, others by LOOSE.
PARTS = frozenset("p li dt dd td th caption figcaption blockquote pre summary address".split()) | HEADINGS
LOOSE = 0.1
#: First words of the names that blogs give an article by its subjects.
SUBJECTS = ("category", "tag")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡\"'()«»“”„–—-]")

#: Weights of an element whose names all speak against content, of one with such a word among others, of one that isn't
#: shown, of an article within an article (a comment or teaser), of what lies beside the articles that hold most text,
#: (and of articles beside most text), and of what an article's header holds besides headings.
NAMED, MENTIONED, UNSEEN, NESTED, BESIDE, HEADER = 0.01, 0.2, 0.01, 0.03, 0.1, 0.3
#: An element that holds this part of the page's text is no advert or notice, whatever its name.
MASS, READERS_MASS = 0.75, 0.97
#: Neighbours that a unit is smoothed with on each side, and the greatest distance of their paths in the tree.
NEIGHBOURS, DISTANCE = 4, 8
#: A path is content from this part of the best path's score on.
THRESHOLD = 0.06
#: A part of text is talk, whatever its name, from this part of the best ratio on.
TALK = 0.3
#: What stands in the story's element has this part of the best score, times what its names and kinds say; down to so many steps.
STORY, STEPS = 0.1, 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.DOTALL,
)
_MARK = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z]+")


@dataclass
class Unit:
    """Text that a block holds itself: its path's number, its block, its text, characters in links, and element."""

    path: int
    block: int
    parts: list[str]
    linked: int
    element: int

    @property
    def text(self) -> str:
        return "".join(self.parts).strip()


class Page:
    """Units in page order; elements and paths as trees by parent numbers, so depth costs nothing."""

    def __init__(self) -> None:
        self.units: list[Unit] = []
        self.tags, self.parents, self.signs = [""], [0], [""]
        self.elements = [0]  # the path of each block element
        self._known: dict[tuple, int] = {}
        #: Of each path: tag, parent, depth, what its element's names say.
        self.paths: list[tuple[str, int, int, str]] = [("", 0, 0, "")]

    def element(self, tag: str, parent: int, sign: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.signs.append(sign)
        above = self.elements[parent]
        key = (above, tag, sign)
        if key not in self._known:
            self._known[key] = len(self.paths)
            self.paths.append((tag, above, self.paths[above][2] + 1, sign))
        self.elements.append(self._known[key])
        return len(self.tags) - 1

    def distance(self, a: int, b: int) -> int:
        """Steps between two paths in the tree; beyond DISTANCE it isn't told."""
        steps = 0
        while a != b and steps <= DISTANCE:
            if self.paths[a][2] >= self.paths[b][2]:
                a = self.paths[a][1]
            else:
                b = self.paths[b][1]
            steps += 1
        return steps


def _names(value: str, tag: str) -> str:
    """What a name says: "n" (all its words speak against content), "m" (some do), "r" (readers), or nothing."""
    words = [w for w in _WORDS.findall(value)]
    if not words or words[0] in ("has", "with", "no", "without", "not"):
        return ""  # tells of what is elsewhere (has-sidebar)
    if tag == "article" and (value.startswith(tuple(f"{x}-" for x in SUBJECTS)) or value == "comments-open"):
        return ""
    if any(w in READERS for w in words):
        return "r" if all(w in READERS | NEUTRAL | NOT_CONTENT for w in words) else "m"
    if not any(w in NOT_CONTENT for w in words):
        return ""
    return "n" if all(w in NOT_CONTENT or w in NEUTRAL for w in words) else "m"


def _sign(attributes: str, tag: str) -> str:
    """What an element's attributes say: "h" for hidden, else the strongest of what its names do, and those names."""
    if not attributes.strip():
        return ""
    said = set()
    for m in _MARK.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "h"
        if name in ("class", "id", "role"):
            said |= {f"{x} {v}" for v in value.split() if (x := _names(v, tag))}
    return next((" ".join(sorted(said)) if x == "m" else f"{x} {' '.join(sorted(said))}" for x in "rnm" if any(v[0] == x for v in said)), "")


def parse(page: str) -> Page:
    """Units of a page, in page order.

    Unclosed and misnested tags are read as browsers mostly do: an end tag closes up to its start tag, or nothing; a new
    block ends an open paragraph."""
    out = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, block element, never content
    open_tags: dict[str, int] = {}
    block, at = 0, 0

    def text(upto: int) -> None:
        if upto > at and not stack[-1][2]:
            piece = page[at:upto]
            last = out.units[-1] if out.units and out.units[-1].block == block else None
            if piece.isspace():
                if last:
                    last.parts.append(" ")
                return
            piece = html.unescape(piece)
            path = out.elements[stack[-1][1]]
            if not last or last.path != path:
                last = Unit(path, block, [], 0, stack[-1][1])
                out.units.append(last)
            last.parts.append(piece)
            if open_tags.get("a"):
                last.linked += len(piece.strip())

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    def close(names: tuple[str, ...], within: frozenset[str]) -> None:
        """Close the nearest open element of these names, unless one of ``within`` is nearer."""
        if not any(open_tags.get(n) for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in within:
                return

    scopes = frozenset(["table", "td", "th", "article", "section", "div", "body", "html", "ul", "ol", "dl", "blockquote", *NEVER, *RARELY])
    lists = frozenset(["table", "ul", "ol", "dl", "select"])
    i = 0
    while (start := page.find("<", i)) >= 0:
        m = _TOKEN.match(page, start)
        if not m:
            i = start + 1
            continue
        text(start)
        i = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            if tag in BLOCKS:
                block += 1
            continue
        if tag in ENDS_P:
            close(("p",), scopes)
        if tag in ENDS:
            close(ENDS[tag], lists)
        if tag in BLOCKS:
            block += 1
        elif tag == "br" and out.units and out.units[-1].block == block:
            out.units[-1].parts.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, i)
            i = at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        sign = "" if tag in ("html", "body", "main") else _sign(m[3], tag)
        # Inline elements are no part of a path, unless they aren't shown or are adverts by their whole name.
        apart = sign == "h" or sign[:1] == "n" and not ADVERTS.isdisjoint(sign.split())
        number = out.element(tag, stack[-1][1], sign) if tag in BLOCKS or apart else stack[-1][1]
        stack.append((tag, number, stack[-1][2] or tag in NEVER))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text(len(page))
    return out


def path_weights(page: Page, sizes: list[int], ratios: list[float]) -> list[float]:
    """Weight of each path from the kinds and names of its elements. sizes: characters of each unit; ratios: of each path."""
    talk = TALK * max(ratios)
    total = max(1, sum(sizes))
    held = [0] * len(page.tags)
    for u, n in zip(page.units, sizes, strict=True):
        held[u.element] += n
    for e in range(len(held) - 1, 0, -1):  # parents have smaller numbers
        held[page.parents[e]] += held[e]
    # The names of a path count unless one of its elements holds most of the page.
    most = [0.0] * len(page.paths)
    for e, n in enumerate(held):
        most[page.elements[e]] = max(most[page.elements[e]], n / total)
    weights, within = [1.0], [False]
    for k, (tag, above, _, sign) in enumerate(page.paths[1:], 1):
        w = weights[above]
        if tag in PARTS and sign[:1] in ("n", "m") and ratios[k] >= talk:
            sign = ""
        if sign[:1] == "h":
            w *= UNSEEN
        elif sign[:1] == "r" and most[k] < READERS_MASS or sign[:1] == "n" and most[k] < MASS:
            w *= NAMED
        elif sign[:1] == "m" and most[k] < MASS:
            w *= MENTIONED
        if tag == "article" and within[above]:
            w *= NESTED
        elif tag == "header" and within[above]:
            w *= HEADER
        elif tag in RARELY and most[k] < MASS:
            w *= RARELY[tag]
        elif tag in HEADINGS and page.paths[above][0] == "header" and within[above]:
            w /= HEADER
        weights.append(w)
        within.append(within[above] or tag in ("article", "main"))
    inside = sum(n for u, n in zip(page.units, sizes, strict=True) if within[u.path] and weights[u.path] >= HEADER)
    whole = sum(n for u, n in zip(page.units, sizes, strict=True) if weights[u.path] >= HEADER)
    # Articles hold the page's text, or they are its teasers.
    held_by = 2 * inside > whole
    return [w if i == held_by else w * BESIDE for w, i in zip(weights, within, strict=True)] if any(within) else weights


def _steps_to(page: Page, path: int, above: int) -> int:
    """Steps up from a path to one above it; STEPS if there are more, or it isn't above."""
    steps = 0
    while path != above:
        if steps == STEPS or page.paths[path][2] <= page.paths[above][2]:
            return STEPS
        path, steps = page.paths[path][1], steps + 1
    return steps


def _lift(page: Page, own: list[float], weights: list[float], score: list[float]) -> None:
    """Raise the scores of what stands in the story's element: the one whose parts of text hold most."""
    best, mass = max(own), [0.0] * len(page.paths)
    strong = [own[u.path] >= THRESHOLD * best and page.paths[u.path][0] in PARTS for u in page.units]
    for u, s in zip(page.units, strong, strict=True):
        if s:
            mass[page.paths[u.path][1]] += len(u.text)
    story = max(range(len(mass)), key=mass.__getitem__)
    places = [i for i, u in enumerate(page.units) if strong[i] and page.paths[u.path][1] == story]
    # Below a heading that follows the last paragraph the story goes on to its end.
    inside = [0 < _steps_to(page, u.path, story) < STEPS for u in page.units]
    if places and any(page.paths[u.path][0] in HEADINGS and page.paths[u.path][1] == story and weights[u.path] >= weights[story] for u in page.units[places[-1] + 1 :]):
        places.append(max(i for i, within in enumerate(inside) if within) + 1)
    if not places or 2 * mass[story] < sum(mass):
        return
    lies, all_ = [0] * len(mass), [0] * len(mass)
    for i, u in enumerate(page.units):
        all_[u.path] += 1
        lies[u.path] += places[0] < i < places[-1]
    for k in range(1, len(mass)):
        if 2 * lies[k] > all_[k] and 0 < _steps_to(page, k, story) < STEPS:
            score[k] = max(score[k], STORY * best * min(1.0, weights[k] / weights[story]))


def content_paths(page: Page) -> set[int]:
    """Paths whose smoothed, fused and weighted ratio reaches the threshold."""
    units, n = page.units, len(page.paths)
    length, marks, links, count = ([0.0] * n for _ in range(4))
    sizes = []
    for u in units:
        t = u.text
        sizes.append(len(t))
        length[u.path] += len(t)
        marks[u.path] += len(PUNCTUATION.findall(t))
        links[u.path] += min(u.linked, len(t))
        count[u.path] += 1
    fused = [0.0 if not c else (x / c * (m + 0.1) / c) ** 0.5 * (1 - k / max(1.0, x)) ** 2 for x, m, k, c in zip(length, marks, links, count, strict=True)]
    gauss = [math.exp(-(k**2) / 8) for k in range(NEIGHBOURS + 1)]
    weights = path_weights(page, sizes, fused)
    score = [f * w for f, w in zip(fused, weights, strict=True)]
    own = list(score)
    for i, u in enumerate(units):
        share = 1.0 if page.paths[u.path][0] in PARTS else LOOSE
        # A path that is nearly all links takes no part in its neighbours' text.
        share *= (1 - links[u.path] / max(1.0, length[u.path])) ** 2
        for j in range(max(0, i - NEIGHBOURS), min(len(units), i + NEIGHBOURS + 1)):
            v = units[j].path
            most = gauss[abs(i - j)] * share * min(own[v], fused[v] * weights[u.path])
            if v != u.path and most > score[u.path] and (d := page.distance(u.path, v)) <= DISTANCE:
                score[u.path] = max(score[u.path], most / (1 + d))
    _lift(page, own, weights, score)
    cut = THRESHOLD * max((score[u.path] for u in units), default=0.0)
    return {u.path for u in units if score[u.path] >= cut}


def main_text(page: str | None) -> str:
    """Main text of a page: units on content paths as blocks in page order, joined by line ends; empty if there is none."""
    if not page:
        return ""
    parsed = parse(page)
    parsed.units = [u for u in parsed.units if u.text]
    if not parsed.units:
        return ""
    paths = content_paths(parsed)
    lines: dict[int, list[str]] = {}
    for u in parsed.units:
        if u.path in paths:
            lines.setdefault(u.block, []).extend(u.parts)
    joined = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(x for x in joined if x)


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    pages: needs page_id, url, html; other columns are not read. Null or empty html, and pages without content: empty
    text, 0. Text after an unclosed tag or comment belongs to it. Repeated rows are read one by one; an empty table
    gives no rows. One narrow pass over whole pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
