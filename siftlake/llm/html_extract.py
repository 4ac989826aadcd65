"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks: runs of text with the same nearest block element. A block's path is the element names (of containers
also their classes and id) from the root to that element. For each path of a page the text length and the punctuation of its
blocks are summed and divided by their number; these two ratios are laid along the page, smoothed over neighbouring blocks of
the same container and fused into one score. Scores are smoothed over the tree of paths, too: a heading or a short list has a
share of the score of its container's best path, or of its article's. Paths whose score reaches a share of the page's greatest
are content, whatever they are called.

Names are a tie-break. What a class, id, role or element calls navigation, header, footer, notice, advert, form, sidebar or
comment weighs less; and where such text is as long as the rest, so that ratios cannot tell a reader's comment from an article, or a
short article from a footer, the names decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import free_name, slices, small_batches, text_or_empty

#: A path is content from this share of the page's greatest score; weight of the smoothing window around a block.
THRESHOLD, WINDOW = 0.25, (0.25, 0.5, 0.25)
#: The share of its container's best path, and of its article's, that a path has; the weight of a path that names speak against.
NEAR, FAR, MARKED_WEIGHT = 0.5, 0.3, 0.3
#: Names decide where the greatest product of a path's ratios is, of the other blocks, less than so many times that of the marked
#: ones, and not (outside an article) less than this share of it.
ALIKE, FAINT = 2.5, 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that show no text of the page.
NEVER = frozenset("head script style title noscript template iframe object svg canvas audio video button select option textarea input label datalist xmp noembed noframes".split())
#: Elements that are not the article's by their meaning; forms and headers in case, see Element.
APART = frozenset("nav aside footer dialog menu".split())
#: An element that starts closes these, as far up as one of the elements after the colon.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
#: Names of what is not the article, as whole classes and ids: one of these nouns, maybe with a place before and a kind of box after it.
NOUNS = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations trending sidebar sidenav aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer foot header head masthead topbar toolbar comment comments commentlist disqus reply replies respond feedback form search widget skiplink copyright legal disclaimer hidden offscreen"
).split()
PLACES = "site page main global top bottom left right post article entry user reader social cookie search login newsletter related".split()
BOXES = "area list section container wrapper wrap box block bar banner links menu item items form notice posts articles stories widget slot unit popup modal overlay buttons consent nav".split()
MARK = re.compile(rf"(?:(?:{'|'.join(PLACES)})[-_])?({'|'.join(NOUNS)})(?:[-_](?:{'|'.join(BOXES)}|\d+))?")
COMMENT = frozenset("comment comments commentlist disqus reply replies respond".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar status".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>|<!\[CDATA\[""", re.S)
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[^\W_]+")
#: Elements that belong to the container around them.
INNER = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hgroup blockquote pre table thead tbody tfoot tr td th caption figure figcaption details summary address".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
Path = tuple[str, ...]


class Element:
    """An open element. marks: it and elements around it that names speak against; size: the text in it."""

    __slots__ = ("name", "step", "hidden", "article", "marks", "soft", "size")

    def __init__(self, name: str, attributes: str, within: "Element | None"):
        names: list[str] = []
        self.name, self.size, self.soft = name, 0, True
        self.hidden = bool(within and within.hidden) or name in NEVER
        self.article = bool(within and within.article) or name in ("article", "main")
        hard = name in APART or name == "header" and not self.article
        if attributes and not attributes.isspace():
            for key, value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id"):
                    names += value.split()
                elif key == "role":
                    hard |= value in ROLES
                    self.article |= value in ("main", "article")
                elif key == "itemprop":
                    self.article |= value == "articlebody"
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden |= name not in ("html", "body")
        # the heading of an article stands in its own header
        nouns = {m[1] for m in map(MARK.fullmatch, names) if m and not (self.article and m[1] in ("header", "head"))}
        marked = hard or name in ("form", "fieldset") or bool(nouns) and name not in ("html", "body", "article", "main")
        # a layout, too, can be a form or have such a name: then it holds half of the page's text
        self.soft = not hard and not nouns & COMMENT
        self.marks: tuple[Element, ...] = (within.marks if within else ()) + ((self,) if marked else ())
        self.step = name if name in INNER else ".".join([name, *sorted(set(names))])


class Block(NamedTuple):
    """A run of text. marked: whether names speak against it; article: whether an article or main element holds it."""

    path: Path
    text: str
    marked: bool
    article: bool


class TagEnds:
    """Where tags end: at the first > outside quoted values, however long; at the first > at all if a quote is not closed.

    A quote from which the end of the page was reached once is not followed again, so a page takes linear time.
    """

    def __init__(self, page: str):
        self.page, self.last, self.lost = page, {c: page.rfind(c) for c in ">\"'"}, set()

    def end(self, start: int) -> int:
        """The place of the > that ends the tag whose name ends at start, or -1."""
        if start > self.last[">"]:
            return -1
        at, quotes = start, []
        while m := STOP.search(self.page, at):
            at = m.start()
            c = m[0]
            if c == ">":
                return at
            if at in self.lost or at >= self.last[c]:
                break
            quotes.append(at)
            at = self.page.find(c, at + 1) + 1
        self.lost.update(quotes)
        return self.page.find(">", start)


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    raw: list[tuple[Path, list[tuple[str, tuple[Element, ...]]], Element | None]] = []
    stack: list[Element] = []
    parts: list[tuple[str, tuple[Element, ...]]] = []
    pos = total = 0

    def flush() -> None:
        if parts:
            k = next((k for k in range(len(stack), 0, -1) if stack[k - 1].name in BLOCK), 0)
            raw.append((tuple(e.step for e in stack[:k]), parts.copy(), stack[k - 1] if k else None))
            parts.clear()

    def close(k: int) -> None:
        if any(e.name in BLOCK for e in stack[k:]):
            flush()
        del stack[k:]

    def say(text: str) -> None:
        nonlocal total
        if text and not (stack and stack[-1].hidden):
            marks, size = stack[-1].marks if stack else (), len(text.strip())
            parts.append((html.unescape(text) if "&" in text else text, marks))
            total += size
            for e in marks:
                e.size += size

    ends, at = TagEnds(page), 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[pos:])
            break
        name, stop = (m[2] or "").lower(), m.end()
        if name:
            stop = ends.end(m.end()) + 1
            if not stop:  # no tag: the < is text
                at = m.start() + 1
                continue
        say(page[pos : m.start()])
        pos = at = stop
        if not name:
            continue
        if m[1]:
            if name == "br":
                parts.append(("\n", ()))
                continue
            inline = name not in BLOCK
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if inline and stack[k].name in BLOCK:
                    break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(("\n", ()))
            continue
        attributes = page[m.end() : stop - 1]
        if name in BLOCK:
            names = [e.name for e in stack]
            if "p" in names and name not in ("html", "body", "head", "option"):
                close(len(names) - 1 - names[::-1].index("p"))
            if name in CLOSES:
                which, stop = CLOSES[name]
                cut = len(stack)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in stop:
                        break
                    if stack[k].name in which:
                        cut = k
                close(cut)
            if name in ("html", "body") and any(e.name == name for e in stack):
                continue
            if name == "body":
                close(next((k for k, e in enumerate(stack) if e.name == "head"), len(stack)))
            flush()
        element = Element(name, attributes, stack[-1] if stack else None)
        if attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, pos)
            pos = at = end.end() if end else len(page)
            continue
        stack.append(element)
    flush()
    counts = lambda e: not e.soft or 2 * e.size < total
    out = []
    for path, said, last in raw:
        own = last.marks if last else ()
        marked = any(map(counts, own))
        # a marked inline element within a block is left out
        text = " ".join("".join(t for t, marks in said if marked or not any(map(counts, marks[len(own) :]))).split())
        if text:
            out.append(Block(path, text, marked, bool(last and last.article)))
    return out


def path_sums(found: list[Block]) -> dict[Path, tuple[int, int, int]]:
    """Of each path: characters, punctuation marks, and blocks on the page."""
    sums: dict[Path, tuple[int, int, int]] = {}
    for b in found:
        size, marks, n = sums.get(b.path, (0, 0, 0))
        sums[b.path] = size + len(b.text), marks + len(PUNCTUATION.findall(b.text)), n + 1
    return sums


def path_ratios(found: list[Block]) -> np.ndarray:
    """Of each block's path: characters, and punctuation marks, for each block of it."""
    sums = path_sums(found)
    return np.array([[sums[b.path][0] / sums[b.path][2], sums[b.path][1] / sums[b.path][2]] for b in found])


def element(step: str) -> str:
    return step.split(".")[0]


def container(path: Path) -> Path:
    k = len(path)
    while k and element(path[k - 1]) in INNER:
        k -= 1
    return path[:k]


def article_of(path: Path) -> Path:
    """The path down to the outermost article element; empty if there is none."""
    k = next((k for k, step in enumerate(path, 1) if element(step) == "article"), 0)
    return path[:k]


def scores(found: list[Block]) -> list[float]:
    """Each block's path's score: the mean over its blocks of the smoothed and fused ratios, smoothed over the tree of paths."""
    ratio, homes = path_ratios(found), [container(b.path) for b in found]
    smooth = WINDOW[1] * ratio
    for k, step in ((0, -1), (2, 1)):
        beside = np.array([j if 0 <= (j := i + step) < len(found) and homes[j] == homes[i] else i for i in range(len(found))])
        smooth += WINDOW[k] * ratio[beside]
    fused = smooth[:, 0] * (1 + smooth[:, 1])
    each: dict[Path, list[float]] = {}
    for b, s in zip(found, fused.tolist()):
        each.setdefault(b.path, []).append(s)
    own = {p: sum(x) / len(x) for p, x in each.items()}
    near: dict[Path, float] = {}
    far: dict[Path, float] = {}
    for b, home in zip(found, homes):
        near[home] = max(near.get(home, 0.0), own[b.path])
        if not b.marked:
            whole = article_of(b.path)
            far[whole] = max(far.get(whole, 0.0), own[b.path])
    far[()] = 0.0
    return [max(own[b.path], NEAR * near[home], FAR * far.get(article_of(b.path), 0.0)) * (MARKED_WEIGHT if b.marked else 1.0) for b, home in zip(found, homes)]


def names_decide(found: list[Block]) -> list[Block]:
    """Where marked and other blocks are much alike, those that names do not speak against (in an article, if there are such); else all."""
    sums, most = path_sums(found), {True: 0.0, False: 0.0}
    for b in found:
        size, marks, n = sums[b.path]
        most[b.marked] = max(most[b.marked], size / n * (1 + marks / n))
    inside = [b for b in found if b.article and not b.marked]
    if most[False] >= ALIKE * most[True] or not inside and most[False] < FAINT * most[True]:
        return found
    return inside or [b for b in found if not b.marked] or found


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    found = blocks(page)
    if not found:
        return ""
    found = names_decide(found)
    score = scores(found)
    least = threshold * max(score)
    return " ".join(b.text for b, s in zip(found, score) if s >= least)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pages without html, with text (the main text, empty if none) and n_chars (its code points).

    The whole html is read; null is empty. Columns of pages named text or n_chars, in whatever case, are replaced. Repeated
    rows get equal results and an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    names, own = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")], free_name(pages, "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, own, 1 << 21):
                texts = [main_text(h, threshold) for h in some.column(own).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in names)
    return pages.select(*names, text_or_empty("html").alias(own)).mapInArrow(run, schema + "text string, n_chars bigint")
