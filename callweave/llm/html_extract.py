"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser is fed the page and reports events; each block of text becomes a line with the number of
tags that stand in and before it. Lines that structure marks as menus, adverts, forms and the like count as empty. The
ratio of text to tags along the page is smoothed; lines over the threshold form clusters. The clusters choose the region,
which is the article with most of their text, or without one the containers that hold their lines, and they decide about
lines whose marks may be an article's own, and about lists of links within it. The rest of the region's text is returned
whole. Text of dropped elements that stand within a line, as scripts and hidden parts do, is no part of the line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that begin a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noscript option script select style svg template textarea title".split()
)
#: Roles, and words of classes and ids, that mark such elements.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr "
    "menu nav navbar navigation newsletter notice outbrain pagination promo promoted promotion replies share sharing sidebar signup social "
    "sponsor sponsored subscribe taboola".split()
)
#: Words that may mark such elements, or parts of an article; the clusters decide.
MAYBE = frozenset("masthead modal notification pager popup recommended related respond search skip toolbar widget".split())
#: Those that mark an element only outside of the article: within, a header holds its heading.
OUTER_MARKS = frozenset("header banner".split())
#: Blocks of text. An article's own may have any class, so the clusters decide about those of a marked one.
TEXT_BLOCKS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 p pre".split())
#: How a notice begins that is no article's last line.
NOTICE = re.compile(r"(?:©|\(c\)|copyright\b)", re.IGNORECASE)
NOTICE_CHARS = 120
#: Elements that hold an article.
HOLDERS = frozenset(["article", "main"])
#: Elements that can hold an article's lines where none of those is; others are blocks of it or parts of blocks.
CONTAINERS = frozenset("body center details div html section table tbody td tr".split())
WORD = re.compile(r"[a-z0-9]+")
WHITE = re.compile(r"\s+")
MARKUP = re.compile(r"<[a-zA-Z/!?]")


#: What an element is, and what its descendants are with it.
DROP, DOUBT, IN_HOLDER = 1, 2, 4


@dataclass
class Line:
    text: str
    tags: int
    element: int  # the innermost one around it, 0 for none
    linked: int  # characters of it in links


class Lines(HTMLParser):
    """Lines of a page, and its elements by number: their parents and flags. Each event costs the same, however deep."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.tags = self.linked = 0
        self.parts: list[str] = []
        self.parent, self.flags = [0], [0]
        self.holders: set[int] = set()
        self.containers: set[int] = set()
        #: Open elements as (tag, number, blocks that were open then), and those of each tag that no end tag has met.
        self.open: list[tuple[str, int, int]] = []
        self.unmet: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of blocks among the open elements
        self.links = 0

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            element = self.open[-1][1] if self.open else 0
            if self.skips():  # the line began around what is skipped
                while self.flags[element] & DROP:
                    element = self.parent[element]
            self.lines.append(Line(text, self.tags, element, self.linked))
            self.tags = self.linked = 0

    def skips(self) -> bool:
        """Whether a dropped element is open within a line that isn't dropped itself."""
        if not self.open or not self.flags[self.open[-1][1]] & DROP:
            return False
        return not self.blocks or not self.flags[self.open[self.blocks[-1]][1]] & DROP

    def cut(self, size: int) -> None:
        """Close open elements down to ``size``."""
        while len(self.open) > size:
            tag, number, _ = self.open.pop()
            if self.unmet[tag] and self.unmet[tag][-1] == len(self.open):
                self.unmet[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
            self.close_implied(tag)
        if tag in VOID:
            return
        up = self.open[-1][1] if self.open else 0
        number = len(self.parent)
        holder = tag in HOLDERS or dict(attrs).get("role") in HOLDERS
        self.parent.append(up)
        self.flags.append(self.flags[up] | self.kind(tag, attrs, bool(self.flags[up] & IN_HOLDER)) | IN_HOLDER * holder)
        if holder:
            self.holders.add(number)
        if tag in CONTAINERS:
            self.containers.add(number)
        self.unmet.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, len(self.blocks)))
        if tag in BLOCKS:
            self.blocks.append(len(self.open) - 1)
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.unmet.get(tag):
            return
        at = self.unmet[tag][-1]
        # an inline element doesn't end blocks that were begun within it
        if tag in BLOCKS or self.open[at][2] == len(self.blocks):
            self.cut(at)
        else:
            self.unmet[tag].pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "canvas", "iframe", "object") and self.open and self.open[-1][0] == tag:
            self.cut(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if self.skips():
            return
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data)

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; items and cells end their like."""
        ends = {"p"} | {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(tag, set())
        if tag == "body":
            if self.unmet.get("head"):
                self.cut(self.unmet["head"][-1])
            return
        for at in reversed(self.blocks):
            own = self.open[at][0]
            if own in ends:
                self.cut(at)
                return
            if own not in ("p", "li", "dd", "dt", "tr", "td", "th"):
                return

    def kind(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
        """DROP, DOUBT or 0; ``inside``: within an element that may hold the article."""
        if tag in DROPPED:
            return DROP
        if tag in ("html", "body"):
            return 0
        if tag == "header" and not inside:
            return DROP
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return DROP
        if (a.get("role") or "").lower() in ROLES:
            return DROP
        names = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        words = set(WORD.findall(names))
        if tag in HOLDERS and not inside:
            return DROP * bool(words & {"comment", "comments", "related", "promo", "ad", "sponsored"})
        if words & MARKS or not inside and words & OUTER_MARKS:
            # within the article a word that is but a part of a name says little
            whole = not inside or bool(MARKS & set(names.split()))
            return DROP if whole and tag not in TEXT_BLOCKS else DOUBT
        return DOUBT * bool(words & MAYBE)


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[j]) for w, j in zip(kernel, range(i - radius, i + radius + 1), strict=True) if 0 <= j < len(ratios)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def content_lines(lines: list[Line], flags: list[int], sigma: float) -> set[int]:
    """Numbers of the lines that are not dropped and whose smoothed ratio reaches the standard deviation: the clusters."""
    gone = [bool(flags[x.element] & DROP) for x in lines]
    ratios = [0.0 if no else len(x.text) / max(1, x.tags) for x, no in zip(lines, gone, strict=True)]
    if not any(ratios):
        return set()
    soft = smoothed(ratios, sigma)
    mean = sum(soft) / len(soft)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in soft) / len(soft)), max(x for x, no in zip(soft, gone, strict=True) if not no))
    return {i for i, x in enumerate(soft) if x >= threshold and not gone[i]}


def regions(page: Lines, kept: list[int], chosen: set[int]) -> list[bool]:
    """For each element whether it, or one around it, is a region; ``kept``: numbers of the lines that aren't dropped.

    Of articles the one with most of the clusters' text is the region. Without any, regions are the innermost containers
    of cluster lines; a container of a single line is a paragraph by another name, and the next one around it counts.
    """
    weight, own = [0] * len(page.parent), [0] * len(page.parent)
    for i in kept:
        own[page.lines[i].element] += 1
        weight[page.lines[i].element] += len(page.lines[i].text) * (i in chosen)
    for n in range(len(page.parent) - 1, 0, -1):
        own[page.parent[n]] += own[n]
        weight[page.parent[n]] += weight[n]
    within = [False] * len(page.parent)
    if held := [n for n in page.holders if weight[n]]:
        within[max(held, key=lambda n: (weight[n], n))] = True
        for n in range(1, len(page.parent)):
            within[n] = within[n] or within[page.parent[n]]
        return within
    # the container that counts for each element
    around = [0] * len(page.parent)
    for n in range(1, len(page.parent)):
        around[n] = n if n in page.containers and own[n] > 1 else around[page.parent[n]]
    hold = {around[page.lines[i].element] for i in chosen}
    return [around[n] in hold for n in range(len(page.parent))]


def whole_tags(html: str) -> str:
    """``html`` without a tag that its end cuts off: the parser would look for the end of each such tag anew."""
    last = html.rfind(">") + 1
    broken = MARKUP.search(html, last)
    return html[: broken.start()] if broken else html


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks, joined by a line feed; empty if there is none. Null counts as empty."""
    page = Lines()
    page.feed(whole_tags(html or ""))
    page.close()
    page.flush()
    lines = page.lines
    chosen = content_lines(lines, page.flags, sigma)
    if not chosen:
        return ""
    kept = [i for i, x in enumerate(lines) if not page.flags[x.element] & DROP]
    article = any(page.flags[lines[i].element] & IN_HOLDER for i in chosen)
    if not article:  # a line of links by the side of the text is a menu's, whatever smoothing lends it
        chosen = {i for i in chosen if 2 * lines[i].linked < len(lines[i].text)} or chosen
    within = regions(page, kept, chosen)
    first, last = min(chosen), max(chosen)

    def stays(i: int) -> bool:
        x = lines[i]
        if not article and len(x.text) <= NOTICE_CHARS and NOTICE.match(x.text):
            return False
        if i in chosen:
            return within[x.element]
        if page.flags[x.element] & DOUBT:
            return False
        if article:
            return within[x.element] and i not in listed
        return first < i < last or within[x.element] and 2 * x.linked < len(x.text)

    # beside the clusters, lines of links that follow one another are a list of links, in an article too
    links = [i for i in kept if i not in chosen and 2 * lines[i].linked >= len(lines[i].text)]
    place = {i: k for k, i in enumerate(kept)}
    listed = {i for a, b in zip(links, links[1:], strict=False) if place[b] == place[a] + 1 for i in (a, b)}
    return "\n".join(lines[i].text for i in kept if stays(i))


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    A null or empty html gives the empty text, as does one without any text outside of menus and the like. A page is
    read whole by one task, and no page meets another, so memory is bounded by the longest page, and time is in proportion
    to its length however deep its markup. Repeated rows give repeated results; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": [main_text(x, sigma) for x in part["html"]]})

    kind = pages.schema["page_id"].dataType.simpleString()
    # ids go through Python as strings: a column of longs with a null in it would become floats there
    rows = pages.select(pages["page_id"].cast("string").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    found = rows.mapInPandas(run, "page_id string, url string, text string")
    return found.withColumn("page_id", found["page_id"].cast(kind))
