"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page.  A line weighs its characters
outside links.  The weights of three lines in a row form the block distribution: text
surges where that sum rises above a threshold after an empty stretch and dives where it
falls to zero.  The lines from the first surge to the last dive are the text.

Elements that are never main text (menus, forms, scripts ...) and elements whose class, id
or role names such a part weigh nothing and open an empty stretch, as do the borders of
``article`` and ``main``; if those hold text, lines outside weigh nothing.  Text on both sides of a
dropped element in one parent stays together.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table

WINDOW = 3
SURGE = 80

DROPPED = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg canvas object audio video dialog menu map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
# Words of a class, id or role that name a part which is not main text, and words that may stand beside them.
NAMED = re.compile(
    r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"menu|nav|navbar|navigation|breadcrumbs?|sidebar|sidenav|rail|masthead|footer|comments?|commentlist|replies|reply|respond|disqus|"
    r"share|sharing|social|related|recommended|widget|toolbar|pagination|pager|tags|skip|search|contentinfo|complementary|dialog|form")
BESIDE = frozenset(
    "area article articles bar block body bottom box button buttons container content entry global group header icons id inner item items left line link links list main media middle outer page panel post "
    "posts primary reader right row secondary section site slot stories story text title to top unit user wrap wrapper zone".split())
PAGE_HEADER = re.compile(r"(?:site|page|top|main)?[_-]?header")


def names_aside(value: str) -> bool:
    """Whether a token of a class, id or role names an aside: one of its parts does and the others only place it."""
    for token in value.lower().split():
        parts = [p for p in re.split("[_-]+", token) if p and not p.isdigit()]
        if any(NAMED.fullmatch(p) for p in parts) and all(p in BESIDE or NAMED.fullmatch(p) for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page as (text, weight, inside article or main, elements around it); an empty text is a gap, with the dropped element's parent."""

    def __init__(self, names: bool = True):
        super().__init__(convert_charrefs=True)
        self.names, self.seen_main = names, False
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, bool, int]] = []
        self.count = 0
        self.skipped = self.links = self.mains = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, max(0, len(text) - self.linked), self.mains > 0, tuple(n for _, _, n in self.open)))
        self.parts, self.linked = [], 0

    def gap(self, bridge: bool = False) -> None:
        """An empty stretch; a dropped element's may be bridged inside its parent, unless that is the whole page."""
        self.end_line()
        parent = next(((n,) for tag, _, n in reversed(self.open) if tag not in INLINE and tag not in ("html", "body")), ()) if bridge else ()
        self.lines.append(("", 0, self.mains > 0, parent))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.end_line()
            return
        if tag in MAIN and self.skipped and not self.seen_main and not self.named(attrs):
            # An unclosed menu or advert ends where the main text begins.
            self.leave(0)
        drop = tag in DROPPED or (tag == "header" and not self.mains) or self.named(attrs) and tag not in ("html", "body")
        if drop and not self.skipped:
            self.gap(True)
        if tag not in INLINE:
            self.end_line()
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.leave(len(self.open) - 1)
        self.count += 1
        self.open.append((tag, bool(drop), self.count))
        self.skipped += bool(drop)
        self.links += tag == "a"
        if tag in MAIN and not self.skipped:
            self.gap()
            self.mains += 1
            self.seen_main = True

    def named(self, attrs) -> bool:
        """Whether class, id or role name a part that is not main text; the title block of an article stays."""
        return self.names and any(
            k in ("class", "id", "role") and v and (names_aside(v) or not self.mains and any(map(PAGE_HEADER.fullmatch, v.lower().split()))) or k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)

    def leave(self, depth: int) -> None:
        """Close every element from ``depth`` on."""
        while len(self.open) > depth:
            if self.open[-1][0] not in INLINE:
                self.end_line()
            tag, drop, _ = self.open.pop()
            if tag in MAIN and not self.skipped:
                self.mains -= 1
                self.lines.append(("", 0, False, ()))
            self.skipped -= drop
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name == tag:
                if tag in INLINE and any(t not in INLINE for t, _, _ in self.open[depth + 1:]):
                    return
                return self.leave(depth)
            if tag in INLINE and name not in INLINE and name != "a":
                return

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def bridged(lines: list[tuple[str, int, bool, tuple[int, ...]]]) -> list[tuple[str, int, bool]]:
    """Gaps as WINDOW empty lines, but for those of a dropped element with text before and after it in the same parent."""
    texts = [k for k, x in enumerate(lines) if x[0]]
    out = []
    for k, (text, weight, inside, around) in enumerate(lines):
        if text:
            out.append((text, weight, inside))
            continue
        at = bisect.bisect(texts, k)
        if not (around and 0 < at < len(texts) and around[0] in lines[texts[at - 1]][3] and around[0] in lines[texts[at]][3]):
            out += [("", 0, inside)] * WINDOW
    return out


def main_lines(lines: list[tuple[str, int, bool]], surge: int = SURGE) -> list[str]:
    """Lines from the first surge to the last dive."""
    weights = np.array([w for _, w, _ in lines], np.int64)
    inside = np.array([m for _, _, m in lines], bool)
    if (weights * inside).sum():
        weights = weights * inside
    if not weights.sum():
        return []
    blocks = np.convolve(np.concatenate([weights, np.zeros(WINDOW - 1, np.int64)]), np.ones(WINDOW, np.int64), "valid")
    # A page of short lines surges at its own highest block; an article element needs no height.
    height = 1 if inside.any() and (weights * inside).sum() else min(surge, int(blocks.max()))
    high = np.flatnonzero(blocks >= height)
    first, last = int(high[0]), int(high[-1])
    while first > 0 and blocks[first - 1] > 0:
        first -= 1
    while last + 1 < len(blocks) and blocks[last + 1] > 0:
        last += 1
    keep = inside if (weights * inside).any() else np.ones(len(lines), bool)
    return [lines[i][0] for i in range(first, min(last + WINDOW, len(lines))) if lines[i][0] and keep[i]]


def main_text(html: str | None) -> str:
    """The text of a page, one line per block; null and empty pages give ''.

    Where names leave nothing (a wrapper called after its sidebar), elements alone decide.
    """
    for names in (True, False):
        parser = Lines(names)
        parser.feed(html or "")
        parser.close()
        parser.end_line()
        if found := main_lines(bridged(parser.lines)):
            return "\n".join(found)
    return ""


def main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` columns page_id and url with ``text`` and ``n_chars``; rows are independent, nothing is shuffled."""
    out = pages.select("page_id", "url", F.pandas_udf(main_texts, "string")("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page.

    Rows are independent: repeated rows give repeated results, an empty table none, and a null
    or empty page an empty text; page_id and url are passed on, null or not.
    """
    return extract(table(spark, folder, "pages"))
