"""Element table of saved HTML: one row per element, from which signals, links and contacts are plain aggregates.

Texts are held once, by the elements that need them: an anchor knows the first year in its parent's text and the
landmarks that it stands in, so rows do not grow with the depth of a page or with the number of links in a paragraph.
A page without any element has one row with an empty tag and its text; an empty or null page has none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

ELEMENTS = "pos int, tag string, attrs map<string,string>, text string, parent_year string, landmarks array<string>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose own text signals need.
TEXT_OF = frozenset("a address body footer form h1 h2 h3 h4 h5 h6 script style title".split())
LANDMARKS = frozenset("nav header footer main aside".split())
YEAR = re.compile("(?:19|20)[0-9]{2}")
#: Rows that are passed on at once.
FRAME_ROWS = 5_000


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int, int, list[int]]] = []  # tag, row, first piece of text, rows of its anchors
        self.of_tag: Counter[str] = Counter()
        self.landmarks: list[str] = []
        self.pieces: list[str] = []
        self.footers: set[int] = set()  # rows that name themselves footers

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":  # anchors do not nest
            self.handle_endtag(tag)
        row = len(self.rows)
        self.rows.append([row, tag, {k: v or "" for k, v in attrs}, "", None, list(self.landmarks)])
        if tag == "a" and self.open:
            self.open[-1][3].append(row)
        if tag not in VOID:
            if any(k in ("class", "id") and "footer" in (v or "") for k, v in attrs):
                self.footers.add(row)
            self.open.append((tag, row, len(self.pieces), []))
            self.of_tag[tag] += 1
            if tag in LANDMARKS:
                self.landmarks.append(tag)
        elif tag == "br":
            self.pieces.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.of_tag[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, row, first, anchors = self.open.pop()
        self.of_tag[tag] -= 1
        if tag in LANDMARKS:
            self.landmarks.pop()
        if tag in TEXT_OF or anchors or row in self.footers:
            text = "".join(self.pieces[first:])
            if tag in TEXT_OF or row in self.footers:
                self.rows[row][3] = text
            if anchors and (year := YEAR.search(text)):
                for anchor in anchors:
                    self.rows[anchor][4] = year[0]
        return tag

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)


def elements(html: str | None) -> list[list]:
    """Rows of a document in order; unclosed elements end with their parent."""
    p = _Elements()
    p.feed(html or "")
    p.close()
    while p.open:
        p._close()
    return p.rows or ([[0, "", {}, "".join(p.pieces), None, []]] if html else [])


def html_elements(df: DataFrame, key: str, html: str, tags: frozenset[str] | None = None) -> DataFrame:
    """Element table of a column of HTML, with ``tags`` of these elements alone. Filter before it: nothing is pushed below it."""
    key_type = df.schema[key].dataType.simpleString()
    names = [key, "pos", "tag", "attrs", "text", "parent_year", "landmarks"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[list] = []
            for k, text in zip(pdf["key"].astype(object), pdf["html"]):
                held += [[k, *row] for row in elements(text) if tags is None or row[1] in tags]
                if len(held) >= FRAME_ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return df.select(df[key].alias("key"), df[html].alias("html")).mapInPandas(run, f"`{key}` {key_type}, {ELEMENTS}")
