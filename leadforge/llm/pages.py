"""Main-text extraction from HTML, with a host suffix array for boilerplate that markup does not name.

A page is read once as a stream of tags and text. Elements that name themselves as menus, headers,
footers, sidebars, notices, adverts, forms or comments (by tag, role, class or id) are left out. If
the page has articles or a main element, the blocks in them are the text, unless none of those is prose (a block of
at least LONG words that are not mostly links) and one beside them is: then the article is a teaser and all blocks are the page's.
Within an article only a whole known name of a class or id leaves an element out, and in its own header only bylines go.

The other pages have only unnamed blocks. The token streams of the unnamed blocks of every page
are concatenated by host and the suffixes of those streams sorted; substrings of at least LONG tokens
that occur on SHARE percent of the host's distinct pages with such blocks, and on SUPPORT at least, are
boilerplate. Where a page has no other blocks their tokens are removed, and the unique runs
stay. Only the first LONG tokens of a suffix are compared: a longer repeat is a chain of such, so
the array is cut there and its runs of equal suffixes become a grouping of (host, first tokens),
pre-aggregated before the shuffle, which no popular host or line can pull into one task. A run that
is more than ``copy_share`` of its page stays: it is a copy, not a frame.

Repeats inside articles are kept, since an article that was published twice is still one.

Defined cases: null html is empty and gives an empty text; pages with null urls share one host;
unclosed tags end with the element that holds them; rows that repeat a page count as one page; empty tables
give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadforge.llm.common import stored

LONG, SUPPORT, SHARE = 8, 3, 20
COPY = Fraction(2, 3)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe object svg canvas audio video button select option textarea dialog head title menu map".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words that name boilerplate wherever they stand in a class or id.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter "
    "subscribe sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comments commentlist disqus respond pagination pager".split()
)
#: Words that name boilerplate only where all other words of the class or id are FILLING: a share button, but no share price.
WEAK_WORDS = frozenset("promotion banner notice notices notification alert subscription signup widget widgets comment reply replies share sharing social related recommended toolbar login search".split())
FILLING = frozenset("bar box block button buttons btn container content count site page post posts area section list item items link links icon icons left right top bottom main article this tools panel inner outer wrap wrapper form header title more module group".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Filling words that may be what an article's own element is about: no part of a known name there.
OWN_WORDS = frozenset("content page post item title main article this header".split())
#: What an article's header holds besides its headings and standfirst.
BYLINE_WORDS = frozenset("byline author authors dateline date time timestamp meta metadata published posted updated reading credit credits tags tag category categories".split())
#: How a byline without a class begins; a longer block is a standfirst.
BYLINE = re.compile(r"(?:by|written|posted|published|(?:last )?updated)\b", re.I)
SIDE_PHRASES = re.compile(r"side[-_]?bar|side[-_]?nav|site[-_]?header|page[-_]?header|paywall", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Reader(HTMLParser):
    """Blocks of a page as (whether in an article or main element, whether prose, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, outside, header within an article
        self.linked = 0
        self.of_tag: Counter[str] = Counter()
        self.count = {"article": 0, "main": 0, "outside": 0, "byline": 0}
        self.parts: list[str] = []
        self.blocks: list[tuple[bool, bool, str]] = []

    def _outside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in OUTSIDE or (tag == "header" and not self.count["article"] and not self.count["main"]):
            return True
        if self.count["byline"] and tag in ("time", "address"):
            return True
        if not attrs or tag in ("html", "body"):
            return False
        a = dict(attrs)
        if "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or NO_DISPLAY.search(a.get("style") or ""):
            return True
        named = f"{a.get('class') or ''} {a.get('id') or ''}"
        names = [{w.lower() for w in WORDS.findall(name)} for name in named.split()]
        if tag in ("article", "main"):
            return any(words & COMMENT_WORDS for words in names)
        if (a.get("role") or "").lower() in OUTSIDE_ROLES:
            return True
        if self.count["article"] or self.count["main"]:
            if self.count["byline"] and any(words & BYLINE_WORDS for words in names):
                return True
            known = OUTSIDE_WORDS | WEAK_WORDS
            return any(map(SIDE_PHRASES.fullmatch, named.split())) or any(words & known and words <= known | (FILLING - OWN_WORDS) for words in names)
        return bool(SIDE_PHRASES.search(named)) or any(words & OUTSIDE_WORDS or (words & WEAK_WORDS and words <= WEAK_WORDS | FILLING) for words in names)

    def _close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            many = text.count(" ") + 1 >= LONG
            if text and (many or not self.count["byline"] or not BYLINE.match(text)):
                prose = many and 2 * self.linked < len(text)
                self.blocks.append((bool(self.count["article"] or self.count["main"]), prose, text))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            self._close_block()
        if tag in VOID:
            return
        outside = self._outside(tag, attrs)
        byline = tag == "header" and not outside
        self.count["outside"] += outside
        self.count["byline"] += byline
        if tag in ("article", "main"):
            self.count[tag] += 1
        self.open.append((tag, outside, byline))
        self.of_tag[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._close_block()
        if not self.of_tag[tag]:
            return
        while True:
            t, outside, byline = self.open.pop()
            self.of_tag[t] -= 1
            self.count["outside"] -= outside
            self.count["byline"] -= byline
            if t in ("article", "main"):
                self.count[t] -= 1
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.count["outside"]:
            self.parts.append(data)
            if self.of_tag["a"]:
                self.linked += len(" ".join(data.split()))


def split_blocks(html: str | None) -> tuple[bool, list[str], list[str]]:
    """Whether markup names the main text, the blocks of it (or all blocks), and the blocks that markup does not decide on."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close_block()
    inside, beside = [t for k, _, t in reader.blocks if k], [t for k, _, t in reader.blocks if not k]
    teaser = any(prose for k, prose, _ in reader.blocks if not k) and not any(prose for k, prose, _ in reader.blocks if k)
    if inside and not teaser:
        return True, inside, beside
    blocks = [t for _, _, t in reader.blocks]
    return False, blocks, blocks


def blocks_of(html: str | None) -> tuple[bool, list[str]]:
    """Whether markup names the main text, and the blocks of it (or all blocks)."""
    return split_blocks(html)[:2]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = [split_blocks(h) for h in pdf["html"]]
        yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "named": [n for n, _, _ in read], "blocks": [b if n else [] for n, b, _ in read], "unnamed": [u for _, _, u in read]})


def _starts(tokens: list[str]) -> np.ndarray:
    """Hash of the first LONG tokens of every suffix that is that long."""
    return np.array([xxhash.xxh3_64_intdigest("\0".join(tokens[i : i + LONG])) for i in range(len(tokens) - LONG + 1)], np.uint64).view(np.int64)


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        heads = [_starts(" ".join(b).split()) for b in pdf["unnamed"]]
        yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "named": pdf["named"], "heads": heads})


def _unique_runs(copy_share: Fraction, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for blocks, covered in zip(pdf["unnamed"], pdf["repeats"]):
            tokens = " ".join(blocks).split()
            gone = np.zeros(len(tokens) + 1, np.int64)
            if covered is not None and len(tokens) >= LONG:
                at = np.flatnonzero(np.isin(_starts(tokens), np.asarray(covered, np.int64)))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + LONG, -1)
            inside = np.cumsum(gone)[:-1] > 0
            starts, ends = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2).T
            for a, b in zip(starts, ends):
                if int(b - a) > copy_share * len(tokens):
                    inside[a:b] = False
            texts.append(" ".join(t for t, x in zip(tokens, inside) if not x))
        yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts})


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", copy_share: Fraction = COPY) -> DataFrame:
    """One row per page: id, url, text. A repeated run of over ``copy_share`` of a page that markup does not decide on is a copy and stays."""
    key_type = df.schema[key].dataType.simpleString()
    read = df.select(df[key].alias("id"), df[url].alias("url"), df[html].alias("html")).mapInPandas(_parse, f"id {key_type}, url string, named boolean, blocks array<string>, unnamed array<string>")
    read = stored(read, "blocks")
    done = read.where("named").select("id", "url", F.array_join("blocks", " ").alias("text"))
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    loose = read.where(F.size("unnamed") > 0).withColumn("host", host).withColumn("page", F.xxhash64("id", "url", "named", "unnamed"))
    heads = loose.select("host", "page", "named", "unnamed").mapInPandas(_suffixes, "host string, page bigint, named boolean, heads array<bigint>")
    shown = heads.select("host", "page", "named", F.explode(F.array_distinct("heads")).alias("head"))
    hosts = loose.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    repeats = shown.distinct().groupBy("host", "head").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= SUPPORT)
    repeats = repeats.join(hosts, "host").where(100 * F.col("pages") >= SHARE * F.col("all_pages")).select("host", "head")
    covered = shown.where(~F.col("named")).join(repeats, ["host", "head"]).groupBy("page").agg(F.collect_set("head").alias("repeats"))
    bare = read.where(~F.col("named")).withColumn("page", F.xxhash64("id", "url", "named", "unnamed"))
    joined = bare.join(covered, "page", "left").select("id", "url", "unnamed", "repeats")
    return done.unionByName(joined.mapInPandas(partial(_unique_runs, copy_share), f"id {key_type}, url string, text string"))
