"""Boilerplate of a host by its repeated runs."""

import random
import re
import time

import pytest

from leadforge.llm import pages

SCHEMA = "page_id bigint, url string, html string"


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def texts(spark, rows):
    return {x["id"]: x["text"] for x in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_phrase_of_few_pages_of_a_large_host_stays(spark):
    phrase = "as everyone in the old town has always known"
    html = [f"<p>{words('frame', 12)}</p><p>{words(f'a{i}x', 20)} {phrase if i < 4 else words(f'c{i}x', 3)} {words(f'b{i}x', 20)}</p>" for i in range(40)]
    got = texts(spark, [(i, f"http://a.example/{i}", h) for i, h in enumerate(html)])
    for i in range(40):
        assert got[i] == f"{words(f'a{i}x', 20)} {phrase if i < 4 else words(f'c{i}x', 3)} {words(f'b{i}x', 20)}"


def test_a_mirrored_article_is_not_a_frame(spark):
    article = words("story", 60)
    got = texts(spark, [(i, f"http://a.example/{i}", f"<p>{article}</p><p>{words(f'buy{i}x', 5)}</p>") for i in range(3)])
    assert all(article in got[i] for i in range(3))


def test_unnamed_blocks_beside_an_article_show_the_frame(spark):
    frame = words("frame", 10)
    rows = [(i, f"http://a.example/{i}", f"<div>{frame}</div><article>{words(f'told{i}x', 30)}</article>") for i in range(4)]
    rows += [(9, "http://a.example/9", f"<div>{frame}</div><p>{words('bare', 30)}</p>")]
    got = texts(spark, rows)
    assert got[9] == words("bare", 30) and all(got[i] == words(f"told{i}x", 30) for i in range(4))


@pytest.mark.parametrize("html,text", [
    ("<main><p>Intro</p><article><p>Body</p></article><p>Tail</p></main>", ["Intro", "Body", "Tail"]),
    (f"<div><article><p>Read on</p></article></div><div><p>{words('body', 60)}</p></div>", ["Read on", words("body", 60)]),
    ("<article><p>Shares</p><table class='share-price'><tr><td>12 p</td></tr></table><div class='share-buttons'>Tell</div><div class='searchResults'>found</div></article>", ["Shares", "12 p", "found"]),
    ("<article><p>a</p><div class='post'>b</div><div id='related-posts'>c</div><div class='x related'>d</div></article>", ["a", "b"]),
])
def test_what_markup_decides(html, text):
    assert pages.blocks_of(html)[1] == text


LINKS = {n: "".join(f"<li><a href='/{i}'>link{i}</a></li>" for i in range(n)) for n in (50, 70)}


@pytest.mark.parametrize("html,text", [
    *((f"<article><p>{words('told', 20)}</p></article><ul>{x}</ul>", [words("told", 20)]) for x in LINKS.values()),
    (f"<article><p>{words('told', 20)}</p></article><div><a href='/'>{words('menu', 90)}</a></div>", [words("told", 20)]),
    (f"<article><p>{words('told', 8)}</p></article><div>{words('more', 90)}</div>", [words("told", 8)]),
    (f"<article><a href='/more'>{words('read', 9)}</a></article><div>{words('body', 9)}</div>", [words("read", 9), words("body", 9)]),
    ("<article><div class='modal-verbs'>can may</div><p class='navigation-history'>compass</p><div class='login-content'>user</div><div id='cookie-banner'>yes</div></article>", ["can may", "compass", "user"]),
    ("<article><header><h1>Head</h1><p>Standfirst</p><p class='byline'>By A B</p><time>today</time><address>here</address></header><p>Body</p></article>", ["Head", "Standfirst", "Body"]),
    ("<div class='modal-verbs'>can</div><div class='text'>may</div>", ["may"]),
])
def test_shapes_and_names_decide_not_sizes(html, text):
    assert pages.blocks_of(html)[1] == text


def test_unclosed_and_stray_tags_take_linear_time():
    began = time.perf_counter()
    html = "<div>" * 20_000 + "<p>text</p>" + "</span>" * 20_000 + "</div>" * 30_000 + "<p>end</p>"
    assert pages.blocks_of(html)[1] == ["text", "end"]
    assert time.perf_counter() - began < 5


def brute(rows):
    """Unique runs of pages without markup, by comparing all token runs of a host."""
    tokens = {i: " ".join(re.findall(r"<p>(.*?)</p>", h)).split() for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    out = {}
    for i, t in tokens.items():
        mates = [j for j in tokens if host[j] == host[i]]
        inside = [False] * len(t)
        for a in range(len(t) - pages.LONG + 1):
            run = t[a : a + pages.LONG]
            on = sum(any(tokens[j][b : b + pages.LONG] == run for b in range(len(tokens[j]))) for j in mates)
            if on >= pages.SUPPORT and 100 * on >= pages.SHARE * len(mates):
                inside[a : a + pages.LONG] = [True] * pages.LONG
        a = 0
        while a < len(t):
            b = a
            while b < len(t) and inside[b]:
                b += 1
            if 3 * (b - a) > 2 * len(t):
                inside[a:b] = [False] * (b - a)
            a = b + 1
        out[i] = " ".join(w for w, x in zip(t, inside) if not x)
    return out


def test_host_runs_against_brute_force(spark):
    rng = random.Random(8)
    frames = [words(f"frame{k}x", rng.randint(6, 14)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [f"<p>{words(f'own{i}x{k}y', rng.randint(1, 12))}</p>" for k in range(3)] + [f"<p>{f}</p>" for f in rng.sample(frames, rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, f"http://h{rng.choice('aaabc')}.example/{i}", "".join(parts)))
    assert texts(spark, rows) == brute(rows)


def test_clashing_columns_and_very_long_pages(spark):
    long = words("word", 60_000)
    df = spark.createDataFrame([(1, "http://a.example/", f"<article>{long}</article>"), (2, "http://a.example/", f"<p>{long}</p>"), (None, None, None)], SCHEMA)
    df = df.selectExpr("*", "'x' AS id", "'x' AS host", "'x' AS page", "'x' AS named", "'x' AS blocks", "'x' AS text")
    got = {x["id"]: x["text"] for x in pages.main_text(df).collect()}
    assert got == {1: long, 2: long, None: ""}
