"""Pages, archives and conversations."""

import base64
import collections
import gzip
import hashlib

import pytest
from pyarrow import fs

from leadforge.llm import chat, pages, warc
from leadforge.llm.common import shared_dir

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header class="site"><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; <b>line</b></h1><p>By someone</p></header><p>First&nbsp;part<br>goes   on.<p>Sec<i>ond</i> one</p>
<div class="ad">Buy!</div><aside>Side</aside><form><input>Ask</form><ul><li>a</li><li>b</li></ul><section id="comments"><p>Nice post</p></section></article>
</main><div class="sidebar">Links</div><footer>&copy; us</footer></body></html>"""


def test_article_without_its_frame():
    assert pages.blocks_of(PAGE) == (True, ["Head & line", "First part goes on.", "Second one", "a", "b"])


@pytest.mark.parametrize("html,text", [
    (None, []), ("", []), ("plain words", ["plain words"]), ("<p>a<p>b", ["a", "b"]), ("<p>a &lt;b&gt; &#233; &bogus;</p>", ["a <b> é &bogus;"]),
    ("<div><p>open <b>bold<p>next", ["open bold", "next"]), ("<main>x<div hidden>y</div></main>z", ["x"]), ("<p>a</p><!-- no --><p style='display: none'>b</p>", ["a"]),
    ("<article class=comment>c</article><article>real</article>", ["real"]), ("<script>never closed", []),
])
def test_blocks(html, text):
    assert pages.blocks_of(html)[1] == text


def test_repeated_runs_of_a_host_are_removed(spark):
    frame = "welcome to the site of all good things here"
    rows = [(i, "http://a.example/x", f"<p>{frame}</p><p>{i} is the story of item {i}</p>") for i in range(5)]
    rows += [(10, "http://b.example/", f"<p>{frame}</p>"), (11, None, None), (12, "http://a.example/y", f"<p>{frame}</p>"), (13, "http://a.example/z", f"<article>{frame}</article>")]
    got = {x["id"]: x["text"] for x in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"{i} is the story of item {i}" for i in range(5))
    assert got[10] == got[12] == got[13] == frame and got[11] == ""
    assert pages.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/", "same"), (2, "http://a/\r\n2", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", "x\r\n\r\nWARC/1.0\r\n\r\n"), (7, "u", "same"), (7, "u", "same"), (None, "n", "same"), (None, "n", "alone")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(2)
    folder = shared_dir(spark)
    manifest = warc.write_archives(df, folder, least_bytes=least)
    chunks = warc.read_archives(manifest, folder, chunk_bytes=1000)
    got = warc.records(chunks)
    newest = {}
    for i, _, h in ROWS:
        newest[digest(h)] = max((x for x in (newest.get(digest(h)), i) if x is not None), default=None)
    want = []
    for i, _, h in ROWS:
        top = newest[digest(h)]
        to = None if i == top or top is None or len((h or "").encode()) < least else top
        want.append((i, len((h or "").encode()), digest(h), "response" if to is None else "revisit", to, True))
    assert sorted(map(repr, map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()))) == sorted(map(repr, want))
    long = sorted(((x["chunk_no"], bytes(x["data"])) for x in chunks.where("record_id = 5").collect()))
    assert len(long) == 140 and b"".join(d for _, d in long) == ("é" * 70_000).encode()
    store, root = fs.FileSystem.from_uri(folder)
    texts = [gzip.decompress(store.open_input_file(x["path"]).readall()) for x in manifest.select("path").distinct().collect()]
    assert sum(t.count(b"WARC-Record-ID") for t in texts) == len(ROWS)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    talk = [("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "more"), (None, None), ("user", "bye")]
    convs = {1: talk[:1], 2: talk[:3], 3: talk, 4: talk, 5: talk[:2] + [("user", "other")], 6: [("user", "hi"), ("user", "hi")], None: [("user", "lost")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [rows[0], (7, None, "user", "first"), (7, 3, "user", "then")]
    convs[7] = [("user", "first"), ("user", "then")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3), part_turns=2).collect()
    parts = collections.defaultdict(dict)
    for x in got:
        parts[x["id"]][x["part"]] = (x["n_turns"], x["text"])

    def text(turns):
        return "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in turns)

    assert set(parts) == {3, 5, 6, 7, None}
    for c in parts:
        assert "".join(parts[c][p][1] for p in sorted(parts[c])) == text(convs[c])
        assert sum(n for n, _ in parts[c].values()) == len(convs[c])
    assert chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
