import hashlib
import html
import re

import numpy as np
import pytest

from quarry.llm import html_text, warc

SF001 = "/root/testdata/sf0.001"


# ---- operator 8

def brute(page):
    a = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    a = re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", a)
    return " ".join(html.unescape(re.sub(r"<(/?[a-zA-Z!][^>]*)>", " ", a)).split())


def test_articles_match_brute_force(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = {r["page_id"]: (r["url"], brute(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(want)
    for i, (url, text) in want.items():
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<header><h1>The site</h1><nav><ul><li><a href=x>Home<li><a>About us and much more of it</a></ul></nav></header>
<div id="cookie-notice">We use cookies. This text is fairly long so that it could look like content.</div>
%s
<aside>Side text that is fairly long and could be mistaken for content of the page.</aside>
<section class="comments"><p>Nice article, I liked it a lot and have much more to say about all of it.</p></section>
<form>Subscribe <input name=q><button>Go</button></form>
<script>var s = "<p>not text</p>";</script><footer>&copy; foot</footer></body></html>"""
BODY = """<h1>A title</h1><p>First long <b>para</b>graph &amp; many words in it, that goes on for a while, &lt;here&gt;.
<p>Ok.</p><div class="advert">Buy this now, it is cheap and there are many words here.</div>
<ul><li>one item<li>another <i>item</i></ul><p>Last&nbsp;paragraph,<br>which also has a number of words to be counted.</p>"""
TEXT = ("A title First long paragraph & many words in it, that goes on for a while, <here>. Ok. one item another item "
        "Last paragraph, which also has a number of words to be counted.")


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div><div id=x>%s</div></div>",
                                    "<nav><a>open menu<article>%s</article>"])
def test_templates(around):
    assert html_text.main_text(PAGE % (around % BODY)) == TEXT


def para(word, n):
    return "<p>" + " ".join([word] * n) + "</p>"


@pytest.mark.parametrize("page, words", [
    (f"<div id=post><div>{para('first', 85) * 5}</div><div>{para('last', 75)}</div></div>", {"first": 425, "last": 75}),
    (f"<body><article>{para('one', 60)}</article><article>{para('two', 40)}</article></body>", {"one": 60, "two": 40}),
    (f"<main><article>{para('one', 55)}</article><div>{para('two', 45)}</div></main>", {"one": 55, "two": 45}),
    (f"<body><article>{para('one', 55)}</article><div>{para('two', 45)}</div></body>", {"one": 55, "two": 45}),
    (f"<article>{para('one', 50)}<section id=related-work>{para('work', 50)}</section><h2 id=comments-on-results>Results</h2>{para('r', 50)}</article>",
     {"one": 50, "work": 50, "Results": 1, "r": 50}),
    (f"<div>{para('one', 50)}<section id=related-work><h3 id=comments>Work</h3>{para('w', 50)}</section></div>", {"one": 50, "Work": 1, "w": 50}),
    (f"<article>{para('one', 50)}<div class='share-buttons'>{para('s', 50)}</div><div id=cookie-notice>{para('c', 50)}</div>"
     f"<section class='x comments'>{para('k', 50)}</section></article>", {"one": 50}),
])
def test_no_content_region_is_lost(page, words):
    assert html_text.main_text(page).split() == [w for word, n in words.items() for w in [word] * n]


A = " ".join(["Long article words that go on and on with sense."] * 6)
B = " ".join(["Second paragraph of the article has words too."] * 6)
ART = f"<h1>Title</h1><p>{A}</p><p>Short.</p><p>{B}</p>"
ALL = f"Title {A} Short. {B}"
HARD = [
    *[(f'<body><nav><a>Home</a></nav><div class="{c}">{ART}</div><div class="comments"><p>first! {A}</p></div></body>', ALL)
      for c in ("content with-sidebar", "has-comments", "navbar-fixed page", "social-science", "sidebar")],
    (f'<article>{ART}</article><section class="comments"><article class="comment">{A}</article></section>', ALL),
    (f'<article>{ART}<section class="comments"><article>{A} x</article></section></article><aside><article>{B} tease</article></aside>', ALL),
    (f'<article><p>one two <button>Share</button> three <span class="ad">buy now</span> {A}</p><select><option>x</option></select></article>',
     f"one two three {A}"),
    (f"<body><ul><li><a>Home</a><li><a>News</a><li><a>About us</a></ul>{ART}<p>Copyright 2024 Someone</p></body>", ALL),
    (f"<body><p>{A}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{B}</p></body>", f"{A} {B}"),
    (f"<div id=post><div>{A}</div><div>The last part.</div></div>", f"{A} The last part."),
    (f"<main><article>{A}</article><div>{B}</div></main>", f"{A} {B}"),
    (f'<div class="cookie-banner">We use cookies<article>{ART}</article>', ALL),
    (f"<aside><article>{ART}</article></aside>", ALL),
]


@pytest.mark.parametrize("page, text", HARD)
def test_boxes_comments_menus_and_inline_boilerplate(page, text):
    assert html_text.main_text(page) == text


def test_regions_choose_the_text(monkeypatch):
    monkeypatch.setattr(html_text, "content", lambda lines: np.ones(len(lines), bool))
    assert sum(html_text.main_text(page) != text for page, text in HARD) >= 1


def test_odd_pages(spark):
    for page, text in [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<script>x", ""), ("<nav>only menu</nav>", ""),
                       ("a < b &amp; c &#233;", "a < b & c é"), ("<!-- x --><b>bold", "bold"), ("</p></div>x</b>", "x")]:
        assert html_text.main_text(page) == text, page
    rows = [(1, None, None, "c"), (None, "u", "<p>x", "c"), (2, "u", "<article>" + "<p>word " * 50_000, "c"), (2, "u", "<p>x", "c")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 0), (2, 1), (2, 249_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- operator 7

def expected(rows):
    payload = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    out = {}
    for i, p in payload.items():
        again = len(p) >= 100 and first[p] != i
        out[i] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None)
    return out


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700", "4k"])
def test_round_trip_with_magic_inside_payloads(spark, tmp_path, split):
    long = "long payload " * 3000
    rows = [(i, f"http://e.org/{i}\r\nX: y", f"<p>page {i % 7}</p>" + "word " * (i % 13) * 5) for i in range(60)]
    rows += [(100, "u", FAKE), (101, "u", "x" * 90 + FAKE + "WARC/1.0\r\n" * 40 + FAKE), (102, None, None), (103, "u", ""),
             (104, "u", "WARC/1.0\r\n"), (105, "u", long + FAKE + long + FAKE), (106, "u", "\r\n\r\nWARC/1.0"), (107, "u", "é漢" * 50 + FAKE),
             (108, "u", "é漢" * 50 + FAKE), (109, "u", "\n\r\n"), (9007199254740993, "u", "big")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.round_trip(df, str(tmp_path / "a")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected(rows)
    assert len(got) == len(rows) and all(r["intact"] for r in got)


def test_the_second_read_may_have_other_splits(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "x" * 400 * i + FAKE + "y" * 1500 + FAKE * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    splits, read = iter(["3k", "1k"]), warc.open_archives

    def other(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(splits))
        return read(*args)

    monkeypatch.setattr(warc, "open_archives", other)
    try:
        got = warc.round_trip(df, str(tmp_path / "s")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert next(splits, None) is None
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected(rows)
    assert len(got) == len(rows) and all(r["intact"] for r in got)


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty, str(tmp_path / "e")).count() == 0
    same = "same " * 50
    rows = [(None, None, same, "x"), (5, "u", same, "x"), (3, "u", same, "x"), (3, "u", same, "x"), (9, "u", "z" * 3_000_000, "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), str(tmp_path / "o")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "revisit", 3), (3, "response", 0), (3, "response", 0), (5, "revisit", 3), (9, "response", 0)]


def test_a_broken_chain_ends_its_file(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\nabc\r\n\r\n"
    (tmp_path / "f.warc").write_bytes((good % (1, 3) + good % (2, 4) + good % (3, 3)).encode())
    assert [r["page_id"] for r in warc.read_archives(spark, str(tmp_path)).collect() if r["payload_bytes"] == 3] == [1]
