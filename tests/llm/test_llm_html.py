"""Extraction on planted pages, repeats against brute force, and the defined cases."""
import re
import time

import numpy as np
import pytest

from erisk.llm import html


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='has-sidebar'>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    ("<nav><ul><li>Menu</ul></nav><article><h1>Head &amp; more</h1><p>One<b>two</b>\n three<br>four<p>five</article><footer>F</footer>", "Head & more Onetwo three four five"),
    ("<div class=ad>Buy</div><main>Main <form>name</form> text<aside>side</aside></main>", "Main text"),
    ("<article>A<section id='comments'><p>reader</p></section><div class='cookie-notice'>ok</div> B</article>", "A B"),
    ("<article>kept <!-- > <p>no</p> --> this", "kept this"),
    ("<article>cut <p>here <a href='x", "cut here"),
    ("<article>&lt;b&gt; 3 < 4 &eacute;&#233; &am</article>", "<b> 3 < 4 éé &am"),
    ("<p>open text</p>", "open text"),
    ("<article>post</article><div class='comments'><article class='comment'>reader</article></div>", "post"),
    ("<article hidden='x'>a<span style='display:none'>secret</span>b</article>", "ab"),
])
def test_page(body, want):
    article, rest, _ = html.texts(page(body))
    assert (article or rest) == want


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, page string, covered int")


def test_hosts(spark, prose):
    """Open pages lose what other pages of the host repeat, at any place; other hosts and articles keep it."""
    shared = prose("shared", 60)
    rows = [(k, f"http://a.example/{k}", page(f"<p>{prose(('x', k), 30)}</p><p>{shared}</p><p>{prose(('y', k), 20)}</p>")) for k in range(5)]
    rows.append((10, "http://b.example/1", page(f"<p>{shared}</p>")))
    rows += [(k, f"http://a.example/{k}", page(f"<article>{shared}</article>")) for k in (11, 12)]
    rows += [(13, None, None), (14, "http://a.example/14", ""), (None, "http://c.example/", page("<p>null id</p>"))] + [(15, "u", page("<p>twice</p>"))] * 2
    got = {}
    for r in html.extracted(pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    flat = " ".join(shared.split())
    for k in range(5):
        own = " ".join(f"{prose(('x', k), 30)} {prose(('y', k), 20)}".split())
        rest = [w for w in got[k][0].split() if w not in own.split()]
        assert len(rest) <= 2 * (html.PLACES - 1) and [w for w in got[k][0].split() if w in own.split()] == own.split()
    assert got[10] == [flat] and got[11] == got[12] == [flat]
    assert got[13] == got[14] == [""] and got[None] == ["null id"] and got[15] == ["twice", "twice"]


def test_shared_runs_share_a_suffix(prose):
    run = prose("run", html.PREFIX + html.PLACES - 1)
    for k in range(20):
        a, b = html.suffixes(f"{prose(('a', k), k)} {run} {prose(('b', k), 31)}"), html.suffixes(f"{prose(('c', k), 40)} {run}")
        assert len(np.intersect1d(a[1], b[1]))


def test_empty_and_long(spark):
    assert html.extracted(pages(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    assert html.extracted(pages(spark, [(1, "u", page(f"<article>{long}</article>"))])).first()["n_chars"] == len(long)


def test_nothing_of_a_repeat_remains(spark, prose):
    """Long repeats leave neither holes nor ends, short ones of 12 words go as well; 11 words stay."""
    long, short, less = prose("long", 1200), prose("short", 12), prose("less", 11)
    body = lambda k: " ".join(f"{prose(('a', k), 15)} {long} {prose(('b', k), 3)} {short} {prose(('c', k), 7)} {less} {prose(('d', k), 9)}".split())
    rows = [(k, f"http://a.example/{k}", page(f"<p>{body(k)}</p>")) for k in range(3)]
    rows += [(3, "http://b.example/", page(f"<p>{short} {prose('e', 4)}</p>")), (4, "http://b.example/x", page(f"<article>{prose('f', 9)} {short}</article>"))]
    got = {r["page_id"]: r["text"] for r in html.extracted(pages(spark, rows)).collect()}
    for k in range(3):
        assert got[k] == " ".join(f"{prose(('a', k), 15)} {prose(('b', k), 3)} {prose(('c', k), 7)} {less} {prose(('d', k), 9)}".split())
    assert got[3] == prose("e", 4) and got[4] == f"{prose('f', 9)} {short}"


@pytest.mark.parametrize("body", ["<a " * 350_000, "<div>" * 100_000 + "</p>" * 120_000, "<a \"" * 250_000, "<a '" * 250_000 + ">", "<!-- " * 200_000, "<p" * 250_000,
                                  "<div>" * 60_000 + "</div>" * 60_000 + "x < y & z " * 20_000])
def test_a_megabyte_of_bad_markup_is_read_at_once(body):
    began = time.process_time()
    html.texts(body)
    assert time.process_time() - began < 2


def test_repeats_of_dropped_blocks_leave_open_text_but_not_articles(spark, prose):
    """A footer elsewhere makes a run of open text boilerplate; an article that an advert quotes stays whole."""
    note = prose("note", 16)
    rows = [(0, "http://a.example/0", page(f"<p>{prose('a', 25)} {note} {prose('b', 5)}</p>")), (1, "http://a.example/1", page(f"<article>{prose('c', 9)}</article><footer>{note}</footer>")),
            (2, "http://a.example/2", page(f"<article>{prose('d', 9)} {note}</article><div class=ad>{note}</div>")), (3, "http://b.example/", page(f"<p>{note}</p>"))]
    got = {r["page_id"]: r["text"] for r in html.extracted(pages(spark, rows)).collect()}
    flat = lambda t: " ".join(t.split())
    assert got == {0: flat(f"{prose('a', 25)} {prose('b', 5)}"), 1: flat(prose("c", 9)), 2: flat(f"{prose('d', 9)} {note}"), 3: flat(note)}


def test_pages_without_landmarks_equal_a_plain_repeat_finder(spark):
    """The given pages, their landmark tags and telling names taken away: every open run of 12 words that another page has goes."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    strip = re.compile(r"</?(article|main|nav|header|footer|aside|form|menu)\b[^>]*>|\b(class|id|role)=(\"[^\"]*\"|'[^']*'|\S+)", re.I)
    rows = [(r["page_id"], r["url"], strip.sub(lambda m: "<p>" if m[1] else "", r["html"] or "")) for r in given]
    parts = [html.texts(h) for *_, h in rows]
    host = [r[1].split("/")[2].lower() if "//" in r[1] else "" for r in rows]
    own = [(a or b).split() for a, b, _ in parts]
    where = {}
    for k, (words, (_, _, rest)) in enumerate(zip(own, parts, strict=True)):
        for stream in (words, rest.split()):
            for i in range(len(stream) - html.PREFIX + 1):
                where.setdefault((host[k], tuple(stream[i:i + html.PREFIX])), set()).add(k)
    want = {}
    for k, words in enumerate(own):
        keep = [True] * len(words)
        for i in range(len(words) - html.PREFIX + 1):
            if len(where[host[k], tuple(words[i:i + html.PREFIX])]) > 1:
                keep[i:i + html.PREFIX] = [False] * html.PREFIX
        want[rows[k][0]] = " ".join(w for w, x in zip(words, keep, strict=True) if x)
    assert not any(a for a, _, _ in parts) and sum(len(t.split()) for t in want.values()) < sum(map(len, own))
    assert {r["page_id"]: r["text"] for r in html.extracted(pages(spark, rows)).collect()} == want


def test_words_are_compared_not_their_hashes(spark, prose):
    """plumless and buckeroo have one CRC-32, so their suffixes have equal hashes; as words they differ and are no repeat."""
    head, tail = prose("head", 8), prose("tail", 8)
    rows = [(k, f"http://a.example/{k}", page(f"<p>{head} {w} {tail}</p>")) for k, w in ((1, "plumless"), (2, "buckeroo"))]
    assert np.array_equal(html.suffixes(f"{head} plumless {tail}")[1], html.suffixes(f"{head} buckeroo {tail}")[1])
    got = {r["page_id"]: r["text"].split() for r in html.extracted(pages(spark, rows)).collect()}
    assert got == {k: f"{head} {w} {tail}".split() for k, w in ((1, "plumless"), (2, "buckeroo"))}


def test_keys_of_all_hosts_are_sorted(spark, prose):
    """Articles and dropped blocks are in the array too, and keys shared with an open text are found over batches."""
    text, host = prose("text", 40), 7
    rows = [(host, k, k == 3, text if k in (1, 3) else prose(("own", k), 40), "") for k in range(6)]
    streams = spark.createDataFrame(rows, "host long, page long, open boolean, text string, rest string").repartition(3)
    packed = streams.mapInArrow(html.blocks, "bucket int, keys binary")
    assert packed.selectExpr("sum(length(keys)) / 5").first()[0] >= 5 * len(set(html.filed(text, host)[1].tolist())) / 2
    keys = packed.coalesce(1).sortWithinPartitions("bucket").mapInArrow(html.shared_keys, "key long")
    assert {r["key"] for r in keys.collect()} == set(html.filed(text, host)[1].tolist())


def test_open_text_beside_an_article_is_in_the_array(spark, prose):
    """A teaser beside an article makes the same run of an open page a repeat; blocks of two kinds are no run together."""
    teaser, head, tail = prose("teaser", 16), prose("head", 6), prose("tail", 6)
    flat = lambda t: " ".join(t.split())
    rows = [(0, "http://a.example/0", page(f"<p>{prose('a', 25)} {teaser} {prose('b', 5)}</p>")), (1, "http://a.example/1", page(f"<div>{teaser}</div><article>{prose('c', 9)}</article>")),
            (2, "http://a.example/2", page(f"<p>{head} {tail}</p>")), (3, "http://a.example/3", page(f"<nav>{head}</nav><article>{prose('d', 9)}</article><p>{tail}</p>"))]
    got = {r["page_id"]: r["text"] for r in html.extracted(pages(spark, rows)).collect()}
    assert got == {0: flat(f"{prose('a', 25)} {prose('b', 5)}"), 1: flat(prose("c", 9)), 2: flat(f"{head} {tail}"), 3: flat(prose("d", 9))}


def test_repeats_of_all_blocks_are_sorted_by_words(spark, prose, monkeypatch):
    """Menus and articles that pages of a host share are in the array of words, without any open text; articles stay whole."""
    menu, text = " ".join(prose("menu", 20).split()), " ".join(prose("text", 30).split())
    rows = [(k, f"http://a.example/{k}", page(f"<nav>{menu}</nav><article>{text if k < 2 else prose(k, 30)}</article>")) for k in range(4)]
    kept, write = {}, html.written
    monkeypatch.setattr(html, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = {r["page_id"]: r["text"] for r in html.extracted(pages(spark, rows)).collect()}
    assert got == {k: " ".join((text if k < 2 else prose(k, 30)).split()) for k in range(4)}
    starts = {" ".join(t.split()[k:k + html.PREFIX]) for t in (menu, text) for k in range(len(t.split()) - html.PREFIX + 1)}
    assert {r["prefix"] for r in kept["repeats"].collect()} == starts
