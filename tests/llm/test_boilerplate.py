import random
import re

import numpy as np
import pytest

from jobmeter.llm import boilerplate
from jobmeter.llm.boilerplate import BOILERPLATE, MAIN, OPEN
from tests.llm.tables import prose, rows_of

PAGES = "page_id long, url string, html string, host string, text string"


def test_zones_and_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="nav-open">
      <header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-banner">We use cookies</div>
      <article><header><h1>Head &amp; line</h1><span class="byline">By</span></header><p>One <b>bo</b>ld&nbsp;word<br>two
      <p>a &lt; b &#233; &amp</p><aside>Also</aside><form>Name</form><ul><li>x</li><li>y</li></ul>
      <div class="share-buttons">Share</div><table><tr><td>1</td><td>2</td></tr></table></article>
      <section id="comments"><article class="comment"><p>Reader</p></article></section>
      <script>var a = "</p><p>";</script><!-- <p>hidden</p> --><footer>End</footer></body></html>"""
    main = [t for z, t in boilerplate.page_blocks(page) if z == MAIN]
    assert main == ["Head & line", "One bold word two", "a < b é &", "x", "y", "1", "2"]
    rest = {t for z, t in boilerplate.page_blocks(page) if z == BOILERPLATE}
    assert {"Site", "Menu", "We use cookies", "Also", "Name", "Share", "Reader", "End"} <= rest
    assert not any(z == OPEN for z, _ in boilerplate.page_blocks(page))


def test_unclosed_and_inline_boilerplate():
    page = """<div class="content with-sidebar"><article><p>a<p class="advert">b<p>c <span class="ad">d <span>e</span></span> f
      <ul><li class="share">g<li>h</ul><p>i <a href="/x">j</a></p><span class="comment">k<p>l</article>"""
    assert [t for z, t in boilerplate.page_blocks(page) if z == MAIN] == ["a", "c f", "h", "i j", "l"]


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<p class='x", "</p></div>", "<script>x", "<!-- x", "<article><p>a<nav>b", "a &amp b"])
def test_broken_markup(page):
    boilerplate.page_blocks(page)
    assert [t for _, t in boilerplate.page_blocks("plain text")] == ["plain text"]
    assert [t for z, t in boilerplate.page_blocks("<article><p>a<p>b<nav>c</nav>d") if z == MAIN] == ["a", "b", "d"]


def brute_force(streams, min_tokens, min_pages):
    windows = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - min_tokens + 1):
            windows.setdefault(tuple(s[i : i + min_tokens]), set()).add(p)
    out = []
    for s in streams:
        covered = [False] * len(s)
        for i in range(len(s) - min_tokens + 1):
            if len(windows[tuple(s[i : i + min_tokens])]) >= min_pages:
                covered[i : i + min_tokens] = [True] * min_tokens
        out += covered
    return out


def test_suffix_array_covers_long_repeats():
    rng = random.Random(3)
    for _ in range(150):
        streams = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 7))]
        k, m = rng.randint(2, 6), rng.randint(1, 4)
        tokens = np.array([t for s in streams for t in s], np.int64)
        bounds = np.cumsum([0, *[len(s) for s in streams]])[:-1]
        content = np.array([p for p, s in enumerate(streams) for _ in s], np.int64)
        found = boilerplate._covered(tokens, content, bounds, k, m)
        assert found.tolist() == brute_force(streams, k, m)


def page(*blocks):
    return "<html><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>"


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    texts = prose(9, seed=5)
    notice = "all rights reserved by the owners of this fine web site"
    rows = [(i, f"http://h.example/{i}", page("Home News About Contact Jobs Press Legal Help", t, f"{notice} and {t.split()[0]}")) for i, t in enumerate(texts)]
    rows += [(50 + i, f"http://h.example/c{i}", page(texts[0])) for i in range(6)]  # copies keep their text
    rows += [(60, "http://other.example/", page(notice)), (61, None, page("x")), (62, "no url", None), (63, "http://h.example/e", "")]
    rows += [(64, "http://h.example/a", f"<article><p>{notice}</p></article>")] * 2
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    found = {r["page_id"]: r for r in boilerplate.extract(df).collect()}
    assert set(boilerplate.extract(df).columns) == {"page_id", "url", "host", "text", "n_chars", "n_repeated"}
    for i, t in enumerate(texts):
        assert found[i]["text"] == f"{t}\n{t.split()[0]}" and found[i]["n_chars"] == len(found[i]["text"])
        assert found[i]["n_repeated"] > 0
    assert all(found[50 + i]["text"] == texts[0] for i in range(6))
    assert found[60]["text"] == notice and found[61]["text"] == "x"
    assert found[62]["text"] == found[63]["text"] == "" and found[62]["n_chars"] == 0
    assert found[64]["text"] == notice
    assert len(rows_of(boilerplate.extract(df), "page_id")) == len(rows)
    assert boilerplate.extract(df.limit(0)).collect() == []


def test_shared_block_longer_than_each_unique_one():
    legal = " ".join(prose(3, seed=8))
    pages = [boilerplate.page_blocks(page(legal, t)) for t in prose(4, seed=9, words=20)]
    found = boilerplate.host_texts(pages, 8, 3)
    assert [text for text, _ in found] == prose(4, seed=9, words=20)
    assert all(n == len(legal.split()) for _, n in found)


def test_parts_of_a_host_find_what_the_whole_host_repeats(spark):
    texts, rare = prose(40, seed=6), prose(2, seed=7, words=12)
    rows = [(i, f"http://h.example/{i}", page(t, *[rare[0]] * (i % 10 == 0), *[rare[1]] * (i in (3, 4)))) for i, t in enumerate(texts)]
    rows += [(50 + i, f"http://h.example/c{i}", page(texts[1])) for i in range(6)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    whole = rows_of(boilerplate.extract(df), "page_id", "text", "n_repeated")
    assert rows_of(boilerplate.extract(df, pages_per_part=3), "page_id", "text", "n_repeated") == whole
    assert sum(n == 12 for *_, n in whole) == 4


def plain(page):
    """A page without any mark of what its elements are."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|header|footer|aside|form|main|section)\b", r"<\1div", page))


@pytest.mark.parametrize("change", [lambda p: p.replace("article", "div"), plain], ids=["no article", "no marks"])
def test_given_pages_keep_their_text_without_marks(change):
    """The host and the kind of blocks find the text that the markup of the given pages names."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    hosts = {}
    for p in pages:
        hosts.setdefault(re.match(r"[a-z]+://([^/:?#]+)", p["url"].lower())[1], []).append(p["html"] or "")
    same = total = repeated = 0
    for htmls in hosts.values():
        marked, bare = (boilerplate.host_texts([boilerplate.page_blocks(f(h)) for h in htmls], 8, 3) for f in (str, change))
        same += sum(a[0] == b[0] for a, b in zip(marked, bare))
        repeated += sum(n > 0 for _, n in marked)
        total += len(htmls)
    assert same >= 0.95 * total and repeated > 0


def test_whole_query_against_brute_force_on_small_hosts(spark):
    """Runs of eight tokens on three pages of different content, found by comparing all pages of a host."""
    rng = random.Random(12)
    texts = prose(30, seed=21, words=25)
    menus, notices = prose(2, seed=22, words=9), prose(3, seed=23, words=12)
    rows = []
    for i, t in enumerate(texts + texts[:3]):
        blocks = [rng.choice(menus), t, rng.choice(notices)] if i % 4 else [t, rng.choice(notices)]
        rows.append((i, f"https://h{i % 2}.example/{i}", page(*blocks)))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    found = {r["page_id"]: (r["text"], r["n_repeated"]) for r in boilerplate.extract(df).collect()}
    for h in range(2):
        mine = [r for r in rows if r[0] % 2 == h]
        blocks = [boilerplate.page_blocks(r[2]) for r in mine]
        streams = [[w for _, t in b for w in t.split()] for b in blocks]
        windows = {}
        for b, s in zip(blocks, streams):
            for i in range(len(s) - 7):
                windows.setdefault(tuple(s[i : i + 8]), set()).add(frozenset(b))
        for r, b, s in zip(mine, blocks, streams):
            covered = [any(len(windows[tuple(s[j : j + 8])]) >= 3 for j in range(max(0, i - 7), min(i, len(s) - 8) + 1)) for i in range(len(s))]
            kept, at = [], 0
            for _, t in b:
                n = len(t.split())
                own = [w for w, c in zip(t.split(), covered[at : at + n]) if not c]
                kept += [" ".join(own)] if own else []
                at += n
            assert found[r[0]] == ("\n".join(kept), sum(covered))
