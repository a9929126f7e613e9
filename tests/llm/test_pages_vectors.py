"""Operators on pages and vectors against brute force and on odd input."""

import base64
import hashlib
import json
import math
import random

import numpy as np
import pytest

from standlab.llm import topk, url_filter, warc, wrappers
from standlab.session import cut_lineage


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, block int")
    return make


def brute_top(rows, k, query):
    ints = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[n] = (i, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for i, q in ints.values():
        if query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints.values() if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["mixed lengths", "equal lengths", "negative", "ties"])
def test_top_k_against_brute_force(spark, monkeypatch, kind):
    for name, value in (("BUCKET", 40), ("QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 20))
    v = {"mixed lengths": v * rng.lognormal(0, 1.5, (300, 1)), "equal lengths": v / np.linalg.norm(v, axis=1, keepdims=True),
         "negative": -np.abs(v), "ties": rng.integers(0, 2, (300, 20)) / 4.0}[kind]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 10 == 0, 5).collect())
    assert got == brute_top(rows, 5, lambda i: i % 10 == 0)


def test_top_k_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-1.0, 0.5]), (None, [1.0, 1.0]),
            (6, []), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (10, []), (20, [1e6, -1e6]), (50, [3e6, 2e6])]
    df = spark.createDataFrame([(i, v, "l") for i, v in rows], "vec_id long, embedding array<float>, dim string")
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 10 == 0).collect())
    assert got == brute_top(rows, 5, lambda i: i % 10 == 0)
    assert topk.top_k(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_pruned_products_lose_nothing_above_the_threshold():
    rng = np.random.default_rng(7)
    q, v = (np.floor(256 * rng.normal(size=(n, 32)) * rng.lognormal(0, 1, (n, 1))) for n in (20, 400))
    least = np.quantile(q @ v.T, 0.97, axis=1)
    out = topk.pruned_products(q, v, least)
    real = (q @ v.T).astype(np.int64)
    assert ((out == real) | ((out == topk.PRUNED) & (real < least[:, None]))).all() and (out == topk.PRUNED).any()


PAGES = [(1, "http://a.com/x", "hi\r\n\r\nthere"), (2, "http://b.a.com/x?y", "hi\r\n\r\nthere"), (3, None, None),
         (4, "http://a.com/x", ""), (None, "http://a.com/x", "hi\r\n\r\nthere"), (7, "http://a.com/é x", "é" * 5000), (8, "no scheme", "WARC/1.1\r\n")]


def test_archive_round_trip(spark, pages, tmp_path):
    archive = warc.write(pages(PAGES), str(tmp_path))
    got = {tuple(r) for r in warc.page_records(spark, archive, pages(PAGES)).collect()}
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0]), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    want = set()
    for i, _, h in PAGES:
        data, r = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.add((i, len(data), digest, "response" if i == r else "revisit", None if i == r else r))
    assert got == want
    found = warc.lookup(spark, archive, spark.createDataFrame([("http://a.com/x",), ("http://zz/",), ("http://A.com/é x",)], "url string"))
    assert sorted(r["id"] for r in found.collect()) == ["<urn:page:->", "<urn:page:1>", "<urn:page:4>", "<urn:page:7>"]
    payload = {r["id"]: bytes(r["payload"]).decode() for r in found.collect()}
    assert payload["<urn:page:1>"] == "hi\r\n\r\nthere" and payload["<urn:page:7>"] == "é" * 5000


def test_index_blocks_are_sorted_and_found_across_them(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", f"t{i}") for i in range(60)]
    archive = warc.write(pages(rows), str(tmp_path))
    directory = spark.read.parquet(archive.directory).orderBy("first").collect()
    assert len(directory) >= 20 and all(a["last"] <= b["first"] for a, b in zip(directory, directory[1:]))
    found = warc.lookup(spark, archive, spark.createDataFrame([("http://h3.org/1",)], "url string")).collect()
    assert {r["id"] for r in found} == {f"<urn:page:{i}>" for i in range(60) if i % 7 == 3 and i % 3 == 1}


def test_archive_with_least_size_and_without_pages(spark, pages, tmp_path):
    archive = warc.write(pages(PAGES), str(tmp_path / "a"), least=100)
    assert {r["record_type"] for r in warc.page_records(spark, archive, pages(PAGES)).collect()} == {"response"}
    archive = warc.write(pages([]), str(tmp_path / "b"))
    assert warc.page_records(spark, archive, pages(PAGES)).count() == 0


def test_a_key_over_many_parts_and_blocks_and_a_response_with_many_revisits(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "CHUNK", 1 << 10)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h.org/{i} {i % 5}", "same" if i % 2 else f"é{i}" * (i % 50)) for i in range(300)]
    archive = warc.write(pages(rows), str(tmp_path / "with space"))
    got = warc.page_records(spark, archive, pages(rows)).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [
        (i, len(h.encode()), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows]
    hot = warc.lookup(spark, archive, pages([(0, "http://HOT.org/", None)])).select("id").collect()
    assert sorted(r["id"] for r in hot) == sorted(f"<urn:page:{i}>" for i in range(300) if i % 3)


def test_rules_and_hosts(spark, pages):
    rows = [(1, "http://x.example.net/en/a", None), (2, "http://example.net/de/", None), (3, "http://www.example.com/de/1", None),
            (4, "https://M.EXAMPLE.org/fr/z?q", None), (5, "http://example.net", None), (6, None, None), (7, "plain/path", None),
            (8, "http://u:p@notexample.net:80/en/", None), (9, "http:///p#f", None), (9, "http:///p#f", None), (None, "x://net/", None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages(rows), labels).collect()}
    assert got[1] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("m.example.org", "/fr/z", "org/fr/", "allow")
    assert got[5][:3] == ("example.net", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][0] == "u:p@notexample.net:80" and got[8][2] is None and got[9][:3] == ("", "/p", None)
    assert got[None][2:] == ("net/", "block")
    assert url_filter.judge(pages([]), labels).count() == 0


def test_reputation_borrows_from_the_level_above(spark, pages):
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}{i % 6}.{'fine' if i % 2 else 'foul'}.com/", None) for i in range(600)]
    rows += [(1000, "http://new.fine.com/", None), (1001, "http://new.foul.com/", None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages(rows), labels).collect()}
    assert got[1] == got[1000] == "allow" and got[0] == got[1001] == "block"


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='no-sidebar'>"
        "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy</div><article><header>By me</header><h1>A &amp; B</h1>"
        "<p><b>One <i>two</i>&nbsp;\n three<br><p>Fo<em>ur</em> &lt;x&gt;</p>{}<div class='comments'><p>first!</p></div></article>"
        "<aside>More</aside><form>Mail</form><footer>&copy;</footer></body></html>")


def test_main_text(spark, pages):
    plain = "<div class=menu>M</div><p>Only</p><p>text &am</p>"
    rows = [(1, "http://h/1", PAGE.replace("{}", "")), (2, "http://h/2", PAGE.replace("{}", "<ul><li>i<li>j</ul>")), (3, "http://h/3", None),
            (4, "http://p/4", plain), (5, None, ""), (5, None, ""), (6, "http://h/6", PAGE[:PAGE.index("Fo<em") + 4]), (7, "http://q/", "a < b <"),
            (8, "http://q/2", "<p>" * 3000 + "deep"), (9, "http://r/", "<p>word</p>\n" * 20000)]
    got = {r["page_id"]: r for r in wrappers.extract(pages(rows)).collect()}
    assert got[1]["text"] == "A & B\nOne two three\nFour <x>" and got[1]["n_chars"] == 28
    assert got[2]["text"] == "A & B\nOne two three\nFour <x>\ni\nj"
    assert got[3]["text"] == got[5]["text"] == "" and got[4]["text"] == "Only\ntext &am"
    assert got[6]["text"] == "A & B\nOne two three\nFo" and got[7]["text"] == "a < b <"
    assert got[8]["text"] == "deep" and got[9]["text"] == "\n".join(["word"] * 20000)
    assert wrappers.extract(pages([])).count() == 0


def test_layouts_of_a_host_are_told_apart(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate([
        ("http://h/new", "<div>Top</div><main><p>new text</p></main>"), ("http://h/old", "<div><p>old text</p></div>"),
        (None, "<article> <p>in article</p></article><p>out</p>"), (None, "<table><tr><td>in cell</table>"),
        ("http://h/empty", "<main> <nav>Menu</nav> </main><p>beside</p>")])]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows)).collect()}
    assert got == {0: "new text", 1: "old text", 2: "in article", 3: "in cell", 4: "beside"}


def test_names_are_whole_classes(spark, pages):
    kept = ['<article class="post tag-search"><p>a</p></article>', '<main id="comments-open"><p>a</p></main>', '<div class="category-alerts">a</div>',
            '<article><div class="entry-header"><h1>a</h1></div></article>', '<div class=post-header>a</div>', '<div class=share-price-report>a</div>', '<p class="x no-sidebar">a</p>',
            '<article><button>a</button></article>', '<p><math><mi>a</mi></math></p>', '<p><object>a</object></p>', '<p><svg><text>a</text></svg></p>']
    lost = ['<div class="x ad">b</div>', '<div id=cookie-banner>b</div>', '<div class="site-footer">b</div>', '<ul class="main_nav-links"><li>b</ul>',
            '<div class="ad-slot-3">b</div>', '<div role=search>b</div>', '<article><div class="post-comments">b</div></article>', '<aside>b</aside>']
    rows = [(i, f"http://h{i}/", h) for i, h in enumerate(kept + lost)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == ["a"] * len(kept) + [""] * len(lost)


def test_equal_text_of_a_host_is_template(spark, pages):
    words = "one two three four five".split()
    old = ["<div>Home</div><ul class=x><li>News<li>About</ul><div><p>Price: <b>{}</b></p></div><p class=fine>All rights</p>".format(w) for w in words]
    new = [f"<article><h1>Same</h1><div class=share-price-report>{h}</div><p>{h}</p><div class=entry-notice>Sign up</div></article>" for h in words]
    rows = [(i, "http://old/", h) for i, h in enumerate(old)] + [(i + 10, "http://new/", h) for i, h in enumerate(new)]
    rows += [(i + 20, f"http://both/{i}", h) for i, h in enumerate(old + new)] + [(i + 40, "http://copies/", old[i % 2]) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows)).collect()}
    whole = [f"Home\nNews\nAbout\nPrice: {w}\nAll rights" for w in words]
    assert [got[i] for i in range(5)] == [got[i + 20] for i in range(5)] == [f"Price: {w}" for w in words]
    assert [got[i + 10] for i in range(5)] == [got[i + 25] for i in range(5)] == [f"Same\n{w}\n{w}" for w in words]
    assert [got[i + 40] for i in range(6)] == whole[:2] * 3


def test_wrapper_has_repeats_and_options(spark, pages):
    rows = [(i, "http://h/", "<article><h1>t</h1>" + "<p>x</p><h2>y</h2>" * (i % 4) + ("<blockquote>q</blockquote>" if i % 2 else "") + "</article>")
            for i in range(1, 9)]
    wrapper, = wrappers.infer(pages(rows)).collect()
    text = wrappers.expression(wrappers._tuples(json.loads(wrapper["wrapper"])))
    assert text.startswith("article/h1#") and "(article/p# article/h2#)+" in text and "(article/blockquote#)?" in text
    assert "|" not in text


def test_skeletons_of_a_host_meet_in_rounds(spark, pages, monkeypatch):
    rounds = []

    def kept(df):
        df = cut_lineage(df)
        rounds.append(df.count())
        return df

    monkeypatch.setattr(wrappers, "FAN", 4)
    monkeypatch.setattr(wrappers, "cut_lineage", kept)
    tags = "p h2 blockquote pre h3 dt".split()
    rows = [(i, "http://h/", "<div>Menu</div><section>" + "".join(f"<{t}>{t}{i}</{t}>" for j, t in enumerate(tags) if i >> j & 1) + "</section>")
            for i in range(1, 61)] * 2 + [(99, "http://one/", "<p>x</p>")]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows)).collect()}
    assert got == {99: "x"} | {i: "\n".join(f"{t}{i}" for j, t in enumerate(tags) if i >> j & 1) for i in range(1, 61)}
    assert rounds[0] >= 61 and rounds[1] <= 16 and rounds[-2] == 2 and len(rounds) >= 5


def test_alignment_covers_both_sides():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert set(wrappers.slots(wrappers.align(a, b))) == set(a) | set(b)
