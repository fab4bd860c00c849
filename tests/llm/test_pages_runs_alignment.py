"""Main text, periodic runs and tokenizer alignment against brute force."""

import hashlib
import html
import random
import re
import zlib

import pytest

import public_tokenizers
from pyspark.sql import functions as F

from tardy.llm import alignment, html_text, periodic_runs, queries, site_style_tree
from tardy.llm.common import ship

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def sha(x):
    return hashlib.sha256(x).hexdigest()


# --- main text ---------------------------------------------------------------

def article_by_hand(page):
    """The article of the generated pages, whose only inner tags are known."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


@pytest.mark.parametrize("folder", [SF, SF_MID])
def test_main_text_of_the_table(spark, folder):
    got = {r.page_id: r for r in queries.op11_html_extraction(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_by_hand(r.html)
        assert got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


def shop_pages(n=40):
    """Pages without any telling markup: only the tree can tell the template."""
    r = random.Random(5)
    body = {}
    rows = []
    for i in range(n):
        body[i] = " ".join(r.choice("abcdefghij") + str(r.randint(0, 999)) for _ in range(30))
        rows.append((i, f"https://shop.example/{i}", f"<div class=x1><div>All offers of the week</div>"
                     f"<div class=q><p>{body[i]}</p><p>{body[i][::-1]}</p></div>"
                     f"<div class=x9><span>Call us</span> <span>every day</span></div></div>"))
    return rows, body


@pytest.mark.parametrize("small", [site_style_tree.SMALL, 0])
def test_repeated_branches_go_without_telling_names(spark, small):
    rows, body = shop_pages()
    # the same words on a host of one page are no template
    rows.append((100, "https://one.example/", "<div class=z><div>All offers of the week</div></div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style_tree.extract(df, small).collect()}
    for i, t in body.items():
        assert got[i] == f"{t}\n\n{t[::-1]}"
    assert got[100] == "All offers of the week"


def test_named_branches_go_and_copies_stay(spark):
    page = ('<html><body class="nav-open"><header><h2>Site</h2></header><div class="cookie-notice">We use</div>'
            '<main><article class="post"><h1>T &amp;\n t</h1><p>one<br>two<p>three <i>x</i>y'
            '<div class="share">tell</div><ul><li>l1<li>l2</ul><aside>rel</aside><form>mail</form></article>'
            '<section id="comments"><article class="comment"><p>nice</p></article></section></main>'
            '<script>var a="<p>no</p>"</script><style>p{}</style><footer>foot</footer></body></html>')
    want = "T & t\n\none two\n\nthree xy\n\nl1\n\nl2"
    df = spark.createDataFrame([(i, "http://a.example/x", page) for i in range(60)], "page_id long, url string, html string")
    got = [r.text for r in site_style_tree.extract(df).collect()]
    assert got == [want] * 60


def test_main_text_edges(spark):
    long = "<article>" + "<p>w &lt; x</p>" * 40000 + "</article>"
    rows = [(1, None, None, "a"), (None, "not a url [", "", "b"), (3, "http://x/", "<p>alone", "c"),
            (3, "http://x/", "<p>alone", "c"), (4, "http://y:1/", long, "d"), (5, "", "<div>" * 5000 + "deep", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in site_style_tree.extract(df).collect())
    assert got == sorted([(1, None, "", 0), (0, "not a url [", "", 0), (3, "http://x/", "alone", 5),
                          (3, "http://x/", "alone", 5), (4, "http://y:1/", "\n\n".join(["w < x"] * 40000), 40000 * 7 - 2),
                          (5, "", "deep", 4)], key=lambda r: (r[0], r[1] or ""))
    assert site_style_tree.extract(df.limit(0)).collect() == []


def test_importance_by_the_definition(spark):
    """Composite importance equals the recursive definition, host by host."""
    import math

    rows, _ = shop_pages(12)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = site_style_tree.node_table(site_style_tree.read_pages(df)).cache()
    host = [r for r in nodes.collect() if r.site == "shop.example"]
    by = {r.node: r for r in host}
    kids = {}
    for r in host:
        if len(r.path) > 1:
            kids.setdefault(r.path[-2], []).append(r)

    def importance(r):
        if r.kind >= 0:
            return r.own
        fade = site_style_tree.GAMMA ** r.styles
        return (1 - fade) * r.own + fade * sum(k.share / r.pages * importance(k) for k in kids.get(r.node, []))

    got = {r.node: r.importance for r in site_style_tree.composite(nodes).collect() if r.site == "shop.example"}
    assert set(got) == set(by)
    for n, r in by.items():
        assert math.isclose(got[n], importance(r), abs_tol=1e-9)
    # a text on all pages has no importance, texts of one page all of it
    assert min(r.own for r in host if r.kind >= 0) == pytest.approx(0, abs=1e-9)
    assert max(r.own for r in host if r.kind >= 0) == 1.0


@pytest.mark.parametrize("page", ["<div>" * 50000, '<a ="' * 50000 + ">", "<b <" * 50000, "<!-" * 50000,
                                  "<p><button>" * 10000, "<table><tr><td>" * 10000, "&#x" * 50000, "<script>" * 20000])
def test_hostile_markup_is_read_in_linear_time(page):
    import time

    t = time.perf_counter()
    html_text.read_page(page)
    assert time.perf_counter() - t < 5


# --- periodic runs -----------------------------------------------------------

def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 5)):
            w = []
            for _ in range(r.randint(0, 6)):
                unit = [r.choice([b"a", b"b", b"cc"]) for _ in range(r.randint(1, 5))]
                w += unit * r.choice([1, 1, 2, 4, 5, 9]) + unit[:r.randint(0, len(unit))]
            texts.append(w)
        assert periodic_runs.runs_of(texts) == [runs_by_hand(w) for w in texts]


def test_runs_of_the_table(spark):
    """Every column of the query against an independent reading of its contract."""
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    seen = 0
    for d in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        seen += len(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped).encode())
    assert seen > 10


def test_runs_edges(spark):
    rows = [(1, None, "a"), (None, "", "b"), (3, " \t\n", "c"), (4, "x " * 200000, "d"), (4, "x " * 200000, "d"),
            (5, "a b " * 6, "e"), (6, "a b " * 3, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed)
           for r in periodic_runs.find_runs(df).collect()]
    whole = (4, [(0, 200000, 1)], (0, 200000, 1), "x")
    assert got == [(1, [], None, ""), (None, [], None, ""), (3, [], None, ""), whole, whole,
                   (5, [(0, 6, 1)], (0, 6, 1), "a b"), (6, [], None, "a b a b a b")]
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


# --- alignment ---------------------------------------------------------------

def aligned_by_hand(texts):
    """(n_a, n_b, groups, links) of every text, by plain token lists."""
    tool = alignment.tokenizer_pair(A, B)
    out = []
    for t in texts:
        a = tool.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tool.b.encode(t) if t else []
        raw = (" " + t).encode()
        if not t or b"".join(tool.bytes_a[i] for i in a) != raw or b"".join(tool.bytes_b[i] for i in b) != raw:
            out.append((0, 0, "", []))
            continue
        ends = [[], []]
        for side, ids, spelled in ((0, a, tool.bytes_a), (1, b, tool.bytes_b)):
            at = 0
            for i in ids:
                at += len(spelled[i])
                ends[side].append(at)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        out.append((len(a), len(b), ";".join(groups), links))
    return out


EDGE = ["", " ", "a", " lead", "two  spaces", "end ", "a\n\n b\tc", "<|endoftext|> x<s>", "▁ mark", "執 é ſ \U0001f600",
        "a" * 3000, "ab" * 2000, " " * 300, " x　y", "\r\n \r\n", "x\x00y", "﻿z"]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_brute_force(spark, hot):
    r = random.Random(11)
    signs = "  aehtinrsAé\n\t ▁　執\U0001f6000129'.,<|endoftext|><0x0A>"
    texts = EDGE + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(200)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts += [x.text or "" for x in docs.collect()]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, None, "c")],
                               "doc_id long, text string, links string")
    got = {x.doc_id: x for x in alignment.align(df, A, B, hot_pairs=hot).collect()}
    want = aligned_by_hand(texts)
    count, most = {}, {}
    for *_, links in want:
        for p in links:
            count[p] = count.get(p, 0) + 1
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    assert len(got) == len(texts) + 1
    for i, (n_a, n_b, groups, links) in enumerate(want):
        g = got[i]
        assert (g.n_a, g.n_b, g.n_groups, g.n_links) == (n_a, n_b, len(links), len(links)), repr(texts[i][:50])
        assert g.groups_sha256 == (sha(groups.encode()) if n_a else "")
        assert g.n_best == sum(count[p] == most[p[1]] for p in links)
        assert g.count_sum == sum(count[p] for p in links)
    assert (got[None].n_a, got[None].count_sum, got[None].groups_sha256) == (0, 0, "")
    assert sum(n > 0 for n, *_ in want) > 150


def test_alignment_of_an_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert alignment.align(df, A, B).collect() == []
    assert set(queries.op13_alignment(spark, SF).columns) == {
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
