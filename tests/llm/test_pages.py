import html
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from riskloom.llm import alignment, pages

SF = "/root/testdata/sf0.01"
ROWS = "page_id long, url string, html string"


def longest(a, b):
    """Length of the longest common subsequence, by the plain table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 16])
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_alignment_is_longest(bits, a, b):
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    before, alignment.TABLE_BITS = alignment.TABLE_BITS, bits
    try:
        x, y = alignment.common_lines(a, b)
    finally:
        alignment.TABLE_BITS = before
    assert (a[x] == b[y]).all() and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    assert len(x) == longest(a.tolist(), b.tolist())


def test_long_pages_are_aligned():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 40, 12_000), draw.integers(0, 40, 9_000)
    x, y = alignment.common_lines(a, b)
    assert (a[x] == b[y]).all() and len(x) > 2_000


def kept(page):
    return pages.main_text(pages.page_lines(page))


def test_marked_parts_go_and_references_are_decoded():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="with-sidebar">
    <header>top</header><nav><ul><li><a href=/a>menu</a></ul></nav><!-- <p>no</p> --><div class='ad box'>buy</div>
    <article><h1 class="entry-header">A &amp; B&copy</h1><script>var t = "</p>";</script><p title="a > b">one
      <b>bo</b>ld&nbsp;x<br>two<p>three &#x41; &lt;i&gt;<form><label>name</label></form><aside>see also</aside>
    <section id="comments"><p>first!</p></section></article><footer>end</footer></body></html>"""
    assert kept(page) == "A & B© one bold x two three A <i>"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p>cut <b", "cut"), ("<nav>only", ""), ("plain", "plain"),
    ("<nav>m<article>x</article>", "x"), ("<aside><article>teaser</article></aside><main>y</main>", "y"),
    ("<p title='a>b>c", "b>c"), ("</div></p>z", "z"), ("<article>" * 3 + "deep", "deep"),
    ("<article><!-- open", ""), ("<div class='cookie-notice'>c</div><p>body</p>", "body"),
    ("<article>kept<article class=comment>said</article></article>", "kept"),
])
def test_odd_pages(page, text):
    assert kept(page) == text


def test_very_long_page():
    page = "<article>" + "<p>word <b>x" * 200_000
    assert len(kept(page)) == 200_000 * 7 - 1


def site(n, own, template=("Home", "News", "About us", "All rights reserved")):
    """Pages of one host without any marks: template lines around lines of their own."""
    body = lambda k: "".join(f"<div>{t}</div>" for t in [*template[:2], *own(k), *template[2:]])
    return [(k, f"http://h.example/a/{k:03d}", body(k)) for k in range(n)]


def test_shared_lines_of_unmarked_pages_go(spark):
    rows = site(9, lambda k: [f"The long article number {k}", f"its end {k}"])
    rows += [(100, "http://one.example/x", "<div>Home</div><div>alone</div>"), (101, None, "<div>Home</div>"), (102, "no url", "<p>Home")]
    rows += [(103, "http://h.example/a/004", rows[4][2]), (4, *rows[4][1:]), (104, "http://z.example/", None)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as key", "'x' as text", "2 as m1", "3 as place").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.main_texts(df).collect())
    want = [(k, f"The long article number {k} its end {k}") for k in (0, 1, 2, 3, 4, 4, 5, 6, 7, 8)]
    want += [(100, "Home alone"), (101, "Home"), (102, "Home"), (103, "The long article number 4 its end 4"), (104, "")]
    assert got == sorted((k, t, len(t)) for k, t in want)


def test_copies_do_not_delete_each_other(spark):
    rows = site(3, lambda k: ["The same long article on every page"])
    got = {r.text for r in pages.main_texts(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"Home News The same long article on every page About us All rights reserved"}


def plain_texts(rows):
    """The operator without blocks or hashes: whole hosts, plain tables."""
    hosts = defaultdict(dict)
    for _, url, page in rows:
        found = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#]+)([^?#]*)", url or "")
        if found:
            hosts[found[1].lower()][(found[2], url, page)] = [x.text for x in pages.page_lines(page)]
    shared = {}
    for host, known in hosts.items():
        order = sorted(known)
        for n, name in enumerate(order):
            def near(m):
                a, b = order[m][0].split("/"), name[0].split("/")
                return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            for m in sorted((m for m in range(max(0, n - 4), min(len(order), n + 5)) if m != n), key=lambda m: (-near(m), abs(m - n), m)):
                a, b = known[name], known[order[m]]
                size = longest(a, b)
                if any(x and size and longest([y for k, y in enumerate(x) if k != max(range(len(x)), key=lambda i: (len(x[i]), -i))], z) < size for x, z in ((a, b), (b, a))):
                    continue
                shared[name] = size
                break
    return shared


def test_pairs_and_counts_equal_a_plain_version(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = pages.main_texts(df).collect()
    given_rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    size = plain_texts(given_rows)
    by_name = {(re.sub(r"^[a-z]+://[^/?#]+([^?#]*).*", r"\1", u), u, h): size.get((re.sub(r"^[a-z]+://[^/?#]+([^?#]*).*", r"\1", u), u, h), 0) for _, u, h in given_rows}
    counts = {(u, h): n for (_, u, h), n in by_name.items()}
    whole = {k: (u, h) for k, u, h in given_rows}
    off = [r.page_id for r in got if r.n_shared != counts[whole[r.page_id]]]
    # Pages of equal path are ordered by hash, not by address; a line may be in one longest alignment and not in another.
    assert len(off) <= len(got) // 50


def test_given_pages_give_their_articles(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in df.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub("<[^>]+>", "\n", re.sub("</?b>", "", inner))).split())
    got = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert got == want


def test_no_pages(spark):
    assert pages.main_texts(spark.createDataFrame([], ROWS)).collect() == []
