import html as H
import random
import re
from collections import defaultdict

import pytest

from tessella.llm import pagediff as d
from tessella.llm.common import Scratch
from tests.conftest import SF


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def is_common(a, places, b):
    got, j = [a[i] for i in places], 0
    for x in got:
        while j < len(b) and b[j] != x:
            j += 1
        if j == len(b):
            return False
        j += 1
    return places == sorted(set(places))


@pytest.mark.parametrize("limit", [16_000_000, 1])
def test_alignment_is_longest(monkeypatch, limit):
    monkeypatch.setattr(d, "ROW_BYTES", limit)
    rng = random.Random(1)
    for _ in range(400):
        k = rng.randrange(1, 9)
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(25))] for _ in range(2))
        places = d.aligned(a, b)
        assert is_common(a, places, b) and len(places) == lcs(a, b)


def test_long_alignment():
    rng = random.Random(2)
    a, b = ([rng.randrange(400) for _ in range(6000)] for _ in range(2))
    assert is_common(a, d.aligned(a, b), b)


def text(html):
    lines = list(d.page_lines(html))
    return d.main_lines([x for x, _ in lines], [p for _, p in lines], [])


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("just  text &amp; more", ["just text & more"]),
        ("<p>one<p>two<br>three<div>four</div>five", ["one", "two three", "four", "five"]),
        ("<nav>menu</nav><article><h1>T&eacute;</h1><p><b>x<br><p>y &lt;z&gt; &am &amp</article><footer>f</footer>", ["Té", "x", "y <z> &am &"]),
        ("<script>var a='</p><article>no';</script><style>p{}</style><p>yes", ["yes"]),
        ("<script>never closed <p>no", []),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", ["yes"]),
        ("<body class='has-sidebar'><div class=sidebar>no</div><p>yes", ["yes"]),
        ("<div id='cookie-notice'>no</div><div class=\"content\">yes</div>", ["yes"]),
        ("<div class='with ad'><article>yes</article>no</div>", ["yes"]),
        ("<article>yes<div class=comments><article>no</article></div><section id=comments>no</section></article>", ["yes"]),
        ("<article><header><h1>yes</h1></header><aside>no</aside><p>and <form>no<input value='x>y'></form>this</article>", ["yes", "and", "this"]),
        ("<main><p>in</main><p>out", ["in"]),
        ("<div role=navigation>no</div><div role=main>yes</div>no", ["yes"]),
        ("<head><title>no</title><body>yes", ["yes"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p><P>z", ["x", "y", "z"]),
        ("a < b and c <3 </ >d", ["a < b and c <3 d"]),
        ("<p>a &nbsp;b\n\tc</p>", ["a b c"]),
        ("<svg><text>no</text></svg><noscript>no</noscript><button>no</button>yes", ["yes"]),
        ("<nav>no<p>no<article>no</article></nav><p>yes", ["yes"]),
        ("<p class=notice>no<p>yes", ["yes"]),
        ("<span class=ad>no</span>yes", ["yes"]),
        ('<p id="x>unclosed quote</p><p>y', ["unclosed quote", "y"]),
    ],
)
def test_lines(html, want):
    assert text(html) == want


def test_inline_ad_ends_with_its_element():
    assert text("<p>a <span class=ad>no</span> b</p>") == ["a b"] and text("x<button>no</button> y<svg><b>no</b></svg>") == ["x y"]


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in d.op12_html(spark, SF).collect()}
    assert got.keys() == pages.keys() and len(got) > 20
    hosts = defaultdict(dict)
    for r in pages.values():
        lines = [t for t, _ in d.page_lines(r.html)]
        host, path = d.address(r.url)
        key = (path, d._digest(host, [d.sign(t) for t in lines]))
        hosts[host][tuple(lines)] = min(key, hosts[host].get(tuple(lines), key))
    for i, r in pages.items():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == r.url
        lines = [t for t, _ in d.page_lines(r.html)]
        host, _ = d.address(r.url)
        order = sorted(hosts[host], key=hosts[host].get)
        at = order.index(tuple(lines))
        own = hosts[host][order[at]][0]
        near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        near.sort(key=lambda x: -d._common(own, hosts[host][x][0]))  # ties: the one before
        assert got[i].n_lines == len(lines) and got[i].n_shared == (lcs(lines, near[0]) if near else 0)


def test_frames_are_deleted_across_ranges(spark):
    frame = "<div>Site name</div><div>All topics</div>"
    end = "<div>Imprint</div>"
    rows = [(i, f"http://a.b/x/{i % 7}/{i}", f"{frame}<div>text {i}</div><div>more {i}</div>{end}", 5) for i in range(60)]
    rows += [(i, "http://a.b/copy", f"{frame}<div>same</div>{end}", 5) for i in range(100, 140)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(4)
    got = {r.page_id: r for r in d.extract(df, Scratch(spark, "t")).collect()}
    assert len(got) == 100
    for i in range(60):
        assert got[i].lines == [f"text {i}", f"more {i}"] and (got[i].n_lines, got[i].n_shared) == (5, 3)
    assert all(got[i].lines == ["same"] for i in range(100, 140))


def test_edges(spark):
    rows = [(None, None, None), (1, "http://[bad", "<p>x"), (2, "", ""), (2, "", ""), (3, "http://h/p", "<p>y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, len(r.lines)) for r in d.extract(df, Scratch(spark, "t")).collect()), key=str)
    assert got == [(1, 1), (2, 0), (2, 0), (3, 50_000), (None, 0)]
    assert d.extract(df.limit(0), Scratch(spark, "t")).count() == 0
