import hashlib
from collections import defaultdict

import pytest

from tessella.llm import warc
from tests.conftest import SF

BIG = "<p>" + "x" * 1000
ROWS = [
    (1, "http://a.example.com/x", BIG), (5, "https://b.example.com/", BIG), (3, "http://www.a.example.com/x#top", BIG),
    (2, None, None), (None, "bad url [", "small"), (7, "http://é.example.org/a b?q=1", "small"), (8, "http://a.example.com/x", "é" * 600),
    (9, "\n odd\r\n: x", "é" * 600), (10, "http://c.de/", "y" * 3_000_000), (11, "http://d.de/", "z" * 999), (12, "http://d.de/", "z" * 999),
]


def brute(rows):
    by = defaultdict(list)
    for p, _, h in rows:
        by[(h or "").encode()].append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in by[b] if x is not None), default=None)
        again = len(b) >= 1000 and len(by[b]) > 1 and top is not None and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [[], ROWS, ROWS + [(4, "u", BIG)] * 3 + [(None, "u", BIG)], ROWS * 3 + [(20 + i, "http://hot.example.com/", "p") for i in range(40)]])
def test_round_trip(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    root = warc.archive(df)
    got = warc.find_captures(df, root).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert sorted(r.url for r in got) == sorted(r[1] or "" for r in rows)
    assert all(r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    find = warc.Lookup(root)
    for url in [*{r[1] for r in rows}, "http://nowhere.example/", "zz", ""]:
        want = sorted(str(p) for p, u, _ in rows if warc.url_key(u) == warc.url_key(url))
        assert sorted(str(r["page_id"]) for r in find.find(url)) == want
    absent = spark.createDataFrame([(999, "http://a.example.com/x"), (1, "http://nowhere.example/")], "page_id long, url string")
    assert warc.find_captures(absent, root).count() == 0
    shards = [find.root.entry(i) for i in range(find.root.n)]
    assert all(a["last"] <= b["first"] for a, b in zip(shards, shards[1:]))
    find.close()


def test_a_second_attempt_has_files_of_its_own(spark, monkeypatch):
    """Each task's first attempt writes its files and is lost; the rows lead to those of the second."""
    import os

    rows = [(i, f"http://h{i % 7}.example/{i}", f"page {i} " * 40) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    root = warc.archive(df)
    folder = os.path.dirname(root.removeprefix("file:").replace("//", "/"))
    names = [n.split("-")[2] for n in os.listdir(folder) if n.startswith("archive-")]
    assert len(names) == len(set(names)) and all(len(n) == 32 for n in names)
    first = {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder)}
    other = warc.archive(df.orderBy(df.html.desc()))  # the same task numbers, rows in another order
    assert {n: open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder)} == first
    for r in (root, other):
        got = warc.find_captures(df, r).collect()
        assert sorted((x.page_id, x.payload.decode()) for x in got) == sorted((p, h) for p, _, h in rows)


def test_sorted_lookups_read_each_block_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    rows = [(i, f"http://h{i % 5}.example/{i}", "p") for i in range(300)]
    root = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    find, reads = warc.Lookup(root), []
    inner = find._read
    monkeypatch.setattr(find, "_read", lambda s, i: (reads.append((s, i)) if (s, i) != find.at else None, inner(s, i))[1])
    for place in sorted(warc.order(warc.url_key(u), p) for p, u, _ in rows):
        assert len(list(find.captures(place, place))) == 1
    assert len(reads) == len(set(reads))


def test_fixture(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = warc.op2_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keys():
    assert warc.url_key("https://www.News.example.co.uk:8080/Path?q=A#f") == "uk,co,example,news)/path?q=a"
    assert warc.url_key("example.com") == "com,example)/" and warc.url_key(None) == ")/"
