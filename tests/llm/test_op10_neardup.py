import numpy as np
import pytest

from tessella.llm import neardup
from tests.conftest import SF


def brute(rows, k, num, den=100):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and bool(a) and bool(sets[j])
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if same or (a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j])):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if d is None or not sets[i] else min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_fixture(spark, k, num):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_duplicates(docs, k=k, num=num).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, num)


def family(rng, n, words=120):
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for p in rng.integers(0, words, int(rng.integers(0, 6))):
            t[p] = f"x{rng.integers(0, 30)}"
        out.append(" ".join(t))
    return out


def test_families_with_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = family(rng, 60) + family(rng, 40) + ["A b", "a B", "a b c", "a B c", "", None, "  \n", "b a"]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    want = brute(rows, 3, 85)
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, m int, c string")
    for size, signatures in ((1_000_000, 10_000), (700, 7)):  # one block, many blocks
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", size)
        monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", signatures)
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", 10)
        got = neardup.near_duplicates(df, k=3, num=85).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_growing_texts_with_blocks(spark, monkeypatch):
    """A chain of texts, each a little longer than the last: sizes spread over many classes, links cross them."""
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate(int(20 * 1.06**j) for j in range(70))]
    rows += [(500 + i, " ".join(words[i * 40 : i * 40 + 130])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert 1 < len({r[2] for r in want}) < len(rows)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", 5)
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, k=3, num=85).collect()), key=str) == want


def test_spread_meets_every_possible_pair_once(spark, monkeypatch):
    from tessella.llm.common import Scratch

    rng = np.random.default_rng(3)
    sizes = [int(x) for x in np.exp(rng.uniform(0, 9, 120))] + [17, 20, 340, 400, 4, 4, 4]
    members = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "c long, m long, n long")
    from pyspark.sql import functions as F

    groups = {}
    for r in neardup.spread(members, F.lit(1), 6, 85, 100, Scratch(spark, "test")).collect():
        groups.setdefault((r.g, r.lo, r.hi), []).append((r.m, r.side))
    met = []
    for (g, lo, hi), rows in groups.items():
        cross = g % 2 == 1 or lo != hi
        met += [(min(a, b), max(a, b)) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if not cross or s != t]
    assert len(met) == len(set(met))
    possible = {(i, j) for j, b in enumerate(sizes) for i, a in enumerate(sizes[:j]) if 100 * min(a, b) >= 85 * max(a, b)}
    assert possible <= set(met) and len(met) < len(sizes) * (len(sizes) - 1) / 4


def test_least_matches():
    t = neardup.least_matches(210, 0.85)
    rng = np.random.default_rng(1)
    assert 130 < t < 160 and (rng.binomial(210, 0.85, 1_000_000) >= t).all()


def test_edges(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (None, None), (7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (8, "word " * 100_000)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, schema), k=3, num=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 85)
