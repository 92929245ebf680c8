import hashlib
import re

import pytest
import regex

from tessella.llm import winnowing as W
from tests.conftest import SF


def words(t):
    t = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])", r" \1 ", t)
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if w]


def brute(text):
    """Chosen positions and grams, by the definition; a gram stands for its words."""
    w = words(text)
    if not w:
        return [], set()
    return w, [tuple(w[i : i + W.K]) for i in range(max(1, len(w) - W.K + 1))]


def test_choice_equals_definition(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    texts += ["", "a", "a b", "a b c d e", "x " * 100, "lorem ipsum " * 30, "这是一个没有空格的文本，" * 20 + "第二句话abc说明", "ภาษาไทยไม่มีช่องว่าง" * 9, "한국어 문장 は 日本語テキスト" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in W.fingerprint(df).collect()}
    # every gram's hash, from windows of one gram
    for i, t in enumerate(texts):
        w, grams = brute(t)
        r = got[i]
        if not w:
            assert r.grams == [] and r.hashes == []
            continue
        h = dict(zip(r.positions, [g >> W.POSITION_BITS for g in r.grams]))
        known = {grams[p]: x for p, x in h.items()}
        assert len(set(known.values())) == len(known)
        for a in range(max(1, len(grams) - W.WINDOW + 1)):
            window = range(a, min(a + W.WINDOW, len(grams)))
            inside = [p for p in window if p in h]
            assert inside  # a fingerprint in every window
            least = min(h[p] for p in inside)
            best = max(p for p in inside if h[p] == least)
            # no gram in the window that is equal to the least stands further right
            assert all(grams[p] != grams[best] for p in window if p > best)


def test_query_equals_brute_force(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in W.op9_winnowing(spark, SF).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
        if nxt == t:
            assert r.near_next == 1
    long = [r for r in got.values() if r.n_chars > 2000]
    assert sum(r.near_edited for r in long) / len(long) > 0.25 > 0.1 > sum(r.near_next for r in long) / len(long)


def chosen(hash_of, w):
    """Hashes that winnowing chooses, from the hash of each gram."""
    grams = [tuple(w[i : i + W.K]) for i in range(max(1, len(w) - W.K + 1))] if w else []
    out = set()
    for a in range(max(1, len(grams) - W.WINDOW + 1) if grams else 0):
        out.add(min(hash_of[g] for g in grams[a : a + W.WINDOW]))
    return out


def test_likeness_equals_brute_force(spark, monkeypatch):
    """near_edited and near_next from each gram's hash (got with windows of one) and the definition."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()] + ["", "a b", "没有空格" * 40, "没有空格" * 39]
    rows = sorted(enumerate(texts), reverse=True)
    got = {r.doc_id: r for r in W.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edited = {}
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        edited[d] = t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]
    every = [*texts, *edited.values()]
    monkeypatch.setattr(W, "WINDOW", 1)
    hash_of = {}
    for r in W.fingerprint(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect():
        w = words(every[r.doc_id])
        for p, g in zip(r.positions, r.grams):
            hash_of[tuple(w[p : p + W.K])] = g >> W.POSITION_BITS
    monkeypatch.undo()
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, (d, t) in enumerate(rows):
        own, after = chosen(hash_of, words(t)), chosen(hash_of, words(rows[(i + 1) % len(rows)][1]))
        assert abs(got[d].near_edited - like(own, chosen(hash_of, words(edited[d])))) < 1e-12
        assert abs(got[d].near_next - like(own, after)) < 1e-12


def test_native_plan(spark):
    plan = W.op9_winnowing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rows", [[], [(None, None, 1)], [(1, "a b", 1), (1, "a b", 2), (None, "c", 3), (None, None, 4), (2, "w " * 50000, 5), (1, "z", 6)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = W.compare_edits(df).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0].near_next == 1.0 and got[0].n_chars == 0
    one = [r for r in got if r.doc_id == 1 and r.n_chars == 3]
    assert len({tuple(r) for r in one}) <= 1
