import random
import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import phrases
from tests.conftest import SF

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, longest=3, least=10):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    by = {}
    for (lang, p), a in cands.items():
        if 100 * longer[lang, p] >= 50 * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in by.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])
    )


def of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_sql_and_brute_force(spark):
    got = of(phrases.op11_phrases(spark, SF))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.OP11_SQL})").fetchall()) == got and len(got) > 50
    rows = duckdb.sql("SELECT lang, text FROM documents").fetchall()
    assert got == brute(rows)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_random_texts(spark, monkeypatch, longest):
    monkeypatch.setattr(phrases, "BLOCK", 20_000)
    monkeypatch.setattr(phrases, "BUCKET", 3_000)
    rng = random.Random(longest)
    vocabulary = ["the", "Of", "É", " x", "new", "york", "a", "\U0001f600", "Z" * 300, "x\x00y"]
    rows = []
    for i in range(700):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", "\r\n", "!"]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice(["en", "en", "de", None, "", "a\nb\tc"]), rng.choice([text, text, text, None])))
    rows += [("en", "New York city hall. " * 40)] * 30 + [("fr", "mot " * 20_000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    for top in (7, None):
        got = of(phrases.collocations(phrases.phrase_counts(df, longest), longest, top=top))
        assert got == brute(rows, top or 10**9, longest)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "")], [("en", " .\n,")], [(None, "one")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    assert of(phrases.collocations(phrases.phrase_counts(df))) == []


def test_products_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "", 5 * big), ("en", "a", 3 * big), ("en", "b", 2 * big + 1), ("en", "a b", 2 * big)]
    got = of(phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, n long")))
    assert got == [("en", 1, "a b", 2 * big, 3 * big, 2 * big + 1, 5 * big, 1000000 * (2 * big) ** 2 // (3 * big * (2 * big + 1)))]
