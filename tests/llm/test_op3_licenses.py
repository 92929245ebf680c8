import re

import pytest

from tessella.llm import licenses as L
from tests.conftest import SF

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op3_licenses(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 10
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


ODD = [
    None, "", "MIT", "license mit license MIT License", "cc by cc by", "CC-BY 4.0", "gnu general public licensé",
    "GNU General\nPublic, License apache license", "x " * 100_000 + "apache license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "the GNU Lesser General Public License", "All rights reserved.", "rights reserved",
]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "mit license", 1)] * 2, "doc_id long, text string, n_words int")
    by = {r.doc_id: r for r in L.scan(df, L.fit(df)).collect()}
    for i, t in enumerate(ODD):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
    assert by[9].labels == "bsd" and by[10].labels == "lgpl" and by[11].labels == "proprietary" and by[12].labels == ""
    assert L.scan(df.limit(0), L.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("counts", [{}, {b"license": 900, b"mit": 950, b"cc": 999}])
def test_places_do_not_depend_on_frequencies(counts):
    index = L.Index(counts, 1000)
    for t in ODD:
        found = index.scan(L.words(t))
        assert sum(index.templates[x].base for x, _, _ in found) == brute(t)[1]


def brute_labels(text, index):
    """Labels and score from the definition: every template at every place."""
    w = L.words(text)
    labels, score = set(), 0.0
    for t in index.templates:
        rare = sorted(set(t.words), key=lambda x: (-index.idf[x], x))
        n = 1 if t.base else L.ANCHORS
        total = sum(index.idf[x] for x in t.words if x in rare[:n])
        looked = [x for x in rare if x in w][:n]
        for at in range(-len(t.words), len(w)):
            agree = sum(index.idf[x] for p, x in enumerate(t.words) if x in looked and 0 <= at + p < len(w) and w[at + p] == x)
            whole = all(at + o >= 0 and w[at + o : at + o + len(p)] == p for o, p in t.phrases)
            if whole and min(1, agree / total) >= L.AGREE:
                labels.add(t.label)
                score = max(score, min(1, agree / total))
    return ",".join(sorted(labels)), score


def test_labels_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD) if t is None or len(t) < 5000]
    notices = [n for _, n, _ in L.NOTICES]
    rows += [(100 + i, n) for i, n in enumerate(notices)]
    rows += [(200 + i, "some words before. " + " ".join(x for j, x in enumerate(n.split()) if j % 9 != 8) + " and after") for i, n in enumerate(notices)]
    rows += [(300, " ".join(notices)), (301, " ".join(reversed(" ".join(notices).split())))]
    rows += [(400 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '(?i)licen[sc]e|copyright|cc by'").limit(30).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = L.fit(df)
    by = {r.doc_id: r for r in L.scan(df, index).collect()}
    for i, t in rows:
        labels, score = brute_labels(t, index)
        assert by[i].labels == labels and abs(by[i].score - score) < 1e-9, t
    for i, (label, _, _) in enumerate(L.NOTICES):
        assert label in by[100 + i].labels.split(",")
