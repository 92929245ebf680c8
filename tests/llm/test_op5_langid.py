import itertools
import math
import zlib
from collections import Counter

import numpy as np

from tessella.llm import langid
from tests.conftest import SF


def test_held_out_accuracy_and_fold(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = langid.op5_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


class BruteLanguages:
    """Error-correcting output codes for up to five languages, from the definition, with dictionaries and plain floats."""

    def __init__(self, rows):
        counts = {}
        for text, lang in rows:
            if text is not None and lang is not None:
                counts.setdefault(lang, Counter()).update(self.trigrams(text))
        self.langs = sorted(x for x, c in counts.items() if c)
        k, size = len(self.langs), langid.BUCKETS
        p = {x: {b: (counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * size) for b in range(size)} for x in self.langs}
        self.bits = []
        for rest in itertools.product((1, -1), repeat=k - 1):
            sign = dict(zip(self.langs, (1, *rest)))
            if -1 not in rest:
                continue
            up, down = ([x for x in self.langs if sign[x] == s] for s in (1, -1))
            mean = lambda group, b: sum(p[x][b] for x in group) / len(group)
            w = {b: math.log(mean(up, b)) - math.log(mean(down, b)) for b in range(size)}
            expected = {x: sum(p[x][b] * w[b] for b in range(size)) for x in self.langs}
            top, low = (sum(expected[x] for x in g) / len(g) for g in (up, down))
            centre, scale = (top + low) / 2, max((top - low) / 2, 1e-9)
            worst = min(sign[x] * (expected[x] - centre) / scale for x in self.langs)
            self.bits.append((sign, w, centre, scale, min(1.0, max(0.05, worst))))

    @staticmethod
    def trigrams(text):
        data = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode()) + b" "
        out = Counter(data[i : i + 3] for i in range(len(data) - 2))
        del out[b"   "]
        return Counter({h: n for h, n in _hashed(out).items()})

    def predict(self, text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        grams = self.trigrams(text)
        total, loss = sum(grams.values()), {}
        margins = [(sum(n * w[b] for b, n in grams.items()) / total - centre) / scale for _, w, centre, scale, _ in self.bits]
        for x in self.langs:
            loss[x] = sum(r * math.exp(-min(20, max(-20, sign[x] * m))) for (sign, _, _, _, r), m in zip(self.bits, margins))
        first, second = sorted(self.langs, key=lambda x: loss[x])[:2]
        score = 1 - loss[first] / loss[second]
        return first, score, score < langid.AMBIGUOUS


def _hashed(grams):
    out = Counter()
    for g, n in grams.items():
        out[(int.from_bytes(g, "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += n
    return out


def test_predictions_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = BruteLanguages([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    got = {r.doc_id: r for r in langid.op5_language(spark, SF).collect()}
    assert len(got) == len(rows) and len(model.langs) == 4
    for r in rows:
        lang, score, ambiguous = model.predict(r.text)
        g = got[r.doc_id]
        assert math.isclose(g.score, score, abs_tol=1e-4)
        assert (g.lang_pred == lang and g.ambiguous == ambiguous) or abs(score - langid.AMBIGUOUS) < 1e-4 or score < 1e-4


def test_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {}
    for r in docs.collect():
        want[r.lang] = want.get(r.lang, 0) + langid.trigrams(r.text)
    got = {(r.lang, r.bucket): r.n for r in langid.counts(docs).collect()}
    assert got == {(x, int(b)): int(n[b]) for x, n in want.items() for b in np.flatnonzero(n)}


def test_codewords():
    for k in (2, 3, 4, 5, 9, 40):
        c = langid.codewords(k).astype(int)
        agree = c @ c.T
        assert len(c) == k and (agree[~np.eye(k, dtype=bool)] < c.shape[1]).all()
    one = langid.trigrams("ab " * 200_000)  # in chunks, as in one piece
    assert one.sum() == 3 * 200_000 and langid.trigrams("").sum() == 0


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    rows = [(1, "the cat and the dog", "en", 1), (2, "el gato y el perro", "es", 1), (3, None, "en", 1), (4, "12 !?", None, 1), (None, "the dog", None, 1), (None, "the dog", None, 1), (5, "the " * 300_000, "xx", 1)]
    df = spark.createDataFrame(rows, schema)
    model = langid.fit(df)
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_ambiguous"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].lang_pred == by[4].lang_pred == "und" and by[3].lang_score == 0 and by[2].lang_pred == "es"
    empty = df.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(df, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    alone = langid.fit(df.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(df, alone).collect()} == {"en", "und"}
