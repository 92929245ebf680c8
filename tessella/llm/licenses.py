"""Licence scans by a positional rare-token index.

Every licence is given by templates: notices of a few words, and sentences of the licences' bodies,
each with phrases that must occur. The index maps the templates' words to postings (template,
position). Document frequencies of these words are counted over all documents, so a word's IDF tells
how well it discriminates here. Of a document's licence words, the highest-IDF ones are looked up for
each template whose mandatory words it has; each posting gives a relative position, document position
less template position, and positions where enough of the template's rare weight agrees are
candidates. A candidate counts when the template's mandatory phrases stand word by word where the
alignment says, or, for the base phrases, the whole template does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import prepare, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# ---- fixed values: phrases of the contract, and public licences' notices -------------------
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: label, notice, mandatory phrases
NOTICES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license version"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "creative commons attribution sharealike", ["attribution sharealike"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    # sentences of the bodies
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["shall be included in all copies"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ["the software is provided as is"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["must retain the above copyright notice"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ["must reproduce the above copyright notice"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["to endorse or promote products"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ["required by applicable law or agreed to in writing"]),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", ["perpetual worldwide non exclusive no charge royalty free"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", ["in the hope that it will be useful"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["gnu general public license along with"]),
    ("gpl", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works", ["to take away your freedom to share and change"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["lesser general public license along with"]),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", ["interacting with it remotely through a computer network"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["in no event will the authors be held liable"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["must be plainly marked as such"]),
    ("bsl", "boost software license version 1 0", ["boost software license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("wtfpl", "do what the fuck you want to public license", ["you want to public license"]),
    ("cc-by-nc", "creative commons attribution noncommercial", ["attribution noncommercial"]),
    ("cc-by-nd", "creative commons attribution noderivatives", ["attribution noderivatives"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form", ["free to copy modify publish use compile sell"]),
]
#: Words that are looked up for a template, and the share of its rarest words' weight that must agree.
ANCHORS, AGREE = 4, 0.5


def words(text: str | None) -> list[bytes]:
    """The text's words, ASCII capitals as small letters."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # offset in the template, words
    base: bool


def templates() -> list[Template]:
    out = [Template(label, words(text), [(0, words(text))], True) for label, text in BASE]
    for label, text, phrases in NOTICES:
        w, found = words(text), []
        for p in phrases:
            pw = words(p)
            at = next(i for i in range(len(w)) if w[i : i + len(pw)] == pw)
            found.append((at, pw))
        out.append(Template(label, w, found, False))
    return out


class Index:
    """Templates, postings of all their words, and IDF."""

    def __init__(self, docs_with: dict[bytes, int], n_docs: int):
        self.templates = templates()
        self.idf = {w: math.log((n_docs + 1) / (docs_with.get(w, 0) + 1)) + 1 for x in self.templates for w in x.words}
        self.by_rarity: list[list[bytes]] = []  # of each template, its words
        self.places: list[dict[bytes, list[int]]] = []  # of each template, its words' positions
        self.weight: list[float] = []  # of each template, its rarest words' weight
        self.needs: list[frozenset[bytes]] = []  # of each template, the words of its mandatory phrases
        for x in self.templates:
            places: dict[bytes, list[int]] = {}
            for p, w in enumerate(x.words):
                places.setdefault(w, []).append(p)
            rare = sorted(places, key=lambda w: (-self.idf[w], w))
            self.by_rarity.append(rare)
            self.places.append(places)
            # every place of a base phrase has all its words, so its rarest one finds them all
            self.weight.append(sum(self.idf[w] * len(places[w]) for w in rare[: 1 if x.base else ANCHORS]))
            self.needs.append(frozenset(w for _, phrase in x.phrases for w in phrase))

    def scan(self, w: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its rarest words' weight that agrees), verified."""
        own = set(w)
        open_ = [t for t, need in enumerate(self.needs) if need <= own]
        if not open_:
            return []
        asked: dict[bytes, list[int]] = {}  # word to the templates that it's looked up for
        for t in open_:
            here = [x for x in self.by_rarity[t] if x in own]
            for x in here[: 1 if self.templates[t].base else ANCHORS]:
                asked.setdefault(x, []).append(t)
        votes: Counter = Counter()
        for i, x in enumerate(w):
            for t in asked.get(x, ()):
                for p in self.places[t][x]:
                    votes[t, i - p] += self.idf[x]
        found = []
        for (t, at), v in votes.items():
            share = min(1.0, v / self.weight[t])
            if share < AGREE:
                continue
            for offset, phrase in self.templates[t].phrases:
                a = at + offset
                if a < 0 or w[a : a + len(phrase)] != phrase:
                    break
            else:
                found.append((t, at, share))
        return found


def vocabulary() -> list[bytes]:
    return sorted({w for t in templates() for w in t.words})


def fit(docs: DataFrame) -> Index:
    """Document frequencies of the templates' words over all documents; a row per such word comes back."""
    prepare(docs.sparkSession)
    vocab = vocabulary()

    def count(batches):
        known, total, n = {w: i for i, w in enumerate(vocab)}, np.zeros(len(vocab), np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for w in known.keys() & set(words(text)):
                    total[known[w]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(len(vocab)), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["word", "n"]
        )

    got = docs.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r.word: r.n for r in got}
    return Index({w: by.get(i, 0) for i, w in enumerate(vocab)}, by.get(-1, 0))


SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, matches array<struct<label: string, template: int, word: long, share: double>>"
)


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """A row per row of docs (doc_id, text; other columns are ignored), with all places that match.

    n_base counts the base phrases' places, first_word and last_word are their least and largest
    start; score is the best match's share of rare words, 1 for a base phrase, 0 without a match.
    Null and empty texts have no words and no labels; repeated rows are answered alike.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(index)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    match = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("word", pa.int64()), ("share", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(batches):
        ix = sent.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                found = ix.scan(w)
                base = [(at, ix.templates[t].label) for t, at, _ in found if ix.templates[t].base]
                starts = [at for at, _ in base]
                rows.append(
                    (
                        doc_id, len(w), len(base), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted({x for _, x in base})), ",".join(sorted({ix.templates[t].label for t, _, _ in found})),
                        min(1.0, max((s for _, _, s in found), default=0.0)),
                        [{"label": ix.templates[t].label, "template": t, "word": max(at, 0), "share": s} for t, at, s in sorted(found)],
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([*kinds, match])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; word frequencies counted over all of them first."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).drop("matches")
