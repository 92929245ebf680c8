"""Probabilities of tokens by what came before them, and the chains that they make."""

import pytest

from tessella.operators import segmentation
from tessella.plans import QUERIES
from tests.conftest import SF


def test_followed_equals_counting_again():
    tokens = ["a", " b", " b", ",", "a", " b", " b", "a", " b", "\n", "a", "a"]
    shares = [tokens.count(t) / len(tokens) for t in tokens]
    pairs = list(zip(["", *tokens], tokens))
    want = [(pairs[:i].count(pairs[i]) + shares[i]) / ([p[0] for p in pairs[:i]].count(pairs[i][0]) + 1) for i in range(len(tokens))]
    assert segmentation.followed(tokens, shares) == pytest.approx(want)


def test_chains_are_found_in_corpus_tokens(spark):
    docs = spark.createDataFrame([(1, "Open the red door. " * 12), (2, "each word here comes but once")], "doc_id long, text string")

    def by(follow):
        rows = segmentation.segment(segmentation.corpus_tokens(docs, follow=follow), "transition-chain").collect()
        return {d: max(r.tokens for r in rows if r.doc_id == d) for d in (1, 2)}

    assert by(False) == {1: 1, 2: 1}  # shares alone make no chain
    assert by(True) == {1: 3, 2: 1}


def test_query_has_chains(spark):
    assert QUERIES["transition_segments"](spark, SF).where("longest > 1").count() > 100
