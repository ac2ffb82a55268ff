"""Scores of the language model against a plain model of all pairs, wherever its parts are held."""

import random

import brute
import pytest

from vocabra.llm import lm


@pytest.mark.parametrize("share", [None, 0.02, 1.0])
def test_scores_equal_plain_ones_of_all_pairs(spark, monkeypatch, share):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice((3, 10, 60))]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    if share:  # as on a corpus so large that most words and pairs are below the shares
        monkeypatch.setattr(lm, "WORD_SHARE", share)
        monkeypatch.setattr(lm, "ARC_SHARE", share)
    got = {r.id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r[-1] for r in brute.language_model(rows)}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9, abs=1e-9)
