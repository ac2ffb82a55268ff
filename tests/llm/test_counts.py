import random

import public_tokenizers
import pytest

from vocabra.llm import counts
from vocabra.llm.pieces import SPACE

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return counts.UnigramCounter(f.read())


def brute(counter, word):
    """The best segmentation of one word, by recursion over its last piece."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + counter.byte * size, best[end - 1][1] - size)]
        options += [(best[s][0] + counter.score[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in counter.score]
        best.append(max(options))
    return -best[-1][1]


def every(counter, word):
    """All segmentations of a short word, one by one."""
    if not word:
        return [(0, 0)]
    out = []
    for n in range(1, len(word) + 1):
        cost = [(counter.score[word[:n]], -1)] if word[:n] in counter.score else []
        if n == 1:
            size = len(word[0].encode())
            cost.append((counter.byte * size, -size))
        out += [(a + s, b + k) for a, b in cost for s, k in every(counter, word[n:])]
    return out


def test_walk_equals_brute_force(counter):
    rng = random.Random(1)
    words = sorted({SPACE * rng.randint(0, 1) + "".join(rng.choice(["th", "e", "in", "g", "é", "中", "\x01", "😀", "."]) for _ in range(rng.randint(1, 9))) for _ in range(2000)})
    assert counter.walk(words) == {w: brute(counter, w) for w in words}
    for w in [w for w in words if len(w) <= 9][:200]:
        assert counter.walk([w])[w] == -max(every(counter, w))[1]


def test_counts_do_not_depend_on_slices_or_memos(counter, monkeypatch):
    texts = ["", "the end. The\nend", "  two  spaces ", "the end", "x" * 3000, "\0 nul"]
    whole = counter.count(texts)
    monkeypatch.setattr(counts, "MEMO", 2)
    assert [tuple(x[0] for x in counter.count([t])) for t in texts] == list(zip(*whole, strict=True))


def test_query(spark, tmp_path, counter):
    rows = [(1, None, 7), (1, "the end", 7), (None, "the end", 7), (2, "", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.n_tokens, r.n_pretokens) for r in counts.query(spark, str(tmp_path)).collect()))
    assert got == [(0, 0), (0, 0), (2, 2), (2, 2)]
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
