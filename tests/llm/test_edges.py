"""Clashing names, null and repeated ids, very long texts, empty tables, large benchmarks, recall of near-duplicates."""

import random
import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vocabra.llm import common, counts, leaks, lines, lm, near, repeats, secrets, toxicity

CLASHES = "n_words int, kept string, items string, hits string, _id long, _hash string, id string, row int, text_hash string, n_lines int, doc string, key string, base_failed string, N_chars long"
TEXT = " ".join(f"w{k}" for k in range(40))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{TEXT} own{i} tail{i}\nShared line", 777, "k", "i", "h", 5, "x", "own", 6, "t", 7, "d", "y", "b", 0) for i in range(12)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")


def test_stages_leave_columns_of_any_name_alone(spark, clashing):
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    own = lambda df: {tuple(v for k, v in r.asDict().items() if k not in ("text", "doc_id", "N_chars")) for r in df.collect()}
    want = own(clashing)
    made = {"good": repeats.good(clashing), "drop": lines.drop_lines(clashing), "keep": near.keep_one(clashing), "remove": leaks.remove(clashing, items)}
    for name, out in made.items():
        assert out.dtypes == clashing.dtypes and own(out) == want, name
    assert made["keep"].count() == 1 and all(r.text.endswith("tail" + str(r.doc_id)) and r.N_chars == len(r.text) for r in made["drop"].collect())
    assert all(" w3 " not in r.text and r.N_chars == len(r.text) for r in made["remove"].collect()) and made["good"].count() == 12


def test_keep_one_beside_null_and_repeated_ids(spark):
    rows = [(None, TEXT), (None, TEXT), (1, TEXT), (1, TEXT), (2, TEXT + " x"), (3, ""), (3, ""), (4, None), (4, None), (5, "other words " * 9), (5, TEXT + " y")]
    out = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == Counter([(None, TEXT), (None, TEXT), (1, TEXT), (3, ""), (3, ""), (4, None), (4, None), (5, "other words " * 9)])


def test_text_ids(spark):
    """Ids of any type: the smallest in their own order stays."""
    rows = [("b", TEXT), ("a-10", TEXT), ("a-9", TEXT + " x"), (None, TEXT), ("é", ""), ("z", "other words here and there are these ones")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.id: r.component_id for r in near.groups(docs).collect()} == {"b": "a-10", "a-10": "a-10", "a-9": "a-10", None: None, "é": "é", "z": "z"}
    assert Counter(map(tuple, near.keep_one(docs).collect())) == Counter([rows[1], rows[3], rows[4], rows[5]])


def test_shared_ids_lose_no_link(spark):
    one, two = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, one), (5, two), (6, one + " x"), (7, two + " x"), (4, "y " + two)]
    got = {(r.id, r.text_hash): r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((k[0], c) for k, c in got.items()) == [(4, 4), (5, 4), (5, 5), (6, 5), (7, 4)]


def test_recall_at_the_border(spark, monkeypatch):
    """Pairs with a similarity from 0.75 to 0.80, one pair a group: at least 0.99 are found, by tables and sketches together."""
    rng, texts, pairs = random.Random(11), [], 0
    for k in range(600):
        words = [f"{k}x{i}" for i in range(300)]
        other = list(words)
        while True:
            other[rng.randrange(300)] = f"r{rng.random()}"
            a, b = (set(zip(*(w[j:] for j in range(5)))) for w in (words, other))
            similar = len(a & b) / len(a | b)
            if similar < 0.81:
                break
        if 0.75 <= similar <= 0.80:
            pairs += 1
            texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near.groups(docs).where("id <> component_id").count()
    assert pairs > 400 and found >= 0.99 * pairs


def test_large_benchmarks_are_routed(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.limit(300).unionByName(docs.where("text IS NULL").limit(1)).cache()
    one = sorted(map(repr, leaks.digests(docs, items).collect())), sorted(map(repr, leaks.remove(docs, items).collect()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(leaks, "BLOCK_BYTES", size // 50)
    assert leaks._size(leaks._with_words(items)) > 50
    assert (sorted(map(repr, leaks.digests(docs, items).collect())), sorted(map(repr, leaks.remove(docs, items).collect()))) == one


def best(counter, word):
    """Pieces of the best segmentation, by the last piece."""
    made = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(made[end - 1][0] + counter.byte * size, made[end - 1][1] - size)]
        options += [(made[s][0] + counter.score[word[s:end]], made[s][1] - 1) for s in range(end) if word[s:end] in counter.score]
        made.append(max(options))
    return -made[-1][1]


def test_token_counts_of_whole_texts(spark):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = counts.UnigramCounter(f.read())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    known: dict[str, int] = {}
    for r in counts.query(spark, "/root/testdata/sf0.001").collect():
        words = re.findall("▁?[^▁\n]+|[▁\n]", "▁" + texts[r.doc_id].replace(" ", "▁")) if texts[r.doc_id] else []
        for w in words:
            known[w] = known.get(w) or best(counter, w)
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_the_trie_is_shared_and_replanted(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        counter = counts.UnigramCounter(f.read())
    first = counter.walk(["▁token", "▁tokens"])
    assert len(counter.arcs) == 1 + len("▁tokens")  # one path for both
    monkeypatch.setattr(counts, "NODES", 4)
    assert counter.walk(["▁token", "▁tokens"]) == first


def test_a_long_repeat_alone_fails(spark):
    """900 words twice in 10,000: 18 percent covered, and longer than the longest one may be."""
    rng = random.Random(3)
    own = [f"u{rng.random()}" for _ in range(8200)]
    passage = [f"p{k}" for k in range(900)]
    text = " ".join(own[:4000] + passage + own[4000:] + passage)
    row = repeats.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not row.base_failed and not row.kept and row.longest_repeat == 900 and row.n_repeat_words == 1800


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    text = "\n".join(f"line {k} of words token=abcdef{k:06d} w3 w4 w5" for k in range(40_000))
    spark.createDataFrame([(1, text), (2, "short"), (2, None)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, "line 3 of words token abcdef000003 w3 w4 w5 line")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, text


def test_very_long_texts(spark, long):
    at, text = long
    docs = spark.read.parquet(f"{at}/documents.parquet")
    scores = {(r.doc_id, r.n_tokens) for r in lm.query(spark, at).collect()}
    assert scores == {(1, len(text.split()) + 1), (2, 2), (2, 1)}
    assert all(0 <= r.score <= 1 for r in toxicity.query(spark, at).collect())
    hit = next(r for r in leaks.query(spark, at).collect() if r.doc_id == 1)
    assert hit.n_hit == 10 and hit.n_words == len(brute.benchmark_words(text))
    assert {(r.doc_id, r.n_lines) for r in lines.query(spark, at).collect()} == {(1, 40_000), (2, 1)}
    found = next(r for r in secrets.query(spark, at).collect() if r.doc_id == 1)
    assert found.n_assign == 40_000 and found.spans.endswith(f"assign:{text.rindex('token')}:{text.rindex(' w3')}")
    assert near.groups(docs).count() == 3 and repeats.judge(docs).count() == 3


def test_empty_tables(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string", "labels": "doc_id long, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for module in (lm, toxicity, secrets, counts):
        assert module.query(spark, str(tmp_path)).count() == 0


def test_labels_that_differ_count_for_none(spark):
    docs = spark.createDataFrame([(i, "bad" if i % 2 else "good") for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(1, 60) for y in (0, 1)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(docs, labels).collect()} == {(0.0, 0)}


def test_checkpoints_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checked_dir(Session())
    assert len(corpus_pipeline.STAGES) == 5
