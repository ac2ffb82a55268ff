"""Operators that learn, and the pipeline: against plain versions and on held-out rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from vocabra.llm import components, lines, lm, near, packed, repeats, toxicity, urls
from vocabra.llm.common import LOWER

SF = "/root/testdata/sf0.001"


def write(spark, at, rows, name="documents", schema="doc_id long, text string, lang string, source string, n_chars long"):
    width = schema.count(",") + 1
    spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_scores_equal_plain_ones(spark, documents, tmp_path):
    long = " ".join(f"w{k % 700}" for k in range(60_000))
    rows = [*documents, (None, "Ünd the\x0bthe"), (5, None), (5, ""), documents[3], (7001, long), (None, None)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.query(spark, write(spark, tmp_path, rows)).collect()]
    key = lambda r: (repr(r[:5]), r[5])
    for g, w in zip(sorted(got, key=key), sorted(brute.language_model(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)


def test_scores_equal_sql(spark, documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM ({lm.ORACLE_SQL}) ORDER BY doc_id").fetchall()
    got = lm.query(spark, SF).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").orderBy("doc_id").collect()
    for g, w in zip(got, want, strict=True):
        assert tuple(g) == w


def test_parts_and_cache_change_nothing(spark, documents, monkeypatch, tmp_path):
    """Small chunks, and a cache of nearly all or of no words, give the same scores."""
    at = write(spark, tmp_path, documents[:60])
    read = lambda: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.query(spark, at).collect())
    whole = read()
    monkeypatch.setattr(lm, "LEAST", 1)
    assert read() == whole
    monkeypatch.setattr(lm, "LEAST", 10**6)
    assert read() == whole


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = lm.query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.9


def test_automaton_is_a_distribution():
    words = {b"a": 50, b"b": 30, b"c": 10, lm.END: 20}
    pairs = [(None, b"a", 15), (None, b"b", 5), (b"a", b"b", 20), (b"a", lm.END, 10), (b"a", b"a", 20), (b"b", b"b", 2), (b"b", b"c", 28), (b"c", b"a", 10)]
    after = {}
    for left, _, n in pairs:
        after.setdefault(left, [0, 0, 0])[min(n, 3) - 1] += 1
    model = lm.BackoffAutomaton(words, 115, 7, 20, (0.4, 0.6, 0.8), after, pairs)
    for left in (None, b"a", b"b", b"c"):
        state = lm.START_CODE if left is None else model.code[left]
        arcs = {pair & 0xFFFFFFFF: w for pair, w in model.arcs.items() if pair >> 32 == state}
        rest = 1 - sum(model.base[k] for k in arcs)  # what the failure arc leads to, words that are not cached among it
        assert sum(10**w for w in arcs.values()) + model.fail[state] * rest == pytest.approx(1, abs=1e-9)


def test_packed_integers():
    rng = np.random.default_rng(1)
    for top in (1, 200, 1 << 17, 1 << 63):
        x = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (packed.unpack(packed.pack(x)) == x).all() and (packed.unpack(packed.pack(np.sort(x), True), True) == np.sort(x)).all()
    assert not len(packed.unpack(packed.pack(np.zeros(0, np.uint64)))) and [bytes(f) for f in packed.fields(packed.joined([b"a", b"", b"xyz"]))] == [b"a", b"", b"xyz"]


def test_no_training_text(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm.query(spark, write(spark, tmp_path, [(i, "a b a") for i in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(4, 0, 0)] * 3 and all(math.isfinite(r.score) and r.base_score == 0 for r in got)
    assert lm.query(spark, write(spark, tmp_path / "e", [])).count() == 0


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = {bytes(rng.choice(b"abc") for _ in range(rng.randint(3, 12))): (1.0, False) for _ in range(30)}
    may = lambda t: (len(t) >= 5) + (len(t) >= 10)
    automaton = toxicity.TermAutomaton(terms)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcx") for _ in range(rng.randint(1, 13)))
        want = min((brute.distance(word, t) for t in terms if brute.distance(word, t) <= may(t)), default=-1)
        found, n = automaton.find(word)
        assert (n if found >= 0 else -1) == want, word
    begins = toxicity.TermAutomaton({b"lowei": (1.0, True)})
    assert begins.find(b"loweischaft") == (0, 0) and begins.find(b"lowxischaft") == (0, 1) and begins.find(b"lowe")[1] == 1 and begins.find(b"xowei") == (0, 1)
    assert begins.find(b"olweis")[1] == 1 and begins.find(b"xxwei") == (-1, 0)


def plain_features(terms, text):
    """Features by comparing each word with each term; quotation is only looked for where it opens and closes near by."""
    ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(brute.LETTERS))
    exact = [terms[w.encode()] for w in ws if w.encode() in terms]
    fuzzy = [w for w in ws if w.encode() not in terms and any(brute.distance(w.encode(), t) <= (len(t) >= 5) + (len(t) >= 10) for t in terms)]
    weight = sum(x[0] for x in exact)
    return [math.log1p(weight), math.log1p(len(exact)), math.log1p(len({w for w in ws if w.encode() in terms})), math.log1p(len(fuzzy))]


def test_features_equal_plain_ones():
    rng = random.Random(9)
    terms = {b"idiot": (5.0, False), b"worthless": (4.0, False), b"disgusting": (3.0, False), b"bad": (1.0, False)}
    vocabulary = ["idiot", "idoit", "1diot", "worthles", "wrothless", "disgustign", "disgxstixg", "bad", "bed", "fine", "day", "good", "Idiot", "WORTHLESS"]
    automaton = toxicity.TermAutomaton(terms)
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 15)))
        assert automaton.features(text.encode()) == pytest.approx(plain_features(terms, text))


def test_scores_follow_features(spark, tmp_path):
    """The whole query on a small table: scores are the logistic of a weighted sum of features, larger for toxic texts."""
    rng = random.Random(2)
    clean = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(clean, k=12)) + (" you absolute worthless idiot" if i % 4 == 0 else " fine")) for i in range(400)] + [(None, "worthless idiot"), (900, None)]
    at = write(spark, tmp_path, rows)
    write(spark, tmp_path, [(i, int(i % 4 == 0)) for i in range(400)] + [(8, 0), (12, 0)], "labels", "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.query(spark, at).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400)) and got[None].predicted == 1 and got[900].predicted == 0
    assert {got[i].held_out for i in range(400)} == {True, False} and got[900].score == min(r.score for r in got.values())


def test_signs_inside_words():
    a = toxicity.TermAutomaton({b"idiot": (5.0, False)})
    plain = a.features(b"no hit here")
    for text in (b"id*ot", b"you id!ot,", b"IDI@T"):
        assert a.features(text) == [*plain[:3], math.log1p(1)]
    assert a.features(b"e-mail a.b c*d") == plain and a.features(b"idiot-like") == a.features(b"idiot")


def test_quoted_hits_weigh_less():
    a = toxicity.TermAutomaton({b"idiot": (5.0, False)})
    plain, quoted, far = (a.features(t) for t in (b"you idiot there", b'he said "you idiot" there', b'"x" ' + b"w " * 40 + b"idiot"))
    assert plain == far and 0 < quoted[0] < plain[0] and a.features(b"") == [0.0] * 4


def test_toxicity_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    rows = toxicity.query(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r.predicted == r.toxic for r in rows]
    assert sum(hit) / len(hit) > 0.98 and sum(r.predicted for r in rows if r.toxic) > 0.85 * sum(r.toxic for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_without_labels(spark, tmp_path):
    at = write(spark, tmp_path, [(1, None), (None, "x"), (1, "y")])
    write(spark, tmp_path, [(1, None), (None, 1)], "labels", "doc_id long, toxic int")
    got = toxicity.query(spark, at).collect()
    assert len(got) == 3 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = list(zip(ids[:150], ids[1:151])) + [(ids[200], x) for x in ids[201:300]] + [(ids[310], ids[310]), (ids[320], ids[321]), (ids[321], ids[320])]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_suffix_arrays_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        texts = [b" ".join(rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        got = repeats.measures(texts)
        for k, t in enumerate(texts):
            w = t.split()
            windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            inside = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
            longest = max((n for i in range(len(w)) for j in range(i) for n in [next((x for x in range(len(w) - i + 1) if i + x == len(w) or w[i + x] != w[j + x]))]), default=0)
            assert (got["n_repeat_words"][k], got["longest_repeat"][k]) == (len(inside), longest if longest >= 5 else 0)


def test_globs_equal_regular_expressions():
    rng = random.Random(8)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(30)]
        texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 12))) for _ in range(40)]
        texts = [t for t in texts if "é" not in t or not any("?" in g for g in globs)]  # ? is a byte
        got = urls.GlobAutomaton(globs).match([t.encode() for t in texts])
        assert got.tolist() == [[re.fullmatch(urls._pattern(g), t) is not None for g in globs] for t in texts]


def plain_quality(w):
    """The quality rules on the words of a text, over all pairs of places that a repeat can have."""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    if len(w) < 10 or 100 * len(inside) > 20 * len(w):
        return False
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    longest = 0
    for at in places.values():
        for x in range(len(at)):
            for y in range(x):
                i, j, n = at[y], at[x], 5
                while j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                longest = max(longest, n)
    return not (longest > 50 and 100 * longest > 5 * len(w))


def plain_pipeline(rows, items):
    """The stages over (doc_id, text) in plain Python; ids are unique."""
    own = lambda t: (t or "").encode().translate(LOWER)
    rows = [r for r in rows if plain_quality(brute.words(r[1]))]
    keys = [[own(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")] for _, t in rows]
    often = Counter(k for ks in keys for k in set(ks) if k)
    rows = [(i, "\n".join(x for x, k in zip(t.split("\n"), ks, strict=True) if often[k] < 10)) for (i, t), ks in zip(rows, keys, strict=True)]
    sets = {i: (set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()) for i, t in rows for w in [own(t).split()]}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if j < i else 0
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                comp[max(find(i), find(j))] = min(find(i), find(j))
    rows = [(i, t) for i, t in rows if find(i) == i]
    windows = {tuple(w[k : k + min(10, len(w))]) for _, t in items for w in [brute.benchmark_words(t)] if w for k in range(max(1, len(w) - 9))}
    out = []
    for i, t in rows:
        words = brute.benchmark_words(t)
        hit = sorted({k + j for n in {len(w) for w in windows} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(n)})
        if 2 * len(hit) > len(words):
            continue
        if hit:
            at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(brute.LETTERS))]
            ends = [k for k in hit if k + 1 not in hit]
            for a, b in reversed([(k, next(e for e in ends if e >= k)) for k in hit if k - 1 not in hit]):
                t = t[: at[a][0]] + t[at[b][1] :]
        out.append((i, t))
    return out


def test_pipeline_equals_plain_version(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, hashlib.sha256(np.array(sp.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()) for i, t in plain_pipeline(documents, items)]
    got = [(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < len(documents)


def test_stages_keep_the_columns_of_documents(spark, documents, tmp_path):
    odd = [(None, None), (None, "x y"), (1000, ""), (1001, "a b c d e f g h i j k l"), (1001, "a b c d e f g h i j k l")]
    at = write(spark, tmp_path, [*documents[:40], *odd])
    write(spark, tmp_path, [(0, "f g h")], "benchmark", "item_id long, text string")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.dtypes == docs.dtypes, name
            out.write.parquet(f"{at}/{name}.parquet")
            docs = spark.read.parquet(f"{at}/{name}.parquet")
    texts = [r.text for r in docs.where("doc_id = 1001").collect()]
    assert texts == ["a b c d e  i j k l"]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0
    assert json.dumps([r.doc_id for r in docs.select("doc_id").collect()])


def test_near_uses_whole_sets():
    a = near.shingles(b"a b c")
    assert len(a) == 1 and len(near.shingles(b"")) == 0 and len(near.shingles(b"A b c d e f a b c d e f")) == 6
    assert near.similar(a, a) and not near.similar(a, near.shingles(b"a b c d"))


def test_line_keys(spark):
    from pyspark.sql import functions as F

    lines_ = [" A\xa0É é ", "İ Σ ς ΑΣ", "ǅ Ⓐ ẞ", "\t\x0b", "plain ASCII Z"]
    got = spark.createDataFrame([(x,) for x in lines_], "x string").select(lines.line_key(F.col("x"))).collect()
    assert [r[0] for r in got] == [x.strip(" \t\n\x0b\x0c\r").encode().translate(LOWER).decode() for x in lines_]
