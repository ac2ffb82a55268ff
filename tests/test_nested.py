"""Hashes of nested content against plain ones, pairs of an IRI that many classes share, and searches over an index."""

import hashlib
import itertools
import json
import random

from vocabra.functions import scalars as S
from vocabra.operators import align, tools

SCHEMA = "id int, tags array<string>, unit struct<zeta:string,alpha:array<string>>, parts array<struct<name:string,refs:array<string>,n:int>>, more map<string,array<string>>, grid array<array<string>>"


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        inner = [plain(v) for v in value]
        return sorted(inner) if all(isinstance(v, str) for v in inner) else inner
    return value


def test_nested_hashes(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["b", "a", "é", "Z", "😀", "", "a b"])
    words = lambda: rng.choice([None, [], [word() for _ in range(4)], [word(), None, word()]])
    rows = []
    for k in range(60):
        unit = rng.choice([None, {"zeta": word(), "alpha": words()}])
        parts = rng.choice([None, [{"name": word(), "refs": words(), "n": rng.randint(0, 3)} for _ in range(3)], [None]])
        more = rng.choice([None, {}, {x: words() for x in ("y", "x", "é")}])
        rows.append({"id": k, "tags": words(), "unit": unit, "parts": parts, "more": more, "grid": rng.choice([None, [words(), words()]])})
    df = spark.createDataFrame(rows, SCHEMA)
    names = df.columns[1:]
    got = {r.id: r.h for r in df.select("id", S.nested_hash(df, *names).alias("h")).collect()}
    for r in rows:
        text = json.dumps(plain({n: r[n] for n in names}), sort_keys=True, separators=(",", ":"))
        assert got[r["id"]] == "sha256:" + hashlib.sha256(text.encode()).hexdigest(), text


def test_pairs_of_a_hot_iri(spark, monkeypatch):
    rows = [(f"h{k}", "hot" if k % 3 else f"iri{k % 7}" if k % 2 else None) for k in range(200)]
    df = spark.createDataFrame([*rows, *rows[:9], ("h1", "other"), ("x", "")], "hash_id string, concept_uri string")
    held = {}
    for h, iri in {*rows, ("h1", "other")}:
        if iri:
            held.setdefault(iri, set()).add(h)
    want = sorted((a, b, iri) for iri, hs in held.items() for a, b in itertools.combinations(sorted(hs), 2))
    for size in (2000, 20, 1):
        monkeypatch.setattr(align, "BLOCK", size)
        assert sorted(map(tuple, align.exact_pairs(df).collect())) == want


def test_search_over_an_index_equals_a_scan(spark, tmp_path):
    rows = [(f"h{k}", n, d, ["a"] if k % 2 else ["b"], "") for k, (n, d) in enumerate([("Subject", "A person"), ("ÄRGER", None), ("ab", "ab"), (None, "aaa aaa"), ("100%_x", "x"), ("", ""), ("Session", "subj ect"), ("Über", "İstanbul")] * 3)]
    classes = spark.createDataFrame(rows, "hash_id string, name string, definition string, sources array<string>, iri string")
    tools.write_trigrams(classes, str(tmp_path / "index"))
    for query in ("subject", "SUBJ", "ärg", "aaaa", "aaa", "ab", "", "0%_", "no such", "über", "ubject person"):
        for source, limit in (("", 20), ("a", 2), ("", 0)):
            got, want = (f.collect() for f in (tools.search_indexed(classes, str(tmp_path / "index"), query, source, limit), tools.search_classes(classes, query, source, limit)))
            assert got == want, (query, source, limit)
