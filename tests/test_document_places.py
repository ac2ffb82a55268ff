"""Documents in many files and blocks: places of classes by counts of lines, and no copy of the lines on the way."""

import json

import pytest

from vocabra.operators import snapshot, store


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("doc") / "registry.json")
    names = spark.range(500).selectExpr("concat('h', id) AS hash_id", "IF(id % 7 = 0, NULL, concat('N', (id * 37) % 100)) AS name")
    held = spark.range(3000).selectExpr("concat('h', id % 400) AS src", "concat('p', id % 90) AS dst")
    props = spark.range(90).selectExpr("concat('p', id) AS hash_id", "concat('name', id % 20) AS name")
    snapshot.write_document(store.Frames(spark, **{"class": names, "has_property": held, "property": props}), at, "1.0.0")
    return at, sorted((r.name or "", r.hash_id) for r in names.collect()), held, props


@pytest.mark.parametrize("size", ["128m", "20k", "2k"])
def test_places_in_any_blocks(spark, document, size):
    at, want, _, _ = document
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows, _ = snapshot.read_document(spark, at)
        assert [(r.pos, r.name, r.hash_id) for r in rows.orderBy("pos").collect()] == [(k, *w) for k, w in enumerate(want)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_document_is_json_with_sorted_properties(spark, document):
    at, want, held, props = document
    text = "\n".join(r.value for r in spark.read.text(at).selectExpr("value", "_metadata.file_name AS f", "monotonically_increasing_id() AS k").orderBy("f", "k").collect())
    doc = json.loads(text)
    assert [(c["name"], c["hash_id"]) for c in doc["classes"]] == want
    own, names = {}, {r.hash_id: r.name for r in props.collect()}
    for r in held.collect():
        own.setdefault(r.src, []).append((names[r.dst], r.dst))
    assert all([(p["name"], p["hash_id"]) for p in c["properties"]] == sorted(own.get(c["hash_id"], [])) for c in doc["classes"])
    assert list(doc["classes"][-1]["properties"][0] if doc["classes"][-1]["properties"] else {"hash_id": 0, "iri": 0, "name": 0})[:3] == ["hash_id", "iri", "name"]


def test_lines_are_not_shuffled_or_written_again(spark, document, monkeypatch):
    monkeypatch.setattr(snapshot, "cut", None)
    rows, _ = snapshot.read_document(spark, document[0])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and rows.count() == 500
