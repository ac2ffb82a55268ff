from pathlib import Path

import pytest

from vocabra.operators import align, entities, snapshot, store, tools
from vocabra.sources import linkml

FIXTURES = Path(__file__).parent / "fixtures"
# Published hashes of this schema's elements.
PROPERTIES = {
    "name": "7816ced135927c58f6ebc3f55668039ef2ab66e1549872b5b32b59ece0ce1e53",
    "orcid": "617199b747e8730bed6ba1d2d08de02aba00907407391acebdc51ba1d58de6af",
    "role": "de9b8ad17ae0108b3ad71f9d7cebf4fa3b7a955c71be65afe96a63c09ac8e254",
    "created_at": "5c74fcd14537ed64f8fb1649c2d9f7e414a0b4a3650a6c088c5c4e663d62845e",
}
CLASSES = {
    "Timestamped": "9bfceb04ede599148a836303684503e09198894fa02fc78174825b21621935a9",
    "Entity": "de6a525ca16c94d245fcd52076388be42d45deeed88c8309f414d823428d965f",
    "Person": "b0c27b7b4017b09a6dfe2d75f66243fa0278a7464e5a721e7d8afdda36fe2c32",
}


@pytest.fixture(scope="module")
def elements(spark):
    return linkml.parse(linkml.read_files(spark, str(FIXTURES / "catalogue.yml"))).cache()


def files(spark, **texts):
    return spark.createDataFrame([(f"/x/{k}.yml", v) for k, v in texts.items()], "path string, content string")


def schema(name, field="age", kind="integer", cls="Subject", extra=""):
    return f"id: https://e.org/{name}\nname: {name}\nclasses:\n  {cls}:\n    description: c\n    class_uri: schema:Person\n    slots: [{field}]\nslots:\n  {field}:\n    description: Age.\n    range: {kind}\n{extra}"


def test_slots_come_in_order_of_nearness(elements):
    rows = elements.where("kind = 'class_slot' AND owner = 'Person'").orderBy("pos").collect()
    assert [r.name for r in rows] == ["orcid", "role", "created_at", "name"]


def test_iris_ranges_and_units(elements):
    slots = {r.name: r for r in elements.where("kind = 'slot'").collect()}
    assert slots["name"].iri == "https://schema.org/name" and slots["orcid"].iri == "https://example.org/schema#orcid"
    assert slots["created_at"].value == "xsd:dateTime" and slots["role"].units == "FTE" and slots["role"].multivalued and slots["role"].required
    assert "unused" not in slots


def test_golden_hashes(elements):
    props = entities.properties(elements)
    assert {r.name: r.hash_id for r in props.collect()} == {k: f"sha256:{v}" for k, v in PROPERTIES.items()}
    assert {r.name: r.hash_id for r in entities.classes(elements, props).collect()} == {k: f"sha256:{v}" for k, v in CLASSES.items()}


def test_non_ascii_hash_equals_python(spark):
    import hashlib
    import json

    text = 'é "ü" \\ 😀 \x7f tab\t \x1f end'
    rows = linkml.parse(files(spark, u=schema("u").replace("Age.", "PLACE"))).replace("PLACE", text)
    row = entities.properties(rows).first()
    body = {"description": text, "name": "age", "property_range": "xsd:integer", "unit": None}
    assert row.hash_id == "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    classes = linkml.parse(files(spark, u=schema("u").replace("description: c", "description: PLACE"))).replace("PLACE", "é 😀")
    props = entities.properties(classes)
    made = entities.classes(classes, props).first()
    body = {"class_mixins": [], "description": "é 😀", "is_abstract": False, "name": "Subject", "parent_class": None, "properties": [props.first().hash_id]}
    assert made.hash_id == "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_identity_fields_are_required():
    with pytest.raises(ValueError, match="meaning"):
        entities.hash_of("permissible_value", {"description": None, "name": None})


def test_value_sets(elements):
    values = entities.permissible_values(elements)
    assert {(r.name, r.meaning) for r in values.collect()} == {("active", "skos:Concept"), ("retired", None)}
    assert entities.value_edges(entities.value_sets(elements, values)).count() == 2


def test_bad_files_fail_alone_and_references_are_checked(spark):
    bad = "id: i\nname: bad\nclasses:\n  A:\n    slots: [nowhere]\n    is_a: Missing\n  B:\n    slots: [nothing]\n"
    f = files(spark, good=schema("good"), bad=bad, broken="a: [")
    errors = linkml.parse(f).where("kind = 'error'").collect()
    assert sorted(r.name for r in errors) == ["bad", "broken"]
    found = {(r.source_label, r.kind, r.name) for r in linkml.undefined_references(f).collect()}
    assert ("bad", "slot", "nowhere") in found and ("bad", "class", "Missing") in found and any(k == "load" for _, k, _ in found)
    assert not any(s == "good" for s, _, _ in found)


def test_missing_parent_leaves_own_slots(spark):
    text = "id: i\nname: n\nclasses:\n  A:\n    is_a: B\n    slots: [s]\n    attributes:\n      t: {range: float}\n  B:\n    is_a: Outside\nslots:\n  s: {}\n"
    rows = linkml.parse(files(spark, n=text))
    assert [r.name for r in rows.where("kind = 'class_slot'").orderBy("pos").collect()] == ["t", "s"]
    assert {(r.name, r.value) for r in rows.where("kind = 'class'").collect()} == {("A", "B"), ("B", None)}


def test_ingest_twice_adds_nothing(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    a, b = (linkml.parse(files(spark, **{n: schema(n, cls=c)})) for n, c in (("a", "Subject"), ("b", "Participant")))
    first = store.insert_schema(db, a, "a")
    assert (first["classes_new"], first["properties_new"], first["provenance_added"], first["schema_version"]) == (1, 1, 2, "1.0.0")
    again = store.insert_schema(db, a, "a")
    assert (again["classes_new"], again["properties_new"], again["provenance_added"]) == (0, 0, 0) and again["schema_unchanged"]
    second = store.insert_schema(db, b, "b")
    assert (second["classes_new"], second["properties_new"], second["properties_existing"], second["provenance_added"]) == (1, 0, 1, 2)
    changed = linkml.parse(files(spark, a=schema("a", kind="string")))
    assert store.insert_schema(db, changed, "a", dry_run=True)["properties_new"] == 1
    third = store.insert_schema(db, changed, "a")
    assert third["properties_new"] == 1 and third["schema_version"] == "1.1.0" and db.read("property").count() == 2
    assert store.write_alignments(db) == 3  # three classes share one IRI
    version = snapshot.write_snapshot(db, str(tmp_path / "out"))
    classes, sources = snapshot.read_snapshot(spark, str(tmp_path / "out"), version)
    assert version == "1.0.0" and {(r.label, r.class_count) for r in sources.collect()} == {("a", 2), ("b", 1)}
    one = tools.get_class(classes, "participant").first()
    assert one.sources == ["b"] and one.properties[0].sources == ["a", "b"] and len(one.alignments) == 2 and one.alignments[0].scores.iri == 1.0
    assert snapshot.write_snapshot(db, str(tmp_path / "out"), bump="patch") == "1.0.1"
    store.wipe_source(db, "a")
    assert db.read("class").count() == 3 and {(r.label, r.class_count) for r in snapshot.source_rows(db).collect()} == {("a", 0), ("b", 1)}


def test_upsert_keeps_pairs_that_no_longer_match(spark):
    old = spark.createDataFrame([("a", "b", 1), ("c", "d", 1)], "src string, dst string, v int")
    new = spark.createDataFrame([("a", "b", 2)], "src string, dst string, v int")
    assert sorted(map(tuple, align.upsert_edges(old, new).collect())) == [("a", "b", 2), ("c", "d", 1)]
