"""Hashes and closures over deep, wide and broken hierarchies; files of one name; bad files beside good ones."""

import hashlib
import json

import pytest

from vocabra import cli
from vocabra.operators import entities, snapshot, store
from vocabra.sources import converters, linkml


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def schema(name, cls, slot, kind="integer", extra=""):
    return f"id: i\nname: {name}\nprefixes: {{own: 'https://{cls}.example/'}}\nclasses:\n  {cls}:\n    class_uri: own:{cls}\n    slots: [{slot}]\nslots:\n  {slot}: {{range: {kind}, slot_uri: 'own:{slot}'}}\n{extra}"


def closure(edges):
    """(node, ancestor): least depth, by walking."""
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = {}
    for node in up:
        level, depth = {node}, 0
        while level:
            depth += 1
            level = {b for a in level for b in up.get(a, ()) if (node, b) not in out}
            out |= {(node, b): depth for b in level}
    return out


@pytest.mark.parametrize("edges", [
    [(k, k - 1) for k in range(1, 200)],
    [(0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (5, 5)],
    [(k, j) for k in range(12) for j in (k + 1, k + 2, k + 5)],
    [(k, 0) for k in range(1, 300)],
    [],
], ids=["chain", "cycles", "several parents", "wide", "none"])
def test_ancestors(spark, edges):
    got = entities.ancestors(spark.createDataFrame([*edges, *edges[:2], (999, None)], "node long, parent long"))
    assert {(r.node, r.ancestor): r.depth for r in got.collect()} == closure(edges) and got.count() == len(closure(edges))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_hashes_of_any_depth(spark):
    """Chains of 1 to 90 classes, a bush, a cycle, one below it, and one whose parent is not there."""
    rows = [(s, str(k), str(k - 1) if k else None) for s, n in (("a", 90), ("b", 17), ("c", 1)) for k in range(n)]
    rows += [("bush", "r", None)] + [("bush", f"x{k}", "r") for k in range(50)] + [("bush", f"y{k}", f"x{k % 50}") for k in range(200)]
    rows += [("bad", "p", "q"), ("bad", "q", "p"), ("bad", "below", "p"), ("bad", "orphan", "gone")]
    nodes = spark.createDataFrame(rows, "scope string, node string, parent string").selectExpr("*", "concat('{', scope, node, ':') AS before", "'}' AS after")
    got = {(r.scope, r.node): (r.hash_id, r.parent_hash) for r in entities.chained_hashes(nodes).collect()}
    want = {}
    for s, n, parent in rows:
        if s != "bad":
            above = want[s, parent][0] if parent else None
            text = f"{{{s}{n}:{json.dumps(above)}}}"
            want[s, n] = "sha256:" + hashlib.sha256(text.encode()).hexdigest(), above
    assert got == want
    assert {(r.scope, r.node) for r in entities.depths(nodes).collect()} == set(want)


def test_files_of_one_name_stay_apart(spark, tmp_path):
    both = linkml.parse(files(spark, [("/in/a.yml", schema("same", "A", "x")), ("/in/b.yml", schema("same", "A", "x", "string")), ("/in/c.yml", schema("other", "A", "x"))]))
    props = entities.properties(both)
    classes = entities.classes(both, props)
    assert classes.count() == 3 and {len(r.properties) for r in classes.collect()} == {1} and classes.select("hash_id").distinct().count() == 2
    db = store.Store(spark, str(tmp_path))
    got = {r.label: r for r in store.insert_all(db, both).collect()}
    assert got["same"].classes_new + got["other"].classes_new == 2 and got["same"].property_count == 2 and db.read("schema_version").count() == 2


def test_bad_files_beside_good_ones_of_their_name(spark, tmp_path, capsys):
    """A broken file whose stem is a good schema's name, and a cycle, in a command line."""
    folder = tmp_path / "schemas"
    folder.mkdir()
    (folder / "good.yml").write_text("a: [")
    (folder / "x.yml").write_text(schema("good", "A", "x"))
    (folder / "y.yml").write_text("id: c\nname: cyclic\nclasses:\n  P: {is_a: Q}\n  Q: {is_a: P}\n")
    (folder / "z.yml").write_text(schema("last", "Z", "z"))
    db = str(tmp_path / "db")
    assert cli.main(["ingest", "--schemas", str(folder), "--db", db, "--dry-run"]) == 0 and store.Store(spark, db).read("class").count() == 0
    assert cli.main(["ingest", "--schemas", str(folder), "--db", db]) == 0
    said = capsys.readouterr().out
    assert "ERROR parsing good: " in said and "ERROR parsing cyclic: parents of P" in said
    one = store.Store(spark, db)
    assert {r.name for r in one.read("class").collect()} == {"A", "Z"} and {r.label for r in one.read("source").collect()} == {"good", "last"}
    assert cli.main(["ingest", "--file", str(folder / "z.yml"), "--db", db, "--wipe"]) == 0
    assert {(r.label, r.class_count) for r in snapshot.source_rows(store.Store(spark, db)).collect()} == {("good", 1), ("last", 1)}


def test_convert_fails_on_a_bad_file(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"type": "object", "properties": {"x": {"type": "integer"}}}')
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["convert", f"jsonschema={tmp_path}/good.json", "--out", str(tmp_path / "out")]) == 0
    assert cli.main(["convert", f"jsonschema={tmp_path}/good.json,{tmp_path}/bad.json", "--out", str(tmp_path / "out2")]) == 1
    assert (tmp_path / "out2/jsonschema").exists()


def test_core_tiers(spark):
    aind = {r["class"]: r for r in converters.core_rows("aind", spark).collect()}
    slots = {s.name: s.body for r in aind.values() for s in r.slots}
    assert slots["subject__subject_id"].slot_uri == "schema:identifier" and slots["subject__sex"].description == "Biological sex" and slots["session__experimenter_full_name"].multivalued
    minds = {r["class"]: r for r in converters.core_rows("openminds", spark).collect()}
    assert minds["BrainAtlas"].body.class_uri == "https://openminds.ebrains.eu/sands/BrainAtlas" and minds["Dataset"].slots[3].body.description == "Digital identifier (DOI, etc.)"


def test_pipeline_command(spark, tmp_path):
    folder = tmp_path / "schemas"
    folder.mkdir()
    (folder / "a.yml").write_text(schema("a", "A", "x").replace("own:A", "schema:Person"))
    (tmp_path / "person.json").write_text('{"type": "object", "title": "Pet", "properties": {"x": {"type": "integer"}}}')
    node = {"@id": "schema:Person", "@type": "rdfs:Class", "rdfs:comment": "A person"}
    (tmp_path / "org.jsonld").write_text(json.dumps({"@graph": [node]}))
    told = ["pipeline", f"jsonschema={tmp_path}/person.json", "--folder", str(folder), "--db", str(tmp_path / "db"), "--out", str(tmp_path / "data"), "--seed-file", str(tmp_path / "org.jsonld"), "--fresh"]
    assert cli.main(told) == 0
    rows, _ = snapshot.read_document(spark, str(tmp_path / "data/registry.json"))
    found = {r.name: r for r in rows.collect()}
    assert set(found) == {"A", "Person", "Pet"} and [a.target_name for a in found["A"].alignments] == ["Person"] and found["Person"].sources == ["schemaorg"]
    assert cli.main([*told[:1], "--folder", str(tmp_path / "none"), "--db", str(tmp_path / "db2")]) == 1
