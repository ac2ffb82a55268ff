"""The store beyond one schema: errors, imports, published documents, migration, meta-models and command lines."""

import json

import pytest
from pyspark.sql import functions as F

from vocabra import cli
from vocabra.operators import entities, snapshot, store, tools
from vocabra.sources import converters, linkml, metamodel


def files(spark, **texts):
    return spark.createDataFrame([(f"/x/{k}.yml", v) for k, v in texts.items()], "path string, content string")


def schema(name, extra="", cls="Subject"):
    return f"id: i\nname: {name}\nclasses:\n  {cls}:\n    class_uri: schema:Person\n    slots: [age]\nslots:\n  age:\n    description: Age.\n    range: integer\n{extra}"


def test_refined_slots_and_imports(spark):
    texts = {
        "base": "id: b\nname: base\nimports: [linkml:types, deep]\nprefixes: {own: 'https://own.example/'}\nslots:\n  name: {range: string}\nclasses:\n  Thing: {slots: [name]}\n",
        "deep": "id: d\nname: deep\nimports: [base]\nslots:\n  size: {range: float, description: Deep}\n",
        "top": "id: t\nname: top\nimports: [base]\nclasses:\n  Box:\n    is_a: Thing\n    class_uri: own:Box\n    slots: [size]\n    slot_usage:\n      name: {required: true, description: Refined}\n",
    }
    rows = linkml.parse(linkml.with_imports(files(spark, **texts))).where("source_label = 'top'")
    slots = {r.name: r for r in rows.where("kind = 'slot'").collect()}
    assert slots["name"].required and slots["name"].definition == "Refined" and slots["size"].value == "xsd:float"
    assert {r.name: (r.iri, r.value) for r in rows.where("kind = 'class'").collect()} == {"Box": ("https://own.example/Box", "Thing"), "Thing": ("", None)}
    assert rows.where("kind = 'error'").count() == 0


def test_shapes(spark):
    bad = "name: n\nclasses:\n  A: {slots: age, abstract: 'yes'}\n  B: text\nslots: [age]\n"
    got = {(r.kind, r.owner, r.name) for r in linkml.undefined_references(files(spark, s=bad, t="a: [")).collect()}
    assert {("shape", "", "id"), ("shape", "", "slots"), ("shape", "A", "slots"), ("shape", "A", "abstract"), ("shape", "B", "class")} <= got
    assert any(k == "load" for k, _, _ in got) and linkml.undefined_references(files(spark, s=schema("s"))).count() == 0


def test_errors_write_nothing(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    broken = linkml.parse(files(spark, broken="classes: {A: {slots: [gone]}}"))
    with pytest.raises(ValueError, match="gone"):
        store.insert_schema(db, broken, "broken")
    cycle = linkml.parse(files(spark, c="id: c\nname: c\nclasses:\n  A: {is_a: B}\n  B: {is_a: A}\n  C: {}\n"))
    assert sorted(r.name for r in entities.unrooted(cycle).collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="parents"):
        store.insert_schema(db, cycle, "c")
    assert db.read("source").count() == db.read("schema_version").count() == 0


def test_many_sources_at_once_equal_one_after_another(spark, tmp_path):
    enums = "enums:\n  Kind:\n    permissible_values:\n      x: {meaning: 'schema:x'}\n      y: {}\n"
    texts = {"a": schema("a"), "b": schema("b", enums), "c": schema("c", cls="Other"), "bad": "a: [", "d": "id: d\nname: d\nclasses:\n  P: {}\n  Q: {is_a: P}\n"}
    elements = linkml.parse(files(spark, **texts)).cache()
    one, many = (store.Store(spark, str(tmp_path / k)) for k in ("one", "many"))
    for _ in range(2):
        want = {k: store.insert_schema(one, elements, k) for k in ("a", "b", "c", "d")}
        got = {r.label: r for r in store.insert_all(many, elements).collect()}
        assert got["bad"].error and set(got) == {*want, "bad"}
        for k, stats in want.items():
            for name, value in stats.items():
                if name not in ("rels",):
                    assert got[k][name] == value, (k, name)
    drop = {"id", "had_primary_source", "generated_at_time", "created_at", "yml_path"}
    for name in [*store.NODES, *store.EDGES]:
        own = [sorted(map(repr, db.read(name).drop(*drop).collect())) for db in (one, many)]
        assert own[0] == own[1], name


def test_of_equal_hashes_the_first_label_wins(spark):
    rows = spark.createDataFrame([("h", "z", ["b"]), ("h", "a", ["c"]), ("h", "m", ["a"])], "hash_id string, source_label string, aliases array<string>")
    row = entities.distinct_entities(rows).first()
    assert (row.source_label, row.aliases, row.attestations) == ("a", ["c"], 3)
    assert store.new_rows(rows.drop("source_label"), rows.where("false"), ["hash_id"]).first().aliases == ["a"]


def test_published_document(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    for name in ("a", "b"):
        store.insert_schema(db, linkml.parse(files(spark, **{name: schema(name, cls=name.upper())})), name)
    assert store.write_alignments(db) == 1
    assert snapshot.publish(db, str(tmp_path / "out")) == "1.0.0"
    assert snapshot.publish(db, str(tmp_path / "out"), bump="patch") == "1.0.1"
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "out/registry.json").glob("part-*")))
    assert doc["registry_version"] == "1.0.1" and [c["name"] for c in doc["classes"]] == ["A", "B"] and [s["label"] for s in doc["sources"]] == ["a", "b"]
    rows, sources = snapshot.read_document(spark, str(tmp_path / "out/versions/1.0.0.json"))
    assert [r.b_name for r in tools.diff_schemas(rows, "a", "b").collect()] == ["B"] and sources.count() == 2
    chain = {r.registry_version: r.before for r in snapshot.version_chain(db.read("changelog")).collect()}
    assert chain == {"1.0.0": "0.0.0", "1.0.1": "1.0.0"}
    empty = store.Store(spark, str(tmp_path / "none"))
    snapshot.write_document(empty, str(tmp_path / "e"), "1.0.0")
    assert snapshot.read_document(spark, str(tmp_path / "e"))[0].count() == 0


def test_migration(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    spark.createDataFrame([("h", "n")], "hash_id string, name string").write.parquet(f"{tmp_path}/value_set/v0")
    assert "aliases" in store.lacking(db, "value_set") and store.lacking(db, "class") == []
    assert store.migrate(db, "value_set") and not store.migrate(db, "value_set") and db.read("value_set").first().name == "n"


def test_metamodel(spark):
    text = """
classes:
  Base: {abstract: true, slots: [hash_id, name]}
  Unit: {annotations: {db_inline: true}, slots: [code, odd]}
  Thing: {is_a: Base, slots: [aliases, unit, parent, parts, score, name]}
slots:
  hash_id: {identifier: true, range: string}
  name: {range: datetime}
  aliases: {multivalued: true}
  unit: {range: Unit}
  code: {range: integer}
  odd: {range: Thing}
  parent: {range: Thing}
  parts: {range: Thing, multivalued: true}
  score: {range: float}
"""
    ddl = {r.name: r.ddl for r in metamodel.tables(files(spark, m=text)).collect()}
    assert set(ddl) == {"Thing", "Thing_parts"}
    want = "`hash_id` STRING NOT NULL, `name` STRING, `aliases` ARRAY<STRING>, `code` BIGINT, `parent` STRING, `score` FLOAT"
    assert ddl["Thing"] == f"CREATE TABLE IF NOT EXISTS `Thing` ({want}) USING parquet"


def test_aind_tiers_and_openminds_choice(spark):
    none = spark.createDataFrame([], "path string, content string")
    seed = spark.createDataFrame([("/s/rig_1.yml", json.dumps({"provenance": [{"class": "My Rig"}], "semantic": {"properties": ["h1", "h2"]}}))], "path string, content string")
    held = spark.createDataFrame([("/e/1.yml", json.dumps({"sha256": "h1", "provenance": [{"name": "a field"}], "semantic": {"data_type": "number"}}))], "path string, content string")
    model = spark.createDataFrame([("/m/Rig.json", json.dumps({"properties": {"x": {"type": "integer"}}}))], "path string, content string")
    made = [json.loads(converters.aind(*x).first().document) for x in ((model, seed, held), (none, seed, held), (none, none, none))]
    assert list(made[0]["classes"]) == ["Rig"] and made[1]["slots"]["MyRig__a_field"]["range"] == "float" and set(made[2]["classes"]) == set(converters.AIND_CORE)
    assert set(json.loads(converters.convert(none, "openminds").first().document)["classes"]) == set(converters.OPENMINDS_CORE)
    paths = [f"/r/{v}/{m}/{n}.json" for v in ("v1", "v2") for m in ("core", "sands", "xtra") for n in range(4)]
    chosen = converters.openminds_selection(spark.createDataFrame([(p, "{}") for p in paths], "path string, content string"), modules=2, per_module=3)
    assert sorted(r.path for r in chosen.collect()) == [f"/r/v2/{m}/{n}.json" for m in ("core", "sands") for n in range(3)]


def test_bad_files_and_pass_through(spark):
    df = files(spark, bad="a: [", good=json.dumps({"title": "T", "properties": {"x": {"type": "number"}}}))
    assert [r.path for r in converters.conversion_errors(df).collect()] == ["/x/bad.yml"]
    assert converters.convert(df, "jsonschema").count() == 1
    assert converters.pass_through(files(spark, a=schema("a"), b="classes: {}")).count() == 1


def test_submission_url(spark):
    row = tools.submission_url("https://e.org/new", spark.createDataFrame([("a b", "x: 1\n")], "name string, document string")).first()
    assert row.url == "https://e.org/new?title=Add+schema%3A+a+b&body=x%3A+1%0A" and row.status == "manual"


def test_command_lines(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.yml").write_text(schema(name, cls=name.upper()))
    (folder / "bad.yml").write_text("a: [")
    db = ["--db", str(tmp_path / "db")]
    assert cli.main(["ingest", "--schemas", str(folder), "--dry-run", *db]) == 0 and store.Store(spark, db[1]).read("class").count() == 0
    assert cli.main(["ingest", "--schemas", str(folder), "--agent", "bot", *db]) == 0
    assert cli.main(["ingest", "--file", str(folder / "a.yml"), "--wipe", *db]) == 0
    assert cli.main(["align", *db]) == 0 and cli.main(["export", *db, "--out", str(tmp_path / "out")]) == 0 and cli.main(["counts", *db]) == 0
    said = capsys.readouterr().out
    assert "ERROR parsing bad" in said and "Wrote 2 edges from 1" in said and "Published 1.0.0" in said and "class: 2" in said
    assert cli.main(["validate", str(folder / "a.yml")]) == 0 and cli.main(["validate", str(folder / "bad.yml")]) == 1
    source = tmp_path / "s.json"
    source.write_text(json.dumps({"title": "T", "properties": {"x": {"type": "number"}}}))
    out = ["--out", str(tmp_path / "made")]
    assert cli.main(["convert", f"jsonschema={source}", f"bbqs={folder}/a.yml", *out]) == 0
    assert cli.main(["convert", f"bids={source}", f"odd={source}", *out]) == 1 and cli.main(["convert", f"bids={source}", "--skip", "bids", *out]) == 0
    made = linkml.parse(linkml.read_files(spark, f"{tmp_path}/made/jsonschema/label=s"))
    assert [(r.name, r.value) for r in made.where("kind = 'slot'").collect()] == [("x", "xsd:float")]
    graph = tmp_path / "g.jsonld"
    graph.write_text(json.dumps({"@graph": [{"@id": "schema:Thing", "@type": "rdfs:Class"}]}))
    assert cli.main(["seed", "--file", str(graph), *db]) == 0 and store.Store(spark, db[1]).read("class").where(F.col("name") == "Thing").count() == 1
