import json

import pytest
from pyspark.sql import functions as F

from vocabra.functions import scalars as S
from vocabra.operators import snapshot, tools


def cls(name, source, props, to=(), definition=""):
    return {
        "hash_id": f"{source}:{name}", "iri": "", "name": name, "definition": definition, "is_abstract": False, "sources": [source], "subclass_of": [],
        "properties": [{"name": p, "hash_id": p} for p in props],
        "alignments": [{"target_hash_id": f"{s}:{n}", "target_name": n, "distance": d, "method": "iri"} for s, n, d in to],
    }


@pytest.fixture(scope="module")
def classes(spark, tmp_path_factory):
    doc = {
        "registry_version": "1.0.0", "sources": [{"label": "lab", "version": "1.0.0", "class_count": 4}],
        "classes": [
            cls("Dataset", "lab", ["identifier", "name", "species", "modality"], [("arch", "BIDSDataset", 0.2), ("box", "File", 0.35)], "100% of a_b"),
            cls("Device", "lab", ["name", "modality"], [("box", "Device", 0.1)]),
            cls("Investigator", "lab", ["name", "email", "Identifier"], [("arch", "Participant", 0.15)]),
            cls("Software", "lab", ["name"], [("arch", "Tool", 0.7)]),
            cls("BIDSDataset", "arch", ["identifier", "name", "species"]), cls("Participant", "arch", ["name", "EMAIL", "identifier"]), cls("Tool", "arch", ["name"]),
            cls("File", "box", ["identifier", "species", "modality"]), cls("Device", "box", ["name", "modality"]),
        ],
    }
    path = tmp_path_factory.mktemp("s") / "registry.json"
    path.write_text(json.dumps(doc))
    rows, sources = snapshot.read_document(spark, str(path))
    assert tools.list_sources(sources).first().label == "lab"
    return rows.cache()


def test_search(classes):
    assert [r.name for r in tools.search_classes(classes, "D", "lab").collect()] == ["Dataset", "Device"]
    assert [r.name for r in tools.search_classes(classes, "_").collect()] == ["Dataset"]
    assert tools.search_classes(classes, "", limit=3).count() == 3
    assert tools.search_classes(classes, "Device", limit=0).count() == 0 and tools.search_classes(classes, "Data", limit=-1).count() == 1


def test_lookup_and_alignments(classes):
    assert tools.get_class(classes, "box:Device").first().sources == ["box"]
    assert tools.get_class(classes, "dev").first().hash_id == "lab:Device" and tools.get_class(classes, "nowhere").count() == 0
    rows = tools.get_alignments(classes, "lab:Dataset", 0.35).collect()
    assert [(r.name, r.sources) for r in rows] == [("BIDSDataset", ["arch"]), ("File", ["box"])]


def test_diff(classes):
    rows = {(r.side, r.a_name, r.b_name) for r in tools.diff_schemas(classes, "lab", "arch").collect()}
    assert rows == {("shared", "Dataset", "BIDSDataset"), ("shared", "Investigator", "Participant"), ("shared", "Software", "Tool"), ("only_a", "Device", None)}
    back = {(r.side, r.a_name, r.b_name) for r in tools.diff_schemas(classes, "arch", "lab").collect()}
    assert ("only_a", "Tool", None) in back and ("only_b", None, "Software") in back


def transform(spark, classes, record, source, target):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(json.dumps(record),)], "text string").select(F.from_json("text", "map<string,string>").alias("record"))
    return tools.transform_records(df, tools.field_map(classes, source, target), source=source, target=target).first()


def test_transform(spark, classes):
    r = transform(spark, classes, {"name": "x", "email": "e", "identifier": "i", "areas": "a"}, "lab", "arch")
    assert r.mapped == {"name": "x", "EMAIL": "e", "identifier": "i"} and r.unmapped == ["areas"] and r.warnings == ["1 field(s) had no alignment: areas"]
    r = transform(spark, classes, {"Name": "1", "name": "2"}, "lab", "box")
    assert r.mapped == {"name": "2"} and r.unmapped == [] and r.warnings == []
    r = transform(spark, classes, {"name": "x"}, "lab", "nowhere")
    assert r.mapped == {} and r.unmapped == ["name"] and len(r.warnings) == 2
    r = transform(spark, classes, {}, "lab", "arch")
    assert r.mapped == {} and r.unmapped == [] and r.warnings == []


def test_records_of_a_graph(spark, tmp_path):
    doc = {"@graph": [{"@id": "1", "@type": ["a", "b"], "bbqs:name": "x", "areas": ["p", "q"], "n": 3}]}
    (tmp_path / "g.jsonld").write_text(json.dumps(doc))
    row = tools.read_graph(spark, str(tmp_path / "g.jsonld")).first()
    assert row.record == {"name": "x", "areas": '["p","q"]', "n": "3"}


def test_changelogs(spark, tmp_path):
    e = [{"registry_version": "1.0.0", "timestamp": "a", "stats": {"classes_total": 3}}, {"registry_version": "1.1.0", "timestamp": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(e))
    (tmp_path / "b.json").write_text(json.dumps({"entries": e[:1]}))
    rows = snapshot.read_changelog(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert sorted(r.registry_version for r in rows.collect()) == ["1.0.0", "1.0.0", "1.1.0"]
    log = rows.withColumn("previous_version", F.when(F.col("timestamp") == "b", "1.0.0"))
    assert sorted((r.registry_version, r.before) for r in snapshot.version_chain(log).distinct().collect()) == [("1.0.0", None), ("1.1.0", "1.0.0")]


def value(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda f: S.bump_version(f("1.2.3"), f("major")), "2.0.0"), (lambda f: S.bump_version(f("1.2.3"), f("odd")), "1.2.4"),
        (lambda f: S.bump_padded(f("1"), f("minor")), "1.1.0"), (lambda f: S.bump_padded(f("1.2.3.4"), f("minor")), "1.3.0.4"),
        (lambda f: S.next_registry_version(f("0.0.0"), f("patch")), "1.0.0"), (lambda f: S.units(f("x (unit: mV)")), ""), (lambda f: S.any_units(f("x (unit: mV )")), "mV"),
        (lambda f: S.units(f("x (Units: mV)")), "mV"), (lambda f: S.resolve_prefix(f("schema:a:b")), "https://schema.org/a:b"), (lambda f: S.resolve_prefix(f("odd:a")), "odd:a"),
        (lambda f: S.value_range(f("dateTime")), "https://example.org/obj/dateTime"), (lambda f: S.camel(f("fooBAR-x_y")), "FoobarXY"), (lambda f: S.clean(f("_a b-")), "a_b"),
        (lambda f: S.agent_text(f("bot"), f("7")), "bot (issue #7)"), (lambda f: S.skos_relation(f(0.4), f(True)), "narrowMatch"), (lambda f: S.skos_relation(f(0.71), f(True)), ""),
        (lambda f: S.suffixed_name(f("n"), f("sha256:abcdef")), "n_abcd"),
    ],
)
def test_scalars(spark, made, want):
    from pyspark.sql import functions as F

    assert value(spark, made(F.lit)) == want


def test_alignments_from_edges(spark, classes):
    edges = classes.select("hash_id", F.explode("alignments").alias("a")).select(F.col("hash_id").alias("src"), F.col("a.target_hash_id").alias("dst"), F.col("a.distance").alias("distance"), F.col("a.method").alias("method"))
    want = [tuple(r)[:5] for r in tools.get_alignments(classes, "lab:Dataset", 0.35).collect()]
    assert [tuple(r)[:5] for r in tools.get_alignments(classes.drop("alignments"), "lab:Dataset", 0.35, edges).collect()] == want and len(want) == 2
