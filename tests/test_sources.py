import json

from vocabra.operators import entities, store
from vocabra.sources import converters, linkml
from vocabra.streaming import ingest


def convert(spark, kind, label=None, **files):
    df = spark.createDataFrame([(f"/in/{k.replace('__', '.')}", v if isinstance(v, str) else json.dumps(v)) for k, v in sorted(files.items())], "path string, content string")
    return json.loads(converters.convert(df, kind, label).first().document)


def test_json_schema(spark):
    doc = {"$defs": {"Pet": {"type": "object", "title": "A pet", "required": ["name"], "properties": {"name": {"type": ["string", "null"], "description": "N"}, "tags": {"type": "array", "items": {"type": "integer"}}}}},
           "title": "Owner", "type": "object", "properties": {"pet": {"$ref": "#/$defs/Pet"}, "name": {"type": "number"}}}
    out = convert(spark, "jsonschema", my_pets__json=doc)
    assert out["name"] == "my_pets" and list(out["classes"]) == ["Pet", "Owner"] and out["classes"]["Pet"] == {"slots": ["name", "tags"], "description": "A pet"}
    assert out["slots"] == {"name": {"range": "float"}, "pet": {"range": "Pet"}, "tags": {"range": "integer", "multivalued": True}}


def test_bids(spark):
    out = convert(spark, "bids", columns__yaml="age:\n  type: number\n  description: ' Age '\nunit:\n  anyOf: [{type: 'null'}, {type: array}]\n", suffixes__yaml="T1w:\n  value: T1w\nt1W: {}\n", datatypes__yaml="t1w: {description: d}\n")
    assert out["slots"]["columns__age"] == {"description": "Age", "slot_uri": converters.GLOSSARY + "#age", "range": "float", "multivalued": False}
    assert out["slots"]["columns__unit"]["multivalued"] and out["classes"]["T1w"]["description"] == "d" and out["version"] == "1.9.0"


def test_nwb(spark):
    text = "groups:\n- neurodata_type_def: Series\n  neurodata_type_inc: Container\n  doc: D\n  attributes:\n  - {name: rate, dtype: float32, doc: R}\n  datasets:\n  - {name: when, dtype: isodatetime, quantity: '*'}\n  links:\n  - {target_type: Other}\n---\nneurodata_type_def: Plain\ndoc: P\n"
    out = convert(spark, "nwb", core__yaml=text)
    assert out["classes"]["Series"]["is_a"] == "Container" and out["classes"]["Series"]["slots"] == ["Series__rate", "Series__when", "Series__Other"] and out["classes"]["Plain"]["slots"] == []
    assert out["slots"]["Series__rate"]["required"] and out["slots"]["Series__when"] == {"description": "", "slot_uri": "https://nwb-schema.readthedocs.io/en/latest/#when", "range": "dateTime", "multivalued": True, "required": False}


def test_dandi_openminds_aind(spark):
    doc = {"properties": {"name": {"type": "string", "title": "T"}, "odd": {"type": ["null", "array"]}}, "$defs": {"Inner": {"properties": {"when (x)": {"anyOf": [{"type": "null"}, {"type": "string", "format": "date"}], "description": "w (unit: s)"}}, "$defs": {"Deep": {"properties": {"a": {"type": "integer"}}}}}, "Empty": {}}}
    out = convert(spark, "dandi", dandiset__json=doc)
    assert list(out["classes"]) == ["Dandiset", "Inner", "Deep"] and out["slots"]["Dandiset__name"]["slot_uri"] == "schema:name" and out["slots"]["Dandiset__odd"]["multivalued"]
    out = convert(spark, "aind", Rig__json=doc)
    assert out["slots"]["Inner__when (x)"] == {"description": "w (unit: s) (units: s)", "slot_uri": converters.AIND + "#when (x)", "range": "date", "multivalued": False, "required": False}
    out = convert(spark, "openminds", a__schema__json={"required": ["https://x/b#c d"], "properties": {"@id": {}, "_x": {}, "https://x/b#c d": {"type": "number"}, "e": {"type": "array"}}})
    assert out["classes"]["a"]["slots"] == ["a__c_d", "a__e"] and out["slots"]["a__c_d"]["required"] and out["slots"]["a__c_d"]["range"] == "float"


def test_hash_references(spark):
    schemas = spark.createDataFrame([("Rig", ["h1", "h2"])], "class string, property_hashes array<string>")
    elements = spark.createDataFrame([("h1", "my field", None, "Number")], "sha256 string, name string, description string, data_type string")
    row = converters.aind_from_hashes(schemas, elements).first()
    assert (row.slot, row.range, row.multivalued) == ("Rig__my_field", "float", False)
    assert [r.sha256 for r in converters.missing_hashes(schemas, elements).collect()] == ["h2"]


def test_schema_org(spark):
    graph = {"@graph": [
        {"@id": "schema:Thing", "@type": "rdfs:Class", "rdfs:comment": "T"}, {"@id": "schema:Person", "@type": "rdfs:Class", "rdfs:comment": {"@value": "P"}, "rdfs:subClassOf": [{"@id": "schema:Odd"}, {"@id": "schema:Thing"}]},
        {"@id": "schema:Odd", "@type": "rdfs:Class"}, {"@id": "schema:email", "@type": "rdf:Property", "schema:domainIncludes": [{"@id": "schema:Person"}, {"@id": "schema:Odd"}], "schema:rangeIncludes": {"@id": "schema:Text"}},
    ]}
    rows = converters.schema_org(spark.createDataFrame([("p", json.dumps(graph))], "path string, content string"))
    props = entities.properties(rows)
    assert [(r.name, r.property_range, r.concept_uri) for r in props.collect()] == [("email", "https://schema.org/Text", "https://schema.org/email")]
    made = {r.name: r for r in entities.classes(rows, props).collect()}
    assert set(made) == {"Thing", "Person"} and made["Person"].parent_class == made["Thing"].hash_id and made["Person"].description == "P" and len(converters.SEED_ROOTS) == 38


def test_converted_documents_become_elements(spark):
    files = spark.createDataFrame([("/in/p.json", json.dumps({"title": "A", "properties": {"x": {"type": "integer"}}}))], "path string, content string")
    rows = linkml.elements_from_documents(converters.convert(files, "jsonschema"))
    assert [(r.name, r.value) for r in rows.where("kind = 'slot'").collect()] == [("x", "xsd:integer")]


def test_stream_ingests_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    db = store.Store(spark, str(tmp_path / "db"))
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.yml").write_text(f"id: i\nname: {n}\nclasses:\n  C{n}:\n    slots: [s]\nslots:\n  s: {{}}\n")
        ingest.watch(spark, str(tmp_path / "in"), db, str(tmp_path / "check")).awaitTermination()
    assert db.read("class").count() == 2 and db.read("property").count() == 1 and db.read("provenance").count() == 4
