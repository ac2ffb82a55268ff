"""Other schema formats as LinkML documents: JSON Schema, BIDS, NWB, DANDI, openMINDS, AIND, BBQS and schema.org.

Sources are local files read through Spark as (path, content). A file is parsed once, into rows of JSON bodies: its documents
and the definitions inside them. All else is column expressions over those rows: a format says what its classes are, what
their members are called, and which type, format and quantity a member states; ranges, units and names follow. Which
definition of a name wins is decided over all files of a label.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import send_package
from .linkml import _Text, first_wins

# JSON types and their ranges; lists of types count by their first that is not null.
JSON_TYPES = {"string": "string", "integer": "integer", "number": "float", "boolean": "boolean", "array": "string", "object": "string", "null": "string"}
# Formats with a range of their own.
FORMATS = {"date": "date", "date-time": "datetime", "time": "datetime", "uri": "uri"}
# NWB dtypes and their ranges.
NWB_TYPES = {
    "text": "string", "ascii": "string",
    "float": "float", "float32": "float", "float64": "float",
    "int": "integer", "int8": "integer", "int16": "integer", "int32": "integer", "int64": "integer",
    "uint8": "integer", "uint16": "integer", "uint32": "integer", "uint64": "integer",
    "bool": "boolean", "scalar": "float", "numeric": "float", "datetime": "dateTime", "isodatetime": "dateTime",
}
# Fields of schema.org that DANDI slots stand for.
DANDI_TERMS = {
    "identifier": "schema:identifier", "name": "schema:name", "description": "schema:description", "url": "schema:url", "license": "schema:license",
    "version": "schema:version", "datePublished": "schema:datePublished", "dateModified": "schema:dateModified", "contributor": "schema:contributor",
    "about": "schema:about", "keywords": "schema:keywords", "citation": "schema:citation",
}
# BIDS groups that give slots, with their class; groups that give a class per term.
BIDS_SLOTS = {"metadata": ("BIDSMetadata", "BIDS metadata field."), "columns": ("BIDSColumn", "BIDS tabular column."), "entities": ("BIDSEntity", "BIDS filename entity.")}
BIDS_CLASSES = {"datatypes": "BIDS imaging datatype.", "suffixes": "BIDS file suffix."}
GLOSSARY = "https://bids-specification.readthedocs.io/en/stable/glossary.html"
AIND = "https://aind-data-schema.readthedocs.io/en/stable/"
# Identity and version of each converted schema.
SCHEMAS = {
    "bids": ("https://bids-specification.readthedocs.io/en/stable/", "1.9.0"),
    "nwb": ("https://nwb-schema.readthedocs.io/en/latest/", "2.7.0"),
    "dandi": ("https://schema.dandiarchive.org/", "0.6.7"),
    "openminds": ("https://openminds.ebrains.eu/", "4.0.0"),
    "aind": (AIND, "1.0.0"),
}
# Prefixes of every converted schema.
PREFIXES = {"linkml": "https://w3id.org/linkml/", "schema": "https://schema.org/", "xsd": "http://www.w3.org/2001/XMLSchema#"}
# Classes (name, description, where their IRI ends) with their slots (name, description, range, term, several values), where
# a source has nothing.
CORE = {
    "aind": [
        ("Subject", "AIND subject metadata.", "#Subject", [
            ("subject_id", "Subject ID", "string", "schema:identifier", False),
            ("sex", "Biological sex", "string", None, False),
            ("date_of_birth", "Date of birth", "date", None, False),
            ("species", "Species", "string", None, False),
            ("genotype", "Genotype", "string", None, False),
        ]),
        ("Session", "AIND acquisition session.", "#Session", [
            ("session_start_time", "Session start", "datetime", None, False),
            ("session_end_time", "Session end", "datetime", None, False),
            ("experimenter_full_name", "Experimenter name", "string", None, True),
            ("rig_id", "Rig ID", "string", None, False),
        ]),
        ("Instrument", "AIND instrument / rig.", "#Instrument", [
            ("instrument_id", "Instrument ID", "string", None, False),
            ("instrument_type", "Instrument type", "string", None, False),
        ]),
    ],
    "openminds": [
        ("Subject", "A subject studied in a neuroscience experiment.", "core/Subject", [
            ("lookupLabel", "Lookup label", "string", None, False),
            ("biologicalSex", "Biological sex", "string", None, False),
            ("species", "Species", "string", None, False),
            ("strain", "Strain", "string", None, False),
        ]),
        ("Dataset", "A neuroscience dataset.", "core/Dataset", [
            ("title", "Title", "string", "schema:name", False),
            ("description", "Description", "string", "schema:description", False),
            ("license", "License", "string", "schema:license", False),
            ("digitalIdentifier", "Digital identifier (DOI, etc.)", "uriorcurie", "schema:identifier", False),
        ]),
        ("BrainAtlas", "A brain atlas reference space.", "sands/BrainAtlas", [
            ("shortName", "Short name", "string", None, False),
            ("fullName", "Full name", "string", None, False),
            ("ontologyIdentifier", "Ontology term URI", "uriorcurie", None, False),
        ]),
    ],
}
#: The names of these classes.
AIND_CORE, OPENMINDS_CORE = ([name for name, *_ in CORE[kind]] for kind in ("aind", "openminds"))
# The schema.org types that are seeded.
SEED_ROOTS = """
Thing Person Organization MedicalEntity AnatomicalStructure BrainStructure Nerve AnatomicalSystem MedicalCondition InfectiousDisease
MedicalSignOrSymptom MedicalStudy MedicalObservationalStudy MedicalTrial MedicalProcedure DiagnosticProcedure TherapeuticProcedure MedicalTest
ImagingTest BloodTest MedicalDevice Drug Substance BioChemEntity Gene Protein MolecularEntity ChemicalSubstance CreativeWork Article
ScholarlyArticle Dataset SoftwareApplication SoftwareSourceCode Event ConferenceEvent EducationEvent Place
""".split()

BODY = "path string, stem string, place int, depth int, reached boolean, name string, body string, error string"


def _number(text: str) -> float | str:
    """A JSON number with a point or an exponent, as the YAML parser takes it: an exponent counts after a point and with a sign."""
    mantissa, _, exponent = text.lower().partition("e")
    return float(text) if "." in mantissa and (not exponent or exponent[0] in "+-") else text


def _no_constant(text: str) -> None:
    raise ValueError(text)


def _documents(content: str) -> list:
    """The documents of a JSON or YAML file. JSON is parsed as such, which takes a small part of the YAML parser's memory and time."""
    try:
        return [json.loads(content, parse_float=_number, parse_constant=_no_constant)]
    except ValueError:
        return list(yaml.load_all(content, _Text))


def bodies(files: DataFrame) -> DataFrame:
    """A row for each JSON or YAML document of the files, and each definition inside, at any depth, in file order. ``reached``: all
    bodies around it have properties. A file that can't be parsed gives one row with ``error``."""

    def inside(name: str, body: dict, depth: int, reached: bool) -> Iterator[tuple]:
        yield depth, reached, name, json.dumps(body, default=str), None
        for part in ("$defs", "definitions"):
            for n, b in (body.get(part) or {}).items():
                if isinstance(b, dict):
                    yield from inside(str(n), b, depth + 1, reached and bool(body.get("properties")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                stem = PurePosixPath(path).stem
                try:
                    docs = [d for d in _documents(content or "") if isinstance(d, dict)]
                    rows = [r for d in docs for r in inside(stem, d, 0, True)]
                except (yaml.YAMLError, AttributeError, TypeError, ValueError) as e:  # a bad file fails alone, as a row
                    rows = [(0, False, stem, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame([(path, stem, k, *r) for k, r in enumerate(rows)], columns=[c.split()[0] for c in BODY.split(", ")])

    send_package(files.sparkSession)
    return files.mapInPandas(run, BODY)


def conversion_errors(files: DataFrame) -> DataFrame:
    """path and error of files that can't be parsed."""
    return bodies(files).where("error IS NOT NULL").select("path", "error")


def _at(body: Column, field: str) -> Column:
    return F.get_json_object(body, f"$.{field}")


def _list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _members(text: Column) -> Column:
    """The fields of a JSON object that are objects, in order: an array of (key, value)."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.coalesce(F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.startswith(e["value"], F.lit("{"))), none)


def _first(*texts: Column) -> Column:
    """The first text that is not empty, or an empty one."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def _one_type(kind: Column) -> Column:
    """A type; of a list of types the first that is not null."""
    own = F.coalesce(F.get(F.filter(_list(kind), lambda t: t != "null"), 0), F.lit("string"))
    return F.when(F.startswith(kind, F.lit("[")), own).otherwise(kind)


def _concrete(body: Column) -> tuple[Column, Column]:
    """The type that a body states, and the body that states it: a union counts by its first branch that is not null."""
    options = F.concat(_list(_at(body, "anyOf")), _list(_at(body, "oneOf")))
    branch = F.get(F.filter(options, lambda o: ~F.coalesce(_at(o, "type"), F.lit("")).isin("", "null")), 0)
    own = _at(body, "type")
    return _one_type(F.coalesce(own, _at(branch, "type"))), F.when(own.isNull() & branch.isNotNull(), branch).otherwise(body)


def plain_range(kind: Column) -> Column:
    return F.coalesce(F.element_at(S.lookup(JSON_TYPES), kind), F.lit("string"))


def rich_range(kind: Column, hint: Column) -> Column:
    """As plain_range, in any case, and a format that has a range of its own goes first."""
    return F.coalesce(F.element_at(S.lookup(FORMATS), hint), plain_range(F.lower(kind)))


def _local(prop: Column) -> Column:
    return S.clean_name(F.substring_index(F.substring_index(prop, "/", -1), "#", -1))


def _titled(stem: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(stem, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.initcap(x)), "")


#: What a format's function gives: rows of ``place``, ``class``, ``description``, ``class_uri``, ``parent`` and ``members`` (key, value) of its
#: classes, and for a member's class, key and body its name and the fields of its slot.
Slot = Callable[[Column, Column, Column], tuple[Column, dict[str, Column]]]


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _classes(rows: DataFrame, name: Column, description: Column, uri: Column, members: Column, parent: Column | None = None) -> DataFrame:
    parent = _no_text() if parent is None else parent
    return rows.select("path", "stem", "place", name.alias("class"), description.alias("description"), uri.alias("class_uri"), parent.alias("parent"), members.alias("members"))


def _json_schema(rows: DataFrame) -> tuple[DataFrame, Slot]:
    """Objects with their properties; slots are named by the bare property, the last one wins, and the whole schema comes last."""
    body, root = F.col("body"), F.col("depth") == 0
    kept = rows.where((F.col("depth") <= 1) & ((_at(body, "type") == "object") | _at(body, "properties").isNotNull()))
    kept = kept.withColumn("place", F.when(root, F.lit(2**30)).otherwise(F.col("place")))
    name = F.when(root, _first(_at(body, "title"), _titled(F.replace("stem", F.lit("-"), F.lit("_"))))).otherwise(F.col("name"))
    text = F.nullif(_first(_at(body, "description"), _at(body, "title")), F.lit(""))

    def slot(_, key, value):
        own, ref, items = _at(value, "type"), _at(value, "$ref"), _at(value, "items")
        array = own == "array"
        kind = _one_type(F.coalesce(own, F.lit("string")))
        inner = plain_range(_one_type(F.coalesce(_at(items, "type"), F.lit("string"))))
        found = F.when(array & (items.isNull() | F.startswith(items, F.lit("{"))), inner).when(ref.isNotNull(), F.substring_index(ref, "/", -1)).otherwise(plain_range(kind))
        many = F.coalesce(array, F.lit(False)) | (ref.isNull() & (kind == "array"))
        said = F.nullif(_first(_at(value, "description"), _at(value, "title")), F.lit(""))
        return key, {"range": found, "description": said, "multivalued": F.when(many, True), "required": F.when(F.col("needed"), True)}

    return _classes(kept, name, text, _no_text(), _members(_at(body, "properties"))).join(_needed(kept), ["path", "place"], "left"), slot


def _needed(rows: DataFrame) -> DataFrame:
    """path, place and the names of the members that a body requires."""
    return rows.select("path", "place", _list(_at(F.col("body"), "required")).alias("required_names"))


def _bids(rows: DataFrame) -> tuple[DataFrame, Slot]:
    body, docs = F.col("body"), rows.where("depth = 0")
    of = lambda k: F.element_at(S.lookup({g: v[k] for g, v in BIDS_SLOTS.items()}), F.col("stem"))
    groups = _classes(docs.where(F.col("stem").isin(*BIDS_SLOTS)), of(0), of(1), F.lit(SCHEMAS["bids"][0]), _members(body))
    terms = docs.where(F.col("stem").isin(*BIDS_CLASSES)).select("path", "stem", F.posexplode(_members(body)).alias("place", "term"))
    key, term = F.col("term.key"), F.col("term.value")
    text = _first(F.trim(_at(term, "description")), F.element_at(S.lookup(BIDS_CLASSES), F.col("stem")))
    uri = F.concat(F.lit(f"{GLOSSARY}#"), F.coalesce(_at(term, "value"), key))
    single = _classes(terms, _first(S.camel(key), S.clean(key)), text, uri, _members(_no_text())).where("class <> ''")

    def slot(_, key, value):
        kind, _where = _concrete(value)
        said = F.trim(S.or_empty(_at(value, "description")))
        return F.concat(F.col("stem"), F.lit("__"), key), {"description": said, "slot_uri": F.concat(F.lit(f"{GLOSSARY}#"), key), "range": plain_range(kind), "multivalued": F.coalesce(kind == "array", F.lit(False))}

    return groups.unionByName(single), slot


def _nwb(rows: DataFrame) -> tuple[DataFrame, Slot]:
    body, base = F.col("body"), SCHEMAS["nwb"][0]
    groups, datasets = _list(_at(body, "groups")), _list(_at(body, "datasets"))
    inner = F.when(_at(body, "neurodata_type_def").isNotNull(), F.array(body)).when(F.size(groups) > 0, groups).when(F.size(datasets) > 0, datasets).otherwise(F.array(body))
    types = rows.where("depth = 0").select("path", "stem", F.col("place").alias("doc"), F.posexplode(inner).alias("k", "type"))
    types = types.withColumn("place", F.col("doc") * 100_000 + F.col("k")).where(S.or_empty(_at(F.col("type"), "neurodata_type_def")) != "")
    kind, name = F.col("type"), _at(F.col("type"), "neurodata_type_def")
    parts = F.filter(F.concat(*(_list(_at(kind, part)) for part in ("attributes", "datasets", "links"))), lambda b: F.startswith(b, F.lit("{")))
    members = F.transform(parts, lambda b: F.struct(_first(_at(b, "name"), _at(b, "target_type")).alias("key"), b.alias("value")))

    def slot(name, key, value):
        stated = F.coalesce(_at(value, "dtype"), F.lit("text"))
        head = F.get(_list(stated), 0)
        one = F.when(F.startswith(stated, F.lit("[")), F.when(F.startswith(head, F.lit("{")), F.coalesce(_at(head, "dtype"), F.lit("text"))).otherwise(head)).otherwise(stated)
        times = F.coalesce(_at(value, "quantity"), F.lit("1"))
        found = F.coalesce(F.element_at(S.lookup(NWB_TYPES), F.lower(one)), F.lit("string"))
        said = S.or_empty(_at(value, "doc"))
        return F.concat(name, F.lit("__"), key), {"description": said, "slot_uri": F.concat(F.lit(f"{base}#"), key), "range": found, "multivalued": times.isin("*", "+"), "required": times == "1"}

    return _classes(types, name, S.or_empty(_at(kind, "doc")), F.concat(F.lit(f"{base}#"), name), F.filter(members, lambda m: m["key"] != ""), F.nullif(_at(kind, "neurodata_type_inc"), F.lit(""))), slot


def _dandi(rows: DataFrame) -> tuple[DataFrame, Slot]:
    body, base = F.col("body"), f"{SCHEMAS['dandi'][0]}#"
    kept = rows.where(F.col("reached") & (F.size(F.map_entries(F.from_json(_at(body, "properties"), "map<string,string>"))) > 0))
    name = F.when(F.col("depth") == 0, F.concat(F.upper(F.substring("name", 1, 1)), F.lower(F.substr("name", F.lit(2))))).otherwise(F.col("name"))
    text = F.coalesce(_at(body, "description"), _at(body, "title"), F.concat(F.lit("DANDI "), name))

    def slot(name, key, value):
        kind = _one_type(F.coalesce(_at(value, "type"), F.lit("string")))
        uri = F.coalesce(F.element_at(S.lookup(DANDI_TERMS), key), F.concat(F.lit(base), key))
        said = F.coalesce(_at(value, "description"), _at(value, "title"), F.lit(""))
        return F.concat(name, F.lit("__"), key), {"description": said, "slot_uri": uri, "range": plain_range(kind), "multivalued": kind == "array", "required": F.col("needed")}

    return _classes(kept, name, text, F.concat(F.lit(base), name), _members(_at(body, "properties"))).join(_needed(kept), ["path", "place"]), slot


def _openminds(rows: DataFrame) -> tuple[DataFrame, Slot]:
    body, base, docs = F.col("body"), SCHEMAS["openminds"][0], rows.where("depth = 0")
    raw = F.regexp_replace("stem", r"\.schema$", "")
    members = F.filter(_members(_at(body, "properties")), lambda m: ~F.substring(m["key"], 1, 1).isin("@", "_") & (_local(m["key"]) != ""))
    text = F.coalesce(_at(body, "description"), F.concat(F.lit("openMINDS "), raw))

    def slot(name, key, value):
        kind = _one_type(_first(_at(value, "type"), F.lit("string")))
        uri = F.when(F.startswith(key, F.lit("http")), key).otherwise(F.concat(F.lit(f"{base}vocab/"), _local(key)))
        said = S.or_empty(_at(value, "description"))
        return F.concat(name, F.lit("__"), _local(key)), {"description": said, "slot_uri": uri, "range": plain_range(F.lower(kind)), "multivalued": kind == "array", "required": F.col("needed")}

    found = _classes(docs, S.clean_name(raw), text, F.concat(F.lit(f"{base}core/"), raw), members)
    return found.where(F.size("members") > 0).join(_needed(docs), ["path", "place"]), slot


def _aind(rows: DataFrame) -> tuple[DataFrame, Slot]:
    body = F.col("body")
    kept = rows.where((F.col("depth") <= 1) & F.startswith(_at(body, "properties"), F.lit("{")))
    name = F.when(F.col("depth") == 0, F.col("name")).otherwise(S.clean(F.col("name")))
    text = _first(_at(body, "description"), _at(body, "title"), F.concat(F.lit("AIND "), name))

    def slot(name, key, value):
        kind, stated = _concrete(value)
        items = _at(stated, "items")
        many = F.coalesce(kind == "array", F.lit(False))
        found = F.when(many, rich_range(_at(items, "type"), _at(items, "format"))).otherwise(rich_range(kind, F.coalesce(_at(value, "format"), _at(stated, "format"))))
        said = F.coalesce(_at(value, "description"), _at(value, "title"), F.lit(""))
        unit = S.any_units(said)
        said = F.when(unit != "", F.concat(said, F.lit(" (units: "), unit, F.lit(")"))).otherwise(said)
        return F.concat(name, F.lit("__"), key), {"description": said, "slot_uri": F.concat(F.lit(f"{AIND}#"), key), "range": found, "multivalued": many, "required": F.col("needed")}

    return _classes(kept, name, text, F.concat(F.lit(f"{AIND}#"), name), _members(_at(body, "properties"))).join(_needed(kept), ["path", "place"]), slot


FORMATS_OF: dict[str, Callable[[DataFrame], tuple[DataFrame, Slot]]] = {"jsonschema": _json_schema, "bids": _bids, "nwb": _nwb, "dandi": _dandi, "openminds": _openminds, "aind": _aind}
CLASS, SLOT = "struct<slots:array<string>,description:string,class_uri:string,is_a:string>", "struct<description:string,slot_uri:string,range:string,multivalued:boolean,required:boolean>"


def class_rows(files: DataFrame, kind: str, label: str | None = None) -> DataFrame:
    """label, path, place, class, its body and ``slots`` (an array of name and body) of the files of one format. Files without a
    class give none."""
    found, slot = FORMATS_OF[kind](bodies(files).where("body IS NOT NULL"))
    needed = F.coalesce("required_names", F.array().cast("array<string>")) if "required_names" in found.columns else F.array().cast("array<string>")
    told = F.transform("members", lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value"), F.array_contains(needed, m["key"]).alias("needed")))  # no member's row holds the list
    rows = found.withColumn("members", told).drop("required_names").select("*", F.posexplode_outer("members").alias("slot_pos", "m"))
    rows = rows.withColumn("needed", F.col("m.needed"))
    name, fields = slot(F.col("class"), F.col("m.key"), F.col("m.value"))
    every = {f.split(":")[0]: f.split(":")[1] for f in SLOT.removeprefix("struct<").removesuffix(">").split(",")}
    body = F.struct(*(fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in every.items()))
    member = F.when(F.col("m").isNotNull(), F.struct(F.col("slot_pos"), name.alias("name"), body.alias("body")))
    own = F.lit(label) if label else F.lit(kind) if kind in SCHEMAS else F.col("stem")
    one = rows.groupBy(own.alias("label"), "path", "place", "class", "description", "class_uri", "parent").agg(F.array_sort(F.collect_list(member)).alias("slots"))
    held = F.struct(F.transform("slots", lambda s: s["name"]).alias("slots"), "description", "class_uri", F.col("parent").alias("is_a"))
    return one.select("label", "path", "place", "class", held.cast(CLASS).alias("body"), "slots")


def core_rows(kind: str, spark) -> DataFrame:
    """As class_rows, of the classes that stand in where the files of AIND or openMINDS have none."""
    rows = [(k, c, said, tail, n, f"{c.lower()}__{slot}", *rest) for k, (c, said, tail, slots) in enumerate(CORE[kind]) for n, (slot, *rest) in enumerate(slots)]
    found = spark.createDataFrame(rows, "place int, class string, description string, tail string, n int, slot string, said string, range string, term string, many boolean")
    body = F.struct(F.col("said").alias("description"), F.col("term").alias("slot_uri"), "range", F.when(F.col("many"), True).alias("multivalued"), F.lit(None).cast("boolean").alias("required"))
    one = found.groupBy("place", "class", "description", "tail").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("slot_pos"), F.col("slot").alias("name"), body.alias("body")))).alias("slots"))
    held = F.struct(F.transform("slots", lambda s: s["name"]).alias("slots"), "description", F.concat(F.lit(SCHEMAS[kind][0]), "tail").alias("class_uri"), _no_text().alias("is_a"))
    return one.select(F.lit(kind).alias("label"), F.lit("").alias("path"), "place", "class", held.cast(CLASS).alias("body"), "slots")


def first_tier(*tiers: DataFrame) -> DataFrame:
    """Of class rows of one label from several sources, those of the first that has any."""
    every = None
    for n, rows in enumerate(tiers):
        rows = rows.withColumn("tier", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("label").agg(F.min("tier").alias("tier"))
    return every.join(F.broadcast(best), ["label", "tier"]).drop("tier")  # a row per label


def documents(classes: DataFrame, kind: str) -> DataFrame:
    """label and document (a LinkML schema as JSON) of class rows. Of equal class names the first counts for BIDS and the last for
    the others; of equal slot names the last. Files come in the order of their paths, wherever they are read."""
    pick = F.min_by if kind == "bids" else F.max_by
    each = classes.select("label", "path", "place", F.explode("slots").alias("s"))
    slots = each.groupBy("label", "s.name").agg(F.max_by("s.body", F.struct("path", "place", "s.slot_pos")).alias("body"))
    held = slots.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "body")))).alias("slots"))
    one = classes.groupBy("label", "class").agg(pick(F.struct("path", "place", "body"), F.struct("path", "place")).alias("c"))
    in_order = F.array_sort(F.collect_list(F.struct("c.path", "c.place", "class", "c.body")))
    whole = one.groupBy("label").agg(F.map_from_entries(F.transform(in_order, lambda c: F.struct(c["class"].alias("key"), c["body"].alias("value")))).alias("classes"))
    version = SCHEMAS.get(kind, ("", "1.0.0"))[1]
    home = F.lit(SCHEMAS[kind][0]) if kind in SCHEMAS else F.concat(F.lit(S.SCHEMA_HOME), F.col("label"))
    head = [home.alias("id"), F.col("label").alias("name"), F.lit(version).alias("version"), F.lit("string").alias("default_range"), F.array(F.lit("linkml:types")).alias("imports"), S.lookup(PREFIXES).alias("prefixes")]
    none = F.create_map().cast(f"map<string,{SLOT}>")
    return whole.join(held, "label", "left").select("label", F.to_json(F.struct(*head, "classes", F.coalesce("slots", none).alias("slots"))).alias("document"))


def convert(files: DataFrame, kind: str, label: str | None = None) -> DataFrame:
    """label and document (a LinkML schema as JSON) of files (path, content) of one format."""
    rows = class_rows(files, kind, label)
    if kind in CORE and not label:
        rows = first_tier(rows, core_rows(kind, files.sparkSession))
    return documents(rows, kind)


def openminds_selection(files: DataFrame, modules: int = 5, per_module: int = 8) -> DataFrame:
    """Of files version/module/file.json those of the last version by name, of its first modules, and of each the first files."""
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    named = files.withColumns({"_version": part(3), "_module": part(2)}).where(F.col("path").endswith(".json"))
    last = named.groupBy().agg(F.max("_version").alias("_version"))
    own = named.join(F.broadcast(last), "_version")  # a single row
    chosen = own.select("_module").distinct().orderBy("_module").limit(modules)
    nth = F.row_number().over(Window.partitionBy("_module").orderBy("path"))
    return own.join(F.broadcast(chosen), "_module").withColumn("_n", nth).where(F.col("_n") <= per_module).select(files.columns)


def pass_through(files: DataFrame) -> DataFrame:
    """Schemas that are LinkML already: those with classes and slots."""
    return files.where(F.col("content").rlike(r"(?m)^classes:") & F.col("content").rlike(r"(?m)^slots:"))


def seed_schemas(files: DataFrame) -> DataFrame:
    """class and property_hashes of content-addressed AIND schemas (path, content)."""
    body = F.col("body")
    own = F.coalesce(F.nullif(_at(body, "provenance[0].class"), F.lit("")), F.nullif(_at(body, "provenance[0].name"), F.lit("")), F.substring_index("stem", "_", 1))
    name = _first(F.replace(S.clean(own), F.lit("_"), F.lit("")), F.lit("AindClass"))
    text = _first(_at(body, "provenance[0].description"), F.concat(F.lit("AIND "), name))
    return bodies(files).where("depth = 0 AND body IS NOT NULL").select("path", name.alias("class"), text.alias("description"), _list(_at(body, "semantic.properties")).alias("property_hashes"))


def seed_elements(files: DataFrame) -> DataFrame:
    """sha256, name, description and data_type of content-addressed AIND elements (path, content)."""
    body = F.col("body")
    found = bodies(files).where("depth = 0 AND body IS NOT NULL").where(_at(body, "sha256").isNotNull())
    return found.select(_at(body, "sha256").alias("sha256"), _at(body, "provenance[0].name").alias("name"), _at(body, "provenance[0].description").alias("description"), _at(body, "semantic.data_type").alias("data_type"))


def seed_rows(schemas: DataFrame, elements: DataFrame) -> DataFrame:
    """As class_rows, of content-addressed AIND schemas and elements; classes of which no hash is known are left out."""
    found = aind_from_hashes(schemas, elements)
    body = F.struct("description", "slot_uri", "range", "multivalued", F.lit(None).cast("boolean").alias("required"))
    one = found.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("slot_pos"), F.col("slot").alias("name"), body.alias("body")))).alias("slots"))
    own = schemas.groupBy("class").agg(F.max_by("description", "path").alias("description"), F.max("path").alias("path"))
    held = F.struct(F.transform("slots", lambda s: s["name"]).alias("slots"), "description", F.concat(F.lit(f"{AIND}#"), "class").alias("class_uri"), _no_text().alias("is_a"))
    return one.join(own, "class").select(F.lit("aind").alias("label"), "path", F.lit(0).alias("place"), "class", held.cast(CLASS).alias("body"), "slots")


def aind(models: DataFrame, schemas: DataFrame, elements: DataFrame) -> DataFrame:
    """label and document of AIND: from its models (path, content), else from content-addressed schemas and elements, else its core."""
    tiers = class_rows(models, "aind"), seed_rows(seed_schemas(schemas), seed_elements(elements)), core_rows("aind", models.sparkSession)
    return documents(first_tier(*tiers), "aind")


def to_yaml(docs: DataFrame) -> DataFrame:
    """label and content (YAML) of documents, as files that can be ingested. Rows that have a content already keep it."""
    if "content" in docs.columns:
        return docs.select("label", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [yaml.safe_dump(json.loads(d), allow_unicode=True, sort_keys=False) for d in batch.document]
            yield pd.DataFrame({"label": batch.label, "content": texts})

    send_package(docs.sparkSession)
    return docs.mapInPandas(run, "label string, content string")


def write_yaml(docs: DataFrame, path: str) -> None:
    """A folder label=... with one YAML file for each document."""
    to_yaml(docs).repartition("label").write.mode("overwrite").option("lineSep", "\n").partitionBy("label").text(path)


def run_all(
    sources: dict[str, Callable[[], DataFrame]], path: str, only: tuple[str, ...] = (), skip: tuple[str, ...] = (), inputs: dict[str, DataFrame] | None = None
) -> dict[str, str]:
    """Convert several sources, by name a function that gives documents, and write each under ``path``; the error of each that
    failed. A source fails if one of its files (``inputs``: path and content, by name) can't be parsed, though the others are written; one
    that fails does not stop the next."""
    failed = {}
    for name in only or sources:
        if name in skip:
            continue
        if name not in sources:
            failed[name] = "unknown source"
            continue
        try:
            docs = sources[name]()
            if docs.isEmpty():
                raise ValueError("no classes")
            write_yaml(docs, f"{path}/{name}")
            if name in (inputs or {}):
                bad = conversion_errors(inputs[name]).orderBy("path").collect()  # a row per bad file
                if bad:
                    failed[name] = "; ".join(f"{r.path}: {r.error}" for r in bad)
        except Exception as e:  # told to the caller
            failed[name] = f"{type(e).__name__}: {e}"
    return failed


def aind_from_hashes(schemas: DataFrame, elements: DataFrame) -> DataFrame:
    """class, slot, description, slot_uri, range and multivalued of schemas (class, property_hashes) whose properties are hashes of
    ``elements`` (sha256, name, description, data_type); hashes without an element are left out."""
    rows = schemas.select("class", F.posexplode("property_hashes").alias("pos", "sha256")).join(elements, "sha256")
    field = S.clean(F.coalesce("name", F.substring("sha256", 1, 12)))
    kind = F.lower(F.coalesce("data_type", F.lit("string")))
    return rows.select(
        "class", "pos", F.concat("class", F.lit("__"), field).alias("slot"), S.or_empty(F.col("description")).alias("description"),
        F.concat(F.lit(f"{AIND}#"), field).alias("slot_uri"), plain_range(kind).alias("range"), (kind == "array").alias("multivalued"),
    )


def missing_hashes(schemas: DataFrame, elements: DataFrame) -> DataFrame:
    return schemas.select("class", F.explode("property_hashes").alias("sha256")).join(elements, "sha256", "left_anti")


def schema_org(files: DataFrame, roots: list[str] = SEED_ROOTS) -> DataFrame:
    """schema_org_elements() of JSON-LD documents (path, content)."""
    graph = F.from_json(F.get_json_object("content", "$['@graph']"), "array<map<string,string>>")
    return schema_org_elements(files.select(F.posexplode(graph).alias("n", "m")), roots)


def schema_org_elements(nodes: DataFrame, roots: list[str] = SEED_ROOTS) -> DataFrame:
    """Element rows of the nodes of schema.org (``n``, their place, and ``m``, a map of their fields), restricted to ``roots``: properties go to
    the classes of their domains, a class has its first parent among the roots, and of definitions of one property the first counts."""
    base = "https://schema.org/"
    get = lambda k: F.element_at("m", k)
    short = lambda c: F.replace(F.regexp_replace(c, "^schema:", ""), F.lit(base), F.lit(""))
    many = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<struct<`@id`:string>>")).otherwise(F.array(F.from_json(c, "struct<`@id`:string>")))
    ids = lambda k: F.filter(F.transform(many(get(k)), lambda x: x["@id"]), lambda x: x.isNotNull())
    label = lambda k: S.or_empty(F.coalesce(F.get_json_object(get(k), "$['@value']"), get(k)))
    named = nodes.withColumn("name", short(get("@id")))
    wanted = F.array(*(F.lit(r) for r in roots))
    classes = named.where(F.contains(get("@type"), F.lit("Class")) & F.col("name").isin(roots))
    parents = F.filter(F.transform(F.coalesce(ids("rdfs:subClassOf"), F.array().cast("array<string>")), short), lambda x: F.array_contains(wanted, x))
    rows = classes.select(
        F.lit("class").alias("kind"), F.lit("schemaorg").alias("source_label"), F.lit(None).cast("string").alias("owner"), F.col("n").alias("pos"), "name", F.concat(F.lit(base), "name").alias("iri"),
        label("rdfs:comment").alias("definition"), F.get(parents, 0).alias("value"), F.lit(False).alias("is_abstract"),
    )
    props = named.where(F.contains(get("@type"), F.lit("Property")) & ~F.contains(get("@type"), F.lit("Class")))
    ranges = F.coalesce(ids("schema:rangeIncludes"), F.array().cast("array<string>"))
    full = lambda c: F.when(F.startswith(c, F.lit("schema:")), F.concat(F.lit(base), short(c))).otherwise(c)
    domains = props.select("n", "name", F.explode(F.transform(ids("schema:domainIncludes"), short)).alias("owner")).join(classes.select(F.col("name").alias("owner")), "owner", "left_semi")
    domains = domains.groupBy("owner", "name").agg(F.min("n").alias("n"))
    members = domains.select(F.lit("class_slot").alias("kind"), F.lit("schemaorg").alias("source_label"), "owner", F.col("n").alias("pos"), "name")
    slots = first_wins(props, ["name"], ["n"]).select(
        F.lit("slot").alias("kind"), F.lit("schemaorg").alias("source_label"), F.col("n").alias("pos"), "name", F.concat(F.lit(base), "name").alias("iri"), label("rdfs:comment").alias("definition"),
        F.coalesce(full(F.get(ranges, 0)), F.lit("xsd:string")).alias("value"), F.lit("").alias("units"),
    )
    return rows.unionByName(members, allowMissingColumns=True).unionByName(slots, allowMissingColumns=True).withColumn("aliases", F.array().cast("array<string>"))
