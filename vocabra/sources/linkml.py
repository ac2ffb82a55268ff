"""LinkML schema files as element rows.

A file is the unit of parsing: text in, rows out, in Arrow batches over all files. Inheritance is resolved there; CURIEs,
ranges and units are column expressions afterwards. A file that can't be parsed gives one row of kind error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import ELEMENT
from ..session import send_package

COLUMNS = [c.split()[0] for c in ELEMENT.replace("array<string>", "array").split(",")]


class _Text(yaml.SafeLoader):
    """Dates and versions stay as they are written."""


_Text.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path and content of whole files, in one split per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def _ancestry(name: str, classes: dict) -> list[str]:
    """A class, its mixins, then its parents with theirs, each once; KeyError where one is missing."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        body = classes[n] or {}
        out.append(n)
        for m in body.get("mixins") or []:
            visit(m)
        if body.get("is_a"):
            visit(body["is_a"])

    visit(name)
    return out


def _slots_of(name: str, doc: dict) -> list[tuple[str, dict]]:
    """Slots with their bodies: own ones, own attributes, then those inherited; the nearest wins. With an unknown ancestor a class
    has what it declares itself, attributes first, and nothing inherited."""
    classes, slots = doc.get("classes") or {}, doc.get("slots") or {}
    body = classes[name] or {}
    found: dict[str, dict] = {}
    try:
        line = _ancestry(name, classes)
    except KeyError:
        for n, b in (body.get("attributes") or {}).items():
            found.setdefault(n, b or {})
        for n in body.get("slots") or []:
            if n in slots:
                found.setdefault(n, slots[n] or {})
        return list(found.items())
    for ancestor in line:
        own = classes[ancestor] or {}
        attributes = own.get("attributes") or {}
        for n in own.get("slots") or []:
            if n not in slots and n not in attributes:
                raise ValueError(f"class '{name}': no such slot {n}")
            found.setdefault(n, attributes.get(n) or slots.get(n) or {})
        for n, b in attributes.items():
            found.setdefault(n, b or {})
    default = doc.get("default_range")
    usage: dict[str, dict] = {}
    for ancestor in reversed(line):  # the nearest refinement of a slot wins
        for n, b in ((classes[ancestor] or {}).get("slot_usage") or {}).items():
            usage[n] = usage.get(n, {}) | {k: v for k, v in (b or {}).items() if v is not None}
    refined = {n: b | usage.get(n, {}) for n, b in found.items()}
    return [(n, b if b.get("range") or not default else b | {"range": default}) for n, b in refined.items()]


def merged(doc: dict, imports: list[dict]) -> dict:
    """A schema with the definitions of those it imports; its own win, then those of the first."""
    out = dict(doc)
    for part in ("prefixes", "classes", "slots", "enums"):
        own = dict(doc.get(part) or {})
        for other in imports:
            own |= {k: v for k, v in (other.get(part) or {}).items() if k not in own}
        if own:
            out[part] = own
    return out


def import_names(files: DataFrame) -> DataFrame:
    """path, ``stem`` (the file's name without its ending) and ``imports``, the names that a file imports, of files (path, content). Names with a
    prefix, as linkml:types, are no files; a file that can't be parsed imports nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    names = (yaml.load(content or "", _Text) or {}).get("imports") or []
                except (yaml.YAMLError, AttributeError):
                    names = []  # parse() tells
                rows.append((path, [PurePosixPath(str(n)).name for n in names if ":" not in str(n)]))
            yield pd.DataFrame(rows, columns=["path", "imports"])

    send_package(files.sparkSession)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.mapInPandas(run, "path string, imports array<string>").select("path", stem.alias("stem"), "imports")


def import_edges(names: DataFrame) -> DataFrame:
    """path, place in its list, name and ``target``, the path of the imported file, of rows of import_names(); null where there is no such file."""
    at = names.select(F.col("path").alias("target"), F.col("stem").alias("name"))
    return names.select("path", F.posexplode("imports").alias("place", "name")).join(at, "name", "left").where("target IS NULL OR path <> target")


def with_imports(files: DataFrame) -> DataFrame:
    """Add ``imported`` to files (path, content): the contents of all files among them that a schema imports, directly or through
    others, nearest first. Imports that are not there are left out."""
    edges = import_edges(import_names(files)).where("target IS NOT NULL").select("path", "target", "place").persist()
    reach, new, depth = edges.withColumn("depth", F.lit(1)), edges, 1
    while not new.isEmpty():  # as many rounds as the longest chain of imports
        depth += 1
        step = new.select("path", F.col("target").alias("via")).join(edges.select(F.col("path").alias("via"), "target", "place"), "via").where("path <> target")
        new = step.select("path", "target", "place").distinct().join(reach, ["path", "target"], "left_anti").persist()
        reach = reach.unionByName(new.withColumn("depth", F.lit(depth)))
    near = reach.groupBy("path", "target").agg(F.min(F.struct("depth", "place")).alias("order"))
    held = near.join(files.select(F.col("path").alias("target"), "content"), "target")
    one = held.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "target", "content"))), lambda x: x["content"]).alias("imported"))
    return files.join(one, "path", "left")


def elements_of(doc: dict, label: str) -> list[dict]:
    """Element rows of a parsed schema; the position in the file is kept, since order decides which definition wins."""
    if not isinstance(doc, dict):
        raise ValueError("not a mapping")
    rows = [{"kind": "meta", "name": doc.get("name") or label, "iri": doc.get("id") or "", "value": str(doc.get("version") or "1.0.0"), "definition": doc.get("description") or ""}]
    for n, p in (doc.get("prefixes") or {}).items():
        rows.append({"kind": "prefix", "name": n, "value": p if isinstance(p, str) else (p or {}).get("prefix_reference", "")})
    classes, pos, seen = doc.get("classes") or {}, 0, set()
    for k, (name, body) in enumerate(classes.items()):
        body = body or {}
        rows.append({
            "kind": "class", "pos": k, "name": name, "iri": body.get("class_uri") or "", "definition": body.get("description") or "",
            "value": body["is_a"] if body.get("is_a") in classes else None, "is_abstract": bool(body.get("abstract")), "aliases": list(body.get("aliases") or []),
        })
        for i, (slot, b) in enumerate(_slots_of(name, doc)):
            rows.append({"kind": "class_slot", "owner": name, "pos": i, "name": slot})
            if slot not in seen:
                seen.add(slot)
                raw = b.get("range")
                rows.append({
                    "kind": "slot", "owner": name, "pos": pos, "name": slot, "iri": b.get("slot_uri") or "", "definition": str(b.get("description") or ""),
                    "value": raw if isinstance(raw, str) else "", "multivalued": bool(b.get("multivalued")), "required": bool(b.get("required")),
                    "pattern": b.get("pattern") or "", "aliases": list(b.get("aliases") or []),
                })
                pos += 1
    for k, (name, body) in enumerate((doc.get("enums") or {}).items()):
        body = body or {}
        rows.append({"kind": "enum", "pos": k, "name": name, "iri": body.get("enum_uri") or "", "definition": str(body.get("description") or "")})
        values = body.get("permissible_values") or {}
        values = values if isinstance(values, dict) else dict.fromkeys(values)
        for i, (text, v) in enumerate(values.items()):
            v = v or {}
            rows.append({"kind": "value", "owner": name, "pos": i, "name": str(text), "definition": str(v.get("description") or ""), "value": v.get("meaning") or ""})
    return rows


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{c: r.get(c) for c in COLUMNS} for r in rows], columns=COLUMNS)


def parse(files: DataFrame, label: str | None = None) -> DataFrame:
    """Element rows of all files (path, content, and perhaps ``imported``, of with_imports). The source's label is ``label``, else the
    schema's name, else the file's stem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            others = batch.imported if "imported" in batch else [None] * len(batch)
            for path, content, imported in zip(batch.path, batch.content, others, strict=True):
                stem = PurePosixPath(path).stem
                try:
                    doc = yaml.load(content or "", _Text)
                    if imported is not None:
                        doc = merged(doc, [yaml.load(x or "", _Text) or {} for x in imported])
                    rows = elements_of(doc, stem)
                    own = label or (doc or {}).get("name") or stem
                except Exception as e:  # a bad file fails alone, as a row
                    rows, own = [{"kind": "error", "name": stem, "definition": f"{type(e).__name__}: {e}"}], label or stem
                yield _frame([r | {"source_label": own, "path": path} for r in rows])

    send_package(files.sparkSession)
    return resolved(files.mapInPandas(run, ELEMENT))


def resolved(elements: DataFrame) -> DataFrame:
    """Element rows with IRIs for CURIEs and ranges, and a column ``units``."""
    own = elements.where("kind = 'prefix'").groupBy("source_label", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("prefixes"))
    joined = elements.join(own, ["source_label", "path"], "left")
    p = F.col("prefixes")
    value = (
        F.when(F.col("kind") == "slot", S.value_range(F.col("value"), p))
        .when(F.col("kind") == "value", S.or_empty(S.resolve_prefix(F.col("value"), p))).otherwise(F.col("value"))
    )
    iri = F.when(F.col("kind").isin("class", "slot", "enum"), S.or_empty(S.resolve_prefix(F.col("iri"), p))).otherwise(F.col("iri"))
    found = F.when(F.col("kind") == "slot", S.or_empty(S.units(F.col("definition"))))
    return joined.withColumns({"iri": iri, "value": value, "units": found}).select(*COLUMNS, "units")


def elements_from_documents(schemas: DataFrame) -> DataFrame:
    """Element rows of converted schemas (label, document as JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, document in zip(batch.label, batch.document, strict=True):
                yield _frame([r | {"source_label": label, "path": label} for r in elements_of(json.loads(document), label)])

    send_package(schemas.sparkSession)
    return resolved(schemas.select("label", "document").mapInPandas(run, ELEMENT))


# What the fields of schemas, classes and slots must be.
SHAPE = {
    "schema": {"id": str, "name": str, "title": str, "description": str, "default_prefix": str, "default_range": str, "prefixes": dict, "imports": list, "classes": dict, "slots": dict, "enums": dict, "types": dict, "subsets": dict},
    "class": {"description": str, "class_uri": str, "is_a": str, "mixins": list, "abstract": bool, "mixin": bool, "aliases": list, "slots": list, "attributes": dict, "slot_usage": dict, "tree_root": bool},
    "slot": {"description": str, "range": str, "slot_uri": str, "multivalued": bool, "required": bool, "identifier": bool, "pattern": str, "aliases": list, "is_a": str},
}


def misshapen(doc: dict) -> Iterator[tuple[str, str]]:
    """(owner, field) of what a schema lacks or has of another kind than it must be."""

    def wrong(kind: str, owner: str, body) -> Iterator[tuple[str, str]]:
        if body is not None and not isinstance(body, dict):
            yield owner, kind
            return
        for field, must in SHAPE[kind].items():
            value = (body or {}).get(field)
            if value is not None and not isinstance(value, must):
                yield owner, field

    yield from (("", k) for k in ("id", "name") if not doc.get(k))
    yield from wrong("schema", "", doc)
    for part, kind in (("classes", "class"), ("slots", "slot")):
        for name, body in (doc.get(part) if isinstance(doc.get(part), dict) else {}).items():
            yield from wrong(kind, str(name), body)


def undefined_references(files: DataFrame) -> DataFrame:
    """source_label, kind, owner and name of slots, parents and mixins that a schema uses and does not define, of fields that have
    the wrong shape, and of files that can't be parsed."""
    schema = "source_label string, kind string, owner string, name string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                rows, label = [], PurePosixPath(path).stem
                try:
                    doc = yaml.load(content or "", _Text)
                    label = doc.get("name") or label
                    slots, classes = doc.get("slots") or {}, doc.get("classes") or {}
                    rows += [("shape", *x) for x in misshapen(doc)]
                    if any(field not in ("id", "name") for _, _, field in rows):
                        slots, classes = {}, {}  # what they name can't be told
                    rows += [("defined_slot", "", s) for s in slots] + [("defined_class", "", c) for c in classes]
                    for c, body in classes.items():
                        body = body or {}
                        rows += [("attribute", c, s) for s in body.get("attributes") or {}] + [("slot", c, s) for s in body.get("slots") or []]
                        rows += [("class", c, s) for s in [body.get("is_a"), *(body.get("mixins") or [])] if s]
                except Exception as e:
                    rows = [("load", "", f"{type(e).__name__}: {e}")]
                yield pd.DataFrame([(label, *r) for r in rows], columns=["source_label", "kind", "owner", "name"])

    send_package(files.sparkSession)
    rows = files.mapInPandas(run, schema)
    named = lambda kind, *more: rows.where(F.col("kind") == kind).select("source_label", *more, "name").distinct()
    slots = rows.where("kind = 'slot'").join(named("defined_slot"), ["source_label", "name"], "left_anti").join(named("attribute", "owner"), ["source_label", "owner", "name"], "left_anti")
    classes = rows.where("kind = 'class'").join(named("defined_class"), ["source_label", "name"], "left_anti")
    bad = rows.where(F.col("kind").isin("shape", "load"))
    return slots.unionByName(classes).unionByName(bad).select("source_label", "kind", "owner", "name")


def _nth(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _nth(df, keys, *order)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _nth(df, keys, *(F.desc(c) for c in order))
