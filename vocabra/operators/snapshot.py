"""Versioned nested snapshots of the catalogue, and the log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import NODES, SNAPSHOT
from ..session import cut
from .store import Frames, Store


def attesting_sources(store: Store | Frames, kind: str) -> DataFrame:
    """hash_id and the sorted labels of the sources that have it."""
    labels = store.read("source").select(F.col("id").alias("had_primary_source"), F.col("label").alias("source"))
    rows = store.read("provenance").where(F.col("label") == kind).join(labels, "had_primary_source")
    return rows.groupBy("hash_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def source_rows(store: Store | Frames) -> DataFrame:
    """label, version and class_count of each source; one without classes has 0."""
    classes = store.read("provenance").where("label = 'class'").select(F.col("had_primary_source").alias("id"), "hash_id")
    rows = store.read("source").select("id", "label", "source_version").join(classes, "id", "left")
    version = F.when(S.or_empty(F.col("source_version")) == "", "1.0.0").otherwise(F.col("source_version"))
    return rows.groupBy("label", version.alias("version")).agg(F.count_distinct("hash_id").alias("class_count"))


def _empty(c: str):
    return S.or_empty(F.col(c))


def properties_of(store: Store | Frames) -> DataFrame:
    """hash_id of each class with properties, and the array ``properties`` of them by name and hash."""
    none = F.array().cast("array<string>")
    props = store.read("property").join(attesting_sources(store, "property"), "hash_id", "left").select(F.col("hash_id").alias("dst"), F.struct(
        _empty("name").alias("name"), "hash_id", _empty("concept_uri").alias("iri"), _empty("description").alias("definition"), _empty("property_range").alias("value_range"),
        _empty("ucum_code").alias("units"), F.coalesce("sources", none).alias("sources")).alias("p"))
    order = ("hash_id", "iri", "name", "definition", "value_range", "units", "sources")
    named = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(*(p[c].alias(c) for c in order)))  # nothing goes twice through the shuffle
    return store.read("has_property").join(props, "dst").groupBy(F.col("src").alias("hash_id")).agg(named.alias("properties"))


def parents_of(store: Store | Frames) -> DataFrame:
    """hash_id of each class with parents that have an IRI, and their sorted IRIs as ``subclass_of``."""
    node = store.read("class").where(_empty("concept_uri") != "").select(F.col("hash_id").alias("dst"), F.col("concept_uri").alias("t_iri"))
    return store.read("subclass_of").join(node, "dst").groupBy(F.col("src").alias("hash_id")).agg(F.sort_array(F.collect_list("t_iri")).alias("subclass_of"))


def alignments_of(store: Store | Frames) -> DataFrame:
    """hash_id of each aligned class, and the array ``alignments`` of its edges by distance and target."""
    node = store.read("class").select(F.col("hash_id").alias("dst"), F.col("name").alias("t_name"), F.col("concept_uri").alias("t_iri"))
    number = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d))
    edge = F.struct(
        F.col("dst").alias("target_hash_id"), _empty("t_name").alias("target_name"), _empty("t_iri").alias("target_iri"), number("distance", 1.0).alias("distance"), _empty("method").alias("method"),
        F.struct(*(number(f"score_{k}", 0.0).alias(k) for k in ("iri", "name", "desc", "slot"))).alias("scores"))
    in_order = F.array_sort(F.collect_list(F.struct("a.distance", "a.target_hash_id", "a")))
    return store.read("aligned_to").join(node, "dst").select(F.col("src").alias("hash_id"), edge.alias("a")).groupBy("hash_id").agg(F.transform(in_order, lambda x: x["a"]).alias("alignments"))


def class_rows(store: Store | Frames) -> DataFrame:
    """One nested row per class, its lists ordered by name or distance and then by hash."""
    rows = store.read("class")
    for part in (attesting_sources(store, "class"), properties_of(store), parents_of(store), alignments_of(store)):
        rows = rows.join(part, "hash_id", "left")
    fields = dict(rows.dtypes)
    or_none = lambda c: F.coalesce(F.col(c), F.array().cast(fields[c])).alias(c)
    return rows.select(
        "hash_id", _empty("concept_uri").alias("iri"), _empty("name").alias("name"), _empty("description").alias("definition"), F.coalesce("is_abstract", F.lit(False)).alias("is_abstract"),
        or_none("sources"), or_none("properties"), or_none("subclass_of"), or_none("alignments"),
    )


def write_snapshot(store: Store, path: str, bump: str = "minor", issue: str = "", agent: str = "github-actions", schema: str = "") -> str:
    """Publish the next version under ``path``: classes and sources as JSON lines in a folder per version, and a log entry.
    Classes are written as rows, in name order, and never gathered on the driver. A version that the log lacks, left by a failure, is written over."""
    spark, current = store.spark, current_version(store)
    version = spark.range(1).select(S.next_registry_version(F.lit(current), F.lit(bump))).first()[0]
    classes, sources = class_rows(store), cut(source_rows(store))
    classes.repartitionByRange("name", "hash_id").sortWithinPartitions("name", "hash_id").write.mode("overwrite").json(f"{path}/registry_version={version}/classes")
    sources.coalesce(1).sortWithinPartitions("label").write.mode("overwrite").json(f"{path}/registry_version={version}/sources")
    totals = sources.agg(F.count(F.lit(1)).alias("sources_total")).crossJoin(store.read("class").agg(F.count(F.lit(1)).alias("classes_total")))
    store.append("changelog", totals.select(
        F.lit(version).alias("registry_version"), F.lit(current).alias("previous_version"), S.now_iso().alias("timestamp"), F.lit(bump).alias("bump"), F.lit("issue" if issue else "manual").alias("trigger"),
        F.lit(issue).alias("issue_number"), F.lit(agent).alias("agent"), F.lit(schema).alias("schema_ingested"), F.struct("classes_total", "sources_total").alias("stats"),
        F.lit(f"data/versions/{version}.json").alias("archive_path")))
    return version


def current_version(store: Store) -> str:
    """The last version of the log, or 0.0.0."""
    row = store.read("changelog").agg(F.max_by("registry_version", "timestamp")).first()
    return row[0] or "0.0.0"


def read_snapshot(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Classes and sources of a published version."""
    root = spark.createDataFrame([], SNAPSHOT).schema
    at = f"{path}/registry_version={version}"
    return spark.read.schema(root["classes"].dataType.elementType).json(f"{at}/classes"), spark.read.schema(root["sources"].dataType.elementType).json(f"{at}/sources")


def read_document(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Classes (with ``pos``, their place) and sources of snapshots: files that are one JSON document each, or folders of write_document(),
    whose lines are read by all tasks."""
    root = spark.createDataFrame([], SNAPSHOT).schema
    one = root["classes"].dataType.elementType
    texts = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.ltrim("value").alias("line"))
    if not texts.where(F.col("file").rlike(r"/part-\d+-[^/]*$")).isEmpty():
        # a block of a file is read by one task in order, and files lie in the order of their names: counts of lines say all places
        blocks = texts.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
        earlier = Window.partitionBy(F.regexp_extract("file", "^(.*)/", 1)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") - 1).alias("add"))  # a row per block; the head is no class
        lines = texts.where(F.ltrim("line", F.lit(",")).startswith('{"hash_id"')).join(F.broadcast(blocks), ["file", "block"], "left")
        pos = F.col("k") + F.coalesce("add", F.raise_error(F.lit("A file was split in another way while it was read.")).cast("long"))
        rows = lines.select(pos.cast("int").alias("pos"), F.from_json(F.ltrim("line", F.lit(",")), one).alias("c"))
        heads = texts.where(F.col("line").startswith('{"registry_version"')).select(F.from_json(F.regexp_replace("line", r', "classes": \[$', "}"), root).alias("d"))
        return rows.select("pos", "c.*"), heads.select(F.inline("d.sources"))
    doc = spark.read.schema(SNAPSHOT).json(list(paths), multiLine=True)
    return doc.select(F.posexplode("classes").alias("pos", "c")).select("pos", "c.*"), doc.select(F.inline("sources"))


def read_changelog(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries of change logs, which are one JSON document each."""
    return changelog_entries(spark.read.text(list(paths), wholetext=True))


def changelog_entries(texts: DataFrame) -> DataFrame:
    """Entries of change logs (``value``): a list of entries, or an object with a list ``entries``."""
    entry = texts.sparkSession.createDataFrame([], NODES["changelog"]).schema
    listed = F.from_json("value", f"array<{entry.simpleString()}>")
    held = F.from_json("value", f"struct<entries:array<{entry.simpleString()}>>")["entries"]
    return texts.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(held)).alias("e")).select("e.*")


def version_chain(changelog: DataFrame, *by: str, version: str = "registry_version", order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """``by``, each version and the one before it, by time. Without ``by`` it is one registry's log, a row per release, and the
    version before is the one that the log names."""
    if not by:
        return changelog.select(version, "timestamp", F.col("previous_version").alias("before"))
    return changelog.select(*by, version, F.lag(version).over(Window.partitionBy(*by).orderBy(*order)).alias("before"))


def write_document(store: Store | Frames, path: str, version: str, classes: DataFrame | None = None, sources: DataFrame | None = None) -> None:
    """The snapshot as one JSON document, in a folder ``path`` whose files in the order of their names are the document: a line per class, dealt by ranges
    of names, with a head before the first and a foot behind the last. read_document() reads it. ``classes`` and ``sources`` are what
    class_rows() and source_rows() gave, where that is known."""
    spark = store.spark
    names = store.read("class").select(_empty("name").alias("name"), "hash_id") if classes is None else classes.select("name", "hash_id")  # no list is made for the first of them
    classes, sources = class_rows(store) if classes is None else classes, source_rows(store) if sources is None else sources
    none = F.array().cast("array<struct<label:string,version:string,class_count:bigint>>")
    listed = F.coalesce(F.array_sort(F.collect_list(F.struct("label", "version", "class_count"))), none)  # a row per source
    head = sources.agg(listed.alias("sources")).select(F.to_json(F.struct(F.lit(version).alias("registry_version"), S.now_iso().alias("generated_at"), "sources")).alias("j"))
    place = lambda part, name, hash_id: (F.lit(part).alias("part"), name.alias("name"), hash_id.alias("hash_id"))
    first = head.select(*place(0, F.lit(""), F.lit("")), F.concat(F.col("j").substr(F.lit(1), F.length("j") - 1), F.lit(', "classes": [')).alias("value"))
    each = classes.select(*place(1, F.col("name"), F.col("hash_id")), F.to_json(F.struct("*")).alias("value"))
    start = names.agg(F.min(F.struct("name", "hash_id")).alias("m")).select("m.*", F.lit(True).alias("_first"))
    lines = each.join(F.broadcast(start), ["name", "hash_id"], "left")  # one row
    lines = lines.select("part", "name", "hash_id", F.concat(F.when(F.col("_first"), F.lit("")).otherwise(F.lit(",")), "value").alias("value"))
    foot = spark.range(1).select(*place(2, F.lit(""), F.lit("")), F.lit("]}").alias("value"))
    order = ("part", "name", "hash_id")
    whole = first.unionByName(lines).unionByName(foot).repartitionByRange(*order).sortWithinPartitions(*order)
    whole.select("value").write.mode("overwrite").text(path)


def publish(store: Store, path: str, **told) -> str:
    """The next version: write_snapshot(), the document ``registry.json`` and its archive copy ``versions/<version>.json``, each a folder."""
    version = write_snapshot(store, path, **told)
    classes, sources = read_snapshot(store.spark, path, version)  # what has just been written, so that no join runs again
    for at in (f"{path}/registry.json", f"{path}/versions/{version}.json"):
        write_document(store, at, version, classes, sources)
    return version
