"""The catalogue as Parquet tables in a folder: appends of what is new, attestations, versions, wiping.

What one commit writes is a batch: its rows lie in folders of the batch's number, and readers take the batches up to the last that
is published, so a commit that fails half way is never seen, and the next one starts by deleting its folders. A rewrite writes a table
anew in a batch of its own, beside the old rows, so a table is never overwritten while it is read. Rows with a hash, and edges, are dealt into
buckets by it, and a batch is compared with the buckets that it falls in alone. There is one writer at a time.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..schemas import EDGES, NODES
from ..session import cut
from . import align, entities

#: Folders by hash of each batch of a table.
BUCKETS = 64


def _key(name: str) -> str | None:
    """The column by whose hash a table is dealt into buckets; sources, versions and the log are small and have none."""
    return "src" if name in EDGES else "hash_id" if "hash_id " in NODES[name] else None


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._batch, self._wrote, self._anew = 0, False, set()  # of the open commit

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The published rows of a table, or those of some buckets; none if it has not been written. Columns that an older version lacks come
        as nulls."""
        columns, last = (NODES | EDGES)[name], self._last()
        if old := self._old(name):
            return self.spark.read.schema(columns).parquet(old)
        if not self._exists(name):
            return self.spark.createDataFrame([], columns)
        parts = "batch long" + (", bucket int" if _key(name) else "")
        rows = self.spark.read.schema(f"{columns}, {parts}").parquet(self._current(name)).where(F.col("batch") <= last)
        if buckets is not None and _key(name):
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.drop("batch", "bucket")

    def near(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows of a table in the buckets that ``rows`` fall in; what lies in others has none of their keys."""
        key = _key(name)
        return self.read(name, [r[0] for r in rows.select(_bucket(key)).distinct().collect()] if key else None)  # BUCKETS values at most

    def held(self, name: str) -> DataFrame:
        """The published rows of a table with the columns that its files have."""
        rows = self.spark.read.parquet(self._current(name))
        return rows if self._old(name) else rows.where(F.col("batch") <= self._last()).drop("batch", "bucket")

    @contextmanager
    def commit(self) -> Iterator[None]:
        """What is appended and rewritten inside is published together at the end, or, after an error, not at all; reads see what was there
        before. A commit inside another is part of it."""
        if self._batch:
            yield
            return
        self._batch, self._wrote, self._anew = self._last() + 1, False, set()
        try:
            for name in NODES | EDGES:  # what a commit that failed may have left
                self._delete(f"{name}/base={self._batch}")
                self._delete(f"{self._folder(name)}/batch={self._batch}")
            yield
            if self._wrote:
                fs, p = self._fs(f"{self.path}/published/batch={self._batch}")
                fs.mkdirs(p)
                self._delete(f"published/batch={self._batch - 1}")
        finally:
            self._batch = 0

    def append(self, name: str, rows: DataFrame) -> None:
        with self.commit():
            if self._old(name) and name not in self._anew:
                self.rewrite(name, self.read(name))
            self._write(name, rows)

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """Replace all rows of a table."""
        with self.commit():
            self._delete(f"{name}/base={self._batch}")
            self._anew.add(name)
            self._write(name, rows)

    def drop(self) -> None:
        """Delete all tables."""
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def _write(self, name: str, rows: DataFrame) -> None:
        self._wrote = True
        schema = StructType.fromDDL((NODES | EDGES)[name])
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        base, key = self._batch if name in self._anew else self._base(name), _key(name)
        if key:  # by ranges, so that no bucket and no key is one task
            order = ["bucket", key, *(c for c in ("dst", "id") if c in schema.names)]
            rows = rows.withColumn("bucket", _bucket(key)).repartitionByRange(*order).sortWithinPartitions(*order)
        writer = rows.write.mode("append")
        (writer.partitionBy("bucket") if key else writer).parquet(f"{self.path}/{name}/base={base}/batch={self._batch}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _delete(self, folder: str) -> None:
        fs, p = self._fs(f"{self.path}/{folder}")
        fs.delete(p, True)

    def _numbers(self, folder: str, key: str) -> list[int]:
        """n of the folders key=n."""
        fs, p = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}=")]

    def _last(self) -> int:
        """The last published batch."""
        return max(self._numbers("published", "batch"), default=0)

    def _base(self, name: str) -> int:
        """The batch that wrote a table anew, the last published one; 0 if none did."""
        last = self._last()
        return max((n for n in self._numbers(name, "base") if n <= last), default=0)

    def _folder(self, name: str) -> str:
        return f"{name}/base={self._base(name)}"

    def _current(self, name: str) -> str:
        return self._old(name) or f"{self.path}/{self._folder(name)}"

    def _old(self, name: str) -> str | None:
        """The folder of a table as earlier releases wrote it, a folder for each version with a pointer to the last, until a batch writes it anew."""
        if self._base(name):
            return None
        fs, pointer = self._fs(f"{self.path}/{name}/pointer")
        version = self.spark.read.parquet(f"{self.path}/{name}/pointer").agg(F.max("version")).first()[0] if fs.exists(pointer) else 0
        folder = f"{self.path}/{name}/v{version}"
        return folder if fs.exists(self._fs(folder)[1]) else None

    def _exists(self, name: str) -> bool:
        last = self._last()
        return self._old(name) is not None or any(n <= last for n in self._numbers(self._folder(name), "batch"))


class Frames:
    """Tables that are frames, read as those of a Store; columns that a frame lacks are nulls, and tables that are not given empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark, self.tables = spark, tables

    def read(self, name: str) -> DataFrame:
        blank = self.spark.createDataFrame([], (NODES | EDGES)[name])
        if name not in self.tables:
            return blank
        rows = self.tables[name]
        kinds = dict(blank.dtypes)
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in blank.columns))


def new_rows(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of ``rows`` that ``old`` does not have."""
    one = entities.distinct_entities(rows, tuple(keys)).drop("attestations")
    return one.join(old.select(*keys), keys, "left_anti").select(*rows.columns)


def insert_counts(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """n_new and n_existing of a batch, counted per row: of a key that is new its first row is, and the others exist by then."""
    known = old.select(*keys).distinct().withColumn("_known", F.lit(1))
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(known, keys, "left")
    new = F.col("_known").isNull().cast("long")
    return per_key.agg(F.coalesce(F.sum(new), F.lit(0)).alias("n_new"), F.coalesce(F.sum(F.col("_n") - new), F.lit(0)).alias("n_existing"))


def write_if_new(store: Store, name: str, rows: DataFrame, keys: list[str]) -> int:
    """Append the rows whose keys are not there yet; what is there stays as it is. The number of rows added."""
    new = new_rows(rows, store.near(name, rows), keys).persist()
    added = new.count()
    if added:
        store.append(name, new)
    new.unpersist()
    return added


def ensure_source(store: Store, label: str, version: str, registry_version: str = "") -> str:
    """The id of a source; made at its first ingest, when its version is fixed."""
    row = store.spark.createDataFrame([(label, version, registry_version)], "label string, source_version string, registry_version string")
    row = row.select(F.expr("uuid()").alias("id"), "label", "source_version", "registry_version", F.lit(False).alias("is_hub"), S.now_iso().alias("created_at"))
    blank = store.spark.createDataFrame([], NODES["source"])
    write_if_new(store, "source", blank.unionByName(row, allowMissingColumns=True), ["label"])
    return store.read("source").where(F.col("label") == label).first()["id"]


def attestations(kind: str, rows: DataFrame, agent: str = "anonymous", issue: str = "", registry_version: str = "") -> DataFrame:
    """Provenance rows of entities (hash_id, had_primary_source, source_version), one for each entity and source."""
    return rows.select("hash_id", "had_primary_source", "source_version").distinct().select(
        F.expr("uuid()").alias("id"), F.lit(kind).alias("label"), "hash_id", "had_primary_source", "source_version",
        F.lit(registry_version).alias("registry_version"), S.now_iso().alias("generated_at_time"), S.agent_text(F.lit(agent), F.lit(issue)).alias("was_attributed_to"),
        F.lit("ingestion").alias("was_generated_by"), F.array().cast("array<string>").alias("was_derived_from"),
    )


ATTESTED = ["label", "hash_id", "had_primary_source"]


def attest(store: Store, kind: str, rows: DataFrame, source_id: str, source_version: str, agent: str = "anonymous", issue: str = "", registry_version: str = "") -> int:
    """Record that a source has these entities, once for each (kind, entity, source), whatever its version."""
    own = rows.select("hash_id", F.lit(source_id).alias("had_primary_source"), F.lit(source_version).alias("source_version"))
    return write_if_new(store, "provenance", attestations(kind, own, agent, issue, registry_version), ATTESTED)


def insert_schema(store: Store, elements: DataFrame, label: str, agent: str = "anonymous", issue: str = "", registry_version: str = "", yml_path: str = "", dry_run: bool = False) -> dict:
    """As insert_all(), of one source; its counts. A source that could not be parsed, or has classes in a cycle of parents, is an error and
    writes nothing."""
    found = insert_all(store, elements.where(F.col("source_label") == label), agent, issue, registry_version, dry_run, yml_path).collect()
    rows = [r for r in found if r.error is None]
    if not rows:
        raise ValueError(f"{label}: {found[0].error if found else 'no schema of this name'}")
    stats = {k: v for k, v in rows[0].asDict().items() if v is not None and k not in ("label", "error", "path")}
    if not stats.get("schema_unchanged"):
        stats.pop("schema_unchanged", None)
    return stats


def _sources(store: Store, meta: DataFrame, registry_version: str) -> tuple[DataFrame, DataFrame]:
    """label and id of the sources of ``meta`` (label, source_version), and the rows of those that are new, with their label as ``source_label``."""
    rows = meta.select(F.expr("uuid()").alias("id"), "label", "source_version", F.lit(registry_version).alias("registry_version"), F.lit(False).alias("is_hub"), S.now_iso().alias("created_at"))
    old = store.read("source")
    full = store.spark.createDataFrame([], NODES["source"]).unionByName(rows, allowMissingColumns=True)
    made = cut(new_rows(full, old, ["label"]))  # written, so that ids stay
    known = old.join(meta.select("label"), "label", "left_semi").select("label", "id")
    return known.unionByName(made.select("label", "id")), made.withColumn("source_label", F.col("label"))


def _failed(store: Store, bad: DataFrame) -> DataFrame:
    """label, path and error of files that are left out."""
    return store.spark.createDataFrame([(r.source_label, r.path, r.error) for r in bad.collect()], "label string, path string, error string")  # a row per file


def _dry(store: Store, meta: DataFrame, kinds: dict[str, DataFrame], bad: DataFrame) -> DataFrame:
    """What insert_all() would count, for entities."""
    out = meta.select("label", F.lit(0).cast("long").alias("provenance_added"))
    for name, plural in (("class", "classes"), ("property", "properties")):
        each = kinds[name].select(F.col("source_label").alias("label"), "hash_id").distinct()
        known = each.join(store.near(name, each).select("hash_id", F.lit(1).alias("_old")), "hash_id", "left")
        out = out.join(known.groupBy("label").agg(F.count_if(F.col("_old").isNull()).alias(f"{plural}_new"), F.count("_old").alias(f"{plural}_existing")), "label", "left")
    return out.fillna(0).unionByName(_failed(store, bad), allowMissingColumns=True)


def insert_all(store: Store, elements: DataFrame, agent: str = "anonymous", issue: str = "", registry_version: str = "", dry_run: bool = False, yml_path: str = "") -> DataFrame:
    """Write the elements of many sources at once, as insert_schema() would one after another in the order of their labels, and
    return a row of counts for each label. Files that could not be parsed, or have classes in a cycle of parents, are left out, each with
    ``path`` and ``error``; other files of the same label are not."""
    own = cut(entities.keyed(elements))  # written, so that plans stay short
    every_property = cut(entities.properties(own))
    every = cut(entities.classes(own, every_property))
    cycle = entities.unrooted(own, every).select(*entities.FILE, F.concat(F.lit("parents of "), "name").alias("error"))
    unread = own.where("kind = 'error'").select(*entities.FILE, F.col("definition").alias("error"))
    bad = cut(unread.unionByName(cycle).groupBy(*entities.FILE).agg(F.min("error").alias("error")))
    good = own.join(bad, entities.FILE, "left_anti")
    version = F.coalesce(F.nullif(F.min_by("value", "path"), F.lit("")), F.lit("1.0.0")).alias("source_version")
    meta = cut(good.where("kind = 'meta'").groupBy(F.col("source_label").alias("label")).agg(version))
    props = every_property.join(bad, entities.FILE, "left_anti")
    classes = every.join(bad, entities.FILE, "left_anti")
    if dry_run:
        return _dry(store, meta, {"class": classes, "property": props}, bad)
    ids, made_sources = _sources(store, meta, registry_version)
    ids = cut(ids)
    values = cut(entities.permissible_values(good))
    sets = cut(entities.value_sets(good, values))
    kinds = {"property": props, "class": classes, "value_set": sets, "permissible_value": values}
    edges = {
        "has_property": classes.select("source_label", F.col("hash_id").alias("src"), F.explode("properties").alias("dst")),
        "subclass_of": classes.where("parent_class IS NOT NULL").select("source_label", F.col("hash_id").alias("src"), F.col("parent_class").alias("dst")),
        "has_permissible_value": sets.select("source_label", F.col("hash_id").alias("src"), F.explode("permissible_values").alias("dst")),
    }
    ones: list[DataFrame] = []

    def told(rows: DataFrame, counter: str, n=None) -> None:
        ones.append(rows.groupBy("source_label").agg((F.count(F.lit(1)) if n is None else n).alias("n")).select("source_label", F.lit(counter).alias("counter"), "n"))

    new: list[tuple[str, str, DataFrame]] = [("source", "source_new", made_sources)]  # settled before anything is written
    near: dict[str, list[int]] = {}
    tables = (kinds | edges).items()
    for r in functools.reduce(DataFrame.unionByName, (rows.select(F.lit(n).alias("name"), _bucket(_key(n)).alias("bucket")) for n, rows in tables)).distinct().collect():
        near.setdefault(r.name, []).append(r.bucket)  # at most BUCKETS for each table
    old = store.read("provenance", sorted({b for n in kinds for b in near.get(n, [])}))
    for name, rows in kinds.items():
        told(rows, f"{name}_total", F.count_distinct("hash_id"))
        new.append((name, f"{name}_new", new_rows(rows, store.read(name, near.get(name, [])), ["hash_id"]).persist()))
        attested = rows.join(ids.join(meta, "label"), F.col("source_label") == F.col("label")).select("hash_id", F.col("id").alias("had_primary_source"), "source_version")
        made = new_rows(attestations(name, attested, agent, issue, registry_version), old, ATTESTED)
        labels = ids.select(F.col("label").alias("source_label"), F.col("id").alias("had_primary_source"))
        new.append(("provenance", f"{name}_attested", made.join(labels, "had_primary_source").persist()))
    for name, rows in edges.items():
        new.append((name, f"{name}_new", new_rows(rows, store.read(name, near.get(name, [])), ["src", "dst"]).persist()))
    for _, counter, rows in new:
        told(rows, counter)
    counts: dict[str, Counter] = {}
    for r in functools.reduce(DataFrame.unionByName, ones).collect():  # one job for all; a row per label of the batch and counter
        counts.setdefault(r.source_label, Counter())[r.counter] = r.n
    previous = {r.schema_label: r.source_version for r in latest_versions(store).join(meta, F.col("schema_label") == F.col("label"), "left_semi").select("schema_label", "source_version").collect()}
    stats = []
    for r in meta.collect():
        n = counts.get(r.label, Counter())
        rels = sum(n[f"{e}_new"] for e in edges)
        stats.append((r.label, r.source_version, previous.get(r.label), n["property_new"], n["property_total"], n["class_new"], n["class_total"], n["property_attested"] + n["class_attested"], rels))
    found = store.spark.createDataFrame(stats, "label string, source_version string, previous string, properties_new long, property_count long, classes_new long, class_count long, provenance_added long, rels long")
    grown = (F.col("classes_new") > 0) | (F.col("properties_new") > 0)
    same = F.col("previous").isNotNull() & ~grown & (F.col("provenance_added") == 0)
    bumped = S.bump_padded(F.col("previous"), F.when(grown, "minor").otherwise("patch"))
    after = F.when(F.col("previous").isNull(), F.col("source_version")).when(same, F.col("previous")).otherwise(bumped)
    found = found.withColumns({
        "properties_existing": F.col("property_count") - F.col("properties_new"), "classes_existing": F.col("class_count") - F.col("classes_new"),
        "schema_version": after, "schema_unchanged": same, "error": F.lit(None).cast("string"), "path": F.lit(None).cast("string"),
    })
    versions = found.where(~F.col("schema_unchanged")).select(
        F.expr("uuid()").alias("id"), F.col("label").alias("schema_label"), F.col("schema_version").alias("source_version"), F.lit(yml_path).alias("yml_path"), "class_count", "property_count",
        S.change_summary(F.col("classes_new"), F.col("properties_new"), F.col("provenance_added")).alias("changes_summary"), S.now_iso().alias("created_at"), F.lit(registry_version).alias("registry_version"))
    with store.commit():
        for name, counter, rows in new:
            if any(n[counter] for n in counts.values()):
                store.append(name, rows)
        if not versions.isEmpty():
            store.append("schema_version", versions)
    for _, _, rows in new:
        rows.unpersist()
    failed = _failed(store, bad)
    return found.drop("previous", "source_version").unionByName(failed, allowMissingColumns=True)


def latest_versions(store: Store) -> DataFrame:
    """The last version of each schema."""
    w = Window.partitionBy("schema_label").orderBy(F.desc("created_at"), F.desc("id"))
    return store.read("schema_version").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_version(store: Store, label: str) -> str | None:
    row = latest_versions(store).where(F.col("schema_label") == label).first()
    return row["source_version"] if row else None


def without_source(provenance: DataFrame, sources: DataFrame, label: str, kinds: tuple[str, ...] = ("class", "property")) -> DataFrame:
    """Attestations but those of these kinds by a source."""
    ids = sources.where(F.col("label") == label).select(F.col("id").alias("had_primary_source"), F.lit(True).alias("_own"))
    marked = provenance.join(ids.distinct(), "had_primary_source", "left")
    return marked.where(F.col("_own").isNull() | ~F.coalesce(F.col("label").isin(*kinds), F.lit(False))).select(provenance.columns)


def wipe_sources(store: Store, *labels: str) -> None:
    """Drop the attestations that these sources have of classes and properties, in one rewrite; entities, and attestations of value sets, stay."""
    left = store.read("provenance")
    for label in labels:
        left = without_source(left, store.read("source"), label)
    store.rewrite("provenance", left)


def wipe_source(store: Store, label: str) -> None:
    wipe_sources(store, label)


def write_alignments(store: Store, registry_version: str = "", dry_run: bool = False) -> int:
    """Upsert the exact alignments; the number of unordered pairs."""
    new = align.exact_edges(store.read("class"), registry_version)
    pairs = new.count() // 2
    if not dry_run:
        store.rewrite("aligned_to", align.upsert_edges(store.read("aligned_to"), new))
    return pairs


def label_counts(store: Store | Frames, names: tuple[str, ...] = tuple(NODES)) -> DataFrame:
    """label and n: the rows of each node table."""
    out = None
    for name in names:
        one = store.read(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def compact(store: Store, *names: str) -> None:
    """Write tables anew (all that have batches, if none is named), so that rows of many small batches lie in a few files a bucket."""
    with store.commit():
        for name in names or NODES | EDGES:
            if store._exists(name):
                store.rewrite(name, store.read(name))


def lacking(store: Store, name: str) -> list[str]:
    """Columns that a table must have and its files lack, or have of another type."""
    if not store._exists(name):
        return []
    there = dict(store.held(name).dtypes)
    return [c for c, kind in store.spark.createDataFrame([], (NODES | EDGES)[name]).dtypes if there.get(c) != kind]


def migrate(store: Store, name: str) -> bool:
    """Write a table that lacks columns anew, with nulls in those. Was it?"""
    missing = lacking(store, name)
    if missing:
        old = store.held(name)
        kinds = dict(store.spark.createDataFrame([], (NODES | EDGES)[name]).dtypes)
        store.rewrite(name, old.select(*((F.col(c).cast(k) if c in old.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items())))
    return bool(missing)
