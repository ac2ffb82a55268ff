"""Query tools over snapshot classes: search, lookup, alignments, comparison and record transformation.

``classes`` are rows as snapshot.class_rows or read_document gives them. Snapshot order is by name and hash unless there is a
column ``pos``. Tools return DataFrames; none collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import graphs


def _order(classes: DataFrame) -> list[str]:
    return ["pos"] if "pos" in classes.columns else ["name", "hash_id"]


def _has(needle: str, *columns: str) -> Column:
    """A case-insensitive substring of one of the columns; nothing in it is a wildcard."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(S.or_empty(F.col(c))), F.lower(F.lit(needle)))
    return out


def _in(source: str) -> Column:
    return F.coalesce(F.array_contains("sources", source), F.lit(False))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select("label", "version", "class_count").orderBy("label")


def search_classes(classes: DataFrame, query: str, source: str = "", limit: int = 20) -> DataFrame:
    """Classes whose name or definition holds ``query``. A limit below one looks at the first class (of the source) only."""
    rows = classes.where(_in(source)) if source else classes
    if limit < 1:
        rows, limit = rows.orderBy(*_order(classes)).limit(1), 1
    found = rows.where(_has(query, "name", "definition")).orderBy(*_order(classes)).limit(limit)
    return found.select("name", "hash_id", S.or_empty(F.col("iri")).alias("iri"), "sources", F.substring(S.or_empty(F.col("definition")), 1, 300).alias("definition"))


#: Folders of a trigram index.
BUCKETS = 256


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(0))), lambda i: F.substring(text, i, 3)))


def write_trigrams(classes: DataFrame, path: str) -> None:
    """Write which classes hold which runs of three characters in name or definition, in a folder for each bucket of runs."""
    lower = [F.lower(S.or_empty(F.col(c))) for c in ("name", "definition")]
    grams = F.array_union(*(F.when(F.length(t) >= 3, _grams(t)).otherwise(F.array().cast("array<string>")) for t in lower))
    rows = classes.select("hash_id", F.explode(grams).alias("gram"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)


def search_indexed(classes: DataFrame, path: str, query: str, source: str = "", limit: int = 20) -> DataFrame:
    """As search_classes(), but only classes are looked at that have all runs of the query by an index of write_trigrams(), of which the folders of
    these runs alone are read. Queries of fewer than three characters have no runs."""
    spark = classes.sparkSession
    needle = F.lower(F.lit(query))
    grams = [r.gram for r in spark.range(1).where(F.length(needle) >= 3).select(F.explode(_grams(needle)).alias("gram")).collect()]  # those of the query
    if not grams or limit < 1:
        return search_classes(classes, query, source, limit)
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    buckets = [r.b for r in wanted.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
    index = spark.read.schema("hash_id string, gram string, bucket int").parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    hits = index.distinct().groupBy("hash_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams))
    return search_classes(classes.join(hits, "hash_id", "left_semi"), query, source, limit)


def get_class(classes: DataFrame, name_or_hash: str) -> DataFrame:
    """The first class in snapshot order with this hash, or with this in its name."""
    return classes.where((F.col("hash_id") == name_or_hash) | _has(name_or_hash, "name")).orderBy(*_order(classes)).limit(1)


def within(edges: DataFrame, max_distance: float) -> DataFrame:
    """Edges up to a distance, which counts as near."""
    return edges.where(F.col("distance") <= max_distance)


def nearest(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The nearest edge of each key, the first by ``order`` where several are."""
    rest = [c for c in edges.columns if c not in keys]
    one = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("distance", *order)).alias("_row"))
    return one.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def get_alignments(classes: DataFrame, class_name: str, max_distance: float = 0.5, aligned_to: DataFrame | None = None) -> DataFrame:
    """Alignments of a class up to ``max_distance``, nearest first; unknown targets have no sources and no definition. ``aligned_to`` (src, dst,
    distance, method) is what to read where the classes hold no lists; of equal distances the first by hash comes first."""
    one = get_class(classes, class_name)
    if aligned_to is None:
        edges = one.select(F.posexplode("alignments").alias("place", "a"))
    else:
        names = classes.select(F.col("hash_id").alias("dst"), F.col("name").alias("target_name"))
        own = aligned_to.join(one.select(F.col("hash_id").alias("src")), "src").join(names, "dst", "left")
        edges = own.select(F.col("dst").alias("place"), F.struct(F.col("dst").alias("target_hash_id"), "target_name", "distance", "method").alias("a"))
    edges = edges.where(F.col("a.distance") <= max_distance)
    target = classes.select(F.col("hash_id").alias("t"), F.col("sources").alias("t_sources"), "definition")
    rows = edges.join(target, F.col("a.target_hash_id") == F.col("t"), "left").orderBy("a.distance", "place")
    scores = F.col("a.scores") if "scores" in edges.schema["a"].dataType.names else F.lit(None)
    return rows.select(
        F.col("a.target_name").alias("name"), F.col("a.target_hash_id").alias("hash_id"), F.coalesce("t_sources", F.array().cast("array<string>")).alias("sources"),
        F.col("a.distance").alias("distance"), F.col("a.method").alias("method"), scores.alias("scores"), F.substring(S.or_empty(F.col("definition")), 1, 300).alias("definition"),
    )


def diff_schemas(classes: DataFrame, source_a: str, source_b: str) -> DataFrame:
    """side (only_a, only_b or shared), a_name, b_name and distance: for each class of ``a`` its nearest one of ``b``; the first of equal ones.
    Only the nearest counts as matched, and a class of both sources without an alignment is on both sides."""
    a, b = classes.where(_in(source_a)), classes.where(_in(source_b))
    edges = a.select("hash_id", "name", F.posexplode("alignments").alias("place", "x"))
    hits = edges.join(b.select(F.col("hash_id").alias("t")), F.col("x.target_hash_id") == F.col("t"))
    best = nearest(hits.select("hash_id", "name", "place", "x", F.col("x.distance").alias("distance")), ["hash_id", "name"], ["place"])
    shared = best.select(F.lit("shared").alias("side"), F.col("name").alias("a_name"), F.col("x.target_name").alias("b_name"), F.col("x.distance").alias("distance"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    only_a = a.join(best.select("hash_id"), "hash_id", "left_anti").select(F.lit("only_a").alias("side"), F.col("name").alias("a_name"), null("string", "b_name"), null("double", "distance"))
    matched = best.select(F.col("x.target_hash_id").alias("hash_id"))
    only_b = b.join(matched, "hash_id", "left_anti").select(F.lit("only_b").alias("side"), null("string", "a_name"), F.col("name").alias("b_name"), null("double", "distance"))
    return shared.unionByName(only_a).unionByName(only_b).orderBy("side", "distance", "a_name", "b_name")


def field_map(classes: DataFrame, source: str, target: str, max_distance: float = 0.6) -> DataFrame:
    """field (lower case) and target_field: properties of equal lower-cased names over all aligned class pairs; the last pair in snapshot
    order wins. It is one map for all classes of the source."""
    own = classes.where(_in(source))
    order = F.struct(*_order(classes))
    edges = own.select(order.alias("o"), "properties", F.posexplode("alignments").alias("place", "x")).where(F.col("x.distance") <= max_distance)
    to = classes.where(_in(target)).select(F.col("hash_id").alias("t"), F.col("properties").alias("theirs"))
    pairs = edges.join(to, F.col("x.target_hash_id") == F.col("t"))
    mine = pairs.select("o", "place", F.explode(F.array_distinct(F.transform("properties", lambda p: F.lower(p["name"])))).alias("field"), "theirs")
    both = mine.select("o", "place", "field", F.posexplode("theirs").alias("k", "p")).where(F.lower("p.name") == F.col("field"))
    return both.groupBy("field").agg(F.max_by("p.name", F.struct("o", "place", "k")).alias("target_field"))


def transform_records(records: DataFrame, fields: DataFrame, record: str = "record", source: str = "", target: str = "") -> DataFrame:
    """Add ``mapped`` (map), ``unmapped`` (names) and ``warnings`` to records (maps of text values), all in one pass: the field map, whose size
    is that of a schema, becomes one map value beside each row. Of fields that fall on one target the last wins."""
    one = fields.agg(F.map_from_entries(F.collect_list(F.struct("field", "target_field"))).alias("_fields"))
    rows = records.crossJoin(F.broadcast(one))  # a single row
    known = lambda k: F.element_at(F.col("_fields"), F.lower(k))
    entries = F.map_entries(record)
    hits = F.transform(F.filter(entries, lambda e: known(e["key"]).isNotNull()), lambda e: F.struct(known(e["key"]).alias("key"), e["value"].alias("value")))
    # a map by target whose last entry wins, in the order of first fields
    targets = F.array_distinct(F.transform(hits, lambda e: e["key"]))
    values = F.transform(targets, lambda t: F.element_at(F.filter(hits, lambda e: e["key"] == t), -1)["value"])
    missing = F.transform(F.filter(entries, lambda e: known(e["key"]).isNull()), lambda e: e["key"])
    none = F.array().cast("array<string>")
    lost = F.when(F.size(missing) > 0, F.array(F.format_string("%d field(s) had no alignment: %s", F.size(missing), F.array_join(missing, ", ")))).otherwise(none)
    empty = F.lit(f"No property alignments found between '{source}' and '{target}'. Compute alignments first.")
    blank = F.when(F.size("_fields") == 0, F.array(empty)).otherwise(none)
    return rows.select(*(F.col(c) for c in records.columns), F.map_from_arrays(targets, values).alias("mapped"), missing.alias("unmapped"), F.concat(lost, blank).alias("warnings"))


def read_graph(spark, *paths: str) -> DataFrame:
    """Records of JSON-LD documents with a list ``@graph``: ``type`` and ``record``, a map of their fields (lists as JSON text). Large documents are read by many tasks."""
    rows = graphs.records(spark, *paths).select(F.col("pos").cast("int").alias("pos"), F.from_json("record", "map<string,string>").alias("r"))
    return rows.select("pos", F.element_at("r", "@type").alias("type"), S.field_keys(F.col("r")).alias("record"))


def submission_url(base: str, schemas: DataFrame, name: str = "name", document: str = "document") -> DataFrame:
    """name and url of a prefilled form that proposes a schema; nothing is sent."""
    title = F.concat(F.lit("Add schema: "), F.col(name))
    return schemas.select(name, F.concat(F.lit(base + "?title="), F.url_encode(title), F.lit("&body="), F.url_encode(document)).alias("url"), F.lit("manual").alias("status"))
