"""Table definitions from a meta-model: a LinkML schema whose classes are node tables.

A file is read into rows of classes, of the slots that they list, and of slot definitions; all else is joins. What a class
inherits is what its ancestors list, from the topmost down, and a slot stands where it is first listed. A slot's range tells its column:
text, number or flag; an array of those where it is multivalued; the key of one object of another class; a table of edges
for several; or, for a class that is marked as inline, the columns of that class.

Abstract and inline classes have no tables, and neither have classes that are their own ancestors or below such a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities
from ..session import send_package
from .linkml import _Text

# Ranges and the types of their columns; any other range is text.
TYPES = {
    "string": "STRING", "str": "STRING", "datetime": "STRING", "uri": "STRING", "uriorcurie": "STRING", "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "integer": "BIGINT", "int": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
}
_ROW = "path string, kind string, name string, owner string, place int, range string, many boolean, is_key boolean, skipped boolean, inline boolean"


def _rows(files: DataFrame) -> DataFrame:
    """Classes (``range`` is the parent), listed slots (with owner and place) and slot definitions of files (path, content)."""

    def read(path: str, doc: dict) -> Iterator[dict]:
        for k, (name, body) in enumerate((doc.get("classes") or {}).items()):
            body = body or {}
            marks = body.get("annotations") or {}
            yield {"kind": "class", "name": name, "place": k, "range": body.get("is_a"), "skipped": bool(body.get("abstract")), "inline": bool(marks.get("db_inline"))}
            yield from ({"kind": "listed", "name": s, "owner": name, "place": i} for i, s in enumerate(body.get("slots") or []))
        for name, body in (doc.get("slots") or {}).items():
            body = body or {}
            yield {"kind": "slot", "name": name, "range": body.get("range"), "many": bool(body.get("multivalued")), "is_key": bool(body.get("identifier"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                yield pd.DataFrame([r | {"path": path} for r in read(path, yaml.load(content or "", _Text) or {})], columns=names).astype(object)

    send_package(files.sparkSession)
    return files.mapInPandas(run, _ROW)


def _slots(rows: DataFrame) -> DataFrame:
    """path, class, slot and ``at``, its place among those of the class and of what it inherits."""
    at = F.to_json(F.struct("path", "name"))
    own = rows.where("kind = 'class'").select("path", "name", at.alias("node"), F.when(F.col("range").isNotNull(), F.to_json(F.struct("path", F.col("range").alias("name")))).alias("parent"))
    sound = entities.depths(own.select(F.lit("").alias("scope"), "node", "parent")).select("node")
    above = entities.ancestors(own.select("node", "parent"))
    line = above.unionByName(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))).join(sound, "node")
    named = lambda c, name: F.get_json_object(c, "$.name").alias(name)
    line = line.select(F.get_json_object("node", "$.path").alias("path"), named("node", "class"), named("ancestor", "owner"), "depth")
    listed = rows.where("kind = 'listed'").select("path", "owner", F.col("name").alias("slot"), "place")
    return line.join(listed, ["path", "owner"]).groupBy("path", "class", "slot").agg(F.min(F.struct((-F.col("depth")).alias("depth"), "place")).alias("at"))


def columns(files: DataFrame) -> DataFrame:
    """path, class, class_pos, place, column, type, is_key and target: the columns of all tables of meta-models (path, content); where ``target`` is
    set it is a table of edges to that class instead."""
    rows = _rows(files).persist()
    classes = rows.where("kind = 'class'").select("path", F.col("name").alias("class"), F.col("place").alias("class_pos"), "skipped", "inline")
    defined = rows.where("kind = 'slot'").select("path", F.col("name").alias("slot"), "range", "many", "is_key")
    aimed = classes.select("path", F.col("class").alias("range"), F.lit(True).alias("is_class"), F.col("inline").alias("of_inline"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    every = _slots(rows).join(defined, ["path", "slot"], "left").withColumn("range", F.coalesce("range", F.lit("string"))).join(aimed, ["path", "range"], "left")
    every = every.select("path", "class", "slot", "at", "range", *map(yes, ("many", "is_key", "is_class", "of_inline")))
    inner = every.where("NOT is_class").select("path", F.col("class").alias("range"), F.struct("slot", F.col("range").alias("kind"), "many", "at").alias("inner"))
    held = every.where("of_inline AND NOT many").join(inner, ["path", "range"]).select("path", "class", "at", "inner.at", "inner.slot", F.col("inner.kind").alias("range"), F.col("inner.many").alias("many"), *(F.lit(False).alias(c) for c in ("is_key", "is_class")))
    held = held.toDF("path", "class", "at", "then", "slot", "range", "many", "is_key", "is_class")
    plain = every.where("NOT of_inline").withColumn("then", F.lit(None).cast(held.schema["then"].dataType)).select(held.columns)
    kind = F.when(F.col("is_class"), "STRING").otherwise(F.coalesce(F.element_at(S.lookup(TYPES), F.col("range")), F.lit("STRING")))
    listed = F.col("many") & ~F.col("is_class")
    made = plain.unionByName(held).join(classes.where("NOT skipped AND NOT inline"), ["path", "class"])
    place = F.row_number().over(Window.partitionBy("path", "class").orderBy("at", "then")) - 1
    return made.select(
        "path", "class", "class_pos", place.alias("place"), F.col("slot").alias("column"), F.when(listed, F.concat(F.lit("ARRAY<"), kind, F.lit(">"))).otherwise(kind).alias("type"),
        (F.col("is_key") & ~F.col("many") & ~F.col("is_class")).alias("is_key"), F.when(F.col("is_class") & F.col("many"), F.col("range")).alias("target"),
    )


def tables(files: DataFrame) -> DataFrame:
    """name and ddl of each table of nodes, and of edges with the columns src and dst."""
    found = columns(files)
    line = F.concat(F.lit("`"), "column", F.lit("` "), "type", F.when(F.col("is_key"), F.lit(" NOT NULL")).otherwise(F.lit("")))
    in_order = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    nodes = found.where("target IS NULL").groupBy("path", "class").agg(F.array_join(F.transform(in_order, lambda x: x["line"]), ", ").alias("c"))
    edges = found.where("target IS NOT NULL").select(F.concat("class", F.lit("_"), "column").alias("name"), F.lit("src STRING NOT NULL, dst STRING NOT NULL").alias("c"))
    made = nodes.select(F.col("class").alias("name"), "c").unionByName(edges)
    return made.select("name", F.concat(F.lit("CREATE TABLE IF NOT EXISTS `"), "name", F.lit("` ("), "c", F.lit(") USING parquet")).alias("ddl"))


def create(files: DataFrame) -> list[str]:
    """Create the tables of a meta-model in the current catalogue, if they are not there; their names."""
    spark, rows = files.sparkSession, tables(files).orderBy("name").collect()  # a row per class of a meta-model
    for r in rows:
        spark.sql(r.ddl)
    return [r.name for r in rows]
