"""Ingest of schema files as they arrive in a folder, with the files that they import, whatever comes first.

Each batch's files are kept in a log beside the catalogue, with the names that they import. A file whose imports have not all come
waits there. When a file comes, or comes anew, it is parsed with all that waited for it and all that import it, directly or through
others, so any order of arrival ends in the same entities and edges. Only names are looked at for that; contents are
read of the files that a batch concerns. A batch that is run again writes the same log, and finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import entities
from ..operators import store as stores
from ..session import cut
from ..sources import linkml


def ingest_batch(store: stores.Store, files: DataFrame, batch: int) -> DataFrame:
    """Insert the schemas of a batch of files (path, content), and those that depend on them; a row of counts for each label. Files that can't
    be parsed, and those that wait for imports, are left out, each with ``path`` and ``error``. Batches are numbered, and the last file of a path counts."""
    spark, log = store.spark, f"{store.path}/files"
    names = linkml.import_names(files)
    files.join(names, "path").write.mode("overwrite").parquet(f"{log}/batch={batch}")
    every = spark.read.schema("path string, content string, stem string, imports array<string>, batch long").parquet(log)
    now = cut(every.groupBy("path").agg(F.max_by(F.struct("batch", "stem", "imports"), "batch").alias("x")).select("path", "x.*"))
    edges = cut(linkml.import_edges(now))
    through = entities.ancestors(edges.where("target IS NOT NULL").select(F.col("path").alias("node"), F.col("target").alias("parent")))
    those = lambda rows: rows.unionByName(through.join(rows.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("path"))).distinct()
    waiting = cut(those(edges.where("target IS NULL").select("path").distinct()))
    touched = those(now.where(F.col("batch") == batch).select("path"))
    ready = cut(touched.join(waiting, "path", "left_anti"))
    needed = ready.unionByName(through.join(ready.select(F.col("path").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("path"))).distinct()
    contents = every.join(now.select("path", "batch"), ["path", "batch"]).join(needed, "path", "left_semi").select("path", "content").persist()
    elements = linkml.parse(linkml.with_imports(contents).join(ready, "path", "left_semi"))
    done = stores.insert_all(store, elements)
    late = touched.join(waiting, "path", "left_semi").join(now, "path").select(F.col("stem").alias("label"), "path", F.lit("waits for its imports").alias("error"))
    return done.unionByName(late, allowMissingColumns=True)


def watch(spark: SparkSession, folder: str, store: stores.Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that ingests each new file of ``folder`` once; one stream for a store, as its batches number the log."""
    files = spark.readStream.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    writer = files.writeStream.foreachBatch(lambda rows, batch: ingest_batch(store, rows, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
