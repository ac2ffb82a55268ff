"""Operator 8: line dedup over range-partitioned hashes, with DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased. Its hash, the document and the position of
every line are written once, range-partitioned by hash and document and sorted by position within those, so that a line
which stands in a third of all documents is dealt over many partitions. A window streams over that order, without
another shuffle or sort, and marks the first occurrence of each line in each document; documents per line are counts of
first occurrences, summed from partial counts. What comes out is a keep bitmap per document, compressed as runs of dropped
lines, and no text.

Null or empty texts are one empty line. Rows that have id and text in common are one document and get one bitmap; rows
that have only the id in common are two. With an empty table nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

UPPER, BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased. lower() does that, and faster, where no other letter has
    a lower case of its own."""
    bare = F.btrim(line, F.lit(BLANK))
    others = bare.rlike(r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}]]")
    return F.when(others, F.translate(bare, UPPER, UPPER.lower())).otherwise(F.lower(bare))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document that loses lines: ``id``, ``text_hash`` and ``runs``, its keep bitmap as an ordered array of
    (start, n) runs of dropped lines. Lines go whose keys of ``min_chars`` code points or more stand in ``min_docs``
    documents or more; with ``keep_first`` the very first occurrence stays."""
    doc = ["id", "text_hash"]
    lines = (
        docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
        .select(*doc, "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"), *doc, "pos")
    )
    lines = cut(lines)  # hashes and places only; the sampling of ranges and the join below read them again
    ranged = lines.repartitionByRange("hash", *doc).sortWithinPartitions("hash", *doc, "pos")
    firsts = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("hash", *doc).orderBy("pos"))).where("nth = 1")
    counts = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*doc, "pos")).alias("origin"))
    frequent = cut(counts.where(F.col("docs") >= min_docs))  # written, so that both sides of the join are plain shuffles, which Spark splits where a line is frequent
    dropped = lines.join(frequent, "hash").select(*doc, "origin", "pos").distinct()  # repeated rows are one document
    if keep_first:
        dropped = dropped.where(~F.struct(*doc, "pos").eqNullSafe(F.col("origin")))
    order = Window.partitionBy(*doc).orderBy("pos")
    runs = dropped.select(*doc, "pos", (F.col("pos") - F.row_number().over(order)).alias("run")).groupBy(*doc, "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The kept lines, joined. The bitmap is unrolled into a flag per line, in time linear in the lines."""
    end = lambda k: F.coalesce(F.get(runs, k)["start"] + F.get(runs, k)["n"], F.lit(0))
    flags = F.array_join(F.transform(runs, lambda r, k: F.concat(F.repeat(F.lit("1"), r["start"] - end(k - 1)), F.repeat(F.lit("0"), r["n"]))), "")
    flags = F.split(F.rpad(flags, F.size(lines), F.lit("1")), "")
    both = F.arrays_zip(lines.alias("line"), flags.alias("flag"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["flag"] == "1"), lambda x: x["line"]), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``), ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays; null texts stay)."""
    own = docs.select(F.struct("*").alias("doc"))
    whole = F.col("doc").getField(text)
    keyed = own.select("doc", F.col("doc").getField(doc_id).alias("own_id"), F.xxhash64(whole).alias("own_hash"))
    joined = keyed.join(bitmaps, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    zero = F.lit(0).cast("long")
    n_dropped = F.coalesce(F.aggregate("runs", zero, lambda a, r: a + r["n"]), zero)
    kept = F.when(F.col("runs").isNull(), whole).otherwise(_kept(_lines(whole), F.col("runs")))
    return joined.select("doc", F.size(_lines(whole)).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` without their frequent lines; the same columns and rows. Where text changes, ``n_chars`` follows it."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, doc_id=doc_id, text=text, **limits), doc_id, text)
    new = {text: F.col("kept")}
    for c, kind in docs.dtypes:
        if c.lower() == "n_chars":
            new[c] = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("doc").getField(c)).cast(kind)
    return out.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     l AS (SELECT r, doc_id, text, t.k, string_split(text, chr(10))[t.k] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(k)),
     keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (o.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often AS o USING (key) GROUP BY r
"""
