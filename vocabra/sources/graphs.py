"""JSON-LD documents of any size, cut at the borders of their records.

Spark reads a document as the pieces between its closing braces, so that blocks of one file go to many tasks. Quotes before a piece tell
whether it begins inside a text, and brackets outside texts how deep it lies. Both are running sums: within a block by a window, and over
the blocks of a file, a row each, by another. Pieces up to the one that closes a record are put together again; no task holds more
than a block, or a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK = ["file", "block"]


def _depth(plain: Column) -> Column:
    """Brackets opened less those closed, of text without quoted parts."""
    return F.regexp_count(plain, F.lit(r"[\[{]")) - F.regexp_count(plain, F.lit(r"[\]}]"))


def _change(bare: Column, inside: bool) -> Column:
    """What a piece, and the brace behind it, add to the depth, where it begins inside or outside a text; escapes are gone from ``bare``."""
    whole = F.concat(F.lit('"'), bare) if inside else bare
    ends_inside = F.regexp_count(whole, F.lit('"')) % 2 == 1
    plain = F.regexp_replace(F.when(ends_inside, F.concat(whole, F.lit('"'))).otherwise(whole), r'"[^"]*"', "")
    return (_depth(plain) - F.when(ends_inside, 0).otherwise(1)).cast("long")


def pieces(spark: SparkSession, *paths: str) -> DataFrame:
    """file, block (where it begins), k (order in the block) and value: the texts between closing braces of the files."""
    rows = spark.read.option("lineSep", "}").text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")


def _before(blocks: DataFrame, column: str) -> Column:
    """The sum over the blocks of a file before each; a row per block."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def records(spark: SparkSession, *paths: str, field: str = "@graph") -> DataFrame:
    """file, pos and ``record`` (JSON text): the objects in the list ``field`` at the top of each document, which is one JSON object per file.
    Files without the list give none, and members of it that are no objects are left out and do not count in ``pos``."""
    in_block = Window.partitionBy(*BLOCK).orderBy("k")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    rows = pieces(spark, *paths).select("*", (F.regexp_count(bare, F.lit('"')) % 2).cast("long").alias("quotes"), _change(bare, False).alias("outer"), _change(bare, True).alias("inner"))
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    # a block that begins inside a text has the changes of its pieces swapped; both sums are made here, so that texts are dealt to blocks once
    change = lambda inside: F.when(F.col("odd") == int(inside), F.col("outer")).otherwise(F.col("inner"))
    rows = rows.withColumns({"plain": change(False), "quoted": change(True)})
    rows = cut(rows.select(*BLOCK, "k", "value", "quotes", "odd", "plain", "quoted", F.sum("plain").over(in_block).alias("plain_sum"), F.sum("quoted").over(in_block).alias("quoted_sum")))
    blocks = rows.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes"), F.sum("plain").alias("plain"), F.sum("quoted").alias("quoted"))
    blocks = blocks.select("*", (_before(blocks, "quotes") % 2).alias("inside")).withColumn("change", F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted")))
    blocks = blocks.select(*BLOCK, "inside", _before(blocks, "change").alias("start"))
    rows = rows.join(F.broadcast(blocks), BLOCK)  # a row per block, as Spark's own list of them
    of = lambda plain, quoted: F.when(F.col("inside") == 0, F.col(plain)).otherwise(F.col(quoted))
    rows = rows.withColumns({"change": of("plain", "quoted"), "sum": of("plain_sum", "quoted_sum")})
    after = F.col("start") + F.col("sum")
    rows = rows.select(*BLOCK, "k", "value", ((F.col("odd") + F.col("inside") + F.col("quotes")) % 2 == 1).alias("ends_inside"), ((F.col("odd") + F.col("inside")) % 2 == 1).alias("inside"), after.alias("depth"), (after - F.col("change")).alias("from"))
    # the list begins where its name is a key at depth 1, and ends with the first piece from there on that closes it before a member opens
    closed = lambda text: F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*("|$)', "").rlike(r"^[^\[{]*\]")
    key = rf'(?s)^(.*?)"{field}"\s*:\s*\['
    head, rest = F.regexp_extract("value", key, 1), F.regexp_replace("value", key, "")
    outside = F.regexp_replace(F.regexp_replace(head, r"\\.", ""), r'"[^"]*"', "")
    place = F.struct("block", "k")
    opens = rows.where(~F.col("inside") & (F.col("from") <= 1) & F.col("value").rlike(key) & (F.col("from") + _depth(outside) == 1)).groupBy("file").agg(F.min_by(F.struct(place.alias("first"), closed(rest).alias("closed")), place).alias("o")).where("NOT o.closed").select("file", "o.first")
    closes = rows.where(~F.col("inside") & (F.col("from") == 2) & closed(F.col("value"))).select("file", place.alias("at")).join(opens, "file").where(F.col("at") > F.col("first"))
    bounds = opens.join(closes.groupBy("file").agg(F.min("at").alias("last")), "file", "left")
    own = rows.join(F.broadcast(bounds), "file").where((place >= F.col("first")) & (F.col("last").isNull() | (place < F.col("last"))))
    ends = (~F.col("ends_inside") & (F.col("depth") == 2)).cast("long")
    own = own.select(*BLOCK, "k", F.when(place == F.col("first"), rest).otherwise(F.col("value")).alias("value"), ends.alias("ends"))
    counts = own.groupBy(*BLOCK).agg(F.sum("ends").alias("n"))
    counts = counts.select(*BLOCK, _before(counts, "n").alias("n"))
    own = own.withColumn("pos", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    whole = own.join(F.broadcast(counts), BLOCK).groupBy("file", (F.col("pos") + F.col("n")).alias("pos")).agg(F.sum("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("block", "k", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return whole.where("ends = 1").select("file", "pos", F.regexp_replace(text, r"(?s)^[^{]*", "").alias("record"))
