"""Operator 12: WARC archives whose repeated payloads are revisit records.

``write`` makes archives of record rows, ``read`` gives the rows back, and ``dedup`` writes archives anew: headers alone are
shuffled by payload digest, of the records with one payload that with the largest key stays a response, and the others
become revisit records with fresh headers and no payload. ``resolved`` joins revisit records to their original responses.

An archive is a folder of gzip files that Spark's text writer makes, each a plain sequence of WARC/1.1 records, since the two
line feeds that end a record are the writer's line separator. Reading splits at a line feed with the start of a record.
A payload that holds such a border is cut there as well; lengths tell, and the files concerned are walked from record to record
over lengths alone, so that the pieces of each record come together again.

Record rows have ``uri``, ``key`` and ``payload`` (binary). Null or empty payloads are empty ones, and null or empty URIs are not
written; line feeds in URIs are percent-encoded. Of a payload whose records repeat the largest key all with that key are responses;
null keys are the smallest, and records that all have a null key are all responses. Digests stand for payloads. An empty table gives archives without
records. Other columns of the input are left out by selecting the three.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_dir, cut, table

#: Ends a record; the writer puts it after each.
END = "\r\n\r\n"
#: Where archives are cut when they are read. No start of it comes again within it: Hadoop's reader, whose buffer may end inside a border, passes
#: over one that begins in what looked like the start of another, as END + "WARC/1." does behind an empty payload.
BORDER = "\nWARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are never deduplicated.
MIN_BYTES = 0


def base32(digits: Column) -> Column:
    """A SHA-1 of hexadecimal digits in base32: five are four digits of base 32. Make it of a column, not of the hash itself, which Spark
    would take anew for each five."""
    parts = (F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line with the line feed before it; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def _record_id(*fresh) -> Column:
    """A record id that is the same whenever a lost task runs again."""
    digits = F.md5(F.concat_ws("|", *fresh).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})", r"$1-$2-$3-$4-"), F.lit(">"))


def write(records: DataFrame, path: str, made: str) -> None:
    """Write record rows (type, uri, key, payload, payload_bytes, digest, record_id, refers_to) to a new archive; of type revisit are
    those without payload. ``made`` is the archive's own name, which its headers hold."""
    revisit = F.col("type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    size = F.octet_length(head) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    uri = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    value = F.concat(
        F.lit("WARC/1.1"), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.nullif(uri, F.lit(""))), _line("WARC-Source-Key", F.col("key").cast("string")), _line("WARC-Archive", F.lit(made)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), _line("WARC-Profile", F.when(revisit, PROFILE)), _line("WARC-Refers-To", F.col("refers_to")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"), _line("Content-Length", size.cast("string")), F.lit(END), head,
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")),
    )
    records.select(value.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Parts of files between borders, with their place, what they say of their length, and what it is. Heads end at the first
    empty line; a part without one says nothing."""
    rows = spark.read.option("lineSep", BORDER).text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("value"))
    rows = rows.withColumns({"head": F.substring_index(F.col("value").cast("string"), END, 1), "length": F.octet_length("value").cast("long")})
    # of the first such line, whatever it says: nothing but digits is a length
    size = F.regexp_extract("head", r"\r\n(?i:Content-Length:) *(?:([0-9]{1,18}) *(?![^\r\n]))?", 1)
    rows = rows.withColumn("said", F.nullif(size, F.lit("")).cast("long"))
    return rows.withColumn("needs", F.octet_length("head") + len(END) + F.col("said"))


def _field(head: Column, name: str) -> Column:
    """A header field; empty where it is not there."""
    return F.trim(F.regexp_extract(head, rf"\r\n(?i:{name}:)([^\r\n]*)", 1))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each piece, in order, ``owner``: the first piece of the record that it is part of."""
    file, left, owner = None, -1, -1
    for batch in batches:
        owners = []
        for f, n, length, needs in zip(batch.file, batch.n, batch.length, batch.needs, strict=True):
            if f != file or left < 0:
                file, owner, left = f, n, length if pd.isna(needs) else int(needs)
            left -= length + len(BORDER)  # below 0 where the record ends with this piece
            owners.append(owner)
        yield batch[["file", "block", "n"]].assign(owner=owners)


def _walked(places: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Broken files, a row each, and for each of their pieces the first one of its record; None if no file is broken.

    Pieces have END behind them, without its last line feed where a border follows. A file is walked, over lengths alone, if one of its pieces is not
    as long as it says: a record goes on until it has its length, and what lies inside is no record, whatever it looks like."""
    places = places.select("file", "block", "n", "length", "needs")
    exact = (F.col("length") - F.col("needs")).isin(len(END) - 1, len(END))
    broken = cut(places.where(~F.coalesce(exact, F.lit(False))).select("file").distinct())
    if broken.isEmpty():
        return None
    slim = places.join(broken, "file", "left_semi").repartition("file").sortWithinPartitions("file", "block", "n")
    return broken, cut(slim.mapInPandas(_walk, "file string, block long, n long, owner long"))


def _joined(pieces: DataFrame, walked: DataFrame) -> DataFrame:
    """Records of broken files: ``head``, ``said`` and ``value``, put together from their pieces."""
    parts = pieces.join(walked, ["file", "block", "n"])
    return parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "n", "head", "said", "value"))).alias("p")).select(
        F.col("p")[0]["head"].alias("head"), F.col("p")[0]["said"].alias("said"), F.array_join(F.transform("p", lambda p: p["value"].cast("string")), BORDER).cast("binary").alias("value"))


def _whole(pieces: DataFrame, found: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """``head``, ``said`` and ``value`` of whole records: most are a piece, and those of broken files are put together."""
    own = pieces if found is None else pieces.join(found[0], "file", "left_anti")
    own = own.select("head", "said", "value")
    return own if found is None else own.unionByName(_joined(pieces, found[1]))


#: No column value has more bytes.
MOST = 2**31 - 1
#: Columns of record rows that are read from an archive.
HEADS = ("type", "key", "payload_bytes", "digest", "record_id", "refers_to")
ROWS = ("type", "uri", "key", "payload", *HEADS[2:])


def _rows(whole: DataFrame, *also: str) -> DataFrame:
    """Record rows, with further columns of ``whole``; ``type`` is null in what is no record, or of another type."""
    of = lambda name: F.nullif(_field(F.col("head"), name), F.lit(""))
    size = F.when(F.col("said") > MOST, MOST).otherwise(F.col("said")).cast("int")
    body = F.substring(F.col("value"), F.octet_length("head") + len(END) + 1, size)
    rows = whole.select(
        of("WARC-Type").alias("says"), of("WARC-Target-URI").alias("uri"), of("WARC-Source-Key").alias("key"), of("WARC-Record-ID").alias("record_id"),
        of("WARC-Refers-To").alias("refers_to"), F.regexp_replace(of("WARC-Payload-Digest"), "^sha1:", "").alias("promised"), body.alias("body"), *also)
    rows = rows.withColumn("type", F.when(F.col("says").isin("response", "revisit") & F.col("body").isNotNull(), F.col("says")))
    http = F.substring_index(F.col("body").cast("string"), END, 1)
    rows = rows.withColumn("payload", F.when(F.col("type") == "response", F.substring("body", F.octet_length(http) + len(END) + 1, F.octet_length("body"))))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    return rows.withColumn("digest", F.coalesce(base32(F.col("sha1")), F.when(F.col("type") == "revisit", F.col("promised")))).select(*ROWS, *also)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of an archive: type, uri, key (text), payload, payload_bytes (of the full payload), digest (as computed here, or as a
    revisit record says), record_id and refers_to. Records of other types and parts that are no records are left out."""
    pieces = _pieces(spark, path)
    return _rows(_whole(pieces, _walked(pieces))).where("type IS NOT NULL")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Heads of an archive's records (HEADS), written, and the rows that ``read`` gives. One pass over the archive makes the heads and tells
    which files are broken; of these alone records are made in a second pass."""
    pieces, place = _pieces(spark, path), ("file", "block", "n", "length", "needs")
    seen = cut(_rows(pieces, *place).select(*HEADS, *place))
    found = _walked(seen)
    every = _rows(_whole(pieces, found)).where("type IS NOT NULL")
    heads = seen.where("type IS NOT NULL")
    if found is not None:
        broken, walked = found
        mended = cut(_rows(_joined(pieces, walked)).where("type IS NOT NULL").select(*HEADS))
        heads = heads.join(broken, "file", "left_anti").select(*HEADS).unionByName(mended)
    return heads.select(*HEADS), every


def archived(rows: DataFrame, path: str) -> None:
    """Write rows (uri, key, payload) as responses."""
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    size = F.octet_length("payload").cast("long")
    full = rows.select(F.lit("response").alias("type"), "uri", F.col("key").cast("string").alias("key"), payload.alias("payload"))
    full = full.withColumns({"payload_bytes": size, "sha1": F.sha1("payload"), "refers_to": F.lit(None).cast("string")})
    full = full.withColumn("digest", base32(F.col("sha1")))
    write(full.withColumn("record_id", _record_id(F.lit(path), "key", "digest")), path, path.rsplit("/", 1)[-1])


def dedup(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, order: str = "bigint") -> None:
    """Write the archive ``source`` to ``target`` with one response for each payload; ``order`` is the type by which keys are compared.
    Revisit records of ``source`` refer to the response that stays; those whose original is not there stay as they are. Only heads are shuffled. The records to turn into revisits are a written table: Spark sends it to all tasks if it is small, and
    shuffles the records else."""
    name = target.rsplit("/", 1)[-1]
    fresh = lambda key: _record_id(F.lit(target), F.lit("response"), key, "digest")
    heads, every = opened(spark, source)
    heads = heads.select("type", F.col("key").cast(order).alias("k"), "key", "digest", "payload_bytes")
    whole = (F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)
    shared = heads.where(whole | (F.col("type") == "revisit")).groupBy("digest").agg(F.max(F.when(whole, F.struct("k", "key")))["key"].alias("first"), F.max(whole).alias("_there"), F.count(F.lit(1)).alias("_n"))
    shared = cut(shared.where("_n > 1 AND _there"))
    again = heads.join(shared, "digest").where((F.col("type") == "revisit") | whole & ~F.col("key").eqNullSafe(F.col("first")))
    again = again.select(F.col("type").alias("_type"), F.coalesce("key", F.lit("")).alias("_key"), F.col("digest").alias("_digest"), fresh("first").alias("original")).distinct()
    again.write.parquet(f"{target}-again")  # a table of files, unlike a checkpoint, has a size that Spark knows
    again = spark.read.schema(again.schema).parquet(f"{target}-again")
    known = every.join(again, (F.col("type") == F.col("_type")) & (F.coalesce("key", F.lit("")) == F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    records = known.select(
        F.when(F.col("original").isNotNull(), "revisit").otherwise(F.col("type")).alias("type"), "uri", "key", "payload", F.coalesce("payload_bytes", F.lit(0)).alias("payload_bytes"), "digest",
        _record_id(F.lit(target), "type", "key", "digest").alias("record_id"), F.coalesce("original", "refers_to").alias("refers_to"))
    write(records, target, name)


def resolved(records: DataFrame) -> DataFrame:
    """Heads of records (key, type, payload_bytes, digest) with ``original``, the key of the response that a revisit record refers to, whose
    payload's size and digest it has; revisits of responses that are not there keep what they say, without a size."""
    own = records.select("key", "type", "payload_bytes", "digest", "record_id", "refers_to")
    there = own.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("original"), F.col("payload_bytes").alias("_bytes"), F.col("digest").alias("_digest")).dropDuplicates(["refers_to"])
    joined = own.where("type = 'revisit'").join(there, "refers_to", "left")
    return own.where("type = 'response'").select("key", "type", "payload_bytes", "digest", F.lit(None).cast("string").alias("original")).unionByName(
        joined.select("key", "type", F.col("_bytes").alias("payload_bytes"), F.coalesce("_digest", "digest").alias("digest"), "original"))


def folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    checked_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.col("page_id").alias("key"), F.col("html").cast("binary").alias("payload"))
    at = folder(spark)
    archived(pages, f"{at}/crawled")
    dedup(spark, f"{at}/crawled", f"{at}/deduplicated")
    heads, _ = opened(spark, f"{at}/deduplicated")
    kind = dict(table(spark, sf_dir, "pages").dtypes)["page_id"]
    return resolved(heads).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("original").cast(kind).alias("refers_to"),
    )


_DIGIT = f"substr('{BASE32}', CAST((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31 AS BIGINT) + 1, 1)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j: {_DIGIT}), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q
"""
