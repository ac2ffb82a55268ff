"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that go to a Python worker at a time, and text that one call of a per-batch function gets, at most (a single longer
#: text is a batch of its own).
SLICE_BYTES = 2 << 20

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: LOWER, and every byte that is not a letter, a digit or part of a non-ASCII character becomes a space.
WORDS_ONLY = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about SLICE_BYTES of ``column`` at most."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if held and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    col = batch.column(column)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def held_out(doc_id: str, mod: int):
    """Column: crc32 of the id as text, modulo ``mod``, is 0. A null id is its empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == 0


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from being a column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def checked_dir(spark: SparkSession) -> None:
    """Checkpoints need the shared folder that spark.checkpoint.dir names. Only where all of Spark is one process, as in tests,
    a folder of this machine stands in for one that is not named."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="vocabra-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)


def tidy(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles that nothing refers to when the driver's JVM collects garbage; long jobs with small
    drivers would keep them all until the end, so that is asked for here."""
    gc.collect()  # query objects here keep their plans there
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checked_dir(spark := df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    tidy(spark)
    return out


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, where the session does not have smaller ones: rows may be long."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not conf.get(key).rstrip("b").isdigit() or int(conf.get(key).rstrip("b")) > SLICE_BYTES:
        conf.set(key, str(SLICE_BYTES))
    return df.mapInArrow(run, schema)


def per_slice(df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Run ``work`` over bounded Arrow slices of ``df``; a map without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield work(batch)

    return map_batches(df, run, schema)
