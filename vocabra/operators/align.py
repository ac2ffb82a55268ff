"""Alignment of classes that share a concept IRI."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut

#: Classes of one IRI that a task holds of each side, about.
BLOCK = 1000
#: Pairs that a task makes, about, up to so many tasks as one driver keeps well.
PAIRS, TASKS = 1_000_000, 20_000


def _with_iri(classes: DataFrame, *carried: str) -> DataFrame:
    """hash_id, concept_uri and the carried columns of classes with a hash and an IRI."""
    return classes.select("hash_id", S.or_empty(F.col("concept_uri")).alias("concept_uri"), *carried).where("concept_uri <> '' AND hash_id IS NOT NULL")


def _ordered(both: DataFrame, carried: tuple[str, ...], *more: Column) -> DataFrame:
    """a, b and concept_uri of rows with the classes ``x`` and ``y``, and each carried column of both (c_a, c_b)."""
    first = F.col("x.hash_id") < F.col("y.hash_id")
    of = lambda c, own, other: F.when(first, F.col(f"{own}.{c}")).otherwise(F.col(f"{other}.{c}"))
    return both.select(
        of("hash_id", "x", "y").alias("a"), of("hash_id", "y", "x").alias("b"), "concept_uri",
        *(of(c, *sides).alias(f"{c}_{end}") for c in carried for end, sides in (("a", ("x", "y")), ("b", ("y", "x")))), *more,
    )


def pairs(classes: DataFrame, *carried: str) -> DataFrame:
    """a, b and concept_uri of all pairs of rows with one IRI whose hashes differ, and each carried column of both (c_a, c_b). An empty IRI
    pairs nothing. Rows are paired as they come, repeats too.

    The classes of an IRI are dealt into blocks of about BLOCK, and the triangle of all pairs of blocks is the join's key, so that an IRI
    of any size is many keys. The keys go to as many tasks as PAIRS asks for: what a task makes does not grow with the table. The number
    of tasks is said to Spark, which else puts the few bytes that come in together in a task or two."""
    known = _with_iri(classes, *carried)
    sizes = known.groupBy("concept_uri").agg(F.count(F.lit(1)).alias("n"))
    every = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0  # one number
    tasks = min(max(1, math.ceil(every / PAIRS)), TASKS)
    blocks = sizes.select("concept_uri", F.ceil(F.col("n") / BLOCK).alias("blocks")).where("blocks > 1")
    dealt = known.join(blocks, "concept_uri", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("hash_id"), F.col("blocks")))
    row, key = F.struct("hash_id", *carried), ["concept_uri", "i", "j"]
    x = dealt.select("concept_uri", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), row.alias("x"))
    y = dealt.select("concept_uri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("i"), F.col("own").alias("j"), row.alias("y"))
    both = x.repartition(tasks, *key).join(y.repartition(tasks, *key), key)
    return _ordered(both.where((F.col("i") < F.col("j")) | (F.col("x.hash_id") < F.col("y.hash_id"))), carried)


def exact_pairs(classes: DataFrame) -> DataFrame:
    """a, b and concept_uri of all unordered pairs of classes with one IRI, within a source as well. An empty IRI pairs nothing."""
    return pairs(classes.select("hash_id", "concept_uri").distinct())


def pairs_of(some: DataFrame, classes: DataFrame, *carried: str) -> DataFrame:
    """As pairs(), those of some classes with all, and ``src`` and ``dst``: the class of ``some`` and the other one. Where ``some`` are few, so is
    the work: all classes are read once and no other pair is made."""
    row = F.struct("hash_id", *carried)
    x, y = _with_iri(some, *carried).select("concept_uri", row.alias("x")), _with_iri(classes, *carried).select("concept_uri", row.alias("y"))
    both = x.join(y, "concept_uri").where(F.col("x.hash_id") != F.col("y.hash_id"))
    return _ordered(both, carried, F.col("x.hash_id").alias("src"), F.col("y.hash_id").alias("dst"))


def nearest_after(classes: DataFrame, distance: Column, *carried: str) -> DataFrame:
    """a, b and distance: for each class the nearest of those with its IRI whose hashes come after, the first by hash of equal ones.
    ``distance`` is of the columns that pairs() gives for the carried ones.

    Pairs are made twice and never kept or sorted: the least distance of each class is a number that a hash map holds, and of all pairs only
    those that have it go on."""
    least = cut(pairs(classes, *carried).groupBy("a").agg(F.min(distance).alias("_least")))  # a row per class
    held = classes.join(least.withColumnRenamed("a", "hash_id"), "hash_id", "left")
    ties = pairs(held, *carried, "_least").withColumn("distance", distance).where(F.col("distance").eqNullSafe(F.col("_least_a")))
    return ties.groupBy("a").agg(F.min("b").alias("b"), F.first("distance").alias("distance"))


def concept_groups(classes: DataFrame) -> DataFrame:
    """hash_id, concept_uri, ``representative`` (the least hash with that IRI) and ``links`` (exact pairs it is in) of each class with an
    IRI: what exact_pairs() says, in a row per class, for IRIs that many classes share."""
    known = classes.select("hash_id", S.or_empty(F.col("concept_uri")).alias("concept_uri")).where("concept_uri <> ''").distinct()
    groups = known.groupBy("concept_uri").agg(F.min("hash_id").alias("representative"), (F.count(F.lit(1)) - 1).alias("links"))
    return known.join(groups, "concept_uri").select("hash_id", "concept_uri", "representative", "links")


def exact_edges(classes: DataFrame, registry_version: str = "") -> DataFrame:
    """The edges of exact pairs, both ways."""
    pairs = exact_pairs(classes)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.select(
        "src", "dst", F.lit(0.0).alias("distance"), F.lit("iri").alias("method"), F.lit("exactMatch").alias("skos_relation"),
        F.lit(1.0).alias("score_iri"), *(F.lit(0.0).alias(f"score_{k}") for k in ("name", "desc", "slot")), F.lit(registry_version).alias("registry_version"),
    )


def upsert_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """``new``, and those of ``old`` whose keys it does not have; edges of pairs that no longer match stay."""
    return old.join(new, list(keys), "left_anti").unionByName(new)
