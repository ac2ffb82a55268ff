"""Pairs of classes: many tasks whatever Spark makes of the few bytes that come in, and no second join of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vocabra.operators import align


@pytest.fixture(scope="module")
def suppliers(spark):
    rng = random.Random(7)
    rows = [(f"s{k:03d}" if k % 11 else "same", f"n:{k % 3}" if k % 17 else None, rng.randrange(1000)) for k in range(150)] + [(None, "n:1", 5), ("z", "", 6)]
    return rows, spark.createDataFrame(rows, "hash_id string, concept_uri string, k long")


def all_pairs(rows):
    return [(a, b, iri, x, y) for a, iri, x in rows for b, other, y in rows if iri and iri == other and a and b and a < b]


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_carry_columns_and_repeat_as_rows_do(suppliers, monkeypatch, block):
    rows, df = suppliers
    monkeypatch.setattr(align, "BLOCK", block)
    assert sorted(map(tuple, align.pairs(df, "k").collect())) == sorted(all_pairs(rows))


@pytest.mark.parametrize("block", [1000, 7])
def test_nearest_of_those_after(suppliers, monkeypatch, block):
    rows, df = suppliers
    monkeypatch.setattr(align, "BLOCK", block)
    best = {}
    for a, b, _, x, y in all_pairs(rows):
        best[a] = min(best.get(a, (99.0, "")), ((x * 3 + y) % 5 / 4, b))
    got = align.nearest_after(df, (F.col("k_a") * 3 + F.col("k_b")) % 5 / 4, "k")
    assert sorted(map(tuple, got.collect())) == sorted((a, b, d) for a, (d, b) in best.items())


def test_tasks_grow_with_the_pairs(spark):
    df = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("hash_id"), (F.col("id") % 2).cast("string").alias("concept_uri"))
    found = align.exact_pairs(df).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in found) == 2 * 2000 * 1999 // 2 and len(found) > 1
    assert max(r["count"] for r in found) < 3.5e6


def test_edges_take_no_join_of_pairs(spark, monkeypatch):
    from vocabra.plans import catalogue

    plan = catalogue.skos_bands(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
