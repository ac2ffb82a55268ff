"""What a batch writes is seen together or not at all, and only the buckets that it falls in are read."""

import pytest
from pyspark.sql import functions as F

from vocabra.operators import store
from vocabra.sources import linkml

DROP = {"id", "had_primary_source", "generated_at_time", "created_at", "yml_path"}
ONE = "id: i\nname: one\nclasses:\n  A: {slots: [x]}\n  B: {is_a: A}\nslots:\n  x: {range: integer}\nenums:\n  E:\n    permissible_values: {p: {}, q: {}}\n"
TWO = ONE.replace("  B: {is_a: A}", "  B: {is_a: A}\n  C: {is_a: B, slots: [y]}").replace("slots:\n  x:", "slots:\n  y: {range: string}\n  x:").replace("q: {}", "q: {}, r: {}")


def elements(spark, text):
    return linkml.parse(spark.createDataFrame([("/in/one.yml", text)], "path string, content string")).cache()


def content(db):
    return {n: sorted(map(repr, db.read(n).drop(*DROP).collect())) for n in (*store.NODES, *store.EDGES)}


def test_a_failure_among_the_appends_leaves_the_old_state_and_a_repeat_completes_it(spark, tmp_path, monkeypatch):
    first, second = elements(spark, ONE), elements(spark, TWO)
    db = store.Store(spark, str(tmp_path))
    store.insert_all(db, first)
    old, written, inner = content(db), [], store.Store._write

    def fails(self, name, rows):
        written.append(name)
        inner(self, name, rows)
        if name == "has_property":
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_write", fails)
        with pytest.raises(RuntimeError, match="lost"):
            store.insert_all(db, second)
    assert {"class", "property", "provenance", "has_property"} <= set(written) and content(db) == old
    stats = store.insert_all(db, second).first()
    assert (stats.schema_version, stats.classes_new, stats.properties_new, stats.schema_unchanged) == ("1.1.0", 1, 1, False)
    assert db.read("class").count() == 3 and db.read("permissible_value").count() == 3 and db.read("subclass_of").count() == 2
    assert db.read("schema_version").count() == 2 and db.read("provenance").groupBy(*store.ATTESTED).count().where("count > 1").count() == 0


def test_readers_keep_what_they_began_with(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")
    db.append("has_property", edges(("a", "b")))
    before = db.read("has_property")
    with db.commit():
        db.append("has_property", edges(("c", "d")))
        db.append("subclass_of", edges(("e", "f")))
        assert db.read("has_property").count() == 1 and db.read("subclass_of").count() == 0
    assert db.read("has_property").count() == 2 and db.read("subclass_of").count() == 1
    db.rewrite("has_property", edges(("x", "y")))
    assert before.count() == 1 and [tuple(r) for r in db.read("has_property").collect()] == [("x", "y")]
    with pytest.raises(ZeroDivisionError), db.commit():
        db.rewrite("has_property", edges())
        raise ZeroDivisionError
    db.append("has_property", edges(("x", None), (None, "z")))  # into the batch number that failed
    assert db.read("has_property").count() == 3
    db.rewrite("has_property", edges())
    assert db.read("has_property").count() == 0 and store.write_if_new(db, "has_property", edges(("x", "y")), ["src", "dst"]) == 1


def test_a_small_batch_reads_its_buckets_alone(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    rows = spark.range(5000).select(F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("hash_id"), F.lit("n").alias("name"))
    blank = spark.createDataFrame([], store.NODES["class"])
    db.append("class", blank.unionByName(rows, allowMissingColumns=True))
    batch = rows.limit(3).unionByName(spark.createDataFrame([("sha256:new", "n")], "hash_id string, name string")).cache()
    near = db.near("class", batch)
    files = near.inputFiles()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    read = {r[0] for r in near.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= 4 < len(files)
    full = blank.unionByName(batch, allowMissingColumns=True)
    assert store.write_if_new(db, "class", full, ["hash_id"]) == 1 and store.write_if_new(db, "class", full, ["hash_id"]) == 0
    store.compact(db)
    assert db.read("class").count() == 5001 and store.write_if_new(db, "class", full, ["hash_id"]) == 0


def test_tables_of_earlier_releases_go_on(spark, tmp_path):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")
    edges(("a", "b")).write.parquet(f"{tmp_path}/has_property/v1")
    spark.createDataFrame([(1,)], "version int").write.parquet(f"{tmp_path}/has_property/pointer")
    db = store.Store(spark, str(tmp_path))
    assert store.write_if_new(db, "has_property", edges(("a", "b"), ("c", "d")), ["src", "dst"]) == 1
    assert sorted(map(tuple, db.read("has_property").collect())) == [("a", "b"), ("c", "d")]
