"""Streams of schemas that import each other, in any order of arrival."""

from vocabra.operators import store
from vocabra.streaming import ingest

BASE = "id: b\nname: base\nslots:\n  name: {range: string}\nclasses:\n  Thing: {slots: [name]}\n"
MIDDLE = "id: m\nname: middle\nimports: [linkml:types, base]\nslots:\n  size: {range: float}\n"
TOP = "id: t\nname: top\nimports: [middle]\nclasses:\n  Box: {is_a: Thing, slots: [size]}\n"
TEXTS = {"base": BASE, "middle": MIDDLE, "top": TOP}


def content(db):
    drop = {"id", "had_primary_source", "generated_at_time", "created_at", "yml_path"}
    return {n: sorted(map(repr, db.read(n).drop(*drop).collect())) for n in ("class", "property", "has_property", "subclass_of")}


def frame(spark, *names, texts=TEXTS):
    return spark.createDataFrame([(f"/in/{n}.yml", texts[n]) for n in names], "path string, content string")


def test_any_order_of_arrival_ends_in_the_same(spark, tmp_path):
    ends = []
    for k, batches in enumerate([[("base", "middle", "top")], *([(x,) for x in order] for order in (("top", "middle", "base"),))]):
        db = store.Store(spark, str(tmp_path / str(k)))
        for n, names in enumerate(batches):
            rows = {r.label: r for r in ingest.ingest_batch(db, frame(spark, *names), n).collect()}
            if k == 1 and n < 2:
                assert rows["top"].error == "waits for its imports" and db.read("class").count() == 0
        assert not any(r.error for r in rows.values()) and set(rows) == set(TEXTS)
        ends.append(content(db))
    assert ends[0] == ends[1] and len(ends[0]["class"]) == 2 and len(ends[0]["subclass_of"]) == 1


def test_what_imports_a_changed_file_is_parsed_again(spark, tmp_path):
    db = store.Store(spark, str(tmp_path))
    ingest.ingest_batch(db, frame(spark, *TEXTS), 0)
    before = content(db)
    changed = {"base": BASE.replace("range: string", "range: integer")}
    rows = {r.label: r for r in ingest.ingest_batch(db, frame(spark, "base", texts=changed), 1).collect()}
    assert set(rows) == set(TEXTS) and rows["top"].classes_new + rows["base"].classes_new + rows["middle"].classes_new == 2
    after = content(db)
    assert len(after["class"]) == 4 and set(before["class"]) < set(after["class"])
    ingest.ingest_batch(db, frame(spark, "base", texts=changed), 1)  # again, as after a failure
    assert content(db) == after


def test_a_stream_waits_for_imports(spark, tmp_path):
    folder, db = tmp_path / "in", store.Store(spark, str(tmp_path / "db"))
    folder.mkdir()
    for names in (("top",), ("middle", "base")):
        for n in names:
            (folder / f"{n}.yml").write_text(TEXTS[n])
        query = ingest.watch(spark, str(folder), db, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    assert {r.name for r in db.read("class").collect()} == {"Thing", "Box"}


