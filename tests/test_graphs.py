"""JSON-LD documents cut at record borders, over many blocks of a file."""

import json

from vocabra.sources import graphs

ODD = ['}', '{"a": [', 'x"}]', "\\", '\\"', "line\nnew", "é}漢", '"@graph": [', ""]


def member(i):
    return {"@id": f"n:{i}", "text": ODD[i % len(ODD)] * (i % 4 + 1), "in": {"list": [{"k": ODD[(i + 3) % len(ODD)]}, [], {}], "@graph": [{"deep": i}]}, "n": i}


def test_records_of_any_cut(spark, tmp_path):
    context = {"@context": {"a": {"@id": "x}"}, "b": [{"c": "]"}]}}
    docs = {
        "long": context | {"@graph": [member(i) for i in range(400)], "after": [{"no": 1}], "more": {"no": {}}},
        "empty": context | {"@graph": []}, "none": context, "one": {"@graph": [{}]},
        "closed": {"@graph": [], "x": [{"y": 1}]}, "plain": {"@graph": [1, "]"], "x": [{"y": 1}]}, "tail": {"@graph": [{"a": "]"}, 5], "x": [{"y": 1}]},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.jsonld").write_text(json.dumps(doc, ensure_ascii=name == "one", indent=2 if name == "one" else None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = graphs.records(spark, str(tmp_path)).collect()
        tasks = graphs.pieces(spark, str(tmp_path / "long.jsonld")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 10
    got = {}
    for r in sorted(found, key=lambda r: r.pos):
        got.setdefault(r.file.rsplit("/", 1)[1].removesuffix(".jsonld"), []).append(json.loads(r.record))
    assert got == {"long": docs["long"]["@graph"], "one": [{}], "tail": [{"a": "]"}]}
    assert sorted(r.pos for r in found if "long" in r.file) == list(range(400))
