"""Texts of JSON-LD pieces are kept once and dealt to their blocks once more on the way to records."""

import json

from vocabra.sources import graphs


def test_texts_are_kept_once(spark, tmp_path, monkeypatch):
    nodes = [{"@id": str(k), "t": 'a}"[{' * (k % 4)} for k in range(300)]
    (tmp_path / "a.jsonld").write_text(json.dumps({"x": "]{[", "@graph": nodes, "more": [{}]}))
    (tmp_path / "b.jsonld").write_text(json.dumps({"@graph": nodes[:7]}))
    kept, real = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: kept.append(df) or real(df))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = graphs.records(spark, str(tmp_path))
        got = sorted((r.file[-8], r.pos, json.loads(r.record)["@id"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("a", k, str(k)) for k in range(300)] + [("b", k, str(k)) for k in range(7)])
    assert len(kept) == 1
