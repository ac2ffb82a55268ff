"""Files that converters read: of bounded size in queries, and JSON parsed as JSON."""

import json

import pytest
import yaml

import __spark_entry__ as entry
from vocabra.plans import catalogue
from vocabra.sources import converters


@pytest.mark.parametrize("name", ["bids_slots", "nwb_slots", "dandi_slots", "openminds_slots", "aind_slots", "converted_slots"])
def test_more_parts_are_more_files(spark, tmp_path, monkeypatch, name):
    parts = [(k, f"part {k}", f"Brand#{k % 2}", "Tin") for k in (*range(0, 40), *range(100_000, 100_040), 10**9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    seen, whole = [], converters.bodies
    monkeypatch.setattr(converters, "bodies", lambda files: seen.append(files) or whole(files))
    got = entry.queries()[name](spark, str(tmp_path)).select("slot", "class").collect()
    assert len(got) == len({r.slot for r in got}) == len(parts)
    sizes = [r.content.count("Tin") for r in seen[0].collect()]
    assert sum(sizes) == len(parts) and max(sizes) <= 20
    assert catalogue._PER_FILE <= 100_000


def test_json_equals_yaml_and_needs_no_yaml(monkeypatch):
    text = json.dumps({"a": [1, -2.5, 1.5e300, True, None, "é😀", "2020-01-01", "1e5", "<<"], "b": {"": 10**30, "x": "\t"}, "a2": {}})
    text = text[:-1] + ', "e": [1e5, 1E-7, 1.5e3, 1.5e+3, 2.50, -0.0, 0], "b": 3}'
    want = json.dumps(list(yaml.load_all(text, converters._Text)))
    assert json.dumps(converters._documents(text)) == want
    for other in ("", "a: 1\n---\nb: [x, 1e5, .nan]\n", "{a: 1, 'b': NaN}", '{"a": NaN}'):
        assert repr(converters._documents(other)) == repr(list(yaml.load_all(other, converters._Text)))
    monkeypatch.setattr(yaml, "load_all", None)
    assert converters._documents(text)
