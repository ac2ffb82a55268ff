"""Archives against plain records: round trips, borders inside payloads, revisits, odd rows."""

import base64
import hashlib
import random

import pytest

from vocabra.llm import warc


def row(key, payload, uri="http://a/"):
    return (key, payload, uri)


@pytest.fixture(scope="module")
def rows():
    nested = warc.BORDER + "1\r\nWARC-Type: response\r\nWARC-Source-Key: 99\r\nContent-Length: 3\r\n\r\nabc"
    return [
        (1, "same"), (2, "same"), (7, "same"), (7, "same"), (3, None), (4, ""), (5, "x" + nested + warc.END), (6, "x" + nested + warc.END), (8, warc.BORDER), (9, warc.BORDER), (10, "é\r\n\r\nWARC/1"), (None, "same"),
        (11, "long " * 400_000), (12, warc.END), (13, nested * 3 + warc.BORDER), (14, "7"), (15, "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (None, "own"), (None, "own"), (-3, "\n"),
    ]


@pytest.fixture(scope="module")
def pages(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc"))
    uris = [None, "", "http://a/\r\nWARC-Type: x", "http://b/é"]
    spark.createDataFrame([(k, uris[i % 4], h, "t", 1) for i, (k, h) in enumerate(rows)], "page_id long, url string, html string, record_type string, n int").repartition(3).write.parquet(f"{at}/pages.parquet")
    return at


def plain(rows):
    out = []
    for k, h in rows:
        data = (h or "").encode()
        keys = [x for x, y in rows if (y or "").encode() == data]
        top = max((x for x in keys if x is not None), default=None)
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if k == top else "revisit", None if k == top else top))
    return sorted(map(repr, out))


def test_query_equals_plain_rows(spark, pages, rows):
    got = warc.query(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def test_archives_are_read_back_whole(spark, rows, tmp_path):
    at = str(tmp_path / "a")
    warc.archived(spark.createDataFrame([(k, (h or "").encode(), "u") for k, h in rows], "key long, payload binary, uri string").coalesce(2), at)
    got = warc.read(spark, at).collect()
    assert sorted((r.key or "", bytes(r.payload)) for r in got) == sorted(("" if k is None else str(k), (h or "").encode()) for k, h in rows)
    assert all(r.payload_bytes == len(r.payload) and r.uri == "u" and r.type == "response" for r in got)


def test_revisits_have_fresh_heads_and_no_payload(spark, rows, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.archived(spark.createDataFrame([(k, (h or "").encode(), "http://a/\r\nx") for k, h in rows if k is not None], "key long, payload binary, uri string"), a)
    warc.dedup(spark, a, b)
    before, after = {r.record_id for r in warc.read(spark, a).collect()}, warc.read(spark, b).collect()
    assert not before & {r.record_id for r in after} and all(r.uri == "http://a/%0D%0Ax" for r in after)
    assert all((r.payload is None) == (r.type == "revisit") == (r.refers_to is not None) for r in after)
    assert {r.refers_to for r in after if r.refers_to} <= {r.record_id for r in after if r.type == "response"}
    text = "".join(r.value for r in spark.read.text(b, wholetext=True).collect())
    assert text.startswith("WARC/1.1\r\nWARC-Type: ") and text.endswith(warc.END) and warc.PROFILE in text
    c = str(tmp_path / "c")  # once more: revisits refer to the new responses
    warc.dedup(spark, b, c)
    say = lambda at: sorted(map(repr, warc.resolved(warc.read(spark, at)).select("key", "type", "payload_bytes", "digest", "original").collect()))
    assert say(b) == say(c) and not {r.record_id for r in after} & {r.record_id for r in warc.read(spark, c).collect()}


def test_small_payloads_stay_where_a_least_size_is_set(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.archived(spark.createDataFrame([(k, b"four", None) for k in range(5)], "key long, payload binary, uri string"), a)
    warc.dedup(spark, a, b, min_bytes=5)
    assert {r.type for r in warc.read(spark, b).collect()} == {"response"}


def test_uncompressed_and_foreign_files(spark, tmp_path):
    parts = [f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: u{k}\r\ncontent-length: {len(body)}\r\n\r\n{body}" for k, (kind, body) in enumerate([("warcinfo", "software: x"), ("response", "HTTP/1.1 200 OK\r\n\r\npay"), ("response", "HTTP/1.1 200 OK\r\n\r\n")])]
    (tmp_path / "x.warc").write_bytes((warc.END.join(parts) + warc.END).encode())
    assert sorted((r.uri, bytes(r.payload)) for r in warc.read(spark, str(tmp_path / "x.warc")).collect()) == [("u1", b"pay"), ("u2", b"")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.query(spark, str(tmp_path)).count() == 0


def test_a_payload_is_hashed_once_and_an_archive_passed_once_for_its_heads(spark, tmp_path, monkeypatch):
    """each five digits took the hash anew, and each archive was read once more to find out whether a payload holds a border."""
    texts = [(k, "u", random.Random(k).randbytes(60_000).hex()) for k in range(60)]
    spark.createDataFrame(texts, "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    monkeypatch.setattr(warc, "folder", lambda _: f"{tmp_path}/out")
    read_so_far = lambda: spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file").getLong("bytesRead")
    before = read_so_far()
    assert warc.query(spark, f"{tmp_path}/in").where("record_type = 'response'").count() == 60
    spent = read_so_far() - before
    size = sum(f.stat().st_size for f in (tmp_path / "out" / "crawled").glob("part-*"))
    assert 3 <= spent / size < 4  # heads, rows to write, heads of what was written
    plan = warc.read(spark, f"{tmp_path}/out/crawled")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1


def test_borders_in_payloads_of_one_file_leave_other_files_as_they_are(spark, tmp_path):
    nested = f"{warc.BORDER}1\r\nWARC-Type: response\r\nWARC-Source-Key: no number\r\nContent-Length: 3\r\n\r\nabc"
    data = [(k, f"a{k % 4}".encode(), "u") for k in range(8)] + [(k, f"{nested}{k % 2}".encode(), "u") for k in range(8, 12)]
    frame = spark.createDataFrame(data, "key long, payload binary, uri string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.archived(frame.repartitionByRange(3, "key"), a)
    warc.dedup(spark, a, b)
    heads, every = warc.opened(spark, b)
    got = {(r.key, r.type, r.original) for r in warc.resolved(heads).collect()}
    assert got == {(str(k), *(("response", None) if k in (4, 5, 6, 7, 10, 11) else ("revisit", str(k + (4 if k < 4 else 2))))) for k in range(12)}
    assert sorted(bytes(r.payload) for r in every.where("type = 'response'").collect()) == sorted({p for _, p, _ in data})


def test_lengths_that_are_no_numbers(spark, tmp_path):
    says = ["3 ", "", "x3", "-3", "3.0", "+3", "99999999999999999999"]
    parts = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u{k}\r\nContent-Length: {n}\r\n\r\nabc" for k, n in enumerate(says)]
    for k, part in enumerate(parts):
        (tmp_path / f"{k}.warc").write_bytes((part + warc.END).encode())
    assert [r.uri for r in warc.read(spark, str(tmp_path)).collect()] == ["u0"]


def test_records_without_payload_at_the_end_of_the_readers_buffer(spark, tmp_path):
    """A border behind an empty payload was passed over where the buffer of 65,536 bytes ended in it, and the record behind it was lost."""
    record = lambda k, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Source-Key: {k}\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    bare, http = record(1, "HTTP/1.1 200 OK\r\n\r\n"), "HTTP/1.1 200 OK\r\n\r\n"
    for k in range(20):  # the second record's end, with its END, comes 0 to 19 bytes before the buffer's
        fill = 65_536 + 4 - k - len(bare) - len(warc.END)
        size = next(n for n in range(fill) if len(record(0, http + "x" * n)) == fill)
        for name, payload in (("a", "x" * size), ("b", (warc.END + "WARC/1.1\r\nContent-Length: 0\r\n\r\n").ljust(size, "x"))):
            (tmp_path / f"{name}{k}.warc").write_bytes((warc.END.join([record(0, http + payload), bare, record(2, http + "last")]) + warc.END).encode())
    got = sorted((r.key, bytes(r.payload)[-4:]) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == sorted([("0", b"xxxx"), ("1", b""), ("2", b"last")] * 40)
