"""Tries against plain ones made of tuples, and against SQL; strides of any length give the same."""

import random
import zlib
from collections import defaultdict

import brute
import duckdb
import pytest

from vocabra.llm import trie


def plain(talks):
    """Rows of the trie of {id: [(role, text)]}."""
    made = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = talks.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(brute.words(node[-1][1])) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * words
    return sorted(repr((
        min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node],
        brute.sha(",".join(str(c) for c in sorted(cs) if len(made[c]) == len(node))))) for node, cs in members.items())


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def read(spark, talks, path):
    rows = [(c, t, *turn, "k") for c, turns in talks.items() for t, turn in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `key` string").write.parquet(f"{path}/conversations.parquet")
    return trie.query(spark, str(path))


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    out = {c: [(rng.choice("ua"), rng.choice(["", "a", "a b", "c d e", f"{c}"])) for _ in range(rng.randint(1, 7))] for c in rng.sample(range(400), 150)}
    deep = [("u", f"turn {k} of many") for k in range(40)]
    out |= {1000 + c: deep[: 20 + c] + [("a", str(c))] * (c % 3) for c in range(30)} | {2000 + c: deep for c in range(25)} | {3000 + c: [("u", "same")] for c in range(40)}
    return out


@pytest.mark.parametrize("stride", [32, 8])
def test_equals_plain_tries(spark, talks, tmp_path, monkeypatch, stride):
    monkeypatch.setattr(trie, "STRIDE", stride)
    assert rows_of(read(spark, talks, tmp_path)) == plain(talks)


def test_one_conversation(spark, tmp_path):
    talks = {21: [("u", "a b"), ("a", "c")]}
    assert rows_of(read(spark, talks, tmp_path)) == plain(talks)


def test_turnless_conversations(spark, tmp_path):
    """A first turn alone that the hash takes away, and a family without its first."""
    talks = {c: [("u", "x")] for c in range(21, 40)}
    assert rows_of(read(spark, talks, tmp_path)) == plain(talks) and "None" in plain(talks)[0]


def test_odd_rows_equal_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, 1, 2, 3]), rng.choice([None, "", "u", "ü"]), rng.choice([None, "", " \n", "é", "w " * 30_000, "1:u"]), 1) for c in [*range(-45, 60), None] for _ in range(rng.randint(1, 4))]
    spark.createDataFrame(rows + rows[:40], "conv_id long, turn long, role string, text string, d int").write.parquet(f"{tmp_path}/conversations.parquet")
    df = trie.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({trie.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie.query(spark, str(tmp_path)).count() == 0
