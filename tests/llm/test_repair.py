"""Repairs against every edit sequence of short conversations, and against SQL on odd rows; blocks of any size give the same."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from vocabra.llm import repair

ROLES = {"u": "user", "a": "assistant"}


def plain(turns):
    """(cost, audit, text) by trying all edits, two insertions at a place at most. Turns are (role, text)."""
    seen, options = set(), []
    for role, text in turns:
        own = [("D", 4, "", [])]
        bare = text.strip(" \t\n\x0b\x0c\r")
        if bare and (role, text) not in seen:
            more = 0 if bare[-1] in ".!?" else 3
            own += [("K", more, role[:1] or "0", [f"{role}:{text}"])] + [("R", 3 + more, i, [f"{r}:{text}"]) for i, r in ROLES.items()]
        seen.add((role, text))
        options.append(own)
    gap = [("I" * len(x), 3 * len(x), x, [ROLES[i] + ":" for i in x]) for x in ("", "u", "a", "ua", "au")]
    best = None
    for picks in itertools.product(gap, *(x for o in options for x in (o, gap))):
        if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in picks)):
            found = (sum(p[1] for p in picks), "".join(p[0] for p in picks), "\n".join(line for p in picks for line in p[3]))
            best = min(best or found, found)
    return best


def test_equals_every_edit_sequence(spark):
    rng = random.Random(3)
    texts, roles = ["Yes.", "no", "", " \n", "What?", "Yes.", "é! \n"], ["user", "assistant", "system", "user", "assistant", "tool", " ", ""]
    talks = {c: [(rng.choice(roles), rng.choice(texts) + (f"{rng.random()}!" if rng.random() < 0.6 else "")) for _ in range(rng.randint(0, 3))] for c in range(60)}
    rows = [(c, t, *turn, False) for c, turns in talks.items() for t, turn in enumerate(turns)] + [(c, 0, "user", "x", True) for c in talks]
    got = {r.conv: r for r in repair.repaired(spark.createDataFrame(rows, "conv long, turn long, role string, text string, gone boolean")).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        cost, audit, text = plain(turns)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), turns


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("talks"))
    rng = random.Random(9)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice([None, "", "a.", "b", "c!", "x" * 50_000 + "?", f"{c} {t}."]), "k") for c in [*range(-3, 40), None] for t in range(rng.randint(1, 9))]
    rows += [(50, None, None, None, "k")] * 3 + [(51, 5, "user", "same.", "k")] * 4 + [(52, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.", "k") for t in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("block", [1 << 14, 1, 3])
def test_odd_rows_equal_sql_with_blocks_of_any_size(spark, odd, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    df = repair.query(spark, odd)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{odd}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({repair.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_long_conversations_take_linear_time():
    codes = "".join(random.Random(1).choices(list(repair._CODES), k=300_000))
    edits, state = repair.forwards(codes, repair.END, 0)
    shift, places = repair.backwards(codes, repair.END)
    assert len(edits) == len(places) - 1 == 300_000 and shift > 0 and repair._before.cache_info().currsize < 10_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.query(spark, str(tmp_path)).count() == 0
