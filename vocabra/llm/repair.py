"""Operator 11: least repairs of conversations, by layers of cost over the states of a small automaton.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. Edits keep a turn, give it another role, delete it, or
insert an empty one. For each place between turns there is a layer per cost, a bitset of the states of the automaton from
which the rest can be repaired for that much or less. A layer follows from the cheaper ones behind the next turn; the first
layer that holds the start is the least cost, and a walk from there takes the first edit in ASCII order that stays on a least
path. Layers begin where a state appears and end where all four are in, a dozen at most, so a place takes one small value, and
what a turn does to it is remembered: time and memory are linear in the turns.

Turns are dealt by conversation three times, first as short codes, then with their texts. A conversation is never held whole:
codes stream backwards in blocks of BLOCK turns, which leaves each block with the layers behind it, and then blocks and texts
stream forwards together, a block's edits known before its texts come.

Turns of one conversation stand by turn (nulls first), then role and text, which matters for equal turns only. Null roles and
texts are one space. An empty role has no initial: like a strange one it must be given another role or be deleted. Rows that
repeat all of a row are duplicates. Null conversation ids are one conversation. Without rows a conversation has zeros and an
empty audit; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, table

#: Turns whose codes are one row.
BLOCK = 1 << 14

BLANKS = r"\x20\x09-\x0D"
#: A turn's code: its initial (s, u, a or another) and its first fault (none, truncated, blank, duplicate) as one character.
INITIALS, FAULTS = "suao", "-tbd"
_CODES = {chr(65 + 4 * i + f): (INITIALS[i], FAULTS[f]) for i in range(4) for f in range(4)}

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A repaired conversation ends in 0 or 3.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_ENDS = 0b1001
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3


def _given(state: int) -> tuple[int, str]:
    """The state and the role that an inserted or changed turn leads to; only one is possible anywhere."""
    return (3, "assistant") if state == 2 else (2, "user")


Layers = tuple[int, ...]  # bitsets of states for each cost from the first on; each holds the one before, the last all four


def _closed(base: int, exact: dict[int, int]) -> tuple[int, Layers]:
    """Layers of all costs from states per cost, with insertions."""
    cost, seen, out = base, 0, []
    while seen != 0b1111:
        seen |= exact.get(cost, 0)
        if cost - base >= INSERT:
            cheaper = out[cost - base - INSERT]
            seen |= sum(1 << s for s in range(4) if cheaper >> _given(s)[0] & 1)
        out.append(seen)
        cost += 1
    first = next(k for k, states in enumerate(out) if states)
    return base + first, tuple(out[first:])


@cache
def _before(code: str, behind: Layers) -> tuple[int, Layers]:
    """Layers before a turn, from those behind it; the cost at which they begin counts from that of the others."""
    initial, fault = _CODES[code]
    exact: dict[int, int] = {}
    last = len(behind) - 1
    for cost in range(last + 1 + DELETE + 1):
        states = 0
        if 0 <= (k := cost - DELETE):
            states |= behind[min(k, last)]
        if fault in "-t":
            extra = TRUNCATED if fault == "t" else 0
            if 0 <= (k := cost - extra - KEEP):
                states |= sum(1 << s for s in range(4) if (t := _NEXT.get((initial, s))) is not None and behind[min(k, last)] >> t & 1)
            if 0 <= (k := cost - extra - REROLE):
                states |= sum(1 << s for s in range(4) if behind[min(k, last)] >> _given(s)[0] & 1)
        exact[cost] = states
    return _closed(0, exact)


#: Layers behind the last turn.
_BASE, END = _closed(0, {0: _ENDS})


def _cost(layers: Layers, state: int) -> int:
    return next(k for k, states in enumerate(layers) if states >> state & 1)


def backwards(codes: str, behind: Layers) -> tuple[int, list[tuple[int, Layers]]]:
    """The cost at which the layers before all turns begin, counted from those behind them, and for each place (the first is before the
    first turn, the last behind the last) the cost at which its layers begin, counted from the next, with the layers."""
    out, total = [(0, behind)], 0
    for code in reversed(codes):
        shift, behind = _before(code, behind)
        total += shift
        out.append((shift, behind))
    out.reverse()
    return total, out


@cache
def _edits(code: str, shift: int, layers: Layers, behind: Layers, state: int) -> tuple[str, int]:
    """The edits up to and with that of a turn, first in ASCII order among the cheapest, and the state behind it."""
    initial, fault = _CODES[code]
    extra = TRUNCATED if fault == "t" else 0
    left = _cost(layers, state) + shift  # counted from where the layers behind begin
    done = ""
    while True:
        if DELETE + _cost(behind, state) == left:
            return done + "D", state
        to = _given(state)[0]
        if INSERT + _cost(layers, to) + shift == left:
            done, state, left = done + "I", to, left - INSERT
            continue
        if fault in "-t":
            kept = _NEXT.get((initial, state))
            if kept is not None and KEEP + extra + _cost(behind, kept) == left:
                return done + "K", kept
            if REROLE + extra + _cost(behind, to) == left:
                return done + "R", to
        raise AssertionError("no edit is on a least path")


def forwards(codes: str, behind: Layers, state: int) -> tuple[list[str], int]:
    """For each turn of a block its edits, and the state behind the block."""
    _, places = backwards(codes, behind)
    out = []
    for code, (shift, layers), (_, then) in zip(codes, places, places[1:], strict=False):
        edits, state = _edits(code, shift, layers, then, state)
        out.append(edits)
    return out, state


def _tail(state: int) -> str:
    """Insertions behind the last turn."""
    return "" if _ENDS >> state & 1 else "I" * (_cost(END, state) // INSERT)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows conv, turn, role and text with faults put in by a hash of id and turn, and ``gone``, true where a row is dropped."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    said = F.concat(*(x for c, sep in ((conv, ":"), (turn, "")) for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(sep))))
    which = F.crc32(said.cast("binary")) % 20
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), which.alias("_which"))
    text = F.when(F.col("_which") == 1, "").when(F.col("_which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("_which") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_which")
    times = F.when(F.col("_which") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", "role", "text", (F.col("_which") == 0).alias("gone"), F.explode(times).alias("_copy")).drop("_copy")


def _codes(rows: DataFrame) -> DataFrame:
    """A row per turn without its text: conv, turn, role, digest and code."""
    bare = rows.select(
        "conv", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), 2).when(~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), 1).otherwise(0).alias("fault"),
        F.position(F.substring("role", 1, 1), F.lit("sua")).alias("at"), F.length("role").alias("_named"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy("turn")) > 1
    bare = bare.withColumn("_again", again)
    fault = F.when(F.col("fault") == 2, 2).when(F.col("_again"), 3).otherwise(F.col("fault"))
    # the first of equal texts is the first in the order of turns, as equal rows follow each other there
    initial = F.when((F.col("_named") > 0) & (F.col("at") > 0), F.col("at") - 1).otherwise(3)
    return bare.select("conv", "turn", "role", "digest", "_again", F.chr((65 + 4 * initial + fault).cast("long")).alias("code"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row per block of turns: their codes, the place of the first, and what gaps are counted from."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "digest", "_again")
    placed = _codes(rows).withColumns({"n": (F.row_number().over(order) - 1).cast("long"), "_new": F.when(F.col("turn").isNull(), 0).otherwise((~F.col("turn").eqNullSafe(F.lag("turn").over(order))).cast("int"))})
    entry = F.struct("n", "code")
    return placed.groupBy("conv", F.floor(F.col("n") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["code"]), "").alias("codes"),
        F.min(F.struct("n", "turn", "role", "digest")).alias("first"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("_new").alias("turns"),
    )


def _with_layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come from the last of a conversation to its first; each leaves with the layers behind it, and the first with the cost."""
    conv, behind, begins = object(), END, _BASE
    for batch in batches:
        layers, costs = [], []
        for c, block, codes in zip(*(batch.column(k).to_pylist() for k in ("conv", "block", "codes")), strict=True):
            if c != conv:
                conv, behind, begins = c, END, _BASE
            layers.append(bytes(behind))
            shift, places = backwards(codes, behind)
            behind = places[0][1]
            begins += shift
            costs.append(begins + _cost(behind, 0) if block == 0 else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layers, pa.binary()), pa.array(costs, pa.int64())], names=[*batch.schema.names, "layers", "cost"])


class _Row:
    """Counts of one conversation as its blocks and texts pass by."""

    def __init__(self, conv):
        self.conv, self.cost, self.state, self.turns, self.low, self.high, self.any = conv, 0, 0, 0, None, None, False
        self.faults, self.illegal, self.last, self.audit, self.due, self.digest, self.said = dict.fromkeys(FAULTS, 0), 0, "", [], [], hashlib.sha256(), False
        self.at, self.written = 0, 0

    def block(self, codes: str, layers: bytes, cost, low, high, turns) -> None:
        self.any = True
        edits, after = forwards(codes, tuple(layers), self.state)
        self.due = self.due[self.at :] + edits
        self.at, self.state = 0, after
        self.audit += edits
        self.cost += cost or 0
        self.turns += turns
        lows, highs = [x for x in (self.low, low) if x is not None], [x for x in (self.high, high) if x is not None]
        self.low, self.high = min(lows, default=None), max(highs, default=None)
        for code, n in ((c, codes.count(c)) for c in set(codes)):
            self.faults[_CODES[code][1]] += n
        line = self.last + "".join(_CODES[c][0] for c in codes)
        self.illegal += sum(line[k : k + 2] not in ("su", "ua", "au") for k in range(len(line) - 1))
        self.last = line[-1]

    def say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.said else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.said = True

    def given(self, text: str) -> None:
        self.written, role = _given(self.written)
        self.say(role, text)

    def turn(self, role: str, text: str) -> None:
        edits = self.due[self.at]
        self.at += 1
        for _ in edits[:-1]:
            self.given("")
        if edits[-1] == "K":
            self.written = _NEXT[role[0], self.written]
            self.say(role, text)
        elif edits[-1] == "R":
            self.given(text)

    def result(self) -> tuple:
        tail = _tail(self.state) if self.any else ""
        for _ in tail:
            self.given("")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit) + tail, self.digest.hexdigest())


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation of damaged rows (as damage() gives them): conv, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256."""
    there = rows.where(~F.col("gone"))
    blocks = cut(_blocks(there))
    fields = T.StructType([*blocks.schema.fields, T.StructField("layers", T.BinaryType()), T.StructField("cost", T.LongType())])
    blocks = map_batches(blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block")), _with_layers, fields)
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    kinds = dict(blocks.dtypes) | dict(there.dtypes)
    own = there.select("conv", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.lit(2).alias("kind"), none("block"), "text", *map(none, ("codes", "layers", "cost", "low", "high", "turns")))
    with_codes = blocks.select("conv", "first.turn", "first.role", "first.digest", F.lit(1).alias("kind"), "block", F.lit("").alias("text"), "codes", "layers", "cost", "low", "high", "turns")
    heads = rows.select("conv").distinct().select("conv", none("turn"), none("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"), none("block"), none("text"), *map(none, ("codes", "layers", "cost", "low", "high", "turns")))
    stream = heads.unionByName(with_codes).unionByName(own).repartition("conv").sortWithinPartitions("conv", F.col("kind") > 0, "turn", "role", "digest", "kind", "block")
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(_OUT).fields])
    columns = ("conv", "kind", "role", "text", "codes", "layers", "cost", "low", "high", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, kind_of = None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns_ = list(zip(*done, strict=True))
            types = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, types, strict=True)], names=schema.names)

        for batch in batches:
            kind_of, done = batch.schema.field("conv").type, []
            for conv, kind, role, text, codes, layers, cost, low, high, turns in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if kind == 0:
                    if row is not None:
                        done.append(row.result())
                    row = _Row(conv)
                elif kind == 1:
                    row.block(codes, layers, cost, low, high, turns)
                else:
                    row.turn(role, text)
            if done:
                yield batch_of(done)
        if row is not None:
            yield batch_of([row.result()])

    return map_batches(stream.select(*columns), run, schema)


def query(spark, sf_dir):
    rows = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repaired(rows).withColumnRenamed("conv", "conv_id")


# crc32 of the characters of a text of ASCII, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda y, _: xor(y >> 1, 3988292384::BIGINT * (y & 1)))))"""
_BLANK_SQL = r"[\x20\x09-\x0D]"
#: The whole operator as a shortest path over turns: the cheapest, then least, audit for each state behind each turn.
ORACLE_SQL = rf"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS w FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role, CASE w WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, c
      FROM k, unnest(CASE w WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS u(c)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), c) AS i, substr(role, 1, 1) AS initial FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
f AS (SELECT *, CASE WHEN regexp_full_match(text, '{_BLANK_SQL}*') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?]{_BLANK_SQL}*\z') THEN 't' ELSE '' END AS fault FROM g),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
      count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
m (q, ins, q2, said) AS (VALUES (0, '', 0, []::VARCHAR[]), (1, '', 1, []), (2, '', 2, []), (3, '', 3, []), (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (3, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']),
      (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:']), (3, 'II', 3, ['user:', 'assistant:']), (2, 'II', 2, ['assistant:', 'user:'])),
e (op, initial, q, next, cost, name) AS (VALUES ('D', NULL, 0, 0, 4, NULL), ('D', NULL, 1, 1, 4, NULL), ('D', NULL, 2, 2, 4, NULL), ('D', NULL, 3, 3, 4, NULL),
      ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
      ('R', NULL, 0, 2, 3, 'user'), ('R', NULL, 1, 2, 3, 'user'), ('R', NULL, 3, 2, 3, 'user'), ('R', NULL, 2, 3, 3, 'assistant')),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM counts
  UNION ALL
  SELECT * FROM (
    SELECT s.conv_id, f.i, e.next AS q, s.cost + 3 * length(m.ins) + e.cost + CASE WHEN f.fault = 't' AND e.op <> 'D' THEN 3 ELSE 0 END AS cost, s.audit || m.ins || e.op AS audit,
           list_concat(s.said, m.said, CASE WHEN e.op = 'D' THEN [] ELSE [coalesce(e.name, f.role) || ':' || f.text] END) AS said
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN m ON m.q = s.q JOIN e ON e.q = m.q2 AND (e.initial IS NULL OR e.initial = f.initial) AND (e.op = 'D' OR f.fault IN ('', 't')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
best AS (SELECT s.conv_id, s.cost + 3 * length(m.ins) AS cost, s.audit || m.ins AS audit, list_concat(s.said, m.said) AS said
      FROM s JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN m ON m.q = s.q AND m.q2 IN (0, 3) QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 3 * length(m.ins), s.audit || m.ins) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""
