"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The automaton's states are the classes of word strings that end at the same places of the normalised items. Training
words stream through it; the state and the length of the longest match that ends at a word tell at once which words lie
in a window of an item (``window`` consecutive words, or a whole shorter item) and which items hold that window.

Items of up to ``BLOCK_BYTES`` make one automaton, which is broadcast and goes over all documents. More are dealt into
blocks of that size by hash, and a document goes only to the blocks it may have a window of: hashes of all windows of the
items are joined with those of the documents, thinned by a Bloom filter of fixed size, and each block's automaton then
reads its own candidates. Neither the items nor the documents pass through the driver.

Null texts have no words; items without words match nothing. Repeated items keep their own ids; repeated documents are
judged alike. With an empty item table every document is clean.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORDS_ONLY, cut, map_batches, per_slice, sliced, table, texts_of, unused

#: Item text in a block, in bytes; an automaton takes some 40 times as much in a worker.
BLOCK_BYTES = 1 << 19
#: Bits of the filter of window hashes, a power of two, in rows of FILTER_ROW.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 14
#: Candidates of a block that one task reads.
PER_TASK = 5_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same words in whole texts.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORDS_ONLY).split()


class ItemAutomaton:
    """Suffix automaton of the word sequences of some items; sequences never run together."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)] for _, text in items]
        for words in sequences:
            state = 0
            for w in words:
                state = self._extend(state, w)
        self.shortest = min((min(len(s), window) for s in sequences if s), default=window)
        #: Items that hold the window which ends in a state, and the length of the longest whole short item there.
        self.held: list[set[int]] = [set() for _ in self.next]
        self.whole = [0] * len(self.next)
        for n, words in enumerate(sequences):
            for end in range(window, len(words) + 1):
                self.held[self._state_of(words[end - window : end])].add(n)
            if 0 < len(words) < window:
                state = self._state_of(words)
                self.held[state].add(n)
                self.whole[state] = len(words)
        #: From each state, over its suffix links: the states whose windows end with it.
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.ends[self.link[state]]
            self.ends[state] = (state, *above) if self.held[state] else above

    def _extend(self, last: int, w: int) -> int:
        """The state of the string of ``last`` and ``w``; strings that several items share end in one state."""
        there = self.next[last].get(w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new = self._state(self.length[last] + 1, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            there = self.next[last][w]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        return new

    def _split(self, last: int, w: int, there: int) -> int:
        new = self._state(self.length[last] + 1, dict(self.next[there]))
        self.link[new], self.link[there] = self.link[there], new
        while last >= 0 and self.next[last].get(w) == there:
            self.next[last][w] = new
            last = self.link[last]
        return new

    def _state(self, length: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _state_of(self, words: list[int]) -> int:
        """The state of the class that holds the string, whether or not it is the class's longest."""
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words that are hit (ends exclusive, in order, apart) and the items whose windows occur."""
        window, arcs, link, length, ends, whole = self.window, self.next, self.link, self.length, self.ends, self.whole
        spans: list[list[int]] = []
        found: set[int] = set()
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = matched = 0
                continue
            there = arcs[state].get(w)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = arcs[state].get(w)
            if there is None:
                continue
            state, matched = there, matched + 1
            if ends[state]:
                start = i + 1
                for s in ends[state]:
                    # a window has the same length wherever it ends, but a class holds shorter strings too
                    n = whole[s] if whole[s] else window
                    if matched >= n:
                        found.add(s)
                        start = min(start, i + 1 - n)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], {n for s in found for n in self.held[s]}


SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

#: (items, window, automaton) that this worker process used last.
_made: list = [None, None, None]


def _automaton(items: list[tuple[str, bytes]], window: int) -> ItemAutomaton:
    if _made[0] is not items or _made[1] != window:
        _made[:] = items, window, ItemAutomaton(items, window)
    return _made[2]


def _matched(automaton: ItemAutomaton, words: list[bytes]) -> tuple[list[dict], list[str]]:
    spans, numbers = automaton.match(words)
    return [{"start": a, "end": b} for a, b in spans], sorted({automaton.ids[n] for n in numbers})


def _window_hashes(words: list[bytes], n: int, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if len(known) > 200_000:
        known.clear()
    codes = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    mixed = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B185EBCA87) + codes[k : len(words) - n + 1 + k]
    return mixed ^ (mixed >> np.uint64(32))


def _hashed(df: DataFrame, columns: str, sizes: list[int] | None, window: int, bits=None) -> DataFrame:
    """The hashes of the windows of ``text``, beside ``columns`` (name and type): of an item its own windows, with ``sizes`` all
    runs of so many words that the filter ``bits`` lets through."""
    name = columns.split()[0]

    def run(batches):
        known: dict[bytes, int] = {}
        table_ = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in sliced(batches, "text"):
            keys, hashes = [], []
            for k, data in enumerate(texts_of(batch, "text")):
                words = words_of(data)
                for n in sizes or ([min(window, len(words))] if words else []):
                    h = np.unique(_window_hashes(words, n, known))
                    if table_ is not None:
                        at = h & np.uint64(FILTER_BITS - 1)
                        h = h[(table_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    keys.append(np.full(len(h), k))
                    hashes.append(h)
            own = batch.column(name).take(pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            found = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([own, pa.array(found, pa.int64())], names=[name, "hash"])

    return map_batches(df, run, f"{columns}, hash long").distinct()


def _filter(windows: DataFrame) -> bytes:
    """A Bloom filter of the hashes, of FILTER_BITS whatever their number; a row of it is made at a time."""
    slot = F.shiftrightunsigned(F.col("hash").bitwiseAND(FILTER_BITS - 1), FILTER_ROW.bit_length() - 1)

    def row(group: pa.Table) -> pa.Table:
        flags = np.zeros(FILTER_ROW, np.uint8)
        flags[group.column("hash").to_numpy() & (FILTER_ROW - 1)] = 1
        return pa.table({"slot": pa.array([group.column("slot")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    rows = windows.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).alias("hash")).distinct().withColumn("slot", slot.cast("long"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.groupBy("slot").applyInArrow(row, "slot long, bits binary").toLocalIterator():
        out[r.slot * FILTER_ROW // 8 : (r.slot + 1) * FILTER_ROW // 8] = r.bits
    return bytes(out)


def _routed(docs: DataFrame, items: DataFrame, blocks: int, window: int, text: str) -> DataFrame:
    """key (the md5 of a text), hits and items of the texts that have windows of the items, by the blocks they may match."""
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    windows = cut(_hashed(items.select("block", "text"), "block int", None, window))
    words = F.regexp_count(F.col("text"), F.lit(WORD_PATTERN))
    sizes = sorted(r.n for r in items.select(F.least(words, F.lit(window)).alias("n")).where("n > 0").distinct().collect())  # ``window`` rows at most
    bits = docs.sparkSession.sparkContext.broadcast(_filter(windows))
    texts = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = _hashed(texts, "key binary", sizes, window, bits)
    asked = cut(found.join(windows, "hash").select("key", "block").distinct())
    tasks = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("tasks"))
    whole = texts.join(asked.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    rows = asked.join(whole, "key").join(tasks, "block").select("block", F.pmod(F.xxhash64("key"), F.col("tasks").cast("long")).cast("int").alias("task"), F.lit(True).alias("is_text"), "key", F.lit("").alias("item_id"), "text")
    own = items.join(tasks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("is_text"), F.lit(None).cast("binary").alias("key"), "item_id", "text")
    dealt = rows.unionByName(own).repartition("block", "task").sortWithinPartitions("block", "task", "is_text")

    def run(batches):
        now, block, automaton = None, [], None
        for batch in sliced(batches, "text"):
            keys, hits, ids = [], [], []
            for r in batch.to_pylist():
                if (r["block"], r["task"]) != now:
                    now, block, automaton = (r["block"], r["task"]), [], None
                if not r["is_text"]:
                    block.append((r["item_id"], (r["text"] or "").encode()))
                    continue
                automaton = automaton or ItemAutomaton(block, window)
                spans, own_ids = _matched(automaton, words_of(r["text"].encode()))
                if spans:
                    keys.append(r["key"])
                    hits.append(spans)
                    ids.append(own_ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hits, _SPANS), pa.array(ids, pa.list_(pa.string()))], names=["key", "hits", "items"])

    one = map_batches(dealt, run, f"key binary, hits {SPANS}, items array<string>")
    every = one.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order of their starts: each joins the last one or follows it
    none = F.array().cast(SPANS)
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    union = F.aggregate("hits", none, lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.get(a, F.size(a) - 1)["end"]), grown(a, s)).otherwise(F.concat(a, F.array(s))))
    return every.select("key", union.alias("hits"), "items")


def _with_words(items: DataFrame) -> DataFrame:
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.where(F.col("text").rlike(WORD_PATTERN))


def _size(items: DataFrame) -> int:
    """Blocks of the items."""
    return -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)


def _block(items: DataFrame) -> list[tuple[str, bytes]]:
    """Items of one block: BLOCK_BYTES of text at most, each with a word."""
    return [(r.item_id, r.text.encode()) for r in items.collect()]


def find(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """Add to the columns of ``docs``, in place of columns of these names: ``n_words``, ``hits`` (array of word spans, ends
    exclusive) and ``items`` (sorted ids of the items with windows in the text). Items of one block take one map over the
    documents, without a shuffle."""
    names = ["n_words", "hits", "items"]
    return _found(docs.drop(*(c for c in docs.columns if c.lower() in names)), items, window, text, names)


def _found(docs: DataFrame, items: DataFrame, window: int, text: str, names: list[str]) -> DataFrame:
    items = _with_words(items)
    blocks = _size(items)
    if blocks > 1:
        key, hits, ids = unused(docs, "key", "found_hits", "found_items")
        routed = _routed(docs, items, blocks, window, text).toDF(key, hits, ids)
        joined = docs.join(routed, F.unhex(F.md5(F.col(text).cast("binary"))) == F.col(key), "left")
        none = F.array().cast(SPANS), F.array().cast("array<string>")
        n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
        return joined.select(*docs.columns, n_words.alias(names[0]), F.coalesce(hits, none[0]).alias(names[1]), F.coalesce(ids, none[1]).alias(names[2]))
    block = docs.sparkSession.sparkContext.broadcast(_block(items))
    own = docs.columns
    added = T._parse_datatype_string(f"`{names[0]}` long, `{names[1]}` {SPANS}, `{names[2]}` array<string>")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(block.value, window)
        split = [words_of(data) for data in texts_of(batch, text)]
        hits, found = zip(*(_matched(automaton, words) for words in split), strict=True)
        new = [pa.array([len(w) for w in split], pa.int64()), pa.array(hits, _SPANS), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, *names])

    return per_slice(docs, text, work, T.StructType([*docs.schema.fields, *added.fields]))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words in ``spans``, from the first letter of a span to its last."""
    where = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    cuts = [(where[a][0], where[b - 1][1]) for a, b in spans]
    keeps = zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True)
    return b"".join(text[a:b] for a, b in keeps)


def _stripped(docs: DataFrame, hits: str, text: str, again=None, window: int = 10) -> DataFrame:
    """``docs`` without the words in ``hits``, and without that column; ``n_chars`` follows. With ``again``, a block of items, what
    comes to stand together as a window goes too."""
    names = [c for c in docs.columns if c != hits]
    n_chars = next((c for c in names if c.lower() == "n_chars"), None)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(text)
        spans = batch.column(hits).to_pylist()
        new, lengths = [], []
        for data, own in zip(column.to_pylist(), spans, strict=True):
            if own:
                data = data.encode()
                left = [(s["start"], s["end"]) for s in own]
                while left:
                    data = without_spans(data, left)
                    left = _automaton(again.value, window).match(words_of(data))[0] if again is not None else []
                data = data.decode()
            new.append(data)
            lengths.append(len(data) if data is not None else None)
        out = {c: batch.column(c) for c in names} | {text: pa.array(new, column.type)}
        if n_chars:
            old = batch.column(n_chars)
            changed = pa.array([bool(s) for s in spans], pa.bool_())
            out[n_chars] = pa.compute.if_else(changed, pa.array(lengths, pa.int64()).cast(old.type), old)
        return pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return per_slice(docs, text, work, T.StructType([f for f in docs.schema.fields if f.name != hits]))


def remove(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """Decontaminated documents: hit spans leave the text; a document of whose words more than ``max_coverage`` are hit
    goes whole. Columns, whatever they are called, and clean rows stay as they are; where text changes, ``n_chars``, if
    there, follows it. Where the words around a span come to stand together as a window, they are removed as well."""
    names = unused(docs, "n_words", "hits", "items")
    n_words, hits, _ = names
    found = _found(docs, items, window, text, names)
    n_hit = F.aggregate(hits, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    kept = found.where((F.size(hits) == 0) | (n_hit <= max_coverage * F.col(n_words))).select(*docs.columns, hits)
    own = _with_words(items)
    if _size(own) <= 1:
        return _stripped(kept, hits, text, docs.sparkSession.sparkContext.broadcast(_block(own)), window)
    kept = cut(kept)
    clean, left = kept.where(F.size(hits) == 0).drop(hits), kept.where(F.size(hits) > 0)
    while not left.isEmpty():  # each round takes words away
        again = cut(_found(_stripped(left, hits, text), items, window, text, names).select(*docs.columns, hits))
        clean, left = clean.unionByName(again.where(F.size(hits) == 0).drop(hits)), again.where(F.size(hits) > 0)
    return clean


def digests(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find(docs.select("doc_id", "text"), items, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def query(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT item, array_to_string(w[k:k + 9], ' ') AS win, 10 AS n FROM iw, unnest(range(1, len(w) - 8)) AS t(k) WHERE len(w) >= 10
             UNION SELECT item, array_to_string(w, ' '), len(w) FROM iw WHERE len(w) BETWEEN 1 AND 9),
     sizes AS (SELECT DISTINCT n FROM win),
     wins AS (SELECT DISTINCT win, n FROM win),
     d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     occ AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
     hit AS (SELECT r, k, n, win FROM occ JOIN wins USING (win, n)),
     words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY r),
     found AS (SELECT DISTINCT r, item FROM hit JOIN win USING (win, n)),
     ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
