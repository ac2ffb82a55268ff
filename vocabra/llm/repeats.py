"""Operator 4: quality rules over repeated passages, by suffix arrays.

All texts of a slice get one suffix array over their words, built by prefix doubling in which only suffixes that still
share a prefix are sorted again. The document is part of a suffix's first key, so repeats are found inside documents
only. The longest-common-prefix values of neighbours give, for each word, the longest repeated string that starts there;
those that the string of the word before does not hold already are the maximal repeats. Their spans are united.

A document fails if it has under ``min_words`` words, if repeats of ``min_repeat`` words or more cover over
``max_covered`` percent of its words, or if its longest repeat has over ``long_repeat`` words and over ``max_longest``
percent of its words. Null or empty texts have no words and fail. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, per_slice, table, texts_of, unused

#: A repeat at two places apart covers twice its length, so the share of the longest one is well below half of the other.
MIN_WORDS, MIN_REPEAT, MAX_COVERED, LONG_REPEAT, MAX_LONGEST = 10, 5, 20, 50, 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no code point, and white space.
NO_CHARACTER = bytes(range(0x80, 0xC0)) + SPACES


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of word codes in which a suffix stops at ``ends`` (of its document, exclusive, per word), and the
    common prefix lengths of each entry and the one before it."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ends * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.copy()], 1
    while True:
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, n])
        open_ = np.repeat(sizes > 1, sizes)
        if not open_.any():
            break
        slots = np.flatnonzero(open_)  # places of the array whose suffixes still share a prefix of h words
        at = order[slots]
        after = np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[slots] = at
        group = rank[at]
        new[slots] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[at] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2
        levels.append(rank.copy())
    lcp = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    t = np.flatnonzero(levels[0][left] == levels[0][right])  # the others have nothing in common
    left, right, got = left[t], right[t], np.zeros(len(t), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(left, right) + got < ends[np.maximum(left, right)]
        inside &= np.minimum(left, right) + got < ends[left]
        i, j = np.minimum(left + got, n - 1), np.minimum(right + got, n - 1)
        got += np.where(inside & (levels[k][i] == levels[k][j]), 1 << k, 0)
    lcp[t + 1] = got
    return order, lcp


def repeated(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: is it in a repeat of ``least`` words or more; the length of the maximal repeat that starts there."""
    order, lcp = suffix_array(codes, ends)
    n = len(codes)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if n else 0
    longest[longest < least] = 0
    held = np.r_[False, (ends[1:] == ends[:-1]) & (longest[:-1] == longest[1:] + 1)] if n else np.zeros(0, bool)
    starts = np.flatnonzero((longest > 0) & ~held)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + longest[starts], -1)
    return np.cumsum(edge)[:n] > 0, np.where(held, 0, longest)


def measures(texts: list[bytes], least: int = MIN_REPEAT) -> dict[str, list[int] | np.ndarray]:
    """The measures of each text, by name."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    number = defaultdict(count().__next__)
    codes = np.fromiter((number[w] for words in split for w in words), np.int64, int(counts.sum()))
    ends = np.repeat(np.cumsum(counts), counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    inside, longest = repeated(codes, ends, least)
    longest_of = np.zeros(len(texts), np.int64)
    np.maximum.at(longest_of, doc, longest)
    lines = [0] * len(texts)
    for k, t in enumerate(texts):
        if b"\n" in t:
            own = [x for x in t.split(b"\n") if x.strip()]
            lines[k] = len(own) - len(set(own))
    return {
        "n_words": counts,
        "word_chars": [len(t.translate(None, NO_CHARACTER)) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(doc[inside], minlength=len(texts)),
        "longest_repeat": longest_of,
    }


def _judged(docs: DataFrame, text: str, min_repeat: int, names: list[str]) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept`` under these names."""
    made = names[: len(MEASURES)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measures(texts_of(batch, text), min_repeat)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=[*batch.schema.names, *made])

    out = per_slice(docs, text, work, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in made)]))
    col = {m: F.col(n) for m, n in zip(MEASURES, names)}
    base_failed = (col["n_words"] < MIN_WORDS) | (100 * col["n_repeat_words"] > MAX_COVERED * col["n_words"])
    long = (col["longest_repeat"] > LONG_REPEAT) & (100 * col["longest_repeat"] > MAX_LONGEST * col["n_words"])
    return out.withColumns({names[-2]: base_failed, names[-1]: ~base_failed & ~long})


def judge(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to the columns of ``docs``, in place of columns of these names; a map
    without a shuffle."""
    names = [*MEASURES, "base_failed", "kept"]
    return _judged(docs.drop(*(c for c in docs.columns if c.lower() in names)), text, min_repeat, names)


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns, whatever those are called."""
    names = unused(docs, *MEASURES, "base_failed", "kept")
    return _judged(docs, text, MIN_REPEAT, names).where(F.col(names[-1])).select(docs.columns)


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     k AS (SELECT r, k, array_to_string(w[k:k + 4], ' ') AS win FROM d, unnest(range(1, len(w) - 3)) AS t(k)),
     twice AS (SELECT r, win FROM k GROUP BY r, win HAVING count(*) > 1),
     words AS (SELECT r, count(DISTINCT p) AS n FROM k JOIN twice USING (r, win), unnest(range(k, k + 5)) AS t(p) GROUP BY r),
     pairs AS (SELECT a.r, a.k, a.k - b.k AS gap FROM k a JOIN k b ON a.r = b.r AND a.win = b.win AND a.k > b.k),
     runs AS (SELECT r, gap, k - row_number() OVER (PARTITION BY r, gap ORDER BY k) AS run FROM pairs),
     longest AS (SELECT r, max(n) + 4 AS n FROM (SELECT r, count(*) AS n FROM runs GROUP BY r, gap, run) GROUP BY r),
     lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
     m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
                  coalesce(words.n, 0) AS n_repeat_words, coalesce(longest.n, 0) AS longest_repeat
           FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN longest USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (longest_repeat > 50 AND 100 * longest_repeat > 5 * n_words) AS kept
FROM m
"""
