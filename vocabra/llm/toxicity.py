"""Operator 6: toxicity by Levenshtein automata over a lexicon trie.

A lexicon of words and word beginnings is learned from labelled texts: those that stand in toxic texts far more often
than chance allows for so many candidates. The lexicon is a trie; its intersection with the Levenshtein automata of
the words of a text is made a deterministic automaton step by step, as words need it, so that most words leave it after
a few letters. A letter too many, missing, other or swapped with the next is an edit, the first letter's included; terms
of five letters or more may have one and those of ten or more two. Signs inside a word are letters of it here. Each hit
is weighed by its context: a window with quotation marks, or with a mark and a cue, makes it count as quoted, which
weighs less. Cues are words learned from the windows of hits in clean texts, and a few words of reporting. A logistic
model over a few sums of hits gives the score.

The model is fitted on at most ``SAMPLE`` labelled ids, those with the smallest hashes; an id with both labels has none,
and of the texts of one id the first in order counts. Ids held out (crc32, modulo 5, is 0) never take part. Null or empty
texts have no hits and get the score of no hits. Without labelled rows, or with one kind only, all scores are 0. Repeated
rows are scored alike. Words of over 40 bytes, as scripts without spaces have, are no candidates for the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORDS_ONLY, cut, held_out, map_batches, per_slice, sliced, table, texts_of

#: Labelled rows to fit on, at most. They bound the lexicon and the cues too, of which each must stand in many of their texts.
SAMPLE = 20_000
BEGINNINGS = range(4, 10)
WINDOW, QUOTED = 8, 0.4
#: Letters of a term for one edit, and for two.
EDITS = (5, 10)
#: Windows that a cue of quotation must stand in.
CUE_LEAST = 8
#: Words with signs inside, and those signs.
_MIXED = re.compile(rb"[0-9a-z\x80-\xff]+(?:[!@$*#+.-][0-9a-z\x80-\xff]+)+")
_SIGNS = re.compile(rb"[a-z\x80-\xff][!@$*#+][a-z\x80-\xff]")
#: Words of reporting, in the languages of the corpus.
REPORTING = frozenset(b"said says quote quoted quotes wrote called calls sagte zitat zitiert schrieb dijo cita escribi dit citation".split())
FEATURES = ("weight", "hits", "kinds", "fuzzy")


def _may(term: bytes) -> int:
    """Edits that a term may have."""
    return sum(len(term) >= n for n in EDITS)


class TermAutomaton:
    """Lazily determinised automaton of all terms and of what is a few edits away from the longer ones."""

    def __init__(self, terms: dict[bytes, tuple[float, bool]], cues: frozenset[bytes] = REPORTING):
        self.terms, self.cues = list(terms.items()), cues
        self.child: list[dict[int, int]] = [{}]
        self.end: list[int] = [-1]
        self.may: list[int] = [0]  # edits of the longest term that goes on from here
        for k, (term, _) in enumerate(self.terms):
            node = 0
            for c in term:
                self.may[node] = max(self.may[node], _may(term))
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                    self.may.append(0)
                node = self.child[node][c]
            self.may[node] = max(self.may[node], _may(term))
            self.end[node] = k
        self._reset()

    def _reset(self) -> None:
        start: dict[tuple[int, int], int] = {}
        self._add(start, 0, -1, 0)
        first = frozenset(start.items())
        self.number, self.sets = {first: 0}, [first]
        self.arcs: list[dict[int, int]] = [{}]
        self.sticky: list[tuple[int, int]] = [(-1, 0)]  # the beginning that a state has passed, and its edits
        self.whole: list[tuple[int, int]] = [(-1, 0)]
        self.words: dict[bytes, tuple[int, int]] = {}

    def _add(self, after: dict, node: int, want: int, edits: int) -> None:
        """Put a place into a set: a node, the letter that must come next after a swap (or -1), and the edits so far."""
        if edits > self.may[node] or after.get((node, want), 9) <= edits:
            return
        after[node, want] = edits
        if want < 0:
            for n in self.child[node].values():  # a letter of the term is missing
                self._add(after, n, -1, edits + 1)

    def _step(self, state: int, c: int) -> int:
        """The next state, or -1 where no term is left."""
        after: dict[tuple[int, int], int] = {}
        for (node, want), edits in self.sets[state]:
            if want >= 0:
                if c == want:
                    self._add(after, node, -1, edits)
                continue
            if c in self.child[node]:
                self._add(after, self.child[node][c], -1, edits)
            if edits < self.may[node]:
                self._add(after, node, -1, edits + 1)  # a letter too many
                for letter, n in self.child[node].items():
                    self._add(after, n, -1, edits + 1)  # another letter
                    if c in self.child[n]:
                        self._add(after, self.child[n][c], letter, edits + 1)  # two letters swapped
        if not after:
            return -1
        key = frozenset(after.items())
        new = self.number.get(key)
        if new is None:
            new = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.arcs.append({})
            ends = sorted((e, self.end[n]) for (n, want), e in key if want < 0 and self.end[n] >= 0 and e <= _may(self.terms[self.end[n]][0]))
            begins = [(k, e) for e, k in ends if self.terms[k][1][1]]
            self.sticky.append(begins[0] if begins else (-1, 0))
            self.whole.append((ends[0][1], ends[0][0]) if ends else (-1, 0))
        return new

    def find(self, word: bytes) -> tuple[int, int]:
        """The term that a word is or begins with, or -1, and the edits between them."""
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.words) > 200_000 or len(self.sets) > 50_000:
            self._reset()
        state, begun = 0, (-1, 0)
        for c in word:
            there = self.arcs[state].get(c)
            if there is None:
                there = self.arcs[state][c] = self._step(state, c)
            if there < 0:
                state = -1
                break
            state = there
            here = self.sticky[state]
            if here[0] >= 0 and (begun[0] < 0 or here[1] < begun[1]):
                begun = here
                if not here[1]:
                    break
        found = begun
        if state >= 0 and self.whole[state][0] >= 0 and (begun[0] < 0 or self.whole[state][1] < begun[1]):
            found = self.whole[state]
        if len(word) <= 40:
            self.words[word] = found
        return found

    def features(self, text: bytes) -> list[float]:
        """Sums over the hits of a text: weights by context, hits, kinds of terms, and logarithms keep long texts level."""
        words = text.translate(WORDS_ONLY).split()
        find = self.find
        hits = [(k, x) for k, x in enumerate(map(find, words)) if x[0] >= 0] + self._mixed(text)
        if not hits:
            return [0.0] * len(FEATURES)
        quoted = self._quoted(text, words, [k for k, _ in hits])
        exact = [(x[0], QUOTED if q else 1.0) for (_, x), q in zip(hits, quoted, strict=True) if not x[1]]
        weight = sum(self.terms[t][1][0] * q for t, q in exact)
        fuzzy = sum(q for (_, x), q in zip(hits, (QUOTED if q else 1.0 for q in quoted), strict=True) if x[1])
        return [math.log1p(max(weight, 0.0)), math.log1p(sum(q for _, q in exact)), math.log1p(len({t for t, _ in exact})), math.log1p(fuzzy)]

    def _mixed(self, text: bytes) -> list[tuple[int, tuple[int, int]]]:
        """Hits of words with signs inside that are none without: place of the first part, and what was found."""
        lower = text.translate(LOWER)
        if not _SIGNS.search(lower):
            return []
        out, place, done = [], 0, 0
        for m in _MIXED.finditer(lower):
            place += len(lower[done : m.start()].translate(WORDS_ONLY).split())
            done = m.start()
            found = self.find(m[0])
            if found[1] and all(self.find(part)[0] < 0 for part in m[0].translate(WORDS_ONLY).split()):
                out.append((place, found))
        return out

    def windows(self, text: bytes) -> list[set[bytes]]:
        """The words around each exact hit of a text."""
        words = text.translate(WORDS_ONLY).split()
        at = [k for k, x in enumerate(map(self.find, words)) if x[0] >= 0 and not x[1]]
        return [set(words[max(0, k - WINDOW) : k] + words[k + 1 : k + WINDOW + 1]) for k in at]

    def _quoted(self, text: bytes, words: list[bytes], at: list[int]) -> list[bool]:
        """For each hit: is it reported speech? An odd number of quotation marks stands before it and one closes it near by, or
        a cue stands in its window together with a mark."""
        marks = [0]  # quotation marks before each word
        if not any(m in text for m in (b'"', b"\xe2\x80\x9c", b"\xe2\x80\x9e", b"\xc2\xab")):
            return [False] * len(at)
        data = text.translate(LOWER).replace("“".encode(), b'"').replace("”".encode(), b'"').replace("„".encode(), b'"').replace("«".encode(), b'"').replace("»".encode(), b'"')
        count = 0
        for piece in data.replace(b'"', b' "" ').split():
            if piece == b'""':
                count += 1
            else:
                marks += [count] * len(piece.translate(WORDS_ONLY).split())
        marks = marks[1:] or [0]
        out = []
        for k in at:
            lo, hi = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
            here = marks[min(k, len(marks) - 1)]
            inside = here % 2 == 1 and marks[min(hi, len(marks)) - 1] > here
            near = marks[min(hi, len(marks)) - 1] > marks[min(lo, len(marks) - 1)]
            out.append(inside or near and not self.cues.isdisjoint(words[lo:hi]))
        return out


def _candidates(sample: DataFrame) -> DataFrame:
    """term, begins, toxic and clean texts that hold it: of all words and beginnings of the sampled texts."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_())]
            columns += [pa.array([counts[k][y] for k in keys], pa.int64()) for y in (1, 0)]
            return pa.RecordBatch.from_arrays(columns, names=["term", "begins", "toxic", "clean"])

        for batch in sliced(batches, "text"):
            for t, y in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in t.translate(WORDS_ONLY).split() if 3 <= len(w) <= 40}
                for key in {(w, False) for w in words} | {(w[:n], True) for w in words for n in BEGINNINGS if len(w) > n}:
                    if key not in counts:
                        counts[key] = [0, 0]
                    counts[key][y] += 1
            if len(counts) > 400_000:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    parts = map_batches(sample, run, "term binary, begins boolean, toxic long, clean long")
    return parts.groupBy("term", "begins").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> dict[bytes, tuple[float, bool]]:
    """Term to (log-odds, is a beginning): all terms whose gain chance hardly gives."""
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    counts = cut(_candidates(sample))
    rate, n = bad / (bad + good), F.col("toxic") + F.col("clean")
    p = F.col("toxic") / n
    part = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(0.0)
    gain = 2 * n * (part(p, rate) + part(1 - p, 1 - rate))
    least = 2 * math.log(max(counts.count(), 2)) + 4  # so that chance gives hardly one term
    likely = counts.withColumn("gain", gain).where((p > rate) & (F.col("gain") >= least) & (p >= 0.6))
    found: dict[bytes, tuple[float, bool]] = {}
    beginnings: set[bytes] = set()
    texts: dict[bytes, int] = {}
    for r in likely.orderBy(F.desc("gain"), F.desc(F.length("term")), "begins", "term").collect():  # as many as the sample supports
        term = bytes(r.term)
        covered = any(term[:k] in beginnings for k in range(1, len(term) + 1))
        # a beginning that hardly occurs but in a term found before
        idle = r.begins and any(f.startswith(term) and r.toxic + r.clean <= 1.2 * n for f, n in texts.items())
        if not covered and not idle:
            texts[term] = r.toxic + r.clean
            found[term] = (math.log((r.toxic + 0.5) / (bad + 1)) - math.log((r.clean + 0.5) / (good + 1)), r.begins)
            if r.begins:
                beginnings.add(term)
    return found


def learn_cues(sample: DataFrame, lexicon) -> frozenset[bytes]:
    """Words that stand around exact hits in clean texts far more often than in toxic ones, and REPORTING."""

    def run(batches):
        automaton, counts = TermAutomaton(lexicon.value), {}
        for batch in sliced(batches, "text"):
            for t, y in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
                for window in automaton.windows(t):
                    for w in window:
                        counts.setdefault(w, [0, 0])[y] += 1
        columns = [pa.array(counts, pa.binary()), *(pa.array([n[y] for n in counts.values()], pa.int64()) for y in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic"])

    counts = map_batches(sample, run, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    likely = counts.where((F.col("clean") >= CUE_LEAST) & (F.col("clean") >= 9 * F.col("toxic")))
    found = likely.select("word").collect()  # as many as the sample supports
    return REPORTING | {bytes(r.word) for r in found}


def _features(docs: DataFrame, lexicon, cues: frozenset[bytes]) -> DataFrame:
    """The columns of ``docs`` but its text, and the features."""
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])
    made: list[TermAutomaton] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(TermAutomaton(lexicon.value, cues))
        rows = [made[0].features(t) for t in texts_of(batch, "text")]
        columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=schema.names)

    return per_slice(docs, "text", work, schema)


def fit(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic model, the constant first."""
    x = np.c_[np.ones(len(features)), features]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (toxic - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 5) -> DataFrame:
    """id, held_out, score and predicted of each row of ``docs``; a map over the texts once the model is fitted."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = labels.select(F.col(doc_id).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id", mod))
    sure = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    chosen = sure.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = own.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = cut(rows.select("text", "toxic"))
    terms = learn_lexicon(sample)
    lexicon = docs.sparkSession.sparkContext.broadcast(terms)
    held = held_out("id", mod).alias("held_out")
    if not terms:
        return own.select("id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    cues = learn_cues(sample, lexicon)
    rows = _features(sample, lexicon, cues).collect()  # SAMPLE rows at most
    w = fit(np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r.toxic for r in rows], float))
    z = sum((F.lit(float(v)) * F.col(f) for f, v in zip(FEATURES, w[1:], strict=True)), F.lit(float(w[0])))
    out = _features(own, lexicon, cues).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
