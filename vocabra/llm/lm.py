"""Operator 3: language-model scores by a weighted backoff automaton over all pairs of words.

States are contexts: the root, the start of a text, and each training word. An arc from a state is a pair of words seen in
training, however seldom; its weight is the pair's discounted share of the context plus the share of the base that its
failure arc lets through. The failure arc goes to the root and weighs what the discounts leave, so each state's
probabilities sum to one. Discounts for pairs seen once, twice and more often come from the counts of counts.

The automaton is as large as the corpus, so it lies in parts, by hash of a pair or of its rare word, and grows with the
input. Frequent words (a share of ``WORD_SHARE`` of all tokens or more: 1 / share at most, whatever the corpus) and the
arcs of frequent pairs (``ARC_SHARE``) are broadcast as well, as a cache: one left-to-right traversal of a text carries
the state, adds the weights of cached arcs, and packs what is left into one sorted block per part. A part takes the
blocks of all texts, finds its counts among those of training texts, and gives sums per text back. Nothing is pruned; a
pair has the same probability whether its arc is cached or not.

Null text counts as empty: one end token. A null id's text is empty for the split. Repeated rows are scored alike, each
one counted. With no training text no word is known and every token has the base's uniform share.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER, cut, held_out, map_batches, sliced, table, texts_of, tidy
from .packed import fields, joined, pack, runs, unpack

WORD_SHARE, ARC_SHARE, LEAST = 1e-6, 2e-6, 3
ADD = 0.1
#: The end token; no word holds a line feed.
END = b"\n"
#: Entries of a task's counter of words before it is handed on, and tokens whose pairs are packed at a time.
FLUSH, TOKENS = 400_000, 1_500_000
#: Codes of the start, of the end token, and of the first rare word of a chunk. Frequent words lie between.
START_CODE, END_CODE, RARE_CODE = 0, 1, 1 << 20
#: Words whose codes a task remembers.
MEMO = 300_000
#: Kinds of blocks: pairs of frequent words by pair; others by their rare word, which is the right or the left one.
PAIR, RIGHT, LEFT = 0, 1, 2

_TOP = np.uint64(1 << 63)


def _hash(word: bytes) -> int:
    """64 bits that are no code of a frequent word."""
    h = xxhash.xxh3_64_intdigest(word)
    return h if h >= RARE_CODE else h | 1 << 63


def _key(word: bytes) -> int:
    return _hash(word) - (1 << 63)


def _word_counts(train: DataFrame) -> DataFrame:
    """hash, n, word (null where it can't have a share of WORD_SHARE) of all training tokens."""

    def rows(counts: Counter) -> pa.RecordBatch:
        least = WORD_SHARE * sum(counts.values())  # a word below this in each part is below it in all
        return pa.RecordBatch.from_arrays(
            [
                pa.array(map(_key, counts), pa.int64()), pa.array(counts.values(), pa.int64()),
                pa.array([w if n >= least else None for w, n in counts.items()], pa.binary()),
            ],
            names=["hash", "n", "word"],
        )

    def run(batches):
        counts: Counter = Counter()
        for batch in sliced(batches, "text"):
            for t in texts_of(batch, "text"):
                counts.update(t.translate(LOWER).split())
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    parts = map_batches(train.select("text"), run, "hash long, n long, word binary")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"), F.max("word").alias("word"))


class _Codes(dict):
    """Codes of a chunk's words: those of frequent words stay, rare ones get numbers as they come."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = RARE_CODE + len(self.hashes)
        self.hashes.append(_hash(word))
        return code


class BackoffAutomaton:
    """The cached part: frequent words with their counts, failure weights and base probabilities, and arcs by pair of codes.

    ``words``: word to its training count, most frequent first; ``after``: word (None before a text's first) to the numbers
    of words seen once, twice and more often after it; ``pairs``: (left, right, count) of the arcs to hold.
    """

    def __init__(self, words: dict[bytes, int], tokens: int, kinds: int, texts: int, discounts=(0.5, 0.5, 0.5), after=None, pairs=()):
        self.tokens, self.kinds, self.discounts = tokens, kinds, np.array([0.0, *discounts])
        self.share = tokens + ADD * (kinds + 1)
        self.code = {END: END_CODE} | {w: 2 + k for k, w in enumerate(w for w in words if w != END)}
        size = 2 + len(self.code)
        self.count = np.zeros(size)  # how often a code is a context
        self.base = np.full(size, ADD / self.share)
        for w, k in self.code.items():
            self.base[k] = (words.get(w, 0) + ADD) / self.share
            self.count[k] = words.get(w, 0)
        self.known = np.zeros(size, bool)
        self.known[[self.code[w] for w, n in words.items() if n]] = True
        self.count[START_CODE], self.count[END_CODE] = texts, 0  # the end token is no context
        self.log_base = np.log10(self.base)
        self.log_base[START_CODE] = 0.0
        self.fail = np.ones(size)
        for w, numbers in (after or {}).items():
            k = START_CODE if w is None else self.code[w]
            self.fail[k] = self.weight(np.array([numbers], float), self.count[k : k + 1])[0]
        self.arcs: dict[int, float] = {}
        for left, right, n in pairs:
            a, b = START_CODE if left is None else self.code[left], self.code[right]
            self.arcs[a << 32 | b] = float(np.log10(self.seen(np.array([n]), self.count[a : a + 1]) + self.fail[a] * self.base[b])[0])

    def weight(self, numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Failure weights of contexts that came ``count`` times; 1 where a context never came."""
        return np.where(count > 0, numbers @ self.discounts[1:] / np.maximum(count, 1), 1.0)

    def seen(self, n: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The discounted share of pairs that came ``n`` times in contexts that came ``count`` times."""
        return np.where(n > 0, (n - self.discounts[np.minimum(n, 3).astype(int)]) / np.maximum(count, 1), 0.0)

    def traverse(self, codes: list[int]) -> tuple[float, list[int]]:
        """The sum of the weights of the cached arcs on a text's path, and the pairs (left << 32 | right) without one."""
        arcs, state, total, asked = self.arcs, START_CODE, 0.0, []
        for w in codes:
            pair = state << 32 | w
            arc = arcs.get(pair)
            if arc is None:
                asked.append(pair)
            else:
                total += arc
            state = w
        return total, asked


def discounts(once: int, twice: int, thrice: int, four: int) -> tuple[float, float, float]:
    """Discounts of pairs seen once, twice and more often, from the numbers of pairs seen 1 to 4 times; 0.5 where a corpus
    is too small to tell."""
    if not (once and twice):
        return 0.5, 0.5, 0.5
    y = once / (once + 2 * twice)
    found = [1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * four / thrice if thrice else 1.5]
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B185EBCA87)
    return x ^ (x >> np.uint64(29))


def _blocks(pairs: np.ndarray, doc: np.ndarray | None, hashes: list[int], parts: int):
    """(part, kind, block) of the pairs of a chunk. A block has sorted keys, the word beside each, how often it comes, and in
    which texts. The key is a pair of frequent words (left << 20 | right) or the hash of a rare word; the word beside it is
    a code or, above those, a hash."""
    rare = np.array(hashes or [0], np.uint64)
    codes = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    l_rare, r_rare = (c >= RARE_CODE for c in codes)
    left, right = (np.where(is_rare, rare[np.where(is_rare, c - np.uint64(RARE_CODE), np.uint64(0)).astype(np.int64)], c) for c, is_rare in zip(codes, (l_rare, r_rare), strict=True))
    both = ~(l_rare | r_rare)
    kinds = [(PAIR, left[both] << np.uint64(20) | right[both], None, both), (RIGHT, right[r_rare], left[r_rare], r_rare), (LEFT, left[l_rare], right[l_rare], l_rare)]
    for kind, key, other, chosen in kinds:
        part = _mixed(key) % np.uint64(parts)
        at = doc[chosen] if doc is not None else None
        if other is None:  # keys of 40 bits: one number has part and key
            both = part << np.uint64(40) | key
            if at is None:
                both.sort()
            else:
                order = np.argsort(both)
                both, at = both[order], at[order]
            part, key = both >> np.uint64(40), both & np.uint64((1 << 40) - 1)
        else:
            order = np.lexsort((other, key, part))
            part, key, other = part[order], key[order], other[order]
            at = at[order] if at is not None else None
        start, n = runs(part)
        for a, b in zip(start.tolist(), (start + n).tolist(), strict=True):
            first, count = runs(key[a:b], *([other[a:b]] if other is not None else []))
            block = [pack(key[a:b][first], rising=True), pack(other[a:b][first]) if other is not None else b"", pack(count)]
            yield int(part[a]), kind, joined(block + ([pack(at[a:b])] if at is not None else []))


def _opened(group: pa.Table, kind: int, texts: bool) -> tuple[np.ndarray, ...]:
    """Keys, words beside them and counts of all blocks of one kind; with ``texts`` a row for each occurrence instead: key,
    word beside it, number of its block in the group, and its text there."""
    found = []
    for k, (own, block) in enumerate(zip(group.column("kind").to_pylist(), group.column("block"), strict=True)):
        if own == kind:
            part = fields(block.as_buffer())
            key, n = unpack(part[0], rising=True), unpack(part[2]).astype(np.int64)
            other = unpack(part[1]) if kind else np.zeros(len(key), np.uint64)
            found.append((np.repeat(key, n), np.repeat(other, n), np.full(int(n.sum()), k), unpack(part[3]).astype(np.int64)) if texts else (key, other, n))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)[: 4 if texts else 3])
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _in_order(key: np.ndarray, other: np.ndarray, kind: int) -> np.ndarray:
    return np.lexsort((other, key)) if kind else np.argsort(key, kind="stable")


def _pair_blocks(train: DataFrame, model, parts: int) -> DataFrame:
    """part, kind and block of all pairs of the training texts."""

    def run(batches):
        codes, held, size = _Codes(model.value.code), [], 0

        def made() -> pa.RecordBatch:
            out = list(zip(*_blocks(np.concatenate(held), None, codes.hashes, parts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int8(), pa.binary()), strict=True)], names=["part", "kind", "block"])

        for batch in sliced(batches, "text"):
            for t in texts_of(batch, "text"):
                own = np.array([START_CODE, *map(codes.__getitem__, t.translate(LOWER).split()), END_CODE], np.uint64)
                held.append(own[:-1] << np.uint64(32) | own[1:])
                size += len(own)
                if size > TOKENS:
                    yield made()
                    held, size = [], 0
                    codes = codes if len(codes.hashes) < MEMO else _Codes(model.value.code)
        if held:
            yield made()

    return map_batches(train.select("text"), run, "part int, kind byte, block binary")


def _pair_statistics(train: DataFrame, model, parts: int, least: int) -> list:
    """Rows (what, key, a, b, c, d): of 'words' the code of a context and how many words came once, twice and more often after
    it; of 'arcs' a pair of ``least`` occurrences or more and its count; of 'all' the numbers of pairs seen 1 to 4 times."""

    def count(group: pa.Table) -> pa.Table:
        rows, whole = [], np.zeros(6, np.int64)
        for kind in (PAIR, RIGHT, LEFT):
            key, other, n = _opened(group, kind, texts=False)
            order = _in_order(key, other, kind)
            key, other, n = key[order], other[order], n[order]
            start, _ = runs(key, other)
            if not len(start):
                continue
            key, other, n = key[start], other[start], np.add.reduceat(n, start)
            if kind == RIGHT:  # a pair of two rare words counts beside the left one
                mine = other < RARE_CODE
                key, other, n = key[mine], other[mine], n[mine]
            whole += np.bincount(np.minimum(n, 5), minlength=6)
            if kind != LEFT and len(n):
                words, which = np.unique(key >> np.uint64(20) if kind == PAIR else other, return_inverse=True)
                numbers = (np.bincount(which, ok, len(words)).astype(int).tolist() for ok in (n == 1, n == 2, n > 2))
                rows += [("words", *r, 0) for r in zip(words.tolist(), *numbers, strict=True)]
            if kind == PAIR:
                often = n >= least
                rows += [("arcs", k, x, 0, 0, 0) for k, x in zip(key[often].tolist(), n[often].tolist(), strict=True)]
        rows.append(("all", 0, *whole[1:5].tolist()))
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("what", "key", *"abcd"), zip(*rows, strict=True), kinds, strict=True)})

    found = _pair_blocks(train, model, parts).groupBy("part").applyInArrow(count, "what string, key long, a long, b long, c long, d long")
    return found.groupBy("what", "key").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()  # 1 / WORD_SHARE + 1 / ARC_SHARE + 1 rows at most


def train_model(counts: DataFrame, train: DataFrame, parts: int) -> BackoffAutomaton:
    """The cached part of the automaton. ``counts``: of _word_counts."""
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = counts.where(F.col("n") >= max(LEAST, math.ceil(WORD_SHARE * tokens))).select("word", "n").collect()  # 1 / WORD_SHARE rows at most
    words = {bytes(r.word): r.n for r in sorted(often, key=lambda r: (-r.n, r.word))}
    ends = counts.where(F.col("hash") == _key(END)).select("n").first()
    texts = ends.n if ends else 0
    words.setdefault(END, texts)
    first = BackoffAutomaton(words, tokens, kinds, texts)
    if not tokens:
        return first
    rows = _pair_statistics(train, train.sparkSession.sparkContext.broadcast(first), parts, max(LEAST, math.ceil(ARC_SHARE * tokens)))
    name = {k: w for w, k in first.code.items()} | {START_CODE: None}
    after = {name[r.key]: (r.a, r.b, r.c) for r in rows if r.what == "words"}
    pairs = [(name[r.key >> 20], name[r.key & RARE_CODE - 1], r.a) for r in rows if r.what == "arcs"]
    whole = next(r for r in rows if r.what == "all")
    return BackoffAutomaton(words, tokens, kinds, texts, discounts(whole.a, whole.b, whole.c, whole.d), after, pairs)


#: Columns of what goes to a part: blocks, and a row for each text with what the cache tells of it.
_TOLD = {"row": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
#: Columns of what a part answers, beside those: pairs of two rare words, which lack the right one's count.
_LONE = {"hash": pa.int64(), "seen": pa.float64(), "fail": pa.float64()}


def _filled(columns: dict, schema: pa.Schema) -> pa.Table:
    """A table of ``schema``; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _asked(own: DataFrame, model, parts: int, schema: pa.Schema, ddl: str) -> DataFrame:
    """One left-to-right traversal of all texts: a row for each, and blocks of the pairs without a cached arc by part."""

    def run(batches):
        m = model.value
        codes, pairs, docs, size, first = _Codes(m.code), [], [], 0, None

        def made() -> list[pa.RecordBatch]:
            if not sum(map(len, pairs)):
                return []
            part, kind, block = zip(*_blocks(np.concatenate(pairs), np.concatenate(docs), codes.hashes, parts), strict=True)
            found = {"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int8()), "block": pa.array(block, pa.binary()), "first": pa.array([first] * len(part), pa.int64())}
            return _filled(found, schema).to_batches()

        for batch in sliced(batches, "text"):
            told, plain, sizes = [], [], []
            for row, held, t in zip(batch.column("row").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch, "text"), strict=True):
                first = row if first is None else first
                own = list(map(codes.__getitem__, t.translate(LOWER).split()))
                own.append(END_CODE)
                score, asked = m.traverse(own)
                plain += own
                sizes.append(len(own))
                told.append((row, held, score, first, row % parts))
                pairs.append(np.array(asked, np.uint64))
                docs.append(np.full(len(asked), (row - first) << 1 | held, np.uint64))
                size += len(own)
                if size > TOKENS:
                    yield from made()
                    pairs, docs, size, first = [], [], 0, None
                    codes = codes if len(codes.hashes) < MEMO else _Codes(m.code)
            kinds = {"row": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "first": pa.int64(), "part": pa.int32()}
            columns = {c: pa.array(x, t) for (c, t), x in zip(kinds.items(), zip(*told, strict=True), strict=True)}
            plain, sizes = np.array(plain), np.array(sizes)
            rare = plain >= RARE_CODE
            plain[rare] = START_CODE  # counts as unknown, with a base of 1, until its part tells
            at = np.cumsum(sizes) - sizes
            columns |= {"n_tokens": pa.array(sizes), "known": pa.array(np.add.reduceat(m.known[plain].astype(np.int64), at)), "base": pa.array(np.add.reduceat(m.log_base[plain], at))}
            yield from _filled(columns | {"id": batch.column("id")}, schema).to_batches()
        yield from made()

    return map_batches(own, run, ddl)


def _part_scores(model, schema: pa.Schema):
    """The work of a part: sums for texts from its blocks, in a block for each chunk that asked, and rows of pairs of two
    rare words. Rows of texts go through."""

    def score(group: pa.Table) -> pa.Table:
        m = model.value
        out = [_filled({c: group.column(c) for c in ("first", "id", *_TOLD)}, schema).filter(pa.compute.is_valid(group.column("row")))]
        firsts = np.array([x or 0 for x in group.column("first").to_pylist()], np.int64)
        scores, bases = [], []
        for kind in (PAIR, RIGHT, LEFT):
            key, other, place, doc = _opened(group, kind, texts=True)
            if not len(key):
                continue
            order = _in_order(key, other, kind)
            key, other, chunk, train, doc = key[order], other[order], firsts[place[order]], doc[order] & 1 == 0, doc[order] >> 1
            start, size = runs(key, other)
            n = np.add.reduceat(train.astype(np.int64), start)  # training occurrences of each pair
            of = np.repeat(np.arange(len(start)), size)
            if kind == PAIR:
                a, b = (key[start] >> np.uint64(20)).astype(np.int64), (key[start] & np.uint64(RARE_CODE - 1)).astype(np.int64)
                scores.append((chunk, doc, np.log10(m.seen(n, m.count[a]) + m.fail[a] * m.base[b])[of]))
                continue
            begin, _ = runs(key[start])  # pairs of each rare word
            word = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(start)]))
            count = np.add.reduceat(n, begin)
            beside = other[start]
            frequent = beside < RARE_CODE
            code = np.where(frequent, beside, np.uint64(0)).astype(np.int64)
            if kind == RIGHT:
                base = (count[word] + ADD) / m.share
                p = np.where(frequent, m.seen(n, m.count[code]) + m.fail[code] * base, 1.0)
                scores.append((chunk, doc, np.log10(p)[of]))
                bases.append((chunk, doc, np.log10(base)[of], (count[word] > 0)[of]))
                continue
            numbers = np.stack([np.add.reduceat(ok.astype(float), begin) for ok in (n == 1, n == 2, n > 2)], axis=1)
            fail, seen = m.weight(numbers, count)[word], m.seen(n, count[word])
            here = frequent[of]
            p = np.where(frequent, seen + fail * m.base[code], 1.0)
            scores.append((chunk[here], doc[here], np.log10(p)[of][here]))
            lone = {"first": chunk[~here], "hash": (beside[of][~here] ^ _TOP).view(np.int64), "row": (chunk + doc)[~here], "seen": seen[of][~here], "fail": fail[of][~here]}
            out.append(_filled({c: pa.array(x) for c, x in lone.items()}, schema))
        out.append(_answers(scores, bases, schema))
        return pa.concat_tables(out).combine_chunks()

    return score


def _answers(scores: list, bases: list, schema: pa.Schema) -> pa.Table:
    """A block for each chunk: its texts with a sum of scores, and those with rare words, their base scores and known ones."""
    blocks: dict[int, list[bytes]] = {}
    for what, found in ((0, scores), (1, bases)):
        if not found:
            continue
        chunk, doc, value, *known = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((doc, chunk))
        chunk, doc, value = chunk[order], doc[order], value[order]
        start, _ = runs(chunk, doc)
        sums = np.add.reduceat(value, start)
        more = [np.add.reduceat(known[0][order].astype(np.int64), start)] if known else []
        chunk, doc = chunk[start], doc[start]
        begin, size = runs(chunk)
        for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True):
            own = blocks.setdefault(int(chunk[a]), [b""] * 5)
            own[2 * what : 2 * what + 2] = [pack(doc[a:b], rising=True), sums[a:b].astype("<f8").tobytes()]
            if known:
                own[4] = pack(more[0][a:b])
    return _filled({"first": pa.array(list(blocks), pa.int64()), "block": pa.array([joined(b) for b in blocks.values()], pa.binary())}, schema)


def _chunk_scores(group: pa.Table) -> pa.Table:
    """The work of a chunk: the sums of all parts are added to the rows of its texts. Pairs of two rare words go through."""
    is_text = pa.compute.and_(pa.compute.is_valid(group.column("row")), pa.compute.is_null(group.column("hash")))
    texts, lone = group.filter(is_text), group.filter(pa.compute.is_valid(group.column("hash")))
    row = texts.column("row").to_numpy()
    first = group.column("first")[0].as_py()
    known, base, score = (texts.column(c).to_numpy().astype(float) for c in ("known", "base", "score"))
    total = {c: np.zeros(int(row.max()) - first + 1) for c in ("known", "base", "score")}
    for block in group.column("block"):
        if block.is_valid:
            part = fields(block.as_buffer())
            total["score"][unpack(part[0], rising=True).astype(np.int64)] += np.frombuffer(part[1], "<f8")
            at = unpack(part[2], rising=True).astype(np.int64)
            total["base"][at] += np.frombuffer(part[3], "<f8")
            total["known"][at] += unpack(part[4])
    at = row - first
    new = {"known": pa.array((known + total["known"][at]).astype(np.int64)), "base": pa.array(base + total["base"][at]), "score": pa.array(score + total["score"][at])}
    done = _filled({c: texts.column(c) for c in ("first", "row", "id", "held_out", "n_tokens")} | new, group.schema)
    return pa.concat_tables([done, lone]).combine_chunks()


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 10) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``. Rows whose id's crc32 is a
    multiple of ``mod`` are held out; the others train."""
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("held_out", held_out("id", mod))
    spark, train = own.sparkSession, own.where(~F.col("held_out"))
    counts = cut(_word_counts(train))
    tokens = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # four parts or more for each partition of a shuffle, so that they are dealt evenly, and two million tokens for each
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens) // 2_000_000)
    automaton = train_model(counts, train, parts)
    tidy(spark)  # the shuffle of all pairs is as large as the next one
    model = spark.sparkContext.broadcast(automaton)
    kind = dict(own.dtypes)["id"]
    told = "first long, row long, id {}, held_out boolean, n_tokens long, known long, base double, score double".format(kind)
    asks, answers = f"part int, kind byte, block binary, {told}", f"block binary, {told}, hash long, seen double, fail double"
    arrow = lambda ddl: to_arrow_schema(spark.createDataFrame([], ddl).schema)
    asked = _asked(own.withColumn("row", F.monotonically_increasing_id()), model, parts, arrow(asks), asks)
    found = asked.groupBy("part").applyInArrow(_part_scores(model, arrow(answers)), answers)
    found = cut(found.groupBy("first").applyInArrow(_chunk_scores, answers))
    share = automaton.share
    lone = found.where(F.col("hash").isNotNull()).groupBy("row", "hash", "seen", "fail").agg(F.count(F.lit(1)).alias("times"))
    counted = lone.join(counts.select("hash", "n"), "hash", "left")
    p = F.col("seen") + F.col("fail") * (F.coalesce("n", F.lit(0)) + ADD) / share
    more = counted.groupBy("row").agg(F.sum(F.col("times") * F.log10(p)).alias("more"))
    return found.where(F.col("hash").isNull()).join(more, "row", "left").select(
        "id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir):
    """Scores in millionths: sums of doubles differ beyond those with their order."""
    found = score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: crc32 of the id's characters, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda y, _: xor(y >> 1, 3988292384::BIGINT * (y & 1)))))"""
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') || [chr(10)] AS w FROM documents),
     h AS (SELECT r, doc_id, w, id = '' OR {_CRC} % 10 = 0 AS held FROM d),
     t AS (SELECT r, held, w[k] AS w, CASE WHEN k > 1 THEN w[k - 1] ELSE '' END AS a FROM h, unnest(range(1, len(w) + 1)) AS u(k)),
     c AS (SELECT w, count(*) AS n FROM t WHERE NOT held GROUP BY w),
     total AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, count(*) AS kinds FROM c),
     p AS (SELECT a, w, count(*) AS n FROM t WHERE NOT held GROUP BY a, w),
     cc AS (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4 FROM p),
     y AS (SELECT *, n1 / (n1 + 2.0::DOUBLE * n2) AS y FROM cc),
     disc AS (SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN [least(greatest(1 - 2 * y * n2 / n1, 0.1), 0.9), least(greatest(2 - 3 * y * n3 / n2, 0.1), 1.9),
                     least(greatest(CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5 END, 0.1), 2.9)] ELSE [0.5, 0.5, 0.5] END::DOUBLE[] AS x FROM y),
     ctx AS (SELECT a, sum(n) AS c, sum(x[least(n, 3)]) / sum(n) AS fail FROM p, disc GROUP BY a),
     s AS (SELECT t.r, c.n IS NOT NULL AS known, (coalesce(c.n, 0) + 0.1) / (tokens + 0.1 * (kinds + 1)) AS base, coalesce((p.n - x[least(p.n, 3)]) / ctx.c, 0) AS seen, coalesce(fail, 1) AS fail
           FROM t CROSS JOIN total CROSS JOIN disc LEFT JOIN c ON c.w = t.w LEFT JOIN p ON p.a = t.a AND p.w = t.w LEFT JOIN ctx ON ctx.a = t.a)
SELECT any_value(doc_id) AS doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(tokens) AS train_tokens,
       round(sum(log10(base::DOUBLE)), 6) AS base_score, round(sum(log10(seen + fail * base::DOUBLE)), 6) AS score
FROM s JOIN h USING (r) CROSS JOIN total GROUP BY r
"""
