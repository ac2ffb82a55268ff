"""Operator 2: token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words with their leading space sign. The distinct ones are inserted in a trie, which a worker
goes on using for the next texts. A node stands for a prefix and holds its forward score, the best sum of piece scores
that makes the prefix, and the number of pieces of that segmentation. It is computed once, when the node is made, for
all pre-tokens that share the prefix: a second trie, of the pieces spelled backwards, walks from the node up its path
and meets exactly the pieces that end there. A pre-token's count is that of its terminal node; a text's count is the sum
over its pre-tokens.

The pieces are those of a public vocabulary file. The file has ranks and no probabilities, so a piece's score is that of
Zipf's law for its rank, in whole millionths so that sums are exact: of equal sums the one with fewer pieces counts. A
character outside the vocabulary is a piece per byte. Null or empty texts have no tokens. Repeated rows are counted alike.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import per_slice, table
from .pieces import SPACE, _read

#: Pre-tokens whose counts a worker keeps before it changes memos, and nodes of its trie before it starts a new one.
MEMO, NODES = 200_000, 500_000
#: Rank that is added in Zipf's law, and the score of a byte beside the rarest piece's.
OFFSET, BYTE = 2.7, -10_000_000


#: A word with the space sign before it; more of them are words of their own, and a line feed ends a word.
_WORD = re.compile(f"{SPACE}?[^{SPACE}\\n]+|[{SPACE}\\n]")


class UnigramCounter:
    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        whole = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = sorted(whole, key=lambda i: (-sp.get_score(i), i))
        total = sum(1 / (rank + OFFSET) for rank in range(len(ranked)))
        self.score = {sp.id_to_piece(i): round(-1e6 * math.log((rank + OFFSET) * total)) for rank, i in enumerate(ranked)}
        self.byte = min(self.score.values()) + BYTE
        #: Pieces spelled backwards: an arc by character, and the score of the piece that a node completes.
        self.back: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        for piece, score in self.score.items():
            node = 0
            for c in reversed(piece):
                if c not in self.back[node]:
                    self.back[node][c] = len(self.back)
                    self.back.append({})
                    self.ends.append(None)
                node = self.back[node][c]
            self.ends[node] = score
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._plant()

    def _plant(self) -> None:
        """A trie with a root only. By node: its arcs, the forward score of its prefix, and the pieces of that, negative."""
        self.arcs: list[dict[str, int]] = [{}]
        self.forward: list[int] = [0]
        self.fewest: list[int] = [0]

    def insert(self, word: str) -> int:
        """Insert a pre-token; the number of pieces at its terminal node."""
        arcs, forward, fewest, back, ends = self.arcs, self.forward, self.fewest, self.back, self.ends
        path, node = [0], 0
        for end, c in enumerate(word, 1):
            there = arcs[node].get(c)
            if there is None:
                size = len(c.encode())
                best, n = forward[node] + self.byte * size, fewest[node] - size
                at, begin = back[0].get(c), end - 1
                while at is not None:
                    piece = ends[at]
                    if piece is not None:
                        before = path[begin]
                        score = forward[before] + piece
                        if score > best or score == best and fewest[before] - 1 > n:
                            best, n = score, fewest[before] - 1
                    begin -= 1
                    at = back[at].get(word[begin]) if begin >= 0 else None
                there = arcs[node][c] = len(arcs)
                arcs.append({})
                forward.append(best)
                fewest.append(n)
            path.append(there)
            node = there
        return -fewest[node]

    def walk(self, words: list[str]) -> dict[str, int]:
        """Pieces of each of some distinct pre-tokens."""
        out = {}
        for word in words:
            if len(self.arcs) > NODES:
                self._plant()
            out[word] = self.insert(word)
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = {w for words in split for w in words}
        known = {w: n for w in wanted if (n := self.memo.get(w)) is not None or (n := self.older.get(w)) is not None}
        new = self.walk(list(wanted - known.keys()))
        if len(self.memo) + len(new) > MEMO:
            self.older, self.memo = self.memo, {}
        self.memo.update((w, n) for w, n in new.items() if len(w) <= 64)
        known |= new
        return [len(w) for w in split], [sum(map(known.__getitem__, w)) for w in split]


_counters: dict[bytes, UnigramCounter] = {}


def token_counts(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``n_pretokens`` and ``n_tokens`` to the columns of ``df``; a map without a shuffle."""
    names = ("n_pretokens", "n_tokens")
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))
    own = df.drop(*(c for c in df.columns if c.lower() in names))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = model.value
        if data not in _counters:
            _counters.clear()
            _counters[data] = UnigramCounter(data)
        found = _counters[data].count([x or "" for x in batch.column(text).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.int64()) for f in found)], names=[*batch.schema.names, *names])

    return per_slice(own, text, work, T.StructType([*own.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")
