"""Operator 1: SentencePiece BPE encoding by prefix tables, and decoding.

Every prefix of a text has one last token in its encoding. A table holds it: an automaton of all pieces gives the
pieces that end at a position, and of these the last token is the one that can stand after the last token of the
prefix before it. A pair can stand so if merging its two strings from characters gives back just that pair. The ids are
read from the end of the table to its start.

Pieces in which the space sign stands only in front never reach over the start of a word, so a table is made per word
and kept in a bounded memo; with other models it is made per text. A line feed is outside such vocabularies as well.

Null text counts as empty: it has the begin and end ids only. Repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_slice, table

SPACE = "▁"
#: Entries that a memo holds before it is emptied.
MEMO = 150_000


class PieceModel:
    """The pieces of a BPE model with byte fallback and no text normalisation."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        if sp.normalize(" a  ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only models without text normalisation and with a leading space sign are supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.score[piece] = i, sp.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        if not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("only models that hold each character of their pieces are supported")
        self.byte_values = set(self.byte_ids.values())
        self.leading = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.controls = {i for i in range(sp.vocab_size()) if sp.is_control(i)}
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self._merged(piece) == [piece]:  # other pieces never come out of the merges
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = len(self.bytes_of)
        self.piece = [""] * self.size
        for piece, i in self.ids.items():
            self.piece[i] = piece
        self.length = list(map(len, self.piece))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo before the last change of memos
        cuts = f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n+"
        letters, stops = "[A-Za-zÀ-ɏ]", "[.,;:!?]"
        if not any(re.search(letters + stops, p) for p in self.ids):  # then no piece reaches from a word over its end
            cuts = f"{SPACE}*{letters}++(?={stops})|{cuts}"
        self.cutter = re.compile(cuts)

    def _merged(self, text: str) -> list[str]:
        """The definition, for short strings: merge the best-scored pair, of equal ones the leftmost, until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        if len(self.pairs) >= 3 * MEMO:
            self.pairs.clear()
        known = self.pairs[left * self.size + right] = self._merged(a + b) == [a, b]
        return known

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk that no piece reaches out of, by its prefix table."""
        last = [-1] * (len(chunk) + 1)  # -1: a character outside the vocabulary, or the start; nothing merges over either
        length, pairs, size = self.length, self.pairs, self.size
        for end, token in self.automaton.iter(chunk):
            end += 1
            if last[end] < 0:
                before = last[end - length[token]]
                if before >= 0:
                    fits = pairs.get(before * size + token)
                    if fits or fits is None and self._fits(before, token):
                        last[end] = token
                else:
                    last[end] = token
        ids, i = [], len(chunk)
        while i:
            if (token := last[i]) < 0:
                ids += [self.byte_ids[b] for b in reversed(chunk[i - 1].encode())]
                i -= 1
            else:
                ids.append(token)
                i -= length[token]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
        out = [self.bos.to_bytes(4, "little")]
        if text:
            text = SPACE + text.replace(" ", SPACE)
            words = self.words
            for chunk in self.cutter.findall(text) if self.by_word else [text]:
                packed = words.get(chunk)
                if packed is None:
                    packed = self.older.get(chunk)
                    if packed is None:
                        ids = self.chunk_ids(chunk)
                        packed = struct.pack(f"<{len(ids)}I", *ids)
                    if len(chunk) <= 64:
                        if len(words) >= MEMO:
                            self.older, self.words = words, {}
                            words = self.words
                        words[chunk] = packed
                out.append(packed)
        out.append(self.eos.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: control ids give nothing, and the first other id loses one leading space."""
        ids = np.frombuffer(packed, "<u4").tolist()
        if ids and max(ids) >= self.size:
            raise ValueError("an id is outside the vocabulary")
        parts = [self.bytes_of[i] for i in ids]
        first = next((k for k, part in enumerate(parts) if part), None)
        if first is None:
            return ""
        if ids[first] in self.leading:
            parts[first] = parts[first][1:]
        if self.controls.isdisjoint(ids[1:-1]):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], []  # bytes make a character only if no other id stands between them
        for i, part in zip(ids, parts, strict=True):
            if i in self.byte_values:
                run.append(part)
            else:
                out += [self._mend(b"".join(run)), part.decode()]
                run = []
        return "".join(out) + self._mend(b"".join(run))

    @staticmethod
    def _mend(data: bytes) -> str:
        """Each byte that starts no whole character becomes one replacement character."""
        out, i = [], 0
        while i < len(data):
            n = next((n for n in range(1, 5) if _whole(data[i : i + n])), 0)
            out.append(data[i : i + n].decode() if n else "�")
            i += n or 1
        return "".join(out)


def _whole(part: bytes) -> bool:
    try:
        return len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[bytes, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """One model per worker process."""
    if data not in _models:
        _models.clear()
        _models[data] = PieceModel(data)
    return _models[data]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a tokenizer model over 64 MB is not sent to all tasks")
    return data


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with ``fields`` in place of columns of the same names."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + list(fields))


def _batch(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n.lower() not in {x.lower() for x in new}]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the packed ids of ``text``. The model's file (64 MB at most) is read by the driver and broadcast."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(model.value)
        return _batch(batch, {ids: pa.array([m.encode(x or "") for x in batch.column(text).to_pylist()], pa.binary())})

    return per_slice(df, text, work, _with(df, T.StructField(ids, T.BinaryType())))


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of packed ids; null ids give empty text."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(model.value)
        return _batch(batch, {decoded: pa.array([m.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())})

    return per_slice(df, ids, work, _with(df, T.StructField(decoded, T.StringType())))


def round_trip(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded``, both in one pass over the texts."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(model.value)
        packed = [m.encode(x or "") for x in batch.column(text).to_pylist()]
        return _batch(batch, {"ids": pa.array(packed, pa.binary()), "decoded": pa.array(map(m.decode, packed), pa.string())})

    return per_slice(df, text, work, _with(df, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())))


def digests(df: DataFrame, model_path: str) -> DataFrame:
    return round_trip(df.select("doc_id", "text"), model_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
