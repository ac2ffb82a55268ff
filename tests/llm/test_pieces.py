import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vocabra.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.PieceModel(f.read())


BITS = [*" a  bthe.\n\t▁éñ中梦😀\0\x7fIÐ=_--**..##0123﻿", "addEventListener", "    ", "the ", "ing", "........", "end.", "²."]


def test_ids_and_text_equal_the_library(library, model):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed = model.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids and model.decode(packed) == library.decode(ids)


def test_decoding_any_ids_equals_the_library(library, model):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([1, 2, 259, 28705, 264, rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(200, 259)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_long_words_and_small_memos(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 3)
    text = "x" * 5000 + " " * 100 + "中" * 2000 + " ab cd ef gh ab cd" * 50
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_query(spark, library, tmp_path):
    texts = [None, "", " two  spaces ", "Änd\nline", "Änd\nline"]
    df = spark.createDataFrame([(i % 4, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.query(spark, str(tmp_path)).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i % 4, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(empty, PATH).count() == 0
    parts = pieces.decode(pieces.encode(df, PATH), PATH)
    assert parts.columns == ["doc_id", "text", "ids", "decoded"] and sorted(r.decoded for r in parts.collect()) == sorted(t or "" for t in texts)
