"""Tokens against the library that defines them, and round trips."""

import hashlib
import random

import numpy as np
import pytest

from lodeseam.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.load())


def test_like_the_library(encoder, library):
    rng = random.Random(5)
    alphabet = "aeinrst  .,'\n\tABé日本ßø1290-<>😀▁\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(800)]
    texts += ["", " ", "  ", "a" * 3000, "1" * 2001, "the " * 500, "internationalization <s> </s> <0x0A> ﬁ Ｓ", "   leading", "trailing   ", "​﻿\xa0x"]
    for text, got in zip(texts, encoder.encode(texts)):
        assert got.tolist() == library.encode(text), repr(text)
        assert sp.decode_numbers(got.tolist(), encoder.pieces.decoded) == library.decode(got.tolist())


def test_edges_are_all_occurrences(encoder):
    text = "▁banana\0▁an"
    at, piece = encoder.edges(text)
    got = [(a, encoder.pieces.texts[p]) for a, p in zip(at, piece)]
    known = set(encoder.pieces.texts)
    want = {(i, text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in known}
    assert set(got) == want and len(got) == len(want) and [a for a, _ in got] == sorted(a for a, _ in got)


def test_table(docs, rows, empty, library):
    texts = {r[0]: r[1] or "" for r in rows}
    got = sp.token_digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.tokens_sha256) == (len(want), hashlib.sha256(np.array(want, np.int32).tobytes()).hexdigest())
        assert r.round_trip and r.decoded_chars == len(texts[r.doc_id])
    tokens = sp.encode(docs)
    assert {(r.doc_id, r.text) for r in sp.decode(tokens).collect()} == {(i, t) for i, t in texts.items()}
    assert sp.token_digest(empty).count() == sp.encode(empty).count() == 0


def test_long_words_without_a_space(encoder, library):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(400_000))
    for t in (text, "ab" * 20_000 + " x", "日本語" * 3_000, "é" * 2_000 + "\x00" * 600, ("ab" * 300 + " ") * 3):
        assert encoder.encode([t])[0].tolist() == library.encode(t)


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(sp, "MOST_KNOWN", 100)
    monkeypatch.setattr(sp, "RUN_CHARS", 64)
    texts = [f"word{i} and a longer one {'x' * (i % 90)}" for i in range(200)] + ["z" * 700]
    for part in (texts[:90], texts[80:], texts):
        assert [t.tolist() for t in encoder.encode(part)] == library.encode(part)
