"""Pieces of texts against the library, and how much of them goes through it piece by piece."""

from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
from presswork.llm import tokens


def test_pieces_of_letters_and_signs_match_the_library():
    random = np.random.default_rng(23)
    signs = [*map(chr, range(33, 256)), "'s", "'re", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "ſ", "́"]
    texts = ["".join(signs[i] for i in random.integers(0, len(signs), random.integers(1, 7))) for _ in range(6000)]
    texts += [a + b for a in signs for b in ("", "s", "'s", "%%%", "1.")]
    for name in (tokens.WORD_BPE, tokens.BYTE_BPE):
        flat, lengths = tokens.with_end(pa.array(texts, pa.string()), name)
        for text, ids in zip(texts, np.split(flat, np.cumsum(lengths)[:-1])):
            assert ids.tolist() == brute.tokens(text, name), repr(text)


def test_words_with_signs_are_not_encoded_one_by_one(monkeypatch):
    encoder = tokens.word_tokens(tokens.WORD_BPE)
    monkeypatch.setattr(encoder, "newer", {})
    monkeypatch.setattr(encoder, "older", {})
    asked = []
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda texts: asked.extend(texts) or encode(texts))
    text = "password=f48865c7 rouge%%% ñes&&& été### don't 3.14 (so) x²"
    flat, _ = encoder(pa.array([text]), tokens.END)
    assert flat.tolist() == brute.tokens(text, tokens.WORD_BPE) and asked == []
