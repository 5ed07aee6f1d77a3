"""What the SentencePiece codec does again for parts that it knows, and that its memo's turns don't show."""

from __future__ import annotations

import hashlib
import random

import sentencepiece

from factloom.llm.queries import piece_model
from factloom.llm.sentencepiece_codec import SentencePieceCodec


def test_one_new_word_costs_one_encoding():
    own, asked = SentencePieceCodec(piece_model()), []
    text = " ".join(f"word{i}" for i in range(200))
    own.digest(text)
    part, decode = own._part, own.decode
    own._part = lambda p: asked.append(p) or part(p)
    own.decode = lambda ids: asked.append("decode") or decode(ids)
    own.digest(text + " new")
    assert asked == ["▁new"]


def test_cut_pieces_and_small_memo():
    """Texts of cut pieces make the encoder go back; a memo of some words turns over within each text."""
    library, r = sentencepiece.SentencePieceProcessor(model_file=piece_model()), random.Random(7)
    own = SentencePieceCodec(piece_model(), memo_bytes=20_000, max_pairs=50)
    pieces = [p.replace("▁", " ") for p in own.ids if len(p) > 1]
    for n in (*[12] * 300, 9000):
        text = "".join(r.choice(pieces)[: r.randint(1, 9)] + r.choice(["", "", " ", "\U0001f600"]) for _ in range(n))
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
