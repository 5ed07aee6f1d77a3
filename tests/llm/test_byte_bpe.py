"""The byte-level BPE transducer against the library: whole, cut anywhere, long runs, added tokens, and decoding of any ids."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import byte_bpe
from factloom.llm.queries import QUERIES, byte_model

PARTS = ["a", "the", "ing", " ", "  ", "\n", " \n", "\t", "'", "'s", "'re", "'l", "l", "1", "23", "é", "ß", "中", "😀", "!", "..", "_", "<|endoftext|>", "<|endof", " ", "　", "\x85", "\x1c", "՘", "\U0001e6c0", "₏"]


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_model())


@pytest.fixture(scope="module")
def library():
    return tokenizer()


@pytest.fixture(scope="module")
def own():
    return byte_bpe.model(byte_model())


def expected(library, text):
    return library.encode(text, add_special_tokens=False).ids


def in_pieces(own, text, r):
    encoder, out, at = byte_bpe.Encoder(own), [], 0
    while at < len(text):
        n = r.randrange(1, 6)
        out.append(encoder.feed(text[at : at + n]))
        at += n
    return np.frombuffer(b"".join(out) + encoder.finish(), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(blacklist_categories=("Cs",))), max_size=14).map("".join), st.integers(0, 99))
def test_encoding_is_the_librarys_whole_and_in_pieces(text, seed):
    own = byte_bpe.model(byte_model())
    want = expected(tokenizer(), text)
    assert own.encode(text) == want
    assert in_pieces(own, text, random.Random(seed)) == want
    assert own.decode(want) == text


def test_every_character_is_in_the_librarys_class(library, own):
    for base in range(0, 0x110000, 4096):
        text = "".join(f"a{c}1{c}!{c}b{c} 1" for i in range(base, base + 4096) if not 0xD800 <= i < 0xE000 for c in [chr(i)])
        ends = np.cumsum([len(w) for w in own.find_words(text)]).tolist()
        assert [b for _, (_, b) in library.pre_tokenizer.pre_tokenize_str(text)] == ends


def test_long_runs_in_constant_memory(library, own):
    r = random.Random(1)
    letters = "".join(r.choices("etaoinshrdlu", k=30_000))
    for text in ("a" * 9000, "ab" * 5000, " " * 3000 + "x", "\n" * 2000 + " \n" * 900 + "é", letters, "é" * 4000 + " 1" * 10, " " + "!?*-=" * 900 + "'s", "x" * 1023 + " " + "y" * 1025 + "'s" + " " * 1030 + "\n" + "z", "".join(r.choices("中文字符很长的", k=3000))):
        want = expected(library, text)
        assert own.encode(text) == want
        encoder, out, most = byte_bpe.Encoder(own), [], 0
        for i in range(0, len(text), 500):
            out.append(encoder.feed(text[i : i + 500]))
            most = max(most, len(encoder.text) + len(encoder.tail) + len(encoder.window.held))
        assert np.frombuffer(b"".join(out) + encoder.finish(), "<u4").tolist() == want
        assert most <= byte_bpe.LONG_RUN + 502 + own.span + own.lookahead


def test_lookahead_of_a_small_list_is_enough():
    """For each prefix, boundaries that far before its end are boundaries of every longer text; one byte less is too little somewhere."""
    merges = [(b"b", b"c"), (b"a", b"bc"), (b"c", b"a"), (b"bc", b"b"), (b"ca", b"a"), (b"a", b"b")]
    rank = {m: i for i, m in enumerate(merges)}

    def ends(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while (found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]):
            _, at = min(found)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return set(np.cumsum([len(p) for p in parts]).tolist())

    enough, r, worst = byte_bpe.lookahead(merges), random.Random(2), 0
    for _ in range(4000):
        text = bytes(r.choices(b"abc", k=12))
        for n in range(1, 12):
            before, whole = ends(text[:n]), ends(text)
            agreed = max((e for e in before if {b for b in before if b <= e} == {b for b in whole if b <= e}), default=0)
            worst = max(worst, n - agreed)
    assert 0 < worst <= enough


def test_many_runs_are_merged_as_one_by_one(own):
    r = random.Random(3)
    runs = ["".join(r.choices("aeinrst hlé", k=r.randrange(1, 20))).encode() for _ in range(2000)] + [b"aaaaaaa", b"ssss", b"x"]
    assert own.merge_many(runs) == [b"".join(own.packed[t] for t in own.merge(run)) for run in runs]


def test_decoding_of_any_ids_is_the_librarys(library, own):
    r = random.Random(4)
    for _ in range(1000):
        ids = [r.randrange(50_257) if r.random() < 0.5 else r.randrange(256) for _ in range(r.randrange(9))]
        want = library.decode(ids, skip_special_tokens=False)
        assert own.decode(ids) == want
        machine = byte_bpe.Decoder(own)
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == want
    assert own.decode([70_000, 64]) == own.decode([64])


def test_documents_with_nulls_repeats_and_long_texts(spark, library):
    rows = [(1, "héllo  wörld\n", "x"), (1, None, "y"), (None, "", None), (2, "ab" * 70_000 + " <|endoftext|> z", "x"), (2, "a b", "x"), (2, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = byte_bpe.encode_documents(docs, byte_model())
    found = sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect())
    want = []
    for k, t, _ in rows:
        ids = expected(library, t or "")
        back = library.decode(ids, skip_special_tokens=False)
        want.append((repr(k), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert found == sorted(want)
    back = byte_bpe.decode_documents(got, byte_model())
    assert sorted((repr(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((repr(k), t or "") for k, t, _ in rows)
    assert byte_bpe.encode_documents(docs.where("false"), byte_model()).count() == 0


def test_query_over_all_documents_is_the_librarys(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = expected(library, d["text"] or "")
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        byte_bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
