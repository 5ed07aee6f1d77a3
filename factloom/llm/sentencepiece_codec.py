"""Exact SentencePiece (BPE type) encoding by backtracking, and decoding.

A token sequence is the BPE encoding of its text exactly if every two neighbours are the encoding
of their own concatenation. So the encoder walks over the text, takes the longest piece that
starts here (Aho-Corasick automaton), and checks only that it is compatible with the token before
it, by merging the two anew. If no piece fits, it marks the position as failed in a bit field,
drops the last token and tries the next shorter piece there; each position fails at most once,
so time is linear in the text.

Pieces of this model never hold a space mark behind another character; the text is cut where
one follows, and the encodings of the short parts are kept in a memo of two
generations, bounded by bytes and emptied at the end of each task. Characters outside
the vocabulary become their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, small_batches

SPACE = "▁"
NO_TOKEN = -1


class SentencePieceCodec:
    """Encodes and decodes as the model at path does, without begin or end ids and sampling.

    The model must be of the BPE type with the identity normaliser, a dummy prefix, escaped and
    unremoved white space and byte fallback; these are checked by a probe of the library.
    """

    def __init__(self, path: str, memo_bytes: int = 96 << 20, max_pairs: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        special = self.silent | set(self.byte_of) | {self.unknown} | {i for i in range(size) if model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if model.decode(model.encode("  Å ﬁ")) != "  Å ﬁ" or len(self.byte_ids) != 256:
            raise ValueError("not a BPE model with identity normaliser, kept white space and byte fallback")
        self.last_special = max(special)
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Part -> its ids in decimal, in two generations: what the older one holds moves up when it is met again, and else goes.
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Decodings that are not just the part with spaces for its marks.
        self.odd: dict[str, str] = {}
        self.used, self.memo_bytes, self.max_pairs = 0, memo_bytes, max_pairs
        #: Pieces that are not their own encoding are never produced by merging.
        made = {p for p in self.ids if len(p) == 1 or self._merge(list(p)) == [p]}
        #: Piece -> the next shorter one that it begins with.
        self.shorter = {p: q for p in made if (q := next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in made), ""))}
        self.decimal = {p: str(i) for p, i in self.ids.items()}
        automaton = ahocorasick.Automaton()
        for piece in made:
            if len(piece) > 1:
                automaton.add_word(piece, piece)
        automaton.make_automaton()
        self.automaton = automaton

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge the neighbours with the highest score, leftmost first, until none can be merged."""
        get, none = self.score.get, -float("inf")
        scores = [get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            at = scores.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(symbols[at - 1] + symbols[at], none)
            if at < len(scores):
                scores[at] = get(symbols[at] + symbols[at + 1], none)
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' characters anew gives the two tokens."""
        return left + right not in self.ids and self._merge([*left, *right]) == [left, right]

    def tokens(self, text: str) -> list[str]:
        """The tokens of an escaped text; a character outside the vocabulary is a token of its own."""
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # ends only grow, so the last is the longest
        shorter, pairs = self.shorter, self.pairs
        failed = bytearray()  # a bit for each position, from the first failure on
        out: list[str] = []
        at, size, last, piece = 0, len(text), None, None
        while at < size:
            if piece is None:
                piece = longest[at]
            while piece:
                end = at + len(piece)
                if not (failed and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    known = pairs.get((last, piece))
                    if known or known is None and self._fits(last, piece):
                        break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                at, last, piece = end, piece, None
            else:
                if not out:
                    raise ValueError("no encoding")
                failed = failed or bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = shorter.get(piece, "")
                last = out[-1] if out else None
        return out

    def _fits(self, left: str, right: str) -> bool:
        """compatible() behind a plain memo of max_pairs, emptied when it is full."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.pairs[left, right] = left not in self.ids or right not in self.ids or self.compatible(left, right)
        return known

    def _token_ids(self, token: str) -> list[int]:
        return [self.ids[token]] if token in self.ids else [self.byte_ids[b] for b in token.encode("utf-8")]

    def _parts(self, text: str) -> list[str]:
        """The escaped text, cut where a space mark follows another character. Each part but an odd first begins with its marks."""
        escaped = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return [escaped]
        words = escaped.split(SPACE)
        if "" not in words[1:]:
            return [SPACE + w for w in words[1:]]
        parts, marks = [], 0
        for word in words[1:]:
            marks += 1
            if word:
                parts.append(SPACE * marks + word)
                marks = 0
        return parts + [SPACE * marks] * (marks > 0)

    def encode(self, text: str) -> list[int]:
        return [i for part in self._parts(text) for token in self.tokens(part) for i in self._token_ids(token)] if text else []

    def decode(self, ids: list[int]) -> str:
        """Pieces to text: control ids say nothing, runs of byte pieces are read as UTF-8 (each bad byte: U+FFFD), the dummy prefix goes."""
        if ids and min(ids) > self.last_special:
            return "".join([self.texts[i] for i in ids]).removeprefix(" ")
        out: list[str] = []
        run = bytearray()
        first = True
        for i in [*ids, NO_TOKEN]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
                first = False
            if i == NO_TOKEN or i in self.silent:
                continue
            piece = " ⁇ " if i == self.unknown else self.texts[i]
            if first and i != self.unknown:
                piece = piece.removeprefix(" ")
            first = False
            out.append(piece)
        return "".join(out)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of what they decode to."""
        return self.digest_and_ids(text)[:3]

    def digest_and_ids(self, text: str, keep_ids: bool = False) -> tuple[int, str, str, np.ndarray | None]:
        """As digest(), and the ids themselves if they are to be kept."""
        parts, known = self._parts(text) if text else [], []
        self.odd.clear()
        for i in range(0, len(parts), 4096):  # a generation that was dropped meanwhile is let go
            get = self.memo.get
            known += [get(p) or self._part(p) for p in parts[i : i + 4096]]
        ids = ",".join(known)
        decoded = "".join([self.odd.get(p) or p for p in parts] if self.odd else parts).replace(SPACE, " ")
        if self.splits or not parts:
            decoded = decoded.removeprefix(" ")
        flat = np.fromstring(ids, np.int32, sep=",") if keep_ids else None
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), flat

    def _part(self, part: str) -> str:
        """A part's ids in decimal. Long parts and those whose decoding is odd aren't kept."""
        if (known := self.memo.get(part)) is not None:
            return known
        if (known := self.older.get(part)) is not None:
            return self._keep(part, known)
        tokens, decimal = self.tokens(part), self.decimal
        try:
            known = ",".join([decimal[t] for t in tokens])
        except KeyError:
            pass
        else:  # pieces alone decode to the part with spaces for its marks
            return self._keep(part, known) if len(part) <= 64 else known
        ids = [i for token in tokens for i in self._token_ids(token)]
        known = ",".join(map(str, ids))
        # a part starts with a space mark; another mark before it keeps that space in decode()
        decoded = self.decode([self.ids[SPACE], *ids])
        if decoded != part.replace(SPACE, " "):
            self.odd[part] = decoded
            return known
        return self._keep(part, known) if len(part) <= 64 else known

    def _keep(self, part: str, known: str) -> str:
        """Note a part's encoding; a generation may hold half of memo_bytes, by an estimate of what its objects take."""
        self.used += 230 + 2 * len(part) + len(known)
        if self.used > self.memo_bytes // 2:
            self.older, self.memo, self.used = self.memo, {}, 0
        self.memo[part] = known
        return known

    def forget(self) -> None:
        """Empty the memos: workers outlive the stage, and other stages need the memory."""
        self.memo, self.older, self.pairs, self.used = {}, {}, {}, 0


def _lenient(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a valid character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(2)
def codec(path: str) -> SentencePieceCodec:
    """One for each worker and model."""
    return SentencePieceCodec(path)


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and (keep_ids) ids of every row of docs; a null text is an empty one. Other columns are dropped; repeated rows give repeated rows, an empty table none.

    The model's path must be readable on all executors; tokens of a document stay in one row.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        try:
            for batch in small_batches(batches, "text"):
                found = [own.digest_and_ids(t, keep_ids) for t in batch.column("text").to_pylist()]
                n, ids, decoded, flat = (list(c) for c in zip(*found, strict=True))
                arrays = [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(flat, pa.list_(pa.int32()))] if keep_ids else arrays, names)
        finally:
            own.forget()

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(rows, run, schema).withColumnRenamed("key", key)


def decode_documents(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give a null text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        own = codec(model)
        return pd.Series([None if x is None else own.decode(list(x)) for x in column])

    return rows.withColumn(out, decoded(F.col(f"`{ids}`")))
