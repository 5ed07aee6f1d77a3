"""Byte-level BPE as a transducer of constant memory, and decoding by a machine from bytes to text.

**Sufficient lookahead.** Let two texts share a prefix, and let F be the last boundary up to which
their tokens agree; at first F is the prefix's end. Rules apply in the order of the merge list. A
rule r = (u, v) can move F only where it joins a token u that ends at F with a token v that starts
there, and then moves it by |u|. The token that starts at the new F begins with u from then on, so
the rule that moves F next has a later rank and a right side that begins with u. The largest sum
of |u| over such chains of rules, found in one pass over the list, is therefore enough lookahead:
boundaries that far before the end of what was read stay, whatever follows. (This needs that each
token has one rule, and that it comes before the rules that use the token; both are checked.)

So a run of any length is encoded in a window of fixed size: tokens that end before the lookahead
are emitted, and the window goes on behind them. Runs are what the pattern of the model's
pre-tokeniser cuts texts into; it is applied piece by piece as well, holding back what a later
character could change.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow, small_batches

#: Suffixes that the pre-tokeniser of byte-level models keeps as words of their own.
SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters by which a text is read, and those from which a run goes through the window instead of being held.
CHUNK, LONG_RUN = 1 << 16, 1 << 10
#: Words with more characters aren't memorised; so many new words at least are merged side by side.
LONG_WORD, FEW_WORDS = 64, 400


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """The sufficient lookahead of a merge list in bytes, as derived above."""
    reach: dict[bytes, int] = {}  # left side -> the largest sum of a chain that ends with one of its rules
    for left, right in merges:
        chain = len(left) + max((reach.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), chain)
    return max(reach.values(), default=0)


def word_pattern(letter: str, number: str, engine=regex):
    other = rf"[^\s{letter[1:-1]}{number[1:-1]}]"
    return engine.compile("|".join([*SUFFIXES, f" ?{letter}+", f" ?{number}+", f" ?{other}+", r"\s+(?!\S)", r"\s+"]), re.ASCII if engine is re else 0)


class ByteBpe:
    """The byte-level BPE model of a tokenizers file: its tokens, merges, lookahead, and a memo of words bounded by bytes.

    Files with a normaliser, a template or a prefix space, or with a model other than plain BPE
    over all 256 bytes, are refused.
    """

    def __init__(self, path: str, memo_bytes: int = 96 << 20):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or spec["post_processor"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE model")
        byte = byte_alphabet()
        spelt = {t: bytes(byte[c] for c in t) for t in model["vocab"]}
        self.ids = {spelt[t]: i for t, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(spelt[a], spelt[b]) for a, b in pairs]
        made: dict[bytes, int] = {bytes([b]): -1 for b in range(256)}
        for rank, (a, b) in enumerate(merges):
            if a not in made or b not in made or a + b in made:
                raise ValueError("a token with no rule before its use, or with two rules")
            made[a + b] = rank
        if any(t not in self.ids for t in made):
            raise ValueError("a merge or a byte without an id")
        self.rank, self.none = {m: i for i, m in enumerate(merges)}, len(merges)
        self.lookahead = lookahead(merges)
        #: Bytes of a window besides the lookahead; a token of any length ends within it.
        self.span = max(256, max(map(len, made)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings with them")
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.packed = {t: np.uint32(i).astype("<u4").tobytes() for t, i in self.ids.items()}
        size = len(self.packed)
        ordered = sorted((self.ids[a] * size + self.ids[b], rank) for rank, (a, b) in enumerate(merges))
        self.pairs, self.pair_ranks = (np.array(c, np.int64) for c in zip(*ordered, strict=True))
        self.made_ids = np.array([self.ids[a + b] for a, b in merges])
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)])
        self._classes(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.used, self.memo_bytes = 0, memo_bytes

    def _classes(self, path: str) -> None:
        """Patterns of words, with characters that are newer than the library's tables classed as the library classes them."""
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer
        unknown = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
        differ: list[int] = []
        for kind, sign in (("L", "a"), ("N", "1")):
            own = regex.findall(rf"\p{{{kind}}}", unknown)
            # a character of the sign's kind makes one word with it
            spans = split.pre_tokenize_str("".join(f"{sign}{c}\n" for c in own))
            joined = {word_start for _, (word_start, end) in spans if end - word_start == 2}
            differ += [ord(c) for i, c in enumerate(own) if 3 * i not in joined]
        starts, ends = sorted(set(differ) - {c + 1 for c in differ}), sorted(set(differ) - {c - 1 for c in differ})
        ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))
        #: A stand-in for them has the class that the library sees, and keeps places.
        self.newer = re.compile(f"[{ranges}]") if ranges else None
        self.plain_words = word_pattern("[A-Za-z]", "[0-9]", re)
        self.words = word_pattern(r"[\p{L}]", r"[\p{N}]")
        self.kinds = [regex.compile(k) for k in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]

    def find_words(self, text: str) -> list[str]:
        """The words of a text, one after the other without gaps."""
        if text.isascii():
            return self.plain_words.findall(text)
        if self.newer and self.newer.search(text):
            stand_in, at, out = self.newer.sub("\U0010ffff", text), 0, []
            for word in self.words.findall(stand_in):
                out.append(text[at : at + len(word)])
                at += len(word)
            return out
        return self.words.findall(text)

    def run_length(self, kind: int, text: str) -> int:
        """How many characters of the kind a text begins with."""
        if self.newer and not text.isascii():
            text = self.newer.sub("\U0010ffff", text)
        return self.kinds[kind].match(text).end()

    def kind_of(self, char: str) -> int:
        return next(k for k in range(4) if self.run_length(k, char))

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a run: the pair of the lowest rank is joined, leftmost first, until no rule fits."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.rank.get, self.none
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, none where no rule joins it."""
        pairs = left * len(self.packed) + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), self.none - 1)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], self.none)

    def merge_many(self, runs: list[bytes]) -> list[bytes]:
        """The packed ids of many short runs: each round joins the pairs of the lowest rank of every run, and lets finished runs go."""
        sizes = np.array([len(r) for r in runs])
        word = np.repeat(np.arange(len(runs)), sizes)
        ids = self.byte_ids[np.frombuffer(b"".join(runs), np.uint8)]
        ranks = np.full(len(ids), self.none)
        inner = np.flatnonzero(word[1:] == word[:-1])
        ranks[inner] = self._ranks(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(ranks, starts)
            least = np.repeat(lowest, np.diff(starts, append=len(ids)))
            over = least == self.none
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, ranks, least = ids[~over], word[~over], ranks[~over], least[~over]
                continue
            hits = ranks == least
            hits[1:] &= ranks[:-1] != ranks[1:]  # of a row of equal pairs the first, the others wait
            hits = np.flatnonzero(hits)
            ids[hits] = self.made_ids[ranks[hits]]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            hits -= np.arange(len(hits))
            changed = np.concatenate([hits, hits[hits > 0] - 1])
            ranks[changed] = self.none
            changed = changed[changed + 1 < len(ids)]
            changed = changed[word[changed] == word[changed + 1]]
            ranks[changed] = self._ranks(ids[changed], ids[changed + 1])
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        packed, ends = np.concatenate(done_ids)[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(runs)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids, packed as little-endian unsigned 32-bit integers."""
        found = list(map(self.memo.get, words))
        if None not in found:
            return found
        new = {w: self.older.get(w) for w, f in zip(words, found, strict=True) if f is None}
        runs = {w: w.encode("utf-8") for w, known in new.items() if known is None}
        short = [w for w, run in runs.items() if len(run) <= self.span]
        if len(short) > FEW_WORDS:
            new.update(zip(short, self.merge_many([runs[w] for w in short]), strict=True))
        else:
            new.update((w, b"".join([self.packed[t] for t in self.merge(runs[w])])) for w in short)
        for word, run in runs.items():
            if len(run) > self.span:
                window = Window(self)
                new[word] = window.push(run) + window.close()
        out = [f or new[w] for w, f in zip(words, found, strict=True)]
        for word, known in new.items():
            if len(word) <= LONG_WORD:
                self.used += 150 + 2 * len(word) + len(known)
                self.memo[word] = known
        if self.used > self.memo_bytes // 2:
            self.older, self.memo, self.used = self.memo, {}, 0
        return out

    def forget(self) -> None:
        """Empty the memo: workers outlive the stage, and other stages need the memory."""
        self.memo, self.older, self.used = {}, {}, 0

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(_pieces(self, text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        decoder = Decoder(self)
        return decoder.feed(ids) + decoder.finish()


class Window:
    """A run's bytes in, packed ids of stable tokens out; holds the lookahead and one span at most."""

    def __init__(self, model: ByteBpe):
        self.model, self.held = model, b""

    def push(self, data: bytes) -> bytes:
        model, out = self.model, []
        size = model.span + model.lookahead
        self.held += data
        while len(self.held) > size:
            end = 0
            for token in model.merge(self.held[:size]):
                if end + len(token) > model.span:
                    break
                out.append(model.packed[token])
                end += len(token)
            self.held = self.held[end:]
        return b"".join(out)

    def close(self) -> bytes:
        """The rest of the run, whose end is known now."""
        held, self.held = self.held, b""
        return b"".join([self.model.packed[t] for t in self.model.merge(held)])


class Encoder:
    """Text in by pieces, packed ids out as soon as they are stable.

    Holds what could still become an added token, what could still change the last words (two
    characters behind a word decide its end), and the window of a long run.
    """

    def __init__(self, model: ByteBpe):
        self.model, self.tail, self.text = model, "", ""
        self.window, self.kind = Window(model), -1

    def feed(self, piece: str) -> bytes:
        """The ids that are stable with this piece."""
        out, text = [], self.tail + piece
        at = 0
        for hit in self.model.specials.finditer(text):
            out += [self._words(text[at : hit.start()], True), np.uint32(self.model.special[hit.group()]).astype("<u4").tobytes()]
            at = hit.end()
        keep = next((n for n in range(min(len(text) - at, self.longest - 1), 0, -1) if any(s.startswith(text[-n:]) for s in self.model.special)), 0)
        end = len(text) - keep
        self.tail = text[end:]
        out.append(self._words(text[at:end], False))
        return b"".join(out)

    @property
    def longest(self) -> int:
        return max(map(len, self.model.special), default=0)

    def finish(self) -> bytes:
        tail, self.tail = self.tail, ""
        return self._words(tail, True)

    def _words(self, more: str, last: bool) -> bytes:
        """Words of the text so far; last says that nothing belongs to it any more."""
        model, text = self.model, self.text + more
        out = []
        if self.kind >= 0:
            at = self._run_on(text, last, out)
            if self.kind >= 0:  # the run goes on
                self.text = text[at:]
                return b"".join(out)
            text = text[at:]
        words = model.find_words(text)
        end = len(text)
        if not last:
            first = None
            while words and end > len(text) - 2:
                first = words.pop()
                end -= len(first)
        out += model.words_ids(words)
        self.text = text[end:]
        if not last and first and len(first) > LONG_RUN:
            self.kind = model.kind_of(first[-1])
            start = 1 if self.kind and first[0] == " " else 0
            out.append(self.window.push(first[:start].encode()))
            at = self._run_on(self.text[start:], False, out) + start
            self.text = self.text[at:]
            if self.kind < 0:
                out.append(self._words("", False))
        return b"".join(out)

    def _run_on(self, text: str, last: bool, out: list[bytes]) -> int:
        """Push what text has of the run under way, and close it where it ends. White space leaves its last character to what follows."""
        n = self.model.run_length(self.kind, text)
        goes_on = n == len(text) and not last
        if self.kind == 0 and n and (goes_on or n < len(text)):
            n -= 1
        out.append(self.window.push(text[:n].encode("utf-8")))
        if not goes_on:
            out.append(self.window.close())
            self.kind = -1
        return n


class Decoder:
    """Ids in by pieces, text out; the state is the bytes, three at most, of a character that isn't finished. Bad bytes give U+FFFD, unknown ids nothing."""

    def __init__(self, model: ByteBpe):
        self.bytes_of = model.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(2)
def model(path: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path)


def digest(own: ByteBpe, text: str, keep_ids: bool = False, words: list[str] | None = None) -> tuple[int, str, str, np.ndarray | None]:
    """Number of ids, SHA-256 of the packed ids, SHA-256 of what they decode to, and the ids if they are to be kept. words are the text's, where they are known."""
    decoder, n, kept = Decoder(own), 0, []
    of_ids, of_text = hashlib.sha256(), hashlib.sha256()
    for packed in _pieces(own, text) if words is None else [b"".join(own.words_ids(words))]:
        ids = np.frombuffer(packed, "<u4")
        n += len(ids)
        of_ids.update(packed)
        of_text.update(decoder.feed(ids.tolist()).encode("utf-8"))
        if keep_ids:
            kept.append(ids)
    of_text.update(decoder.finish().encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest(), np.concatenate(kept).astype(np.int32) if keep_ids else None


def _pieces(own: ByteBpe, text: str) -> Iterator[bytes]:
    encoder = Encoder(own)
    for i in range(0, len(text), CHUNK):
        yield encoder.feed(text[i : i + CHUNK])
    yield encoder.finish()


def digests(own: ByteBpe, texts: list[str], keep_ids: bool = False, limit: int = 1 << 20) -> Iterator[tuple]:
    """digest() of each text. A text of one piece is cut at once; new words of about limit characters of such texts are merged together."""
    at = 0
    while at < len(texts):
        end, size, words = at, 0, []
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= limit):
            text = texts[end]
            whole = len(text) <= CHUNK and not own.specials.search(text)
            words.append(own.find_words(text) if whole else None)
            size, end = size + (len(text) if whole else 0), end + 1
        own.words_ids(list(set().union(*(w for w in words if w))))
        yield from (digest(own, t, keep_ids, w) for t, w in zip(texts[at:end], words, strict=True))
        at = end


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and (keep_ids) ids of every row of docs. Other columns are dropped.

    A null text is an empty one, which has no tokens. Null keys stay; repeated rows give repeated
    rows, an empty table none. Texts of any length are read in pieces of 64 K characters; besides the
    text, a row needs memory for its ids only where they are kept. The file must be readable on all executors.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        try:
            for batch in small_batches(batches, "text"):
                found = list(digests(own, batch.column("text").to_pylist(), keep_ids))
                n, ids, decoded, kept = (list(c) for c in zip(*found, strict=True))
                arrays = [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.list_(pa.int32()))] if keep_ids else arrays, names)
        finally:
            own.forget()

    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(rows, run, schema).withColumnRenamed("key", key)


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the decoded text of a column of ids; null ids give a null text, ids without a token nothing."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        own = model(path)
        return pd.Series([None if x is None else own.decode(list(x)) for x in column])

    return rows.withColumn(out, decoded(F.col(f"`{ids}`")))
