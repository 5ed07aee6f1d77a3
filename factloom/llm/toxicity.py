"""Toxicity by a classifier chain.

The categories are predicted one after the other, the general label last. Each link is a linear
(logistic) model on the words and word beginnings of the whole text, and on the probabilities of the
categories before it. In fitting, those probabilities come from models that haven't seen the row
(out-of-fold), so a link learns what they are worth on new texts; in prediction they come from the
links themselves. A link looks at a bounded number of features: those of the sample whose share
among positive rows is most surely larger than among negative ones, or smaller.

Where labels hold only the general mark, the categories come from the sample itself: marked rows are
grouped by the telling features that they share (spherical k-means), and a category's rows are those
of a group. Seed words of categories can be given instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import grams
from factloom.llm.common import batch_texts, give_back, map_arrow, small_batches
from factloom.llm.sampling import held_out, labelled_sample

#: Bytes of a word's beginning that are features of their own, for compounds and inflections.
PREFIXES = (4, 5)
GENERAL = "toxic"
#: A general mark on a larger share of the sample counts as if it were on this share: how often labels were given
#: says little of how often the corpus deserves them, and a text without telling features must not pass the threshold.
REFERENCE_SHARE = 0.125
_EDGES = np.isin(np.arange(256), list(b".,;:!?'\"()[]{}*#$%&|"))


def _strip_table() -> bytes:
    """Lower-cases A-Z and makes punctuation a space, so that words stand alone."""
    return bytes(32 if _EDGES[b] else grams.LOWER[b] for b in range(256))


_PLAIN = _strip_table()


def features(texts: list[bytes], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every distinct feature of every text; with a table only of those whose low bits it holds."""
    whole, parts, first = grams.words_and_prefixes([t.translate(_PLAIN) for t in texts], PREFIXES)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    owners, values = [], []
    for part in (whole, *parts):
        keep = np.flatnonzero(part != 0 if table is None else table[(part & np.uint64(len(table) - 1)).astype(np.int64)])
        owners.append(owner[keep])
        values.append(part[keep])
    owner, value = np.concatenate(owners), np.concatenate(values)
    fresh = np.unique(grams.mix(value ^ grams.mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return owner[fresh], value[fresh]


def _seed_hashes(words: tuple[str, ...]) -> np.ndarray:
    return grams.words([" ".join(words).encode()])[0]


@dataclass
class Link:
    """A logistic model: weight of each chosen feature, of each earlier probability, and the bias."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def odds(self, owner: np.ndarray, values: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        odds = before @ self.earlier + self.bias
        if len(self.chosen):
            at = np.minimum(np.searchsorted(self.chosen, values), len(self.chosen) - 1)
            hit = self.chosen[at] == values
            odds = odds + np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=n)
        return odds


def _telling(owner: np.ndarray, ids: np.ndarray, n_ids: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature the number of texts that have it, and the z-score of its log odds ratio."""
    counts = np.bincount(ids, minlength=n_ids)
    positive = np.bincount(ids, weights=y[owner], minlength=n_ids)
    a, b = positive + 0.5, counts - positive + 0.5
    p, q = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    return counts, (np.log(a / (p - positive + 0.5)) - np.log(b / (q - (counts - positive) + 0.5))) / np.sqrt(1 / a + 1 / b)


def _choose(owner: np.ndarray, ids: np.ndarray, n_ids: int, y: np.ndarray, most: int, least: int) -> np.ndarray:
    """Features in at least ``least`` texts, the ``most`` with the z-scores furthest from 0 (3.5 or more)."""
    counts, z = _telling(owner, ids, n_ids, y)
    z = np.abs(z)
    ok = np.flatnonzero((counts >= least) & (z >= 3.5))
    return np.sort(ok[np.argsort(-z[ok], kind="stable")[:most]])


def _groups(owner: np.ndarray, ids: np.ndarray, n_ids: int, y: np.ndarray, k: int, least: int, most: int = 256) -> np.ndarray:
    """The group (0 to k - 1) of each marked row, by the features that speak for the mark; -1 for other rows and marked ones without such features.

    Groups of fewer than least rows are none. The first centre is the row with the most telling features, each
    further one the row least like the centres before it, so equal samples give equal groups.
    """
    out = np.full(len(y), -1)
    counts, z = _telling(owner, ids, n_ids, y)
    ok = np.flatnonzero((counts >= least) & (z >= 3.5))
    ok = np.sort(ok[np.argsort(-z[ok], kind="stable")[:most]])
    marked = np.flatnonzero(y)
    if k < 1 or len(ok) == 0 or len(marked) < k * least:
        return out
    column, row = np.full(n_ids, -1), np.full(len(y), -1)
    column[ok], row[marked] = np.arange(len(ok)), np.arange(len(marked))
    hit = (column[ids] >= 0) & (row[owner] >= 0)
    x = np.zeros((len(marked), len(ok)))
    x[row[owner[hit]], column[ids[hit]]] = 1
    x *= np.log(1 + len(marked) / np.maximum(x.sum(axis=0), 1))
    norm = np.linalg.norm(x, axis=1)
    full = norm > 0
    x[full] /= norm[full, None]
    centres = x[[int(np.argmax(norm))]]
    while len(centres) < k:
        near = np.where(full, (x @ centres.T).max(axis=1), 2)
        centres = np.concatenate((centres, x[[int(np.argmin(near))]]))
    for _ in range(30):
        group = (x @ centres.T).argmax(axis=1)
        means = np.stack([x[full & (group == g)].sum(axis=0) for g in range(k)])
        size = np.linalg.norm(means, axis=1, keepdims=True)
        fresh = np.where(size > 0, means / np.maximum(size, 1e-12), centres)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    for g in range(k):
        rows = marked[full & (group == g)]
        if len(rows) >= least:
            out[rows] = g
    return out


def _frequent(texts: list[bytes], marked: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """features() of the texts, but for those in fewer than least texts or more than most unmarked ones, which no link would choose.

    Two passes over chunks: counts by the hashes' low bits, then the features whose count allows them.
    """
    slots = np.uint64((1 << 20) - 1)
    counts, plain = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
    for start, part in grams.chunks(texts, 1 << 18):
        owner, value = features(part)
        slot = (value & slots).astype(np.int64)
        counts += np.bincount(slot, minlength=len(counts)).astype(np.int32)
        plain += np.bincount(slot[marked[owner + start] == 0], minlength=len(plain)).astype(np.int32)
    owners, values = [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
    for start, part in grams.chunks(texts, 1 << 18):
        owner, value = features(part)
        slot = (value & slots).astype(np.int64)
        keep = (counts[slot] >= least) & (plain[slot] <= most)
        owners.append((owner[keep] + start).astype(np.int32))
        values.append(value[keep])
    return np.concatenate(owners), np.concatenate(values)


def _train(owner: np.ndarray, ids: np.ndarray, names: np.ndarray, y: np.ndarray, before: np.ndarray, most: int, least: int, rounds: int, ridge: float) -> Link:
    """ids: numbers of the texts' features in names, which are sorted."""
    n = len(y)
    mean = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    if not n or y.min() == y.max():
        return Link(np.empty(0, np.uint64), np.empty(0), np.zeros(before.shape[1]), float(np.log(mean / (1 - mean))))
    chosen = _choose(owner, ids, len(names), y, most, least)
    k = len(chosen)
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(k, dtype=np.int32)
    column = place[ids]
    hit = column >= 0
    row, column = owner[hit], column[hit]
    w = np.zeros(k + before.shape[1] + 1)
    w[-1] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):  # Adam
        odds = np.bincount(row, weights=w[column], minlength=n) + before @ w[k:-1] + w[-1]
        r = y - 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        g = np.concatenate((np.bincount(column, weights=r[row], minlength=k), before.T @ r, [r.sum()])) / n - ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Link(names[chosen], w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    links: list[Link]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One column for each category, in the chain's order."""
        owner, values = features(texts, self._table())
        out = np.zeros((len(texts), 0))
        for link in self.links:
            p = 1 / (1 + np.exp(-np.clip(link.odds(owner, values, len(texts), out), -500, 500)))
            out = np.column_stack((out, p))
        return out

    def _table(self) -> np.ndarray:
        """Low bits of the features that any link looks at: nearly all others are left out at once."""
        if getattr(self, "_kept", None) is None:
            self._kept = np.zeros(1 << 20, bool)
            for link in self.links:
                self._kept[(link.chosen & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return self._kept


def fit(sample: list[tuple[bytes, int]], categories: dict[str, tuple[str, ...]] | int = 3, folds: int = 3, most: int = 512, least: int = 4, rounds: int = 200, ridge: float = 1e-4) -> Chain:
    """A chain of categories, then the general label, from (text, general label) rows.

    categories: how many groups of marked rows to look for (group_1, group_2, ...), or names with seed
    words, of which a marked row of the category holds one. A group that isn't found is no link. A sample
    without rows, or of one label alone, marks nothing.
    """
    toxic = np.array([y for _, y in sample], np.int64)
    n = len(toxic)
    owner, values = _frequent([t for t, _ in sample], toxic, least, max(least, int((n - toxic.sum()) * 0.4)))
    # the features by number from here on: small integers that are counted, never sorted again
    vocabulary = np.unique(values)
    ids = np.searchsorted(vocabulary, values).astype(np.int32)
    del values
    fold = np.random.default_rng(7).permutation(n) % folds
    out_of_fold = np.zeros((n, 0))
    marks: dict[str, np.ndarray] = {}
    if isinstance(categories, int):
        group = _groups(owner, ids, len(vocabulary), toxic, categories, max(least, 8))
        marks = {f"group_{g + 1}": (group == g).astype(np.int64) for g in range(categories)}
        marks = {name: y for name, y in marks.items() if y.any()}
    else:
        for name, seeds in categories.items():
            holds = np.zeros(n, np.int64)
            holds[owner[np.isin(vocabulary, _seed_hashes(seeds))[ids]]] = 1
            marks[name] = toxic * holds
    marks[GENERAL] = toxic
    links = []

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners (renumbered) and features of some rows."""
        number = np.full(n, -1, np.int32)
        number[rows] = np.arange(len(rows), dtype=np.int32)
        inside = number[owner] >= 0
        return number[owner[inside]], ids[inside]

    for y in marks.values():
        fresh = np.zeros(n)
        for f in range(folds):
            rows, other = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            link = _train(*part(rows), vocabulary, y[rows], out_of_fold[rows], most, least, rounds, ridge)
            who, what = part(other)
            fresh[other] = 1 / (1 + np.exp(-np.clip(link.odds(who, vocabulary[what], len(other), out_of_fold[other]), -500, 500)))
        links.append(_train(owner, ids, vocabulary, y, out_of_fold, most, least, rounds, ridge))
        out_of_fold = np.column_stack((out_of_fold, fresh))
    share = float(np.clip(toxic.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    if share > REFERENCE_SHARE:
        links[-1].bias += float(np.log(REFERENCE_SHARE / (1 - REFERENCE_SHARE)) - np.log(share / (1 - share)))
    return Chain(list(marks), links)


def predict(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with a column p_<category> for each link; a null text is an empty one. Columns of docs with such names are replaced."""
    names = [prefix + x for x in chain.names]
    kept = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 1 << 20):
            found = chain.probabilities(batch_texts(batch, text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, i]) for i in range(len(names)))], names=[*batch.schema.names, *names])

    return map_arrow(rows, run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = GENERAL, max_docs: int = 4000, max_chars: int = 100_000, key: str = "doc_id", text: str = "text") -> Chain:
    """Fit on at most max_docs labelled rows that aren't held out."""
    chain = fit(labelled_sample(docs, labels, label, max_docs, max_chars, key, text))
    give_back()
    return chain


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, p_<category>..., toxic (1 if the general probability reaches threshold) of every row of docs.

    Null and empty texts, and others without a letter or digit, are not toxic, whatever their probability; texts of any
    length are read whole. A probability equal to threshold counts as toxic. Equal texts get equal rows, repeated rows
    stay, an empty table gives none; without labels nothing is toxic. Other columns are dropped.
    """
    chain = fit_on(docs, labels, key=key, text=text)
    scored = predict(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), chain, text)
    return scored.withColumns({"held_out": held_out(F.col(f"`{key}`")), "toxic": _flagged(text, threshold).cast("int")}).drop(text)


def _flagged(text: str, threshold: float) -> Column:
    return (F.col(f"p_{GENERAL}") >= threshold) & F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[\p{L}\p{N}]"), F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that toxicity() calls not toxic, with docs' own columns: see there for nulls, empty and long texts, ties and repeated rows."""
    chain = fit_on(docs, labels, key=key, text=text)
    columns = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text = docs.columns[[c.lower() for c in columns].index(text.lower())]
    return predict(docs, chain, text).where(~_flagged(text, threshold)).drop(*(f"p_{x}" for x in chain.names)).toDF(*columns)
