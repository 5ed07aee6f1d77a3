"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own features and those of the lines before and
after it; transitions join neighbouring labels. The field is fitted to documents' labels: at first
every line carries its document's, then lines of bad documents that the field finds good for
sure are relabelled and it is fitted again, so that the good part of a bad document teaches nothing
false. A document's quality is the mean of its lines' forward-backward marginals, weighted by
their lengths, calibrated on the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import grams
from factloom.llm.common import batch_texts, map_arrow, small_batches
from factloom.llm.sampling import held_out, labelled_sample

_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:?'\"-()", "shout": b"!", "bar": b"|<>{}[]\\/=_", "odd": b"*#$%&@^~+`", "lead": range(0xC0, 256),
}.items()}
FEATURES = ("bias", "empty", "upper", "upper_most", "shout", "bar", "odd", "odd_any", "digit", "stop", "repeat", "repeat_most", "few_distinct", "word_long", "word_short", "short_line", "long_line", "line_again", "ends_stop", "starts_upper")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, empty ones too."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes, offset of each text's first line, with the end). An empty text has one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first_line = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    bounds = np.concatenate((starts, [len(data)]))
    count = {k: _sums(v[data], bounds) for k, v in _IS.items()}
    accents = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
    count["upper"] += _sums(np.concatenate(([False], accents)), bounds)
    length = ends - starts
    n = np.maximum(length, 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["lead"], 1)

    lines = [t for text in texts for t in text.split(b"\n")]
    words, first = grams.words(lines)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(lines)), n_words)
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])))
    share = lambda k: count[k] / n
    repeats = _sums(again, first) / np.maximum(n_words, 1)
    fresh = np.unique(grams.mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[fresh], minlength=len(lines))
    mean = length / np.maximum(n_words, 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(first_line))
    line_hash = grams.mix(_sums_u64(words, first) + grams.mix(doc.astype(np.uint64)))
    _, inverse, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    head = data[np.minimum(starts, len(data) - 1)]
    tail = data[np.maximum(ends - 1, 0)]
    upper = count["upper"] / letters
    columns = (
        np.ones(len(lines)), length == 0, upper, upper > 0.6, share("shout") * 10, np.minimum(share("bar") * 10, 2), np.minimum(share("odd") * 10, 2), share("odd") > 0.03, np.minimum(share("digit") * 5, 2),
        np.minimum(share("stop") * 10, 2), repeats, repeats > 0.3, (n_words > 8) * (1 - distinct / np.maximum(n_words, 1)), mean > 11, (mean < 3.5) & (n_words > 0), length < 30, length > 600, (times[inverse] > 1) & (length > 0), _IS["stop"][tail] & (length > 0), (_IS["upper"][head] | (head >= 0xC0)) & (length > 0),
    )
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1), length, first_line


def _sums_u64(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and the line after (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate((x, before, after), axis=1)


class Layout:
    """Lines of texts as a padded (step, text) grid, longest text first, so that step t concerns the first alive[t] texts."""

    def __init__(self, first: np.ndarray):
        sizes = np.diff(first)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.steps = int(self.sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-self.sizes, -np.arange(self.steps), side="left")
        self.starts = first[:-1][self.order]

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.alive[t]] + t


def marginals(emission: np.ndarray, transition: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the summed expected transitions (2 x 2). emission: log odds of good."""
    forward, backward = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    score = np.stack((np.zeros(len(emission)), emission), axis=1)
    expected = np.zeros((2, 2))
    for t in range(layout.steps):
        now = layout.at(t)
        if t:
            last = forward[now - 1]
            forward[now] = score[now] + np.logaddexp(last[:, :1] + transition[0], last[:, 1:] + transition[1])
        else:
            forward[now] = score[now]
        forward[now] -= forward[now].max(axis=1, keepdims=True)
    for t in range(layout.steps - 2, -1, -1):
        now = layout.at(t)[: layout.alive[t + 1]]
        ahead = score[now + 1] + backward[now + 1]
        backward[now] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
        backward[now] -= backward[now].max(axis=1, keepdims=True)
        pair = forward[now][:, :, None] + transition + ahead[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), expected


@dataclass
class QualityField:
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, length, first = line_features(texts)
        return marginals(with_neighbours(x, first) @ self.weights, self.transition, Layout(first))[0], length, first

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal; an empty line weighs one byte."""
        good, length, first = self.line_marginals(texts)
        weight = length + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -500, 500)))


def _fit_field(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, ridge: float, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam. y: label of each line; weight: of each text's lines."""
    layout = Layout(first)
    w, tr = (np.zeros(x.shape[1]), np.zeros((2, 2))) if start is None else (start[0].copy(), start[1].copy())
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    m = np.zeros(len(w) + 4)
    v = np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        good, expected = marginals(x @ w, tr, layout)
        g = np.concatenate((x.T @ ((y - good) * weight), (seen - expected).ravel() * 0.2)) / len(y) - ridge * np.concatenate((w, tr.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        delta = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, tr = w + delta[:-4], tr + delta[-4:].reshape(2, 2)
    return w, tr


def fit(sample: list[tuple[bytes, int]], rounds: int = 120, ridge: float = 1e-4) -> QualityField:
    """A field of a sample of (text, label); without both labels one that gives every text the labels' mean."""
    labels = np.array([y for _, y in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        mean = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
        return QualityField(np.zeros(3 * len(FEATURES)), np.zeros((2, 2)), 0.0, float(np.log(mean / (1 - mean))))
    texts = [t for t, _ in sample]
    x, _, first = line_features(texts)
    x = with_neighbours(x, first)
    sizes = np.diff(first)
    y = np.repeat(labels, sizes)
    # both labels weigh the same, whatever their shares; calibration brings the shares back
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, tr = _fit_field(x, first, y, weight, rounds, ridge)
    good, _ = marginals(x @ w, tr, Layout(first))
    y = np.where((y == 0) & (good > 0.7), 1, y)
    w, tr = _fit_field(x, first, y, weight, rounds // 2, ridge, (w, tr))
    field = QualityField(w, tr)
    raw = field.raw(texts)
    a, b = 1.0, 0.0
    for _ in range(400):  # Newton steps of a logistic curve with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -500, 500)))
        r, s = labels - p, p * (1 - p) + 1e-9
        h = np.array([[(s * raw * raw).sum() + 0.1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 0.1]])
        da, db = np.linalg.solve(h, [(r * raw).sum() - 0.1 * a, r.sum() - 0.1 * b])
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    field.slope, field.shift = float(a), float(b)
    return field


def score_documents(docs: DataFrame, field: QualityField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row of docs; a null text is an empty one, which has one empty line."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            scores = field.scores(batch_texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    scored = map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 3000, max_chars: int = 100_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on at most max_docs labelled rows that aren't held out, and score every row of docs.

    Null and empty texts have one empty line and are scored as such; texts of any length are scored whole.
    A score of 0.7 exactly predicts 1. Repeated rows are scored alike, an empty table gives no rows; rows
    without labels, and columns other than key and text, are no input.
    """
    return score_documents(docs, fit(labelled_sample(docs, labels, label, max_docs, max_chars, key, text)), key, text)
