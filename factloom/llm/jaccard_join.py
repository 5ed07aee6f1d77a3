"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles' hashes, in hash order. Documents with equal
sets are one class and only one of them takes part. Two sets with Jaccard >= t share at least
ceil(t n) elements, so among the first p + l - 1 elements of both, p = n - ceil(t n) + 1, they share
l or more (the l-prefix scheme).

Every document chooses its own l by what its candidates would cost: the shared elements' lists that its
prefix would meet, and the partners among them that would have to be verified. A longer prefix meets more
lists, but asks for more shared elements. A pair that chose l_a and l_b must share min(l_a, l_b) elements.
Elements that stand in the prefixes of more than ``heavy`` classes (shared passages) are never joined: with
l larger than the number of heavy elements in the prefix a partner shares at least one light
element beside all heavy ones, so only the short lists of light elements are. The largest l is the
``slack`` of the set's size. Documents for which no such l exists within the slack (mostly made of
heavy elements: large groups of near copies) are compared in blocks.

Candidates pass a bitmap filter (the Hamming distance of parity bitmaps bounds the symmetric
difference from below), are gathered into clusters, and each cluster is verified exactly in
bounded blocks. A block skips pairs that earlier links already connect and returns a spanning
forest of its links, so a group of k copies gives k - 1 rows, never k squared.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.llm import grams
from factloom.llm.common import batch_texts as _texts
from factloom.llm.common import bit_filter, cut, map_arrow, small_batches
from factloom.llm.components import connected_components


def shingle_sets(texts: list[bytes], n: int, seed: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer than n words one shingle of all of them."""
    for _, part in grams.chunks(texts):
        words, first = grams.words([t.translate(grams.LOWER) for t in part])
        if seed:
            words = grams.mix(words + np.uint64(seed))
        shingles = grams.grams(words, n)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(shingles[a : b - n + 1])
            elif b > a:
                yield grams.mix(grams.grams(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    a, b = elements.sum(dtype=np.uint64), grams.mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(grams.mix(np.array([a + np.uint64(len(elements))]))[0].view(np.int64)), int(grams.mix(np.array([b]))[0].view(np.int64))


def parity_bitmap(elements: np.ndarray) -> np.ndarray:
    """Bit i: the parity of how many elements fall on it. Twice as many bits as elements, 256 to 4,096, a power of two."""
    bits = min(4096, max(256, 1 << (2 * len(elements) - 1).bit_length()))
    counts = np.bincount((elements >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8)).view(np.uint64)


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of more bits as one of fewer words: parities add up. Positions are taken modulo the size, so halves are XORed."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


class Measure:
    def __init__(self, threshold: Fraction):
        self.t = threshold

    def overlap(self, n: int) -> int:
        return math.ceil(self.t * n)

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + 1

    @property
    def slack_share(self) -> Fraction:
        """Slack for each element: three tenths of what two linked sets may differ in."""
        return (1 - self.t) * Fraction(3, 10)

    def slack(self, n: int) -> int:
        """Largest l: grows with n, so that a partner of t n elements has one nearly as large."""
        return n * self.slack_share.numerator // self.slack_share.denominator + 3

    def slack_of(self, n):
        """slack() of a column."""
        return F.floor(n * self.slack_share.numerator / F.lit(self.slack_share.denominator)).cast("int") + 3

    def prefix_of(self, n):
        """prefix() of a column, in integers."""
        num, den = self.t.numerator, self.t.denominator
        return n - F.floor((n * num + (den - 1)) / F.lit(den)).cast("int") + 1

    def linked(self, common, n_a, n_b):
        """common / union >= t in integers; works on arrays too."""
        return self.t.denominator * common >= self.t.numerator * (n_a + n_b - common)


def _survey(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, keys, checks = [], [], []
            for elements in shingle_sets(_texts(batch), n, seed):
                key, check = set_key(elements) if len(elements) else (0, 0)
                sizes.append(len(elements))
                keys.append(key)
                checks.append(check)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64())], ["id", "n", "key", "check"])

    return run


def _prefixes(n: int, seed: int, measure: Measure, heavy: int):
    """Prefix elements, each class once a chunk. Elements of more than ``heavy`` classes of a chunk are known to be heavy: their rows needn't meet."""

    def emit(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.fromiter(sets, np.int64, len(sets))
        lengths = np.array([min(m, measure.prefix(m) + measure.slack(m) - 1) for m in map(len, sets.values())], np.int64)
        elements = np.concatenate([x[:m] for x, m in zip(sets.values(), lengths, strict=True)] or [np.empty(0, np.uint64)]).view(np.int64)
        owner = np.repeat(np.arange(len(keys)), lengths)
        rank = np.arange(len(elements)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        _, inverse, counts = np.unique(elements, return_inverse=True, return_counts=True)
        known = counts[inverse] > heavy
        witness = np.zeros(len(elements), bool)
        if known.any():
            order = np.flatnonzero(known)
            witness[order[np.unique(elements[order], return_index=True)[1]]] = True
        # rank * 4 + state; state 0: to be counted; 1: known to be heavy; 2: known, and tells the others
        return pa.RecordBatch.from_arrays([pa.array(elements), pa.array(keys[owner]), pa.array(rank * 4 + known + witness)], ["element", "key", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for batch in small_batches(batches, "text"):
            for elements in shingle_sets(_texts(batch), n, seed):
                if len(elements) and (key := set_key(elements)[0]) not in sets:
                    sets[key] = elements
                    size += len(elements)
                    if size > 400_000:
                        yield emit(sets)
                        sets, size = {}, 0
        if sets:
            yield emit(sets)

    return run


def _shared(heavy: int):
    """From rows sorted by (element, key): those whose element belongs to two classes or more, whether it is heavy, and else to how many it belongs. Keeps one element's first rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "rank", "element", "heavy", "count"]
        held: pd.DataFrame | None = None  # the last element's rows so far, while it isn't known to be heavy
        last, last_heavy = None, False
        for batch in _with_end(batches):
            rows = batch.to_pandas() if batch is not None else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("element", "key", "place")})
            rows = rows.assign(rank=rows["place"] // 4, state=rows["place"] % 4)
            flagged = rows[rows["state"] == 1]
            rows = rows[rows["state"] != 1]
            out = [flagged.assign(heavy=True, count=0)[names]] if len(flagged) else []
            if held is not None and len(held):
                rows = pd.concat([held, rows], ignore_index=True)
                held = None
            if last_heavy and len(rows):
                same = rows["element"].to_numpy() == last
                if same.any():
                    out.append(rows[same].assign(heavy=True, count=0)[names])
                    rows = rows[~same]
            rows = rows.drop_duplicates(["element", "key", "state"]) if len(rows) else rows
            if len(rows):
                element = rows["element"].to_numpy()
                starts = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
                counts = np.diff(np.r_[starts, len(rows)])
                told = np.maximum.reduceat(rows["state"].to_numpy(), starts) == 2
                is_heavy = (counts > heavy) | told
                if batch is not None and not is_heavy[-1]:
                    held, rows = rows.iloc[starts[-1] :], rows.iloc[: starts[-1]]
                    counts, is_heavy = counts[:-1], is_heavy[:-1]
                    last_heavy = False
                elif batch is not None:
                    last, last_heavy = element[-1], True
                keep = np.repeat((counts > 1) | is_heavy, counts)
                out.append(rows.assign(heavy=np.repeat(is_heavy, counts), count=np.repeat(counts, counts))[keep][names])
            if out and len(whole := pd.concat(out, ignore_index=True)):
                yield pa.RecordBatch.from_arrays([pa.array(whole["key"], pa.int64()), pa.array(whole["rank"], pa.int32()), pa.array(whole["element"], pa.int64()), pa.array(whole["heavy"].astype(bool)), pa.array(whole["count"], pa.int32())], names)

    return run


def _with_end(batches):
    yield from batches
    yield None


#: Keys that a task remembers as sent.
TASK_KEYS = 1_000_000

#: Blocks of a group: a block is sent to each group that it meets, once, not to each block in it.
TILE = 4

#: Up to so many visits of blocks to groups, they (some 50 bytes each, without data) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_VISITS = 200_000


def _fetch(n: int, seed: int, bits: np.ndarray):
    """Sets and bitmaps of the documents that the bit filter lets pass, each class once from a task."""
    mask = np.uint64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in small_batches(batches, "text"):
            rows = []
            for elements in shingle_sets(_texts(batch), n, seed):
                if not len(elements) or (key := set_key(elements)[0]) in sent:
                    continue
                at = np.uint64(key & 0xFFFFFFFFFFFFFFFF) & mask
                if int(bits[int(at >> np.uint64(6))]) >> int(at & np.uint64(63)) & 1:
                    rows.append((key, len(elements), elements.tobytes(), parity_bitmap(elements).tobytes()))
                    if len(sent) < TASK_KEYS:
                        sent.add(key)
            for at in range(0, len(rows), 1000):
                part = list(zip(*rows[at : at + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.binary())], ["key", "n", "elements", "bitmap"])

    return run


def _likely(measure: Measure):
    """Rows (n_a, n_b, bitmap_a, bitmap_b) -> whether the bitmaps allow a link."""
    t = measure.t

    @F.pandas_udf("boolean")
    def passes(n_a: pd.Series, n_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for m, k, x, y in zip(n_a, n_b, a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
            common = min((m + k - apart) // 2, m, k)
            out.append(t.denominator * common >= t.numerator * (m + k - common))
        return pd.Series(out)

    return passes


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def verify_blocks(a: list, b: list | None, measure: Measure, forest: _Forest | None = None) -> list[tuple[int, int]]:
    """Links between the rows (key, n, elements, bitmap) of two blocks, or within one (b None): a spanning forest of them.

    Pairs are tried from the likeliest on; those whose ends are already connected, in the forest given too, are skipped.
    """
    left, right = a, a if b is None else b
    words = min(len(x[3]) for x in (*left, *right)) // 8
    maps = [np.stack([fold(np.frombuffer(x[3], np.uint64), words) for x in side]) for side in ((left,) if b is None else (left, right))]
    n = [np.array([x[1] for x in side], np.int64) for side in (left, right)]
    sets: dict[int, np.ndarray] = {}
    forest, out = _Forest() if forest is None else forest, []
    t = measure.t
    found = []
    for i in range(len(left)):
        start = i + 1 if b is None else 0
        apart = np.bitwise_count(maps[-1][start:] ^ maps[0][i]).sum(axis=1, dtype=np.int64)
        m, k = n[0][i], n[1][start:]
        common = np.minimum((m + k - apart) // 2, np.minimum(m, k))
        ok = np.flatnonzero(t.denominator * common >= t.numerator * (m + k - common))
        if len(ok):
            found.append(np.stack([np.full(len(ok), i), ok + start, apart[ok]]))
    if not found:
        return out
    pairs = np.concatenate(found, axis=1)
    for i, j, _ in pairs[:, np.argsort(pairs[2], kind="stable")].T.tolist():
        x, y = left[i], right[j]
        if x[0] == y[0] or forest.root(x[0]) == forest.root(y[0]):
            continue
        for z in (x, y):
            if z[0] not in sets:
                sets[z[0]] = np.frombuffer(z[2], np.uint64)
        common = len(np.intersect1d(sets[x[0]], sets[y[0]], assume_unique=True))
        if measure.linked(common, x[1], y[1]):
            forest.join(x[0], y[0])
            out.append((x[0], y[0]))
    return out


_BLOCK = pa.schema([("cluster", pa.int64()), ("block", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("data", pa.binary())])


def _pack(limit_rows: int, limit_elements: int):
    """Rows sorted by (cluster, n) -> blocks of a bounded number of rows and elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cluster, number, size = None, 0, 0

        def block() -> pa.RecordBatch:
            n = [x[1] for x in held]  # in order within a salt alone
            values = (cluster, number, min(n), max(n), pickle.dumps(held))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in small_batches(batches, "elements", 1 << 20):
            columns = (batch.column(c).to_pylist() for c in ("cluster", "key", "n", "elements", "bitmap"))
            for own, *row in zip(*columns, strict=True):
                if held and (own != cluster or len(held) >= limit_rows or size + row[1] > limit_elements):
                    yield block()
                    number = number + 1 if own == cluster else 0
                    held, size = [], 0
                cluster = own
                held.append(tuple(row))
                size += row[1]
        if held:
            yield block()

    return run


def _links(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _compare(measure: Measure):
    """Each block with itself, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _links(verify_blocks(pickle.loads(batch.column("data")[i].as_py()), None, measure))

    return run


def _compare_tiles(measure: Measure):
    """Rows sorted by (cluster, tile, other, place): the blocks of two groups, or of one (other the same), each with those of the other that are near. One group in memory at a time, and a block."""
    t = measure.t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit, held, forest = None, [], _Forest()
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, tile, other, own, least, most, data = (batch.column(c)[i].as_py() for c in ("cluster", "tile", "other", "own", "least", "most", "data"))
                if (cluster, tile, other) != visit:
                    visit, held, forest = (cluster, tile, other), [], _Forest()
                block = pickle.loads(data)
                if own == other:
                    for least_b, most_b, b in held:
                        if least * t.numerator <= most_b * t.denominator and least_b * t.numerator <= most * t.denominator:
                            yield from _links(verify_blocks(block, b, measure, forest))
                if own == tile:
                    held.append((least, most, block))

    return run


def _visits(blocks: DataFrame, threshold: Fraction, size: int) -> DataFrame:
    """Blocks (cluster, id, least, most) in groups of ``size`` neighbours in length -> id, cluster, tile, other, own, place: to which pairs of groups each block goes, as one of group ``own``."""

    def near(least_a, most_a, least_b, most_b):
        return (F.col(least_b) * threshold.numerator <= F.col(most_a) * threshold.denominator) & (F.col(least_a) * threshold.numerator <= F.col(most_b) * threshold.denominator)

    place = F.row_number().over(Window.partitionBy("cluster").orderBy("least", "most", "id"))
    placed = cut(blocks.select("cluster", "id", "least", "most", place.alias("place")).withColumn("own", F.floor((F.col("place") - 1) / size).cast("int")))
    tiles = placed.groupBy("cluster", "own").agg(F.min("least").alias("low"), F.max("most").alias("high"), F.count("*").alias("blocks"))
    left, right = tiles.toDF("cluster", "tile", "low", "high", "blocks"), tiles.toDF("cluster", "other", "low_b", "high_b", "blocks_b")
    pairs = left.join(right, "cluster").where((F.col("tile") < F.col("other")) & near("low", "high", "low_b", "high_b") | (F.col("tile") == F.col("other")) & (F.col("blocks") > 1))
    # a block of either group goes, if it is near the other one
    there = pairs.select("cluster", F.col("tile").alias("own"), "tile", "other", "low_b", "high_b")
    back = pairs.where("tile < other").select("cluster", F.col("other").alias("own"), "tile", "other", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    return placed.join(there.union(back), ["cluster", "own"]).where(near("least", "most", "low_b", "high_b")).select("id", "cluster", "tile", "other", "own", "place")


def link_classes(docs: DataFrame, key: str, text: str, n: int, threshold: Fraction, heavy: int, block_rows: int, block_elements: int, seed: int = 0, verify_cost: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """(survey: id, n, key for every row; links: a, b between classes' keys, a spanning forest; the hashes' seed)."""
    measure = Measure(threshold)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    survey = cut(map_arrow(rows, _survey(n, seed), f"id {kind}, n long, key long, check long"))
    classes = survey.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    if classes.where("low <> high").limit(1).count():
        if seed > 8:
            raise RuntimeError("set keys collide under every seed")
        return link_classes(docs, key, text, n, threshold, heavy, block_rows, block_elements, seed + 1, verify_cost)

    prefixes = map_arrow(rows, _prefixes(n, seed, measure, heavy), "element long, key long, place long")
    # rows that are known to be heavy go anywhere; the rest meet by element
    where = F.when(F.col("place") % 4 == 1, F.xxhash64("element", "key")).otherwise(F.col("element"))
    met = prefixes.withColumn("where", where).repartition(F.col("where")).drop("where").sortWithinPartitions("element", "key")
    shared = map_arrow(met, _shared(heavy), "key long, rank int, element long, heavy boolean, count int").repartition("key").dropDuplicates(["key", "rank"])

    ranked = cut(_chosen(shared.join(classes.select("key", F.col("n").cast("int").alias("n")), "key"), measure, verify_cost))

    light = ranked.where("not heavy").select("element", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("l").alias("l_a"), F.col("heavies").alias("h_a"))
    other = light.toDF("element", "b", "n_b", "l_b", "h_b")
    close = (F.col("n_a") * threshold.denominator >= F.col("n_b") * threshold.numerator) & (F.col("n_b") * threshold.denominator >= F.col("n_a") * threshold.numerator)
    met_pairs = light.join(other, "element").where((F.col("a") < F.col("b")) & close).groupBy("a", "b").agg(F.count("*").alias("common"), F.first(F.least("l_a", "l_b") - F.least("h_a", "h_b")).alias("needed"))
    pairs = cut(met_pairs.where("common >= needed").select("a", "b"))
    crowd = ranked.where("heavy and dense").select(F.col("key").alias("a"), F.col("element").alias("b"))

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(crowd.select("a")).distinct()
    wanted = cut(wanted)
    fetched = map_arrow(rows.select("text"), _fetch(n, seed, bit_filter(wanted)), "key long, n long, elements binary, bitmap binary")
    sets = cut(fetched.join(wanted, "key", "left_semi").dropDuplicates(["key"]))

    maps = sets.select("key", "n", "bitmap")
    both = pairs.join(maps.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("map_a")), "a").join(maps.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("map_b")), "b")
    likely = both.where(_likely(measure)("n_a", "n_b", "map_a", "map_b")).select("a", "b")
    # nodes of the crowd's elements and of documents must not meet: elements become odd, documents even strings
    named = likely.select(F.concat(F.lit("d"), "a").alias("a"), F.concat(F.lit("d"), "b").alias("b")).union(crowd.select(F.concat(F.lit("d"), "a"), F.concat(F.lit("e"), "b")))
    clusters = connected_components(named).where("node like 'd%'").select(F.substring("node", 2, 20).cast("long").alias("key"), "component")
    grouped = sets.join(clusters, "key").withColumn("cluster", F.xxhash64("component"))
    # a large cluster is packed into blocks by several tasks: by size class, and salted beyond some blocks' elements
    sizes = grouped.groupBy("cluster").agg(F.sum("n").alias("size")).where(F.col("size") > 2 * block_elements)
    salt = F.pmod(F.xxhash64("key"), F.coalesce(F.ceil(F.col("size") / (2 * block_elements)), F.lit(1))).cast("int")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).cast("int")
    # a row of sizes stands for 2 * block_elements * 8 bytes of sets at least
    placed = grouped.join(F.broadcast(sizes), "cluster", "left").select("cluster", size_class.alias("class"), salt.alias("salt"), "key", "n", "elements", "bitmap")
    placed = placed.repartition("cluster", "class", "salt").sortWithinPartitions("cluster", "class", "salt", "n").select("cluster", "key", "n", "elements", "bitmap")
    blocks = map_arrow(placed, _pack(block_rows, block_elements), "cluster long, block int, least long, most long, data binary")
    blocks = cut(blocks.withColumn("id", F.monotonically_increasing_id()))
    # a block is compared with itself where it lies; which others it meets is settled without data, and it travels to groups of them
    visits = cut(_visits(blocks.select("cluster", "id", "least", "most"), threshold, TILE))
    sent = blocks.select("id", "least", "most", "data").join(F.broadcast(visits) if visits.count() <= BROADCAST_VISITS else visits, "id")
    met = sent.repartition("cluster", "tile", "other").sortWithinPartitions("cluster", "tile", "other", "place").select("cluster", "tile", "other", "own", "least", "most", "data")
    links = cut(map_arrow(blocks.select("data"), _compare(measure), "a long, b long").union(map_arrow(met, _compare_tiles(measure), "a long, b long")))
    return survey, links, seed


def _chosen(shared: DataFrame, measure: Measure, verify_cost: int) -> DataFrame:
    """(key, n, element, heavy, dense, l, heavies) of the shared elements in the prefix of the l that each document chooses, and of a dense one's heavy elements.

    A candidate for l is tried before each shared element (the prefix just doesn't take it in) and at the
    full slack. Its cost: rows of the lists in the prefix, and verify_cost for each partner that could share
    enough of them. The least l has more light elements than a partner may lack.
    """
    whole = Window.partitionBy("key")
    before = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    is_heavy, n, p, rank = F.col("heavy").cast("int"), F.col("n"), F.col("p"), F.col("rank")
    rows = shared.withColumns({"p": measure.prefix_of(n), "count": F.when(F.col("heavy"), 0).otherwise(F.col("count"))})
    rows = rows.withColumns({"heavies_before": F.coalesce(F.sum(is_heavy).over(before), F.lit(0)), "lists_before": F.coalesce(F.sum("count").over(before), F.lit(0))})
    rows = rows.withColumns({
        "heavies": F.sum(is_heavy).over(whole).cast("int"),
        "lists": F.sum("count").over(whole),
        "met": F.sum((F.col("heavy") & (rank - F.col("heavies_before") < p)).cast("int")).over(whole),
        "length": F.least(n, p + measure.slack_of(n) - 1),
    })
    most = F.col("length") - p + 1
    # a linked partner, which may be smaller, must be able to choose an l beyond the heavy elements met
    dense = (F.col("length") - F.col("heavies") < p) | (F.col("met") + 1 > measure.slack_of(n - p + 1))
    cost = lambda lists, needed: lists * (1 + verify_cost / needed.cast("double"))
    here = rank - p + 1
    tried = F.when(here > F.col("met"), F.struct(cost(F.col("lists_before"), here - F.col("heavies_before")).alias("cost"), here.alias("l")))
    rows = rows.withColumns({"dense": dense, "tried": F.min(tried).over(whole), "last": F.struct(cost(F.col("lists"), F.greatest(most - F.col("heavies"), F.lit(1))).alias("cost"), most.alias("l"))})
    rows = rows.withColumn("l", F.when(F.col("dense"), most).otherwise(F.least("tried", "last")["l"]))
    rows = rows.where(rank < p + F.col("l") - 1).withColumn("heavies", F.sum(is_heavy).over(whole).cast("int"))
    return rows.where(~F.col("heavy") | F.col("dense") & (rank < p)).select("key", "n", "element", "heavy", "dense", "l", "heavies")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: Fraction = Fraction(4, 5), heavy: int = 20, block_rows: int = 512, block_elements: int = 200_000, verify_cost: int = 100) -> DataFrame:
    """key, n_shingles, component_id of every row of docs; component_id is the smallest key that links reach.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. A null, empty or blank text
    has no shingles and is linked with nothing; nor is it with other empty ones. Rows with equal
    sets are linked. Rows with a null key take part and get their component's smallest key (null
    if it has none). Sets are compared by 64-bit hashes of their shingles.
    """
    survey, links, _ = link_classes(docs, key, text, n, threshold, heavy, block_rows, block_elements, verify_cost=verify_cost)
    roots = connected_components(links).withColumnRenamed("node", "key")
    placed = survey.join(roots, "key", "left").withColumn("root", F.coalesce("component", "key"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = placed.withColumn("root", F.when(F.col("n") > 0, F.col("root"))).join(least, "root", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: Fraction = Fraction(4, 5), heavy: int = 20, block_rows: int = 512, block_elements: int = 200_000, verify_cost: int = 100) -> DataFrame:
    """One row of each group that jaccard_components() finds: one with the smallest key (null keys are the largest).

    Rows without shingles all stay. Of each class of equal sets every partition sends on one row,
    so even a class that a third of all rows belong to is no burden for one task.
    """
    columns = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    key, text = (docs.columns[[c.lower() for c in columns].index(x.lower())] for x in (key, text))
    survey, links, seed = link_classes(docs, key, text, n, threshold, heavy, block_rows, block_elements, verify_cost=verify_cost)
    roots = connected_components(links).withColumnRenamed("node", "key")
    classes = survey.where("n > 0").groupBy("key").agg(F.min("id").alias("rep")).join(roots, "key", "left")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key"))
    kept = classes.groupBy(F.coalesce("component", "key").alias("root")).agg(first.alias("first")).select(F.col("first.key").alias("_set"))
    mark = T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            sets = [set_key(x)[0] if len(x) else None for x in shingle_sets(_texts(batch, text), n, seed)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.int64())], names=[*batch.schema.names, "_set"])

    rows = map_arrow(docs, marked, mark)
    order = Window.partitionBy("_set").orderBy(F.col(f"`{key}`").asc_nulls_last())
    one = rows.where("_set is not null").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place").join(kept, "_set", "left_semi")
    return one.drop("_set").unionByName(rows.where("_set is null").drop("_set")).toDF(*columns)
