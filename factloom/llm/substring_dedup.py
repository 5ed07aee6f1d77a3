"""Removal of passages that repeat, by a log-structured index of window fingerprints.

A window is ``window`` consecutive words. Every window has an anchor: of the k-grams inside it (k is
``anchor`` words) the leftmost with the smallest hash. Equal windows have equal anchors at equal
offsets, so it is enough to index the anchors, about 2 in (window - anchor + 2) positions.

The index is made of runs: immutable, sorted by fingerprint, bucketed by it. A new batch becomes a
run, finds repeats within itself, and is merge-joined with each older run, both ways: new rows
whose fingerprint an older run has, and older rows that the batch repeats. Beyond ``fanout`` runs the
older ones are compacted into one, bucket by bucket, before the next batch comes. What matches is
verified by the full windows' hashes before any word is removed.

An index lives in a folder and can be opened again, so that later documents are checked against
all that came before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import grams
from factloom.llm.common import batch_texts as _texts
from factloom.llm.common import bit_filter, cut, fresh_path, map_arrow, remove, small_batches


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of some texts' words: for each anchor its position, first and last window (all as word numbers), text and fingerprint."""
    fingerprints = grams.grams(hashes, anchor)
    inside = window - anchor + 1
    starts = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if starts <= 0:
        return none, none, none, none, np.empty(0, np.uint64)
    position = np.lib.stride_tricks.sliding_window_view(fingerprints, inside)[:starts].argmin(axis=1) + np.arange(starts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[:starts] == text[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, np.empty(0, np.uint64)
    position, owner = position[at], text[at]
    new = np.flatnonzero(np.r_[True, (position[1:] != position[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:] - 1, len(at) - 1]
    return position[new], at[new], at[last], owner[new], fingerprints[position[new]]


def text_keys(texts: list[bytes], hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's word sequence."""
    out = np.zeros((2, len(texts)), np.uint64)
    if len(hashes):
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
        full = np.flatnonzero(np.diff(first))
        for i, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            parts = grams.mix(hashes + grams.mix(place + np.uint64(salt)))
            out[i, full] = np.add.reduceat(parts, first[:-1][full])
    return grams.mix(out[0]).view(np.int64), grams.mix(out[1]).view(np.int64)


ANCHOR = "struct<print:long,spot:long,alike:long,state:byte>"
#: Repeated anchors that a task remembers.
TASK_PRINTS = 200_000


def _hashes(window: int, anchor: int):
    """(id, key, check, n, anchors) of every text. A text that stands in a chunk before has no anchors.

    An anchor's spot packs its first window, how far the anchor stands behind it, and how many windows follow;
    alike is a hash of all its windows. An anchor that is alike another one of the task's chunks repeats for sure:
    state 1, but for the first of them, the ``witness`` (2), which meets other tasks' rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.empty(0, np.uint64)  # what has a witness
        for batch in small_batches(batches, "text"):
            for start, part in grams.chunks(_texts(batch)):
                hashes, first = grams.words(part)
                keys, checks = text_keys(part, hashes, first)
                position, low, high, owner, prints = anchors(hashes, first, window, anchor)
                place = (position - first[owner]).astype(np.int32)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(grams.mix(grams.window_sums(hashes, window)))))
                alike = grams.mix(grams.mix(total[high + 1] - total[low] + prints) + ((position - low) * 64 + high - low).astype(np.uint64)) if len(position) else prints
                order = np.lexsort((owner, place, keys[owner], alike))
                alike, prints, owner, place, low, high = alike[order], prints[order], owner[order], place[order], (low - first[owner])[order], (high - first[owner])[order]
                own = keys[owner]
                fresh = np.ones(len(prints), bool)
                fresh[1:] = (alike[1:] != alike[:-1]) | (own[1:] != own[:-1]) | (place[1:] != place[:-1])
                alike, prints, owner, place, low, high = alike[fresh], prints[fresh], owner[fresh], place[fresh], low[fresh], high[fresh]
                begin = np.flatnonzero(np.r_[len(prints) > 0, alike[1:] != alike[:-1]])
                counts = np.diff(np.r_[begin, len(prints)])
                before = np.isin(alike[begin], told)
                state = np.repeat((counts > 1) | before, counts).astype(np.int8)
                new = begin[(counts > 1) & ~before]
                state[new] = 2
                told = np.concatenate((told, alike[new]))[-TASK_PRINTS:]
                order = np.lexsort((place, owner))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(part))))).astype(np.int32)
                spot = (low[order] * 32 + place[order] - low[order]) * 32 + (high - low)[order]
                rows = pa.StructArray.from_arrays([pa.array(prints[order].view(np.int64)), pa.array(spot.astype(np.int64)), pa.array(alike[order].view(np.int64)), pa.array(state[order])], ["print", "spot", "alike", "state"])
                ids = batch.column("id").slice(start, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(checks), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["id", "key", "check", "n", "anchors"])

    return run


ROW = "print long, key long, spot long, alike long, state byte"
#: As stored: state 1 has its fingerprint in real and a random place as print, state 2 has real equal to print, state 0 null.
STORED = "print long, key long, spot long, alike long, real long"
OPEN, KNOWN = "real is null", "real <> print"


def spread(rows: DataFrame) -> DataFrame:
    """Rows as the index takes them: those known to repeat needn't meet others and are dealt out at random."""
    known = F.col("state") == 1
    return rows.select(F.when(known, F.xxhash64("print", "key", "spot")).otherwise(F.col("print")).alias("print"), "key", "spot", "alike", F.when(F.col("state") > 0, F.col("print")).alias("real"))


class FingerprintIndex:
    """Runs of rows (STORED) as tables in a folder, bucketed and sorted by print.

    A run's folder names the batches that it covers, so an index that a lost driver left behind opens in
    its last whole state: runs without Spark's mark of success, or covered by a compacted one, don't count.
    All tasks and the driver must see the folder (default: a fresh one in the shared folder).

    add() returns the rows (print, key, spot, alike), new and old, that repeat because of the batch, and for
    those of older batches that are all alike one at least. Equal (print, key, spot) is the same
    place, not a repeat: a batch may bring a text again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 35, anchor: int = 16, buckets: int | None = None, fanout: int = 4):
        self.spark, self.window, self.anchor, self.fanout = spark, window, anchor, fanout
        self.folder = folder or fresh_path(spark, "fingerprints")
        self.session = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.runs: list[tuple[int, int]] = []
        found = self._found()
        kept = [(a, b) for w, k, _, a, b in found if (w, k) == (window, anchor)]
        if len(kept) < len(found):
            raise ValueError("the index was made with another window or anchor")
        self.buckets = found[0][2] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for a, b in sorted(kept):
            if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in kept):
                self._register((a, b))
                self.runs.append((a, b))

    def _found(self) -> list[tuple[int, ...]]:
        """window, anchor, buckets, first and last batch of each whole run in the folder."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return []
        names = [x.getPath() for x in fs.listStatus(target)]
        mark = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        return [tuple(map(int, p.getName().split("-")[1:])) for p in names if p.getName().startswith("run-") and fs.exists(mark(p))]

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{self.window}-{self.anchor}-{self.buckets}-{run[0]}-{run[1]}"

    def _name(self, run: tuple[int, int]) -> str:
        return f"{self.session}_{run[0]}_{run[1]}"

    def _register(self, run: tuple[int, int]) -> None:
        self.spark.sql(f"CREATE TABLE {self._name(run)} ({STORED}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self._path(run)}'")

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, "print").sortBy("print").option("path", self._path(run)).saveAsTable(self._name(run))

    def table(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.table(self._name(run))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of rows (ROW), and compact first if there are more than fanout runs."""
        self.compact()
        number = self.runs[-1][1] + 1 if self.runs else 0
        run = (number, number)
        rows = spread(batch).repartition(self.buckets, "print")
        # a place stands once in a run; the aggregation finds rows where the exchange put them
        rows = rows.groupBy("print", "key", "spot").agg(F.max("alike").alias("alike"), F.max("real").alias("real"))
        self._write(rows, run)
        new = self.table(run)
        fresh = new.where(OPEN)
        found = [new.where("real is not null"), self._other(fresh, new)]
        for other in self.runs:
            old = self.table(other)
            found += [self._other(fresh, old), self._other(old.where(f"not coalesce({KNOWN}, false)"), new)]
        self.runs.append(run)
        return _union(found).select(F.coalesce("real", "print").alias("print"), "key", "spot", "alike")

    @staticmethod
    def _other(rows: DataFrame, against: DataFrame) -> DataFrame:
        """rows whose fingerprint stands at another place in against: a merge of sorted runs that makes no pairs."""
        place = F.xxhash64("key", "spot")
        ends = against.where(f"not coalesce({KNOWN}, false)").groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b"))
        return rows.hint("merge").join(ends, "print").where((F.col("a") != place) | (F.col("b") != place)).drop("a", "b")

    def keys(self) -> DataFrame:
        """Keys of all texts of a window's length or more."""
        return _union([self.table(r).select("key") for r in self.runs]).distinct()

    def compact(self) -> None:
        """Make one run of all runs if there are more than fanout; the old ones go.

        Runs are merged by full joins of their sorted buckets: a task reads one bucket of every run and
        writes that bucket of the new one, and nothing is shuffled. A place that several runs have stays once.
        """
        if len(self.runs) <= self.fanout:
            return
        whole = (self.runs[0][0], self.runs[-1][1])
        # buckets are by print alone, which is enough for runs to meet by print, key and spot
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            self._write(reduce(self._merged, map(self.table, self.runs)), whole)
        finally:
            self.spark.conf.set(setting, before)
        old, self.runs = self.runs, [whole]
        for run in old:
            self._forget(run)

    @staticmethod
    def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
        place = ["print", "key", "spot"]
        names = [c for c in one.columns if c not in place]
        both = one.hint("merge").join(other.toDF(*(c if c in place else f"{c}_" for c in other.columns)), place, "full")
        return both.select(*place, *(F.greatest(c, f"{c}_").alias(c) for c in names)).select(*one.columns)

    def _forget(self, run: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        remove(self.spark, self._path(run))

    def close(self) -> None:
        """Take the tables out of this session's catalogue; the folder stays."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        self.runs = []

    def drop(self) -> None:
        """Delete the index, unfinished runs too."""
        self.close()
        remove(self.spark, self.folder)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _passes(keys: np.ndarray, bits: np.ndarray, mask: np.uint64) -> np.ndarray:
    at = keys.view(np.uint64) & mask
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Keys that a task remembers as sent.
TASK_KEYS = 1_000_000


def _keyed(bits: np.ndarray, whole: np.ndarray | None = None, once: bool = False):
    """(id, key, packed): texts whose key the bit filter lets pass and whole doesn't hold, compressed for the shuffle. once: equal texts go only once from a task."""
    import zstandard

    mask = np.uint64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in small_batches(batches, "text"):
            for start, part in grams.chunks(_texts(batch)):
                hashes, first = grams.words(part)
                keys, _ = text_keys(part, hashes, first)
                take = np.flatnonzero(_passes(keys, bits, mask) & ~_held(keys, whole))
                if once:
                    take = np.array([i for i in take if (k := int(keys[i])) not in sent and (len(sent) >= TASK_KEYS or not sent.add(k))], np.int64)
                if len(take):
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take + start)), pa.array(keys[take]), pa.array([pack.compress(part[i]) for i in take], pa.binary())], ["id", "key", "packed"])

    return run


def _held(keys: np.ndarray, whole: np.ndarray | None) -> np.ndarray:
    """Whether a sorted array holds the keys."""
    if whole is None or not len(whole):
        return np.zeros(len(keys), bool)
    return whole[np.minimum(np.searchsorted(whole, keys), len(whole) - 1)] == keys


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in batch.column("packed").to_pylist()]


WINDOWS = "print long, key long, low int, offset int, sums array<long>, known int"


def _windows(window: int):
    """Of texts with their candidate anchors: the hashes of each anchor's windows. Windows that repeat in a chunk are ``known``; a row with only such, but for one witness each, carries no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "packed", 2 << 20):
            texts, keys = _unpacked(batch), batch.column("key").to_numpy(zero_copy_only=False)
            spots = batch.column("spots")
            lengths = np.diff(spots.offsets.to_numpy())
            ends = np.cumsum(lengths)
            flat = spots.flatten()
            spot = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("print", "place", "low", "more")}
            for start, part in grams.chunks(texts):
                hashes, first = grams.words(part)
                sums = grams.window_sums(hashes, window)
                chosen = slice(int(ends[start] - lengths[start]), int(ends[start + len(part) - 1]))
                owner = np.repeat(np.arange(len(part)), lengths[start : start + len(part)])
                prints, place, low, more = (spot[c][chosen] for c in ("print", "place", "low", "more"))
                if not len(prints):
                    continue
                own = keys[start : start + len(part)][owner]
                _, fresh = np.unique(np.stack([own, low.astype(np.int64)]), axis=1, return_index=True)
                own, prints, place, low, owner, count = own[fresh], prints[fresh], place[fresh], low[fresh], owner[fresh], more[fresh].astype(np.int64) + 1
                row = np.repeat(np.arange(len(own)), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                values = sums[(first[owner] + low)[row] + step].view(np.int64)
                _, leader, inverse, number = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
                repeats = number[inverse] > 1
                needed = ~repeats
                needed[leader] = True
                known = np.bincount(row, weights=np.where(repeats, 1 << step, 0), minlength=len(own)).astype(np.int32)
                open_row = np.bincount(row, weights=needed, minlength=len(own)) > 0
                sent = open_row[row]
                offsets = np.cumsum(np.r_[0, np.where(open_row, count, 0)])
                yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(own), pa.array(low.astype(np.int32)), pa.array((place - low).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[sent])), pa.array(known)], ["print", "key", "low", "offset", "sums", "known"])

    return run


STRIPPED = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]


def _stripped(ids, found: list[tuple[int, bytes]], n_kept: list[int]) -> pa.RecordBatch:
    texts = [kept for _, kept in found]
    digests = [hashlib.sha256(x).hexdigest() for x in texts]
    removed = [n - k for (n, _), k in zip(found, n_kept, strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in found], pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], STRIPPED)


def _strip(window: int):
    """Whole texts and the masks of their repeated windows -> what is left, as digests and as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "packed", 2 << 20):
            found, n_kept = [], []
            for text, spans, whole in zip(_unpacked(batch), batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                words = kept = text.split()
                if whole and len(words) >= window:
                    kept = []
                elif spans:
                    starts = np.concatenate([s["low"] + np.flatnonzero([s["mask"] >> i & 1 for i in range(31)]) for s in spans])
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                found.append((len(words), b" ".join(kept)))
                n_kept.append(len(kept))
            yield _stripped(batch.column("id"), found, n_kept)

    return run


def _settled(bits: np.ndarray, whole: np.ndarray | None):
    """Texts that surely have no repeated window, whose words are all kept, and those that stand elsewhere as a whole, which lose all."""
    mask = np.uint64(len(bits) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            for start, part in grams.chunks(_texts(batch)):
                hashes, first = grams.words(part)
                keys = text_keys(part, hashes, first)[0]
                gone = _held(keys, whole)
                take = np.flatnonzero(~_passes(keys, bits, mask) | gone)
                if len(take):
                    found = [(len(w), b"" if gone[i] else b" ".join(w)) for i, w in ((i, part[i].split()) for i in take)]
                    yield _stripped(batch.column("id").take(pa.array(take + start)), found, [0 if gone[i] else n for i, (n, _) in zip(take, found, strict=True)])

    return run


#: Keys of texts that stand elsewhere as a whole which scans get as a sorted array, 16 MB; beyond, such texts are shuffled with the others.
MAX_WHOLE = 1 << 21


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, anchor: int = 16, batches: int = 3, keep_text: bool = True, fanout: int = 1, index: FingerprintIndex | None = None, history: DataFrame | None = None, max_whole: int = MAX_WHOLE) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and (keep_text) kept_text of every row of docs.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window that
    covers it has its word sequence start anywhere else in docs too, in the same text or another;
    all windows are judged on the input. Texts with fewer words than a window keep all of them; a
    null text has none. Rows with equal word sequences (repeated rows too) count as other places,
    so all their words go if they have a window. Windows are equal by two 64-bit hashes (anchor
    and whole window). Columns of docs but key and text are not looked at.

    The table enters the index in ``batches`` parts; by default a fresh index that goes in the end,
    and with fanout 1 the first two batches are compacted before the third comes. With an index
    of one's own, which holds the documents of ``history`` (same columns), docs are added to it and judged
    against these too. What is shuffled is one row for each anchor, hashes of the windows of anchors
    that repeat among other windows, and the texts that have any, but not those that stand elsewhere as a whole.
    """
    if window - anchor + 1 > 31:
        raise ValueError("an anchor may have at most 31 windows")
    if (index is None) != (history is None):
        raise ValueError("an index and the documents that it holds go together")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    path = fresh_path(spark, "anchors")
    own = index or FingerprintIndex(spark, None, window, anchor, fanout=fanout)
    try:
        if (own.window, own.anchor) != (window, anchor):
            raise ValueError("the index has another window or anchor")
        map_arrow(rows, _hashes(window, anchor), f"id {kind}, key long, check long, n long, anchors array<{ANCHOR}>").drop("id").write.parquet(path)
        hashed = spark.read.parquet(path)
        copies = cut(hashed.groupBy("key").agg(F.count("*").alias("n_rows"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")).where("n_rows > 1"))
        if copies.where("low <> high").limit(1).count():
            raise RuntimeError("two texts share a 64-bit key")
        whole = copies.where(F.col("n") >= window).select("key")
        if own.runs:
            whole = cut(whole.union(hashed.where(F.col("n") >= window).select("key").join(own.keys(), "key", "left_semi")).distinct())
        found = []
        for b in range(batches):
            part = hashed.where((F.pmod(F.xxhash64("key"), F.lit(batches)) == b) & (F.size("anchors") > 0)).select("key", F.explode("anchors").alias("x"))
            found.append(cut(own.add(part.select("x.print", "key", "x.spot", "x.alike", "x.state"))))
    finally:
        if index is None:
            own.drop()
        remove(spark, path)
    known, unsure = _alike(_union(found).dropDuplicates(["key", "spot"]))
    spots = cut(unsure.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "print", "low", "more"))).alias("spots")))

    packed = f"id {kind}, key long, packed binary"
    texts = rows.select("text") if history is None else rows.select("text").union(history.select(F.col(f"`{text}`").cast("string")))
    texts = map_arrow(texts.select(F.lit(0).alias("id"), "text"), _keyed(bit_filter(spots.select("key")), once=True), "id int, key long, packed binary")
    windows = map_arrow(texts.select("key", "packed").join(spots, "key"), _windows(window), WINDOWS)
    masks = known.unionByName(_matched(windows)).groupBy("key", "low").agg(F.bit_or("mask").alias("mask"))
    spans = masks.groupBy("key").agg(F.collect_list(F.struct("low", "mask")).alias("spans"))

    gone, exact = None, whole.count() <= max_whole
    if exact:
        gone = np.sort(whole.toPandas()["key"].to_numpy(np.int64))
        spans = cut(spans.join(whole, "key", "left_anti").withColumn("whole", F.lit(False)))
    else:
        spans = cut(spans.join(whole.withColumn("whole", F.lit(True)), "key", "full").select("key", F.when(F.col("whole").isNull(), F.col("spans")).alias("spans"), F.coalesce("whole", F.lit(False)).alias("whole")))
    bits = bit_filter(spans.select("key"))
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    touched = map_arrow(rows, _keyed(bits, gone), packed).join(spans, "key", "left").select("id", "packed", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = map_arrow(touched, _strip(window), schema).unionByName(map_arrow(rows, _settled(bits, gone), schema))
    out = out.withColumnRenamed("id", key)
    return out if keep_text else out.drop("kept_text")


def _alike(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate anchors -> (key, low, mask) of those that are alike another one, so that all their windows repeat, and (key, print, place, low, more) of those whose windows must be compared.

    Windows are compared between anchors of one fingerprint that aren't alike, one of each kind.
    """
    rows = cut(found)
    kinds = rows.groupBy("print", "alike").agg(F.count("*").alias("n"), F.min(F.struct("key", "spot")).alias("first"))
    several = kinds.groupBy("print").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = kinds.join(several, "print", "left").where("n > 1 or kinds > 1")
    more, offset, low = F.col("spot").bitwiseAND(31).cast("int"), F.shiftright("spot", 5).bitwiseAND(31).cast("int"), F.shiftright("spot", 10).cast("int")
    met = _by_key(rows, "print", "alike").join(_by_key(kinds, "print", "alike"), ["print", "alike", "_k"]).withColumns({"more": more, "low": low, "place": low + offset})
    full = F.expr("cast(shiftleft(1L, more + 1) - 1 as int)")
    return met.where("n > 1").select("key", "low", full.alias("mask")), met.where((F.col("kinds") > 1) & (F.col("first.key") == F.col("key")) & (F.col("first.spot") == F.col("spot"))).select("key", "print", "place", "low", "more")


def _by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with one more key, which makes a join of an aggregate shuffle both sides anew: only such joins does Spark split where a key has very many rows."""
    return rows.withColumn("_k", F.xxhash64(*keys))


def _matched(windows: DataFrame) -> DataFrame:
    """(key, low, mask): which windows of an anchor start elsewhere too."""
    met = cut(windows)
    each = met.where(F.size("sums") > 0).select("print", "key", "low", F.posexplode("sums").alias("step", "sum"))
    spot = F.xxhash64("key", F.col("low") + F.col("step"))
    # the ends of a window's places are aggregated before they are shuffled
    ends = each.groupBy("print", "sum").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select("print", "sum")
    again = _by_key(each, "print", "sum").join(_by_key(ends, "print", "sum"), ["print", "sum", "_k"])
    bit = F.call_function("shiftleft", F.lit(1), F.col("step"))
    return again.select("key", "low", bit.alias("mask")).union(met.where("known <> 0").select("key", "low", "known"))
