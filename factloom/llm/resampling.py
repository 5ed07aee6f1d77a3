"""Importance resampling towards a target distribution, by hashed word features in two passes over Arrow batches.

First pass: every partition of the documents, and of the target's texts, counts its features' buckets
into one vector (np.bincount), and treeReduce adds the vectors on the executors. A bucket's gain is
the floored logarithm of its share in the target against its share in the documents. Second pass:
the gains, one small broadcast vector, are gathered for each feature and summed for each document
(np.bincount with weights). The draw without replacement adds Gumbel noise, fixed by the key's
hash, to a document's mean gain; the highest scores are ranked by a sort over ranges of the scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, batch_texts, cut, map_arrow, small_batches, word_pieces

#: Words in lower-cased UTF-8: digits, letters and whatever isn't ASCII.
WORD, NO_WORD = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def feature_buckets(text: bytes, max_words: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text, its number of words and the buckets of its features: all runs of up to max_words words."""
    before: list[bytes] = []
    for words in word_pieces(text.translate(LOWER), WORD, NO_WORD):
        features = words
        for n in range(2, max_words + 1):
            run = before[1 - n :] + words  # every run of n words that ends in this piece
            features = features + [b" ".join(run[i : i + n]) for i in range(len(run) - n + 1)]
        yield len(words), np.fromiter(map(crc32, features), np.uint32, len(features)) % buckets
        if max_words > 1:
            before = (before + words)[1 - max_words :]


def bucket_counts(texts: DataFrame, text: str, max_words: int, buckets: int) -> np.ndarray:
    """How many features all rows have in each bucket: a vector for each partition, added up by treeReduce."""
    rows = texts.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small_batches(batches, "text"):
            parts = [b for t in batch_texts(batch) for _, b in feature_buckets(t, max_words, buckets)]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = map_arrow(rows, count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    n = vectors.getNumPartitions()
    # so deep that some hundred vectors at most meet in one place
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(max(n, 1), 100)))) if n else np.zeros(buckets, np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target against that in the source."""
    n = len(source)
    s, t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, key: str, text: str, max_words: int) -> DataFrame:
    """key, n_words, n_features and weight, the floored mean gain of each row's features (0 without any)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    known, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            n = batch.num_rows
            found = [(i, w, b) for i, t in enumerate(batch_texts(batch)) for w, b in feature_buckets(t, max_words, buckets)]
            row = np.array([i for i, _, _ in found], np.int64)
            sizes = np.array([len(b) for _, _, b in found], np.int64)
            words = np.bincount(row, weights=[w for _, w, _ in found], minlength=n).astype(np.int64)
            features = np.bincount(row, weights=sizes, minlength=n).astype(np.int64)
            all_buckets = np.concatenate([b for _, _, b in found]) if found else np.zeros(0, np.uint32)
            # whole numbers far below 2**53: sums in doubles are exact
            sums = np.bincount(np.repeat(row, sizes), weights=known.value[all_buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words), pa.array(features), pa.array(sums // np.maximum(features, 1))], ["key", "n_words", "n_features", "weight"])

    return map_arrow(rows, weigh, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:key")."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add each row's place (from 1) in the order, by a sort over ranges; only counts of partitions reach the driver. Rows that tie take the places in any order."""
    rows = cut(rows)  # the ranges are found in one reading and dealt out in another
    placed = cut(rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    spark = rows.sparkSession
    first = F.broadcast(spark.createDataFrame(starts, "_part long, _first long"))  # a row for each partition
    return placed.join(first, part == F.col("_part")).withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_first")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of docs, drawn towards the texts of target.

    Of the N rows with min_words words at least, the floor(percent * N / 100) highest scores are
    drawn and ranked from 1, ties to the smaller key; other rows have a null rank. Null and empty
    texts have no features and weight 0. Null keys come last among ties and share one noise value;
    repeated rows take neighbouring ranks. Empty tables count as no features; other columns are
    dropped. Texts are read in pieces of about 1 MB, whatever their length.
    """
    gains = bucket_gains(bucket_counts(docs, text, max_words, buckets), bucket_counts(target, text, max_words, buckets))
    scored = weighted(docs, gains, key, text, max_words).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("_in", F.col("n_words") >= min_words)
    placed = numbered(scored, [F.desc("_in"), F.desc("score"), F.asc_nulls_last("key")], "rank")
    drawn = placed.where("_in").count() * percent // 100
    rank = F.when(F.col("_in") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
