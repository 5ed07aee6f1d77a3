"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's score is the sum of its partial scores over ``slices`` groups of components: one score
list for each slice. Phase 1: every block of rows gives the best k of each of its lists; their full
scores are summed up, and a query's k-th best over all blocks is a cutoff that its k-th answer
can't be below. Phase 2: the cutoff goes back with the queries; each list gives up all entries of
at least cutoff / slices. A row that no list gives up scores less than the cutoff. Phase 3: of the
rows given up, those whose known parts and bounds can still reach the cutoff get their exact
scores; each block returns its k best.

Slices of a row lie in one block, so entries of phases 2 and 3 never leave their task; what is
shuffled are k scores for each query and block. Queries and rows meet in blocks of a bounded number
of vectors, components as the smallest integers that hold them. Phase 2 computes the partial scores
anew: lists of all of them would be far larger than the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import cut

#: Sums of products below this are exact as doubles.
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)
#: Scores below this can be summed up in 64 bits; beyond, a block has one list of whole scores.
SUMMABLE = 1 << 61


def _bound(queries: np.ndarray, rows: np.ndarray) -> float:
    """No score or partial score is beyond this."""
    return float(_most(queries)) * float(_most(rows)) * max(1, queries.shape[1])


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: by BLAS where doubles hold them exactly, in 64 bits where those do, else unbounded and then cut."""
    bound = _bound(queries, rows)
    if bound < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < SUMMABLE:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    return np.clip(queries.astype(object) @ rows.astype(object).T, *LONG).astype(np.int64)


def _pack(batch: pd.DataFrame) -> list[tuple]:
    """Rows (vec_id, values) of one length as (ids, matrix, type) in the smallest integer type."""
    matrix = np.array(batch["values"].tolist(), dtype=np.int64).reshape(len(batch), -1)
    most = int(np.abs(matrix.astype(np.float64)).max()) if matrix.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return batch["vec_id"].to_numpy(np.int64).tobytes(), matrix.astype(kind).tobytes(), np.dtype(kind).str


def _blocks(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        columns = ["length", "n", "ids", "matrix", "kind"]
        for batch in batches:
            out = []
            for length, rows in batch.groupby(batch["values"].map(len)):
                rows = pd.concat([held.pop(length), rows]) if length in held else rows
                while len(rows) >= limit:
                    out.append((length, limit, *_pack(rows.iloc[:limit])))
                    rows = rows.iloc[limit:]
                held[length] = rows
            if out:
                yield pd.DataFrame(out, columns=columns)
        rest = [(length, len(rows), *_pack(rows)) for length, rows in held.items() if len(rows)]
        if rest:
            yield pd.DataFrame(rest, columns=columns)

    return run


def _matrix(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(kind)).reshape(n, -1)


def _slices(width: int, slices: int) -> list[slice]:
    edges = np.linspace(0, width, min(slices, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def phase_one(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, exact score) of the rows that stand among the best k of any of the local lists, the k best of them."""
    slices = slices if _bound(queries, rows) < SUMMABLE else 1
    parts = [_product(queries[:, s], rows[:, s]) for s in _slices(queries.shape[1], slices)]
    total = sum(parts[1:], parts[0])
    own = query_ids[:, None] == ids[None, :]
    mine, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    parts = [np.where(own, LONG[0], part) for part in parts]
    m = min(k, len(ids))
    top = np.concatenate([np.argpartition(part, len(ids) - m, axis=1)[:, len(ids) - m :] for part in parts], axis=1)
    for i in range(len(queries)):
        best = np.unique(top[i])
        best = best[~own[i, best]]
        found = np.sort(total[i, best])[::-1][:k]
        mine.append(np.full(len(found), i))
        scores.append(found)
    return np.concatenate(mine), np.concatenate(scores)


def phases_two_three(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, cutoffs: np.ndarray, k: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, score) of this block's k best rows that reach the cutoff."""
    cuts = _slices(queries.shape[1], slices if _bound(queries, rows) < SUMMABLE else 1)
    share = -(-cutoffs // len(cuts))  # an entry below the ceiling of cutoff / slices is below cutoff / slices
    known = np.zeros((len(queries), len(ids)), np.int64)
    missing = np.zeros((len(queries), len(ids)), np.int8)
    given = np.zeros((len(queries), len(ids)), bool)
    for s in cuts:
        part = _product(queries[:, s], rows[:, s])
        sent = part >= share[:, None]
        given |= sent
        known += np.where(sent, part, 0)
        missing += ~sent
    given &= query_ids[:, None] != ids[None, :]
    # a list that didn't give the row up holds at most share - 1 of it
    if len(cuts) > 1:
        given &= known + missing * (share[:, None] - 1) >= cutoffs[:, None]
    who, row = np.nonzero(given)
    scores = np.empty(len(who), np.int64)
    for at in range(0, len(who), 1 << 16):
        a, b = queries[who[at : at + (1 << 16)]], rows[row[at : at + (1 << 16)]]
        if _bound(queries, rows) < SUMMABLE:
            scores[at : at + (1 << 16)] = np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
        else:
            scores[at : at + (1 << 16)] = np.clip((a.astype(object) * b.astype(object)).sum(axis=1), *LONG).astype(np.int64)
    order = np.lexsort((ids[row], -scores, who))
    who, row, scores = who[order], row[order], scores[order]
    start = np.r_[0, np.flatnonzero(np.diff(who)) + 1] if len(who) else np.empty(0, np.int64)
    place = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
    keep = (place < k) & (scores >= cutoffs[who])
    return who[keep], ids[row[keep]], scores[keep]


def _most(x: np.ndarray) -> int:
    return int(np.abs(x.astype(np.float64)).max()) if x.size else 0


def quantised(vector, scale: int):
    """floor(scale * x) of every component as long; null for a vector that is null or has a component that is null, not finite or too large."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    good = F.forall(vector, lambda v: F.coalesce((F.abs(v.cast("double") * scale) < 9e18) & ~F.isnan(v), F.lit(False)))
    return F.when(vector.isNotNull() & good, x)


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, slices: int = 2, row_block: int = 8192, query_block: int = 1024, max_broadcast: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries its k best rows of vectors by integer inner product.

    Both tables hold key and vector. Ties go to the smaller key; rows with the query's own key are no
    candidates, and a key that stands in several rows is a candidate as often. Vectors meet those
    of their own length; empty ones score 0. Null keys, null vectors and vectors with a null or
    non-finite component (or one beyond 9e18 after scaling) take no part. Scores beyond 64 bits
    are cut to the largest or smallest long. A query with fewer candidates gets them all.

    Queries' blocks are broadcast if they take at most max_broadcast bytes, else shuffled by block.
    """
    spark = vectors.sparkSession
    shape = "length int, n int, ids binary, matrix binary, kind string"

    def packed(df: DataFrame, limit: int) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`"), scale).alias("values")).where("vec_id is not null and values is not null")
        n = rows.count()
        spread = rows.repartition(max(1, math.ceil(n / limit)))
        return cut(spread.mapInPandas(_blocks(limit), shape).withColumn("block", F.monotonically_increasing_id()))

    row_blocks, query_blocks = packed(vectors, row_block), packed(queries, query_block)
    rows = row_blocks.select(F.col("block").alias("row_block"), F.col("length").alias("row_length"), F.col("n").alias("rn"), F.col("ids").alias("rids"), F.col("matrix").alias("rmatrix"), F.col("kind").alias("rkind"))
    size = query_blocks.agg(F.sum(F.octet_length("matrix") + F.octet_length("ids"))).first()[0] or 0
    n_blocks = row_blocks.count()

    def meet(queries: DataFrame) -> DataFrame:
        """Every query block beside every row block of its length: the stated all-against-all, block by block."""
        if size <= max_broadcast:
            return rows.join(F.broadcast(queries), F.col("row_length") == F.col("length"))
        # which blocks meet is settled without their data, by length and (as most vectors share one) a salt; data travels by block
        salts = math.ceil(n_blocks / 1000)
        here = rows.select("row_block", "row_length", F.pmod("row_block", F.lit(salts)).alias("salt"))
        there = query_blocks.select("block", "length", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("there"))
        pairs = here.join(there, (F.col("row_length") == F.col("length")) & (F.col("salt") == F.col("there"))).select("block", "row_block")
        return pairs.join(queries, "block").join(rows, "row_block")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, x = _matrix(r.matrix, r.kind, r.n), _matrix(r.rmatrix, r.rkind, r.rn)
                who, scores = phase_one(q, np.frombuffer(r.ids, np.int64), x, np.frombuffer(r.rids, np.int64), k, slices)
                yield pd.DataFrame({"block": r.block, "who": who.astype(np.int32), "score": scores})

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q, x = _matrix(r.matrix, r.kind, r.n), _matrix(r.rmatrix, r.rkind, r.rn)
                cutoffs = np.full(r.n, LONG[0] // 4, np.int64)
                for item in r.cutoffs if r.cutoffs is not None else ():
                    cutoffs[item["who"]] = item["cutoff"]
                ids = np.frombuffer(r.ids, np.int64)
                who, row, scores = phases_two_three(q, ids, x, np.frombuffer(r.rids, np.int64), cutoffs, k, slices)
                yield pd.DataFrame({"block": r.block, "who": who.astype(np.int32), "query_id": ids[who], "vec_id": row, "score": scores})

    local = meet(query_blocks).mapInPandas(first, "block long, who int, score long")
    ranked = Window.partitionBy("block", "who").orderBy(F.desc("score"))
    cutoffs = local.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).groupBy("block", "who").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") >= k)
    cutoffs = cut(cutoffs.groupBy("block").agg(F.collect_list(F.struct("who", "cutoff")).alias("cutoffs")))
    told = query_blocks.join(cutoffs, "block", "left")
    best = meet(told).mapInPandas(second, "block long, who int, query_id long, vec_id long, score long")
    final = Window.partitionBy("block", "who").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
