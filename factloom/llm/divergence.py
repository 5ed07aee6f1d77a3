"""How sources of a language diverge in their words: exact L1 distances between all groups, and each group's telling terms.

Every task counts its documents' terms into one dictionary for each group before anything is
shuffled. A language keeps the terms of enough of its documents; a kept term's counts in all
groups form one posting list. Shares are whole numbers, so all sums are exact in any order.

The distance of two groups is a sum over all kept terms, most of which neither holds. It starts
from V times the distance of two absent terms; tiles of terms add what differs from that, and
each tile splits its terms. *Heavy* ones, which many groups hold, fill a dense matrix that is
compared row against row. *Light* ones stay posting lists: a group's light shares, sorted once,
give the correction against every group that lacks them, and pairs within a short posting list
correct for terms that both hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, batch_texts, cut, map_arrow, small_batches, word_pieces

#: Letters in lower-cased UTF-8: a to z and whatever isn't ASCII.
TERM, NO_TERM = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms that a task counts before it hands them on; groups of a block; shares of a tile; terms of a tile.
MAX_COUNTED, BLOCK, CELLS, WIDTH = 250_000, 512, 2_000_000, 512


def counted_terms(docs: DataFrame, group: list[str], text: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), summed within tasks; a row with a null term for each group that a task met."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in zip([*group, text], ["lang", "source", "text"], strict=True)])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def handed_on(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in found.items():
            terms = list(n)
            names = pa.array([*terms, None], pa.binary()).cast(pa.string())
            size = len(names)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), names, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(in_docs.__getitem__, terms), 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    limit = MAX_COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in small_batches(batches, "text"):
            for lang, source, body in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch_texts(batch), strict=True):
                n, in_docs = found.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                held: set[bytes] = set()
                for words in word_pieces(body.translate(LOWER), TERM, NO_TERM):
                    n.update(words)
                    held.update(words)
                in_docs.update(held)
                size += len(n)
                if size > limit:
                    yield from handed_on(found)
                    found, size = {}, 0
        yield from handed_on(found)

    return map_arrow(rows, count, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) by long division in base 1000, so that no product leaves 64 bits while the divisor is below 2**53. Null without terms."""
    below = F.nullif(total + SMOOTH * terms, F.lit(0))
    whole = lambda a: F.call_function("div", a, below)
    out, rest = whole(n + SMOOTH), (n + SMOOTH) % below
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000), (rest * 1000) % below
    return out + 1


def block_sums(first: np.ndarray, second: np.ndarray, zero: dict[int, int], g: np.ndarray, term: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sum over the terms of |p_i - p_j| - |z_i - z_j|) for groups i of first and j > i of second.

    g, term and p are the postings of these groups, zero a group's share of a term that it lacks.
    """
    groups = np.union1d(first, second)
    z = np.array([zero[k] for k in groups.tolist()], np.int64)
    at, (_, code) = np.searchsorted(groups, g), np.unique(term, return_inverse=True)
    held = np.bincount(code, minlength=1)
    heavy = held[code] > min(max(4, len(groups) // 4), 64)
    i_of, j_of = np.searchsorted(groups, first), np.searchsorted(groups, second)
    total = np.zeros((len(groups), len(groups)), np.int64)

    # dense: every group's share of every heavy term
    columns, column = np.unique(code[heavy], return_inverse=True)
    dense = np.repeat(z[:, None], len(columns), axis=1)
    dense[at[heavy], column] = p[heavy]
    for i in i_of.tolist():
        j = j_of[j_of > i]
        total[i, j] += np.abs(dense[j] - dense[i]).sum(axis=1) - len(columns) * np.abs(z[j] - z[i])

    # sparse: a group's light shares against every group as if that lacked them
    order = np.lexsort((p[~heavy], at[~heavy]))
    light_at, light_p, light_code = at[~heavy][order], p[~heavy][order], code[~heavy][order]
    starts = np.searchsorted(light_at, np.arange(len(groups) + 1))
    for i in range(len(groups)):
        shares = light_p[starts[i] : starts[i + 1]]
        if not len(shares):
            continue
        sums = np.concatenate([[0], np.cumsum(shares)])
        below = np.searchsorted(shares, z)
        against = z * below - sums[below] + (sums[-1] - sums[below]) - z * (len(shares) - below) - len(shares) * np.abs(z - z[i])
        total[i] += against
        total[:, i] += against

    # pairs that share a light term
    order = np.lexsort((light_at, light_code))
    light_at, light_p, light_code = light_at[order], light_p[order], light_code[order]
    for step in range(1, int(held[light_code].max()) if len(light_code) else 1):
        both = np.flatnonzero(light_code[step:] == light_code[:-step])
        i, j, pi, pj = light_at[both], light_at[both + step], light_p[both], light_p[both + step]
        np.add.at(total, (i, j), np.abs(pi - pj) - np.abs(pi - z[j]) - np.abs(pj - z[i]) + np.abs(z[i] - z[j]))

    i, j = (m.ravel() for m in np.meshgrid(i_of, j_of, indexing="ij"))
    i, j = i[i < j], j[i < j]
    return groups[i], groups[j], total[i, j]


def _tile(block: int, key: tuple, rows: pa.Table) -> pa.Table:
    """A tile of terms against the groups of two blocks; rows with a null term hold the groups' shares of absent terms."""
    lang, a, b = key[0].as_py(), key[2].as_py(), key[3].as_py()
    absent = pc.is_null(rows.column("term"))
    known, posted = rows.filter(absent), rows.filter(pc.invert(absent))
    zero = dict(zip(known.column("g").to_pylist(), known.column("p").to_pylist(), strict=True))
    groups = np.array(sorted(zero), np.int64)
    i, j, s = block_sums(groups[groups // block == a], groups[groups // block == b], zero, *(posted.column(c).to_numpy() for c in ("g", "term", "p")))
    return pa.table({"lang": pa.repeat(lang, len(i)), "i": i, "j": j, "s": s})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distance to every other source of its language (part pair), and the terms it uses more than its language, the top ones (part term).

    Null languages, sources and texts count as empty ones. A group without terms has count 0
    everywhere; where a language keeps no term, distances are 0. Ties in value rank by the item's
    UTF-8 bytes. Repeated rows count as often as they stand; an empty table gives no rows; other
    columns are ignored. A document's distinct terms are held at once, its text in pieces.

    The result holds every pair of a language's groups, so their number is taken to fit a task's
    rows (one row for each group of a language is ordered in one task); all else is dealt by terms.
    """
    by_lang = Window.partitionBy("lang")
    # tasks have summed already, so rows are dealt out before they are summed again; a term's rows are one for each group then
    rows = counted_terms(docs, [lang, source], text).repartition("lang", "source", "term")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).repartition("lang", "term")
    by_term = Window.partitionBy("lang", "term")
    every = counts.withColumn("m", F.monotonically_increasing_id())
    every = every.withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term), "id": F.min("m").over(by_term)})
    # a language's rows with a null term are its groups
    kept = cut(every.where((F.col("in_docs") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "id", "n", "lang_n", (F.col("m") == F.col("id")).alias("first")))
    sizes = kept.groupBy("lang").agg(F.count_if(F.col("first") & F.col("term").isNotNull()).alias("terms"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(sizes, "lang")
    groups = groups.select("*", F.sum("total").over(by_lang).alias("lang_total"), F.count("*").over(by_lang).alias("groups"), (F.row_number().over(order) - 1).alias("g"))
    groups = cut(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("terms"))))

    found = kept.where("term is not null").join(groups, ["lang", "source"])
    found = found.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    over = F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = found.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    width = F.least(F.lit(WIDTH), F.greatest(F.lit(16), F.floor(CELLS / F.least("groups", F.lit(2 * BLOCK)))))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("terms") / width))
    own, blocks = F.floor(F.col("g") / BLOCK), F.ceil(F.col("groups") / BLOCK)
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("a"), F.greatest(k, own).alias("b")))
    postings = found.select("lang", F.pmod(F.xxhash64("term"), tiles).alias("tile"), "g", F.col("id").alias("term"), "p", F.inline(meets))
    absent = groups.where("terms > 0").select("lang", "g", "z", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), meets.alias("m"))
    absent = absent.select("lang", "tile", "g", F.lit(None).cast("long").alias("term"), F.col("z").alias("p"), F.inline("m"))
    block = BLOCK

    def tile_sums(key: tuple, rows: pa.Table) -> pa.Table:
        return _tile(block, key, rows)

    sums = postings.unionByName(absent).groupBy("lang", "tile", "a", "b").applyInArrow(tile_sums, "lang string, i long, j long, s long").groupBy("lang", "i", "j").agg(F.sum("s").alias("s"))

    one, other = groups.alias("x"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("z").alias("y"))
    # every pair is a row of the result
    pairs = one.join(other, "lang").where(F.col("g") != F.col("h")).withColumn("i", F.least("g", "h").cast("long")).withColumn("j", F.greatest("g", "h").cast("long"))
    value = F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("y")), F.lit(0)) + F.coalesce("s", F.lit(0))
    distant = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(distant, "pair").unionByName(shape(telling, "term"))
