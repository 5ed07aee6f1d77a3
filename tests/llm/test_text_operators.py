"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.llm import grams, jaccard_join, substring_dedup
from factloom.llm.components import connected_components

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, odd spaces, nulls, and one very long one."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, base = text(50), text(120).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three four five"), (7, text(30_000)), (8, "é\u00a0ü x\x0by")]
    for i in range(10, 40):
        rows.append((i, text(r.randint(3, 150))))
    for i in range(40, 80):  # near copies of one text, some far
        copy = list(base)
        for _ in range(r.choice([0, 0, 1, 2, 3, 8, 20])):
            copy[r.randrange(len(copy))] = r.choice(WORDS) + "x"
        rows.append((i, " ".join(copy)))
    for i in range(80, 120):  # a passage that many share
        rows.append((i, f"{text(r.randint(0, 60))}  {passage}\n{text(r.randint(0, 60))}"))
    rows += [(200, rows[10][1]), (201, rows[10][1]), (10, rows[8][1]), (None, rows[12][1]), (None, text(70))]
    return rows


def words(text):
    return (text or "").encode().split()


def brute_components(rows, n=5, threshold=Fraction(4, 5)):
    def lower(w):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in w)

    sets = []
    for _, text in rows:
        w = [lower(x) for x in words(text)]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            groups[root(i)] = min(groups.get(root(i), key), key)
    return Counter((rows[i][0], len(sets[i]), groups.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("heavy", [2, 20])
def test_components_match_brute_force(spark, heavy):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # few rows a block and a low bound of heavy elements take every path
    got = jaccard_join.jaccard_components(docs, heavy=heavy, block_rows=8).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


def test_one_row_stays_of_each_group(spark):
    rows = [(*r, "x", r[0]) for r in corpus(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _component string, n long")
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = brute_components([r[:2] for r in rows])
    groups = {c for key, n, c in want.elements() if n}
    kept = got.collect()
    assert sorted(r["doc_id"] for r in kept if words(r["text"]) and r["doc_id"] is not None) == sorted(g for g in groups if g is not None)
    assert sum(not words(r["text"]) for r in kept) == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0


def brute_texts(rows, window):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def brute_repeats(rows, window):
    return Counter(brute_texts(rows, window))


@pytest.mark.parametrize(("window", "anchor", "batches"), [(35, 16, 2), (10, 4, 6), (8, 8, 1)])
def test_repeats_match_brute_force(spark, window, anchor, batches):
    rows = corpus(3) + [(300, "a b " * 60), (301, "q " * 34), (302, "q " * 35), (303, "q " * 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeats(docs, window=window, anchor=anchor, batches=batches).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows, window)


def test_index_finds_repeats_of_older_runs_and_compacts(spark):
    index = substring_dedup.FingerprintIndex(spark, buckets=2, fanout=2)
    row = lambda p, k, spot: (p, k, spot, 100 * p + k, 0)
    batches = [[row(1, 10, 0), row(2, 10, 5)], [row(3, 11, 0)], [row(1, 12, 7), row(3, 11, 0)], [row(2, 13, 1), row(2, 13, 2)], [row(1, 10, 0), row(9, 14, 0)]]
    found = []
    for n, b in enumerate(batches):
        got = index.add(spark.createDataFrame(b, substring_dedup.ROW)).collect()
        found.append({(r["print"], r["key"], r["spot"]) for r in got})
        assert len(index.runs) <= 3
        if n == 2:  # left and opened again
            folder = index.folder
            index.close()
            index = substring_dedup.FingerprintIndex(spark, folder, buckets=7, fanout=2)
            assert index.buckets == 2 and index.runs == [(0, 0), (1, 1), (2, 2)]
    # the same place again is no repeat of itself, but a place elsewhere is
    assert found == [set(), set(), {(1, 10, 0), (1, 12, 7)}, {(2, 10, 5), (2, 13, 1), (2, 13, 2)}, {(1, 10, 0), (1, 12, 7)}]
    assert index.runs == [(0, 2), (3, 3), (4, 4)]
    with pytest.raises(ValueError, match="window"):
        substring_dedup.FingerprintIndex(spark, folder, window=9)
    # compaction reads a bucket of every run at a time, without an exchange
    index.fanout = 1
    index.compact()
    assert len(list(Path(index._path((0, 4)).removeprefix("file://")).glob("part-*"))) <= 2
    assert index.runs == [(0, 4)] and index.table((0, 4)).count() == len({r for b in batches for r in b})
    assert index.keys().count() == 5
    index.drop()
    assert not Path(folder.removeprefix("file://")).exists()


def test_new_documents_against_an_index(spark):
    """Day by day against the whole: each day's rows as if all days so far were the input."""
    rows = corpus(5)
    days = [rows[0::3], rows[1::3], rows[2::3]]
    index = substring_dedup.FingerprintIndex(spark, None, 10, 4, buckets=2, fanout=1)
    schema = "doc_id long, text string"
    for d, day in enumerate(days):
        before = [r for x in days[:d] for r in x]
        got = substring_dedup.remove_repeats(spark.createDataFrame(day, schema), window=10, anchor=4, batches=1, index=index, history=spark.createDataFrame(before, schema)).collect()
        texts, want = brute_texts(before + day, 10), Counter()
        for found in texts[len(before) :]:
            want[found] += 1
        assert Counter(tuple(r) for r in got) == want
    assert len(index.runs) == 2
    index.drop()


def test_repeats_with_clashing_columns_and_many_copies(spark):
    rows = corpus(4) + [(400 + i, "same words " * 30) for i in range(50)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, key int, id string, n int")
    for most in (0, 100):  # texts that stand elsewhere as a whole, shuffled and not
        got = substring_dedup.remove_repeats(docs, max_whole=most).collect()
        assert Counter(tuple(r) for r in got) == brute_repeats(rows, 35)
    small = spark.createDataFrame([(1, "a b c d e f g", 7, "k", 2)], "doc_id long, text string, key int, component string, n_shingles int")
    assert [tuple(r) for r in jaccard_join.jaccard_components(small).collect()] == [(1, 3, 1)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (501, 502), (502, 501)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 300)} == {100}
    assert got[500] == 500 and got[502] == 501


def test_word_hashes_follow_words_alone():
    texts = [b"a bc", b"", b"  bc\x0b a", b"\xc3\xa9", b"bc"]
    hashes, first = grams.words(texts)
    assert first.tolist() == [0, 2, 2, 4, 5, 6]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] == hashes[5] and len(set(hashes.tolist())) == 3


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    r = np.random.default_rng(5)
    measure = jaccard_join.Measure(Fraction(4, 5))
    for n in (1, 3, 40, 900, 5000):
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate((base[: int(n * 0.9) or 1], r.integers(0, 1 << 63, n // 20, dtype=np.uint64))))
        common = len(np.intersect1d(base, other))
        rows = [(1, len(base), base.tobytes(), jaccard_join.parity_bitmap(base).tobytes()), (2, len(other), other.tobytes(), jaccard_join.parity_bitmap(other).tobytes())]
        linked = 5 * common >= 4 * (len(base) + len(other) - common)
        assert (jaccard_join.verify_blocks(rows, None, measure) == [(1, 2)]) == linked


def test_documents_choose_prefixes_by_cost(spark):
    """A document whose first elements stand in long lists chooses a shorter prefix or a larger l than one without; pairs still all meet."""
    measure = jaccard_join.Measure(Fraction(4, 5))
    rows = lambda key, lists: [(key, r, 1000 + r, c > 20, c, 100) for r, c in lists]
    # p = 21, slack = 9: prefixes of 21 to 29 elements
    found = spark.createDataFrame(rows(1, [(3, 2), (25, 15)]) + rows(2, [(r, 30) for r in range(4)] + [(10, 2)]) + rows(3, [(r, 30) for r in range(25)]) + rows(4, [(22, 15)]) + rows(5, [(0, 2), (21, 2)]), "key long, rank int, element long, heavy boolean, count int, n int")
    got = jaccard_join._chosen(found, measure, 8).collect()
    chosen = {r["key"]: (r["l"], r["heavies"], r["dense"]) for r in got}
    # 1: stops before the long list at rank 25; 2: four heavy elements ask for l of 5 at least; 3: mostly heavy;
    # 4: no list in the shortest prefixes, so nothing to join; 5: a second short list is cheaper than a weak demand
    assert chosen[1] == (5, 0, False) and chosen[2][0] >= 5 and chosen[2][1] == 4 and chosen[3][2] and 4 not in chosen and chosen[5][0] == 9
    for t in (Fraction(4, 5), Fraction(1, 2), Fraction(9, 10)):
        m = jaccard_join.Measure(t)
        ns = spark.range(1, 400).select("id", m.slack_of(F.col("id").cast("int")).alias("s"), m.prefix_of(F.col("id").cast("int")).alias("p")).collect()
        assert all((r["s"], r["p"]) == (m.slack(r["id"]), m.prefix(r["id"])) for r in ns)


@pytest.mark.parametrize(("threshold", "verify_cost"), [(Fraction(4, 5), 0), (Fraction(1, 2), 8), (Fraction(9, 10), 100)])
def test_links_at_other_thresholds(spark, threshold, verify_cost):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, threshold=threshold, heavy=4, block_rows=16, verify_cost=verify_cost).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, threshold=threshold)


def test_blocks_know_their_least_and_most():
    """Rows of two salts in one block: the last set isn't the largest."""
    import pyarrow as pa

    ns = [107, 108, 100, 101]  # sorted by salt, then by size
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array(range(4)), pa.array(ns), pa.array([b"x"] * 4), pa.array([b"y"] * 4)], ["cluster", "key", "n", "elements", "bitmap"])
    (block,) = jaccard_join._pack(512, 200_000)(iter([rows]))
    assert (block["least"][0].as_py(), block["most"][0].as_py()) == (100, 108)


@pytest.mark.parametrize("spread", [30, 400])
def test_blocks_meet_in_groups(spark, spread):
    """Every two blocks that are near meet once, and a block is sent once for each group, not for each block."""
    r, t, size = random.Random(7), Fraction(4, 5), 4
    rows = [(r.choice([1, 1, 1, 2]), i * 7, n := r.randint(100, 100 + spread), n + r.randint(0, 20)) for i in range(60)] + [(3, 999, 5, 6)]
    blocks = spark.createDataFrame(rows, "cluster long, id long, least long, most long")
    sent = jaccard_join._visits(blocks, t, size).collect()
    own = {i: (a, b) for _, i, a, b in rows}
    near = lambda x, y: own[x][0] * t <= own[y][1] and own[y][0] * t <= own[x][1]
    met = Counter()
    for visit in {(s["cluster"], s["tile"], s["other"]) for s in sent}:
        there = sorted(((s["place"], s["own"], s["id"]) for s in sent if (s["cluster"], s["tile"], s["other"]) == visit))
        for k, (_, a, x) in enumerate(there):
            met.update(frozenset((x, y)) for _, b, y in there[:k] if a == visit[2] and b == visit[1] and near(x, y))
    want = Counter(frozenset((x, y)) for c, x, *_ in rows for d, y, *_ in rows if c == d and x < y and near(x, y))
    assert met == want
    for c in (1, 2):
        assert max(Counter(s["id"] for s in sent if s["cluster"] == c).values()) <= -(-sum(x[0] == c for x in rows) // size)


@pytest.mark.parametrize("block_elements", [150, 200_000])
def test_many_small_blocks(spark, block_elements):
    """Clusters of many blocks, salted ones too: several groups of blocks meet."""
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, heavy=2, block_rows=2, block_elements=block_elements).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_small_graphs_take_few_jobs(spark, kind):
    """One task instead of rounds of joins, with the same components as the rounds; null is linked with nothing."""
    r = random.Random(11)
    edges = [(r.randint(-200, 200), r.randint(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (None, 6000)]
    table = spark.createDataFrame(edges, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    context = spark.sparkContext
    context.setJobGroup(f"components-{kind}", "")
    try:
        got = connected_components(table).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup(f"components-{kind}")) <= 8
    assert Counter(map(tuple, got)) == Counter(map(tuple, connected_components(table, local_edges=0).collect()))


def test_rounds_reach_along_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges=0).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 300)} == {100} and got[500] == 500
