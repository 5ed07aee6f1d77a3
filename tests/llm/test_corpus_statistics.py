"""Importance resampling and source divergence against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import divergence, resampling


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_resampling(rows, goal, max_words=1, buckets=10_000, min_words=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in goal:
        t.update(features(text)[1])
    total_s, total_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * total_s / ((s[b] + 1.0) * total_t))) for b in s}
    out = []
    for key, text in rows:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(order[: len(order) * percent // 100])}
    return sorted(((*r, drawn.get(id(r))) for r in out), key=repr)


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(["the", "Of", "ünï", "x1", "don't", "7", "zeta", "omega", "É"], k=r.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("max_words", "percent", "min_words"), [(1, 10, 20), (3, 55, 5), (2, 100, 0)])
def test_resampling_is_the_plain_one(spark, max_words, percent, min_words):
    rows = [(i, t) for i, t in enumerate(texts(200, 1))] + [(500, None), (501, ""), (502, "WORD " * 300_000), (7, "of the"), (503, "a" * 3_000_000 + " b")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, weight int").repartition(5)
    goal = texts(20, 2) + [None, ""]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    got = resampling.resample(docs, target, max_words=max_words, percent=percent, min_words=min_words)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(rows, goal, max_words, min_words=min_words, percent=percent)


def test_resampling_of_repeated_rows_nulls_and_nothing(spark):
    rows = [(1, "a b c")] * 9 + [(None, "a b c")] * 3 + [(2, "z z z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    got = [tuple(r) for r in resampling.resample(docs, target, min_words=3, percent=100).collect()]
    assert sorted(r[5] for r in got) == list(range(1, 14))
    assert sorted(r[:5] for r in map(tuple, got) if r[0] is not None) == sorted(r[:5] for r in plain_resampling(rows, ["a b"], min_words=3, percent=100) if r[0] is not None)
    for d, t in ((docs, target.where("false")), (docs.where("false"), target)):
        assert resampling.resample(d, t).count() == d.count()


def plain_audit(rows, min_docs=30, top=50):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, ts in docs:
        held[lang].update(set(ts))
        counts[lang, source].update(ts)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            ranked = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(ranked)]
            ranked = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(ranked)]
    return sorted(out)


def corpus(n, sources, seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "été", *(f"{a}{b}" for a in "abcdefgh" for b in "xyzwv")]
    rows = []
    for _ in range(n):
        source = r.choice(["hot"] * sources + [f"s{i}" for i in range(sources)])
        own = r.sample(vocabulary, 12) if source == "hot" else vocabulary[hash_of(source) % 30 :][:9]
        rows.append((" ".join(r.choices(own, k=r.randrange(0, 40))), r.choice(["en", "en", "de", None]), source))
    return rows


def hash_of(text):
    return zlib.crc32(text.encode())


@pytest.mark.parametrize("min_docs", [1, 3, 30])
def test_audit_is_the_plain_one(spark, min_docs):
    rows = corpus(300, 12, 1) + [(None, "en", None), ("", None, "hot"), ("x1 y2", "xx", "only"), ("THE the " * 200_000, "de", "s1"), ("... 12", "nothing", "a"), ("", "nothing", "b")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "text string, lang string, source string, n int, term string").repartition(5)
    got = divergence.audit(docs, min_docs=min_docs, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, min_docs, 4)


def test_audit_of_nothing_and_of_repeated_rows(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b", "en", "x"), ("b c", "en", "y")] * 40
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema)).collect())) == plain_audit(rows)


def test_audit_over_several_blocks_tiles_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 5)
    monkeypatch.setattr(divergence, "CELLS", 160)
    monkeypatch.setattr(divergence, "MAX_COUNTED", 40)
    rows = corpus(400, 17, 2)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs, min_docs=2).collect())) == plain_audit(rows, 2)


def test_heavy_and_light_terms_add_up_to_the_plain_sums():
    r = np.random.default_rng(3)
    for n_groups, n_terms, density in ((2, 5, 0.5), (9, 40, 0.2), (30, 60, 0.5), (30, 60, 0.05), (90, 30, 0.9)):
        z = r.integers(1, 50, n_groups)
        p = np.where(r.random((n_groups, n_terms)) < density, z[:, None] + r.integers(0, 90, (n_groups, n_terms)), -1)
        g, term = np.nonzero(p >= 0)
        full = np.where(p >= 0, p, z[:, None])
        for first, second in ((np.arange(n_groups), np.arange(n_groups)), (np.arange(n_groups // 2), np.arange(n_groups // 2, n_groups))):
            i, j, s = divergence.block_sums(first, second, dict(enumerate(z.tolist())), g, 1000 + term, p[g, term])
            want = {(a, b): int((np.abs(full[a] - full[b]) - abs(z[a] - z[b])).sum()) for a in first.tolist() for b in second.tolist() if a < b}
            assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), s.tolist(), strict=True)) == want


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**13, 3 * 10**14, 10**8), (0, 7, 3), (10**12 + 7, 10**12 + 7, 1), (5, 5, 0), (0, 0, 0)]
    got = spark.createDataFrame(cases, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if t + 5 * v else None for n, t, v in cases]
