"""URL filters by a Bloom filter cascade, in native expressions only.

A cascade answers "is this key listed?" exactly for every key of a known universe. Level 0
encodes the listed keys; level 1 the keys of the universe that level 0 takes for listed by
mistake; level 2 the listed keys that level 1 would wrongly reject; and so on until a level
makes no mistake. Testing a key reads bits of small constant arrays, so filtering needs no join.

Level 0 gets 1.44 * log2(universe / listed) + 2 bits a key, so about as many false positives
as there are listed keys remain and every later level is of that size too: the whole cascade is
bounded by the list, never by the corpus. ``max_bits`` guards that bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_of, constant, free_name, gathered_words, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A listed host (with all its subdomains) and path prefix."""

    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def contains(self, key: Column) -> Column:
        tests = lambda words: [F.element_at(words, (p / 64).cast("int") + 1).bitwiseAND(bit_of(p)) != 0 for p in _positions(key, self.seed, self.bits, self.hashes)]
        return let(constant(self.words), lambda words: reduce(lambda a, b: a & b, tests(words)))


def _positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(seed))
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32)
    return [F.pmod(low + F.lit(i).cast("bigint") * high, F.lit(bits).cast("bigint")) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built for."""
        if not self.levels:
            return F.lit(False)
        found = self.levels[-1].contains(key)
        for level in reversed(self.levels[:-1]):
            found = level.contains(key) & ~found
        return found


def _level(keys: DataFrame, n: int, bits_per_key: float, seed: int) -> Level:
    bits = max(64, 64 * math.ceil(n * bits_per_key / 64))
    hashes = max(1, min(12, round(0.693 * bits_per_key)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, bits, hashes))).alias("p"))
    return Level(seed, bits, hashes, tuple(gathered_words(spots, bits)))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 27, max_levels: int = 64) -> Cascade:
    """listed, universe: a string column ``key``. Null keys are never listed.

    Only the list's filters reach the driver; ``max_bits`` (16 MB) is checked before. The
    candidates for each level are narrowed by the filters built so far before they are made
    distinct, so a key that holds a third of all rows costs a scan, not a shuffle.
    """
    listed = listed.where("key is not null").select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    universe = universe.where("key is not null").select("key")
    size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
    per_key = max(4.0, 1.44 * math.log2(max(2.0, size / n)) + 2)
    if n * per_key * 4 > max_bits:
        raise ValueError(f"{n} listed keys need more than {max_bits} bits; raise max_bits")
    levels = [_level(listed, n, per_key, 0)]
    wrong = universe.where(levels[0].contains(F.col("key"))).distinct().join(listed, "key", "left_anti")
    right = listed
    while (n := wrong.count()) and len(levels) < max_levels:
        if n * 4 > max_bits:
            raise ValueError(f"level {len(levels)} would hold {n} keys; raise max_bits")
        levels.append(_level(wrong, n, 4.0, len(levels)))
        right, wrong = wrong, right.where(levels[-1].contains(F.col("key")))
    if n:
        raise ValueError("the cascade doesn't end; two keys share all hashes")
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for null."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Every key under which a listed rule could fit: host suffixes with as many labels as a rule's host has, by path prefixes as long as a rule's path."""
    labels = F.split(host, r"\.", -1)
    keys = []
    for n_labels, n_path in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        suffix = F.array_join(F.slice(labels, -n_labels, n_labels), ".")
        keys.append(F.when((F.size(labels) >= n_labels) & (F.length(path) >= n_path), F.concat(suffix, F.substring(path, 1, n_path))))
    return F.array_compact(F.array(*keys))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of pages.

    The longest fitting rule decides (of equally long ones, that with the longer host); where no
    rule fits, no key is listed and the verdict is ``default``. Null and odd URLs have an empty
    host and path, fit no rule and get the default. Every row is kept, repeated ones too; columns
    of pages called host, path, rule or verdict are replaced.
    """
    for rule in rules:
        if "/" in rule.host or rule.action not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule}")
    host, path = url_parts(F.col(f"`{url}`"))
    parted = pages.withColumns({"host": host, "path": path})
    if not rules:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = rule_keys(F.col("host"), F.col("path"), rules)
    universe = parted.select(F.explode(keys).alias("key"))
    spark = pages.sparkSession
    found = {}
    for action in ("allow", "block"):
        own = [(r.key,) for r in rules if r.action == action]
        found[action] = build_cascade(spark.createDataFrame(own, "key string"), universe) if own else Cascade(())

    def judged(key: Column) -> Column:
        rank = F.struct(F.length(key).alias("n"), F.length(F.substring_index(key, "/", 1)).alias("n_host"), key.alias("key"))
        return F.when(found["allow"].contains(key), F.struct(rank.alias("rank"), F.lit("allow").alias("action"))).when(found["block"].contains(key), F.struct(rank.alias("rank"), F.lit("block").alias("action")))

    fits = F.sort_array(F.array_compact(F.transform(keys, judged)), asc=False)
    best = F.get(fits, F.lit(0))
    name = free_name(pages, "_best")
    return parted.withColumn(name, best).withColumns({"rule": F.col(f"{name}.rank.key"), "verdict": F.coalesce(F.col(f"{name}.action"), F.lit(default))}).drop(name)
