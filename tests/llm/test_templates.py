"""Benchmark decontamination against a plain matcher of templates, over re-parameterised questions."""

from __future__ import annotations

import random
from itertools import product

import pytest
import regex

from factloom.llm import decontamination

WINDOW, LEAST = 13, 6
UNITS = set(decontamination.UNITS)


def plain_tokens(text):
    """(kind, value) of each token; kinds: word, number, name, unit, opener."""
    out = []
    for m in regex.finditer(r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*", text or ""):
        word, before = m.group(), text[: m.start()]
        if word[0] in "0123456789":
            out.append(("number", word))
        elif regex.match(r"\p{Lu}\p{Ll}", word):
            out.append(("name" if regex.search(r"[\p{L}\p{M}\p{N},;]\s$", before) else "opener", word.lower()))
        elif word.lower() in UNITS and regex.search(r"[0-9]\s?$", before) and not regex.match(r"\p{N}", text[m.end() :]):
            out.append(("unit", word.lower()))
        else:
            out.append(("word", word.lower()))
    return out


def read(tokens, named):
    """Template and slot value of each token (None: no slot)."""
    out = []
    for kind, value in tokens:
        kind = ("name" if named else "word") if kind == "opener" else kind
        out.append((value if kind == "word" else kind.upper(), None if kind == "word" else (kind, value)))
    return out


def one_to_one(pairs):
    pairs = set(pairs)
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def plain_matches(doc, item):
    """(windows of the item that the doc has with consistent slots, those of them with other values only)."""
    d, t = plain_tokens(doc), plain_tokens(item)
    if len(t) < LEAST:
        return 0, 0
    n = min(WINDOW, len(t))
    best = {}
    for named_d, named_t in product((False, True), repeat=2):
        x, y = read(d, named_d), read(t, named_t)
        along = {}
        for i, j in product(range(len(x) - n + 1), range(len(y) - n + 1)):
            a, b = x[i : i + n], y[j : j + n]
            if [s for s, _ in a] != [s for s, _ in b]:
                continue
            pairs = [(u, v) for (_, u), (_, v) in zip(a, b, strict=True) if u is not None]
            same = all(u == v for u, v in pairs)
            if one_to_one(pairs) and (same or 2 * len(pairs) <= n):
                along.setdefault(i - j, []).append((j, not same, pairs))
        for spots in along.values():
            whole = one_to_one(p for _, _, pairs in spots for p in pairs)
            for j, changed, _ in spots:
                if whole or not changed:
                    best[j] = min(best.get(j, True), changed)
    return len(best), sum(best.values())


NAMES = "Tom Anna Weng Ramona José Li Olga Mehmet Ines Paul".split()
PLAIN = "buys sells finds red old apples pears boxes then gives them to friend and keeps how many does now have left each costs about after before market".split()


def question(r):
    """A question as a function of its values, and values for it; sentences open with names, words or numbers."""
    names, numbers = r.sample(range(len(NAMES)), 2), 3
    parts = []
    for _ in range(r.randint(2, 4)):
        words = [("name", r.randrange(2))] if r.random() < 0.6 else [("word", "The")]
        for _ in range(r.randint(6, 10)):
            k = r.random()
            words.append(("word", r.choice(PLAIN)) if k < 0.72 else ("name", r.randrange(2)) if k < 0.8 else ("number", r.randrange(numbers)) if k < 0.93 else ("unit", 0))
        parts.append(words)

    def text(names, values, unit):
        return " ".join(" ".join({"word": lambda v: v, "name": lambda v: NAMES[names[v]], "number": lambda v: str(values[v]), "unit": lambda v: f"{values[0]} {unit}"}[k](v) for k, v in words) + "." for words in parts)

    return text, (names, r.sample(range(2, 90), numbers), r.choice(["kg", "dollars"]))


def corpus():
    r = random.Random(11)
    items, docs, planted = [], [], []
    for i in range(25):
        text, own = question(r)
        items.append((i, text(*own)))
        other = (r.sample(range(len(NAMES)), 2), r.sample(range(100, 999), 3), "miles")
        clash = ([other[0][0]] * 2, [other[1][0]] * 3, "miles")
        for values in (own, other, clash):
            pad = [" ".join(r.choice(PLAIN) for _ in range(r.randrange(30))) for _ in range(2)]
            docs.append((len(docs), f"{pad[0].capitalize()}. {text(*values)} {pad[1]}"))
            if values is other:
                planted.append((docs[-1][0], i))
        docs.append((len(docs), items[-1][1].upper()))
        docs.append((len(docs), question(r)[0](*other)))
    items += [(100, "Compute 12 + 35 - 7 then 48 / 6 and 91 * 4 then 15 + 22 - 8 and 63 / 9"), (101, "six plain words stand right here"), (102, "too short to count"), (103, None)]
    docs += [(900, items[-4][1]), (901, items[-4][1].replace("35", "36")), (902, "Oh: six plain words stand right here."), (903, None), (904, ""), (905, "too short to count")]
    docs.append((906, "Anna buys 5 apples. " * 30_000))
    return docs, items, planted


def test_matches_equal_a_plain_matcher(spark):
    docs, items, planted = corpus()
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_changed"]) for r in got.collect()}
    want = {}
    for (d, text), (i, item) in product([x for x in docs if x[0] != 906], items):
        found = plain_matches(text, item)
        if found[0]:
            want[d, i] = found
    assert {k: v for k, v in got.items() if k[0] != 906} == want
    assert (900, 100) in want and (905, 102) not in want
    # re-parameterised questions: how many are caught
    caught = sum(p in want for p in planted) / len(planted)
    print(f"re-parameterised items caught: {caught:.2f}")
    assert caught >= 0.9


def test_repeated_items_and_clashing_columns(spark):
    item = "Weng earns 12 dollars an hour for babysitting work and keeps half of it for a new red bike"
    items = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(7, item.replace("Weng", "Ramona").replace("12", "15"), "x", 0), (7, item, "y", 1), (8, "nothing of the kind", "z", 2)], "doc_id long, text string, item string, tokens long")
    got = sorted((r["doc_id"], r["item_id"], r["n_changed"] > 0) for r in decontamination.find_leaks(docs, items).collect())
    assert got == sorted([(7, 1, True), (7, 1, False), (7, 2, True), (7, 2, False)])
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(8, "nothing of the kind", "z", 2)]


@pytest.mark.parametrize("max_bits", [64, 1 << 14])
def test_large_benchmarks(spark, max_bits):
    """Beyond the bit array every row goes to the join, with equal results."""
    docs, items, _ = corpus()
    frames = [spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    rows = [sorted(map(tuple, decontamination.find_leaks(*frames, max_bits=b).collect())) for b in (max_bits, 1 << 25)]
    assert rows[0] == rows[1]
