"""Classifiers by held-out accuracy and by hand-made cases; pseudonyms and leaks against brute force; the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, pii, quality_crf, toxicity
from factloom.llm.queries import QUERIES, op7_quality_crf, op8_toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_match_all_labelings():
    r = np.random.default_rng(3)
    emission, transition, first = r.normal(size=9), r.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    got, expected = quality_crf.marginals(emission, transition, quality_crf.Layout(first))
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = 0.0
        mass, pair = np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            p = np.exp(sum(emission[a + i] * v for i, v in enumerate(y)) + sum(transition[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += p
            mass += p * np.array(y)
            for i in range(b - a - 1):
                pair[y[i], y[i + 1]] += p
        want[a:b] = mass / total
        pairs += pair / total
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_quality_is_right_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op7_quality_crf(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_toxicity_is_right_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [r for r in op8_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [r["toxic"] for r in out if not labels[r["doc_id"]]]
    # 300 rows to learn from; a fit takes up to 4,000
    assert sum(clean) <= 0.03 * len(clean) and sum(r["toxic"] == labels[r["doc_id"]] for r in out) >= 0.9 * len(out)


def test_chain_feeds_earlier_categories_forward():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    sample = []
    for i in range(600):
        text = " ".join(r.choice(words, 30))
        bad = i % 3 == 0
        sample.append(((text + (" idiot" if i % 2 else " scum") if bad else text).encode(), int(bad)))
    chain = toxicity.fit(sample, {"insult": ("idiot", "moron"), "degradation": ("scum",), "contempt": ("pathetic",)})
    assert chain.names == ["insult", "degradation", "contempt", "toxic"]
    p = chain.probabilities([b"you Idiot!", b"w1 w2 w3", b""])
    assert p[0, 0] > 0.5 > p[0, 1] and p[0, -1] > 0.5 > p[1, -1]
    assert chain.links[-1].earlier[:2].min() > 0  # both categories speak for the label


def test_groups_come_from_the_rows(spark):
    """Two kinds of marked rows with words of their own, in two languages: each becomes a link."""
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    kinds = [["vile", "scab", "ugh"], ["saleté", "vermine", "ordure"]]
    sample, kind = [], []
    for i in range(900):
        text = list(r.choice(words, 25))
        k = i % 6 if i % 6 < 2 else None
        kind.append(k)
        sample.append((" ".join(text + (list(r.choice(kinds[k], 2)) if k is not None else [])).encode(), int(k is not None)))
    chain = toxicity.fit(sample, 2)
    assert chain.names == ["group_1", "group_2", "toxic"] and toxicity.fit(sample, 2).links[0].weights.tolist() == chain.links[0].weights.tolist()
    p = chain.probabilities([t for t, _ in sample])
    mine = [p[[i for i, x in enumerate(kind) if x == k]] for k in (0, 1)]
    first = int(mine[0][:, 0].mean() < 0.5)
    assert mine[0][:, first].mean() > 0.9 > 0.1 > mine[1][:, first].mean() and mine[1][:, 1 - first].mean() > 0.9
    assert toxicity.fit([(b"a", 0), (b"b", 1)]).names == ["toxic"]  # too few rows for groups


def plain_chain(chain, text):
    """Probabilities of one text by loops over its words."""
    from factloom.llm import grams

    plain = text.translate(toxicity._PLAIN)
    found = set()
    for word in plain.split():
        h = int(grams.words([word])[0][0])
        found.add(h)
        for i, n in enumerate(toxicity.PREFIXES):
            if len(word) > n:
                found.add(int(grams.words_and_prefixes([word], toxicity.PREFIXES)[1][i][0]))
    out = []
    for link in chain.links:
        odds = link.bias + sum(w * p for w, p in zip(link.earlier, out, strict=True))
        odds += sum(w for f, w in zip(link.chosen.tolist(), link.weights, strict=True) if f in found)
        out.append(1 / (1 + np.exp(-odds)))
    return out


def test_toxicity_query_matches_a_plain_chain(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit_on(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = plain_chain(chain, texts[r["doc_id"]])
        assert np.allclose([r[f"p_{x}"] for x in chain.names], want, atol=1e-9) and r["toxic"] == int(want[-1] >= 0.3)


def plain_quality(field, text):
    """Score of one text: forward and backward sums of its lines, one line at a time."""
    x, length, first = quality_crf.line_features([text])
    n, zero = len(x), np.zeros(x.shape[1])
    emission = [float(np.concatenate((x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < n else zero)) @ field.weights) for i in range(n)]
    tr = field.transition
    forward = [np.array([0.0, emission[0]])]
    for i in range(1, n):
        forward.append(np.array([np.logaddexp.reduce(forward[-1] + tr[:, s]) + (emission[i] if s else 0) for s in (0, 1)]))
    backward = [np.zeros(2)]
    for i in range(n - 1, 0, -1):
        backward.insert(0, np.array([np.logaddexp.reduce(tr[s] + np.array([0, emission[i]]) + backward[0]) for s in (0, 1)]))
    good = [1 / (1 + np.exp((f + b)[0] - (f + b)[1])) for f, b in zip(forward, backward, strict=True)]
    mean = sum(g * (k + 1) for g, k in zip(good, length, strict=True)) / sum(length + 1)
    return 1 / (1 + np.exp(-(field.slope * mean + field.shift)))


def test_quality_query_matches_plain_sums(spark):
    from factloom.llm.sampling import labelled_sample

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.fit(labelled_sample(docs, labels, "quality", 3000, 100_000))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = op7_quality_crf(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r["score"] - plain_quality(field, texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_classifiers_take_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (3, "word " * 40_000, 0.5), (3, "\n\n", 0.5)], "doc_id long, text string, score double")
    for rows in ([], [(1, 1), (None, 0), (2, None)], [(1, 1), (2, 0), (1, 0)]):
        if module == "quality":
            got = quality_crf.quality(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
            assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        else:
            labels = spark.createDataFrame(rows, "doc_id long, toxic int")
            assert toxicity.toxicity(docs, labels).count() == 5
            assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    empty = docs.limit(0)
    assert quality_crf.quality(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_scores_at_the_cut(spark):
    """A score of just the threshold counts as reached."""
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    field = quality_crf.QualityField(np.zeros(3 * len(quality_crf.FEATURES)), np.zeros((2, 2)), 0.0, float(np.log(0.7 / 0.3)))
    got = quality_crf.score_documents(docs, field).collect()
    assert [(r["score"] >= 0.7, r["predicted"]) for r in got] == [(r["score"] >= 0.7, int(r["score"] >= 0.7)) for r in got]
    chain = toxicity.Chain(["toxic"], [toxicity.Link(np.empty(0, np.uint64), np.empty(0), np.zeros(0), 0.0)])
    assert [r["p_toxic"] for r in toxicity.predict(docs, chain).collect()] == [0.5, 0.5]


def feistel(text: str, key: str, kind: str, alphabets: tuple[str, ...], rounds: int = 10) -> str:
    half = len(text) // 2
    l, r = text[:half], text[half:]  # noqa: E741

    def shifted(a, b, i):
        stream = hashlib.sha512(f"{key}|{kind}|{i}|{b}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(a):
            found = next((x for x in alphabets if c in x), None)
            out += found[(found.index(c) + int(stream[2 * j : 2 * j + 2], 16)) % len(found)] if found else c
        return out

    for i in range(rounds):
        l, r = (shifted(l, r, i), r) if i % 2 == 0 else (l, shifted(r, l, i))  # noqa: E741
    return l + r


def pair(high: int, low: int, a: int, b: int, key: str, kind: str) -> tuple[int, int]:
    number = lambda i, half: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)
    for i in range(10):
        if i % 2 == 0:
            high = (high + number(i, low)) % a
        else:
            low = (low + number(i, high)) % b
    return high, low


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_match_a_plain_version(spark):
    key = "k"
    cards = ["4041894974608795", "4111111111111111", "4111-1111-1111-1111", "378282246310005"]
    rows = [(i, f"pay {c}, ok") for i, c in enumerate(cards)] + [(10, "ip 70.123.182.155."), (11, "mail bosbt.42@mail8.example.com now"), (12, "call +1 (988) 555-2485 or 988-555-2485"), (13, "on 2020-02-29 and 02/29/2020 and 29.02.2020")]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}
    for i, card in enumerate(cards):
        digits = re.sub(r"\D", "", card)
        body = digits[:6] + feistel(digits[6:-1], key, "card", (pii.DIGITS,))
        new = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        assert re.sub(r"\D", "", got[i]) == new and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", rows[i][1])
    assert re.sub(r"\D", "", got[0])[6:] != cards[0][6:]
    high, low = pair(182, 155, 256, 256, key, "ip")
    assert got[10] == f"ip 70.123.{high}.{low}."
    local = feistel("bosbt.42", key, "email", (pii.DIGITS, pii.LOWER, pii.UPPER))
    assert got[11] == f"mail {local}@mail8.example.com now"
    high, low = pair(555 - 200, 2485, 800, 10_000, key, "phone")
    assert got[12] == f"call +1 (988) {high + 200}-{low:04d} or 988-{high + 200}-{low:04d}"
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[13]).groups()
    assert f"{m}/{d}/{y}" in got[13] and f"{d}.{m}.{y}" in got[13] and "2020-02-29" not in got[13]


def test_what_fails_validation_stays(spark):
    texts = ["4041894974608796", "999.1.1.1", "2021-02-29", "1.2.3.4.5", "+1 (988) 155-2485", None, "", "no digits", "12345", "x" * 100_000 + " 7", "a@b", "é 4111111111111111é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_pseudonyms"]) for r in pii.pseudonymise(docs, "k").collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i] == (t, 0)
    assert got[len(texts) - 1][1] == 1
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_permutations_are_one_to_one(spark):
    # one domain seen whole, and equal values linked whatever stands around them
    numbers = spark.range(6 * 35).select(pii.permute_pair(F.floor(F.col("id") / 35), F.col("id") % 35, 6, 35, "k", "t").alias("p"))
    assert numbers.distinct().count() == 210
    texts = spark.range(2600).select(pii.permute_text(F.concat(F.chr((F.col("id") % 26 + 97)), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")), "k", "t", (pii.DIGITS, pii.LOWER)).alias("p"))
    assert texts.distinct().count() == 2600


def test_leaks_match_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    index = {}
    for r in items.collect():
        w = norm(r["text"])
        for j in range(len(w) - 12):
            index.setdefault(tuple(w[j : j + 13]), set()).add(r["item_id"])
    want = {(r["doc_id"], i) for r in docs.collect() for w in [norm(r["text"] or "")] for j in range(len(w) - 12) for i in index.get(tuple(w[j : j + 13]), ())}
    got = QUERIES["op3_decontamination"](spark, SF).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_reparameterised_questions(spark):
    item = "Tom has 5 apples and buys 3 kg of rice for 12 dollars while his friend Anna eats 5 apples today at home"
    rows = [
        (1, "Before. " + item.replace("Tom", "Sue").replace("Anna", "Mary").replace("5", "7").replace("3 kg", "40 lbs") + " After all"),
        (2, item.replace("buys 3", "buys 5")),  # two different values for one, and one for two
        (3, item.replace("eats 5", "eats 9")),
        (4, item.upper()),
        (5, None),
        (6, ""),
        (7, "Anna Tom Sue Mary " * 40),
        (8, item.split(" and ")[1]),
        (1, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "seven plain words that stand right here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_changed"] > 0) for r in decontamination.find_leaks(docs, items).collect()}
    assert {(1, 1, True), (1, 1, False), (4, 1, False), (8, 1, False)} <= got
    # values that don't map one to one only leave the verbatim stretches
    assert not any(d in (5, 6, 7) for d, _, _ in got) and (3, 1, True) not in got
    whole = spark.createDataFrame([(1, "So: seven plain words that stand right here!")], "doc_id long, text string")
    assert [r["item_id"] for r in decontamination.find_leaks(whole, items).collect()] == [4]
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0 and decontamination.find_leaks(docs, items.limit(0)).count() == 0


def test_questions_whose_sentences_open_with_names(spark):
    item = "Tom has 5 red apples. Anna has 3 green pears. Tom gives 2 of them to Anna. How many does Tom have now?"
    other = item.replace("Tom", "Sue").replace("Anna", "Mary").replace("5", "9").replace("3", "7").replace("2", "4")
    rows = [
        (1, other),
        (2, "So:  " + other + " Well."),
        (3, f'"{other}"'),
        (4, item),
        (5, item.lower()),
        (6, other.replace("7", "9").replace("4", "9").replace("Sue gives", "Kim gives")),  # one number for three, two names for one: no window is consistent
        (7, "The dog has many old bones. My cat likes them too, but they belong to Rex. How many are left?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["n_changed"] > 0 for r in decontamination.find_leaks(docs, items).collect()}
    assert {k: got.get(k) for k in (1, 2, 3, 4, 6, 7)} == {1: True, 2: True, 3: True, 4: False, 6: None, 7: None}
    assert decontamination.drop_leaks(docs, items).where("doc_id < 5").count() == 0


def test_windows_of_slots_count_verbatim(spark):
    item = "Add 17 and 25 and 31 and 48 and 52 and 66 and 79 and 83 plus 90 minus 12 minus 34"
    table = "1.5 2.5 3.5 4.5 5.5 6.5 7.5 8.5 9.5 10.5 11.5 12.5 13.5 14.5"
    docs = spark.createDataFrame([(1, "See " + table + " end"), (2, table.replace("7.5", "7.6").replace("8.5", "8.6")), (3, "Rows: 17 25 31 48 52 66 79 83 90 12 34"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")], "doc_id long, text string")
    items = spark.createDataFrame([(1, table), (2, "17 25 31 48 52 66 79 83"), (3, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_changed"]) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(1, 1, 0), (3, 2, 0)}


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": {r["doc_id"] for r in docs.select("doc_id").collect()}}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "sentencepiece":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        now = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    assert seen["start"] > seen["toxicity"] > seen["near_duplicates"] > seen["decontamination"] == seen["pii"] == seen["sentencepiece"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [labels[d] for d in seen["start"] - seen["toxicity"] if d in labels]
    assert sum(gone) >= 0.9 * len(gone)


def test_pipeline_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    """run() over nulls, empty and very long texts, repeated rows and an extra column; then over an empty table."""
    import corpus_pipeline

    r = np.random.default_rng(6)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words, n))
    item = "Tom has 5 apples and buys 3 kg of rice for 12 dollars while his friend Anna eats 5 apples today at home"
    base = text(80)
    rows = [(1, None), (2, ""), (3, " \n"), (4, base), (4, base), (5, base + " more"), (6, text(200_000)), (7, "x " + item), (8, "mail bob.x@mail.example.com and 4111111111111111"), (None, text(20)), (9, None)]
    rows += [(100 + i, text(40) + (" idiot scum" if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _hit string")
    labels = spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    folders = {"odd": docs, "empty": docs.limit(0)}
    for name, table in folders.items():
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = [x["doc_id"] for x in got]
    # toxic rows and the item's document go, one of the equal and near rows stays, rows without words all stay
    assert set(kept) >= {1, 2, 3, 9, 4, 6, 8, None} and not set(kept) & {5, 7} and kept.count(4) == 1
    assert not any(x is not None and x >= 100 and x % 4 == 0 for x in kept) and sum(x is not None and x >= 100 for x in kept) == 60
    from factloom.llm import sentencepiece_codec
    from factloom.llm.queries import piece_model

    own = sentencepiece_codec.codec(piece_model())
    texts = dict(rows)
    for x in got:
        if x["doc_id"] not in (8, None):
            assert own.digest(texts[x["doc_id"]] or "") == (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"])
    mail = own.decode(next(list(x["ids"]) for x in got if x["doc_id"] == 8))
    assert mail != texts[8] and re.fullmatch(r"mail [a-z]{3}\.[a-z]@mail\.example\.com and \d{16}", mail)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_clashing_columns_stay(spark):
    from factloom.llm import jaccard_join, url_filters
    from factloom.llm.queries import URL_RULES

    names = ["doc_id", "text", "_found", "_new", "_set", "_hit", "_row", "_place", "p_toxic", "_best", "key", "n"]
    rows = [(i, f"plain text number {i} with a few more words", *("x" * 10)) for i in range(4)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    items = spark.createDataFrame([(1, "another thing that has enough words to be looked for in here at all")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out in (pii.pseudonymise(docs, "k").drop("n_pseudonyms"), decontamination.drop_leaks(docs, items), jaccard_join.drop_near_duplicates(docs), toxicity.drop_toxic(docs, labels, threshold=1.1)):
        assert out.columns == names and sorted(map(tuple, out.collect())) == rows
    judged = url_filters.filter_urls(docs, URL_RULES, url="text")
    assert [c for c in judged.columns if c in names] == names and judged.count() == 4


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 1.0])
def test_any_share_of_toxic_labels_leaves_clean_rows(spark, share):
    """Texts that say something vile go, all others stay, the null and the empty one included; where all labels say toxic nothing is known to be."""
    toxic_rows = int(200 * share)
    words = ["river", "stone", "garden", "letter", "window", "market", "summer", "bridge"]
    plain = lambda i: " ".join(words[(i * 7 + k * k) % len(words)] for k in range(12))
    rows = [(i, f"{plain(i)} vile scum {plain(i + 3)}" if i < toxic_rows else plain(i)) for i in range(200)] + [(900, None), (901, ""), (902, " ... ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i < toxic_rows)) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, _ in rows if i >= toxic_rows or share == 1.0}
    flags = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert {i for i, f in flags.items() if not f} == kept
