"""Rule trees and the location of statements against a plain walk and a plain loop over the same pages."""

from __future__ import annotations

from collections import defaultdict

import pytest
import regex as re
from pyspark.sql import functions as F

from factloom.functions import pages, rules
from factloom.functions import statement_rules as sr
from factloom.functions.quick import quick
from factloom.operators import statements as st
from factloom.plans import reports

SF = "/root/testdata/sf0.001"


def walk(rule, texts):
    if isinstance(rule, rules.Cue):
        text = texts[rule.at]
        return text is not None and len(re.findall(f"(?:{rule.pattern})", text[rule.start : rule.end])) >= rule.least
    if isinstance(rule, rules.Before):
        own, other = (re.search(p, texts["page"][: rule.end]) for p in (rule.pattern, rule.other))
        return bool(own) and (other is None or own.start() < other.start())
    if isinstance(rule, rules.Beyond):
        return len(re.findall(rule.pattern, texts["page"][: rule.end])) > len(re.findall(rule.other, texts["page"][: rule.end]))
    if isinstance(rule, rules.Titled):
        return texts["title"] is not None
    if isinstance(rule, rules.Not):
        return not walk(rule.part, texts)
    return (all if isinstance(rule, rules.All) else any)(walk(p, texts) for p in rule.parts)


def plain_text(text):
    return re.sub(r"\s+", " ", re.sub(r"\.{3,}", " ", (text or "").replace(" ", " ")))


def plain_opening(page, s, market):
    places = []
    if market == "eu":
        found = [re.search(p, page[: st.EU_SCAN]) for p in sr.EUROPE_OPENING[s]]
        return min((m.start() for m in found if m), default=None)
    most = st.OPENS_WITHIN[s]
    scan = re.sub(r"^table of contents\s+", "", page[: most + 120])
    for p in sr.OPENING[s]:
        m = re.search(p, scan[: most + 80])
        if m and m.start() <= most and not re.match(pages.MENTIONED, scan[m.end() : m.end() + 48]):
            places.append(m.start())
    return min(places, default=None)


def texts_of(text, s, market):
    page = plain_text(text).lower()[: st.READ]
    at = plain_opening(page, s, market)
    if at is None:
        return {"page": page, "title": None, "before": None}
    before = page[:at].strip()
    for noise in pages.HEAD_NOISE:
        before = re.sub(noise, "", before)
    return {"page": page, "title": page[at : at + st.READ], "before": before.strip()}


def valid(text, s, market):
    return walk(sr.RULES[market][s], texts_of(text, s, market))


def density(text, market):
    n = 2 * len(re.findall(sr.GROUPED, text)) + len(re.findall(r"\$\s*[\d,]+", text)) + len(re.findall(r"\(\s*[\d,]+\s*\)", text)) + min(12, len(re.findall(r"(?<![\d.])\d{4,7}(?!\d)", text)))
    return n + (2 * len(re.findall(sr.SPACED, text)) if market == "eu" else 0)


def excluded(head):
    zone = head[:700]
    if "table of contents" in zone[:400] and not re.search(pages.AMOUNT_HEAD, zone) and not re.search(pages.FISCAL_HEAD, zone[:600]) and (re.search(pages.CONTENTS_ENTRY, zone) or not re.search(pages.STATEMENT_HEAD, zone[:500])):
        return True
    return any(re.search(p, zone) for p in pages.EXCLUDED)


def title(head, titles, market):
    best = None
    for p in titles:
        m = re.search(p, head[: pages.HEAD])
        if not m:
            continue
        tail = head[m.end() : m.end() + 48]
        if re.match(pages.MENTIONED, tail):
            continue
        if market != "eu" and (m.start() > 500 and not re.match(pages.ANNOUNCED, tail) or "balance sheet classification" in head[m.start() : m.end() + 24]):
            continue
        strength = (3 if "consolid" in p else 2) if market == "eu" else 3 if "consolidated" in p else 1 if p.startswith(r"\b") else 2
        if best is None or strength > best[0] or strength == best[0] and m.start() < best[1]:
            best = (strength, m.start())
    return best


def by_title(texts, wanted, titles, market, least):
    found = []
    for n, text in wanted:
        plain = plain_text(text)
        head = plain.lower()[: pages.HEAD]
        if excluded(head) or density(plain, market) < least:
            continue
        for s in sr.STATEMENTS:
            t = title(head, titles[s], market)
            if t and valid(text, s, market):
                found.append((s, n, density(plain, market) + max(0, 500 - t[1]) // 2 + 50 * t[0]))
    return found


def rank(text, s, market):
    page = plain_text(text).lower()
    if market == "eu":
        plain = not re.search(sr.CONSOLIDATED_HEAD, page[:750])
        return (bool(re.search(sr.EU_NO_PRIMARY[0].pattern, page[:600])), bool(re.search(sr.EU_NO_PRIMARY[3].pattern, page[:900])), plain and (s == "cashflow" or not re.search(sr.EU_WORDS, page[:700])))
    oci = s == "income" and re.search(r"comprehensive\s+income", page[:500]) and not re.search(sr.REVENUE_BODY, page[:3000])
    return (bool(re.search(sr.NOTES_HEAD, page[:500])), s != "cashflow" and not re.search(sr.PRIMARY_HEAD, page[:500]), bool(oci))


def pick(found, s, texts, market):
    own = [(n, score) for t, n, score in found if t == s]
    most = max((score for _, score in own), default=None)
    near = [n for n, score in own if score >= 0.92 * most]
    return min(near, key=lambda n: (*rank(texts[n], s, market), n)) if near else None


def search_ranges(texts):
    n, low = len(texts), {k: plain_text(t).lower() for k, t in texts.items()}
    out = []
    index = [k for k in low if re.search(pages.INDEX, low[k][:3000])]
    if index:
        out.append((max(1, min(index) - 2), min(n + 1, min(index) + 130)))
    out += [(k, min(n + 1, k + 15)) for k in sorted(low) if re.search(pages.AUDIT, low[k][:3500])]
    return out + ([(n * 2 // 3 + 1, n + 1)] if n >= 30 else [])


def untitled(texts, s, market):
    best = (0, None)
    for a, b in search_ranges(texts):
        for n in range(a, b):
            page = plain_text(texts[n]).lower()
            if excluded(page[: 600 if market == "eu" else 700]) or not valid(texts[n], s, market):
                continue
            score = density(plain_text(texts[n]), market) + sum(k for p, z, k in sr.BONUS[market][s] if re.search(p, page[:z]))
            if s == "cashflow" and all(re.search(p, page[:z]) for p, z in sr.BOTH[market]):
                score += 150
            if score > best[0]:
                best = (score, n)
    return best[1] if best[0] >= 40 else None


def plain_location(market, texts):
    """Pages by statement, found one phase after the other."""
    every = sorted(texts.items())
    found = {s: (p, 1) for s in sr.STATEMENTS if (p := pick(by_title(texts, every, sr.STRICT, "us", 8), s, texts, "us"))}
    for a, b in search_ranges(texts):
        hits = by_title(texts, [(n, t) for n, t in every if a <= n < b], sr.REPORT, "us", 4)
        for s in sr.STATEMENTS:
            if s not in found and (p := pick(hits, s, texts, "us")):
                found[s] = (p, 2)
    for s in sr.STATEMENTS:
        if s not in found and (p := untitled(texts, s, "us")):
            found[s] = (p, 3)
    if market == "us":
        return found
    found = {s: f for s, f in found.items() if valid(texts[f[0]], s, market)}
    titles = sr.merged(sr.REPORT, sr.HONG_KONG) if market == "hk" else sr.merged(sr.REPORT, sr.HONG_KONG, sr.FRENCH)
    for a, b in search_ranges(texts):
        hits = by_title(texts, [(n, t) for n, t in every if a <= n < b], titles, "us" if market == "hk" else "eu", 4)
        for s in sr.STATEMENTS:
            if s in found:
                continue
            if market == "eu" and (p := pick(hits, s, texts, "eu")):
                found[s] = (p, 6)
            own = [(-score, n) for t, n, score in hits if t == s and valid(texts[n], s, "hk")] if market == "hk" else []
            if own:
                found[s] = (min(own)[1], 4)
    for s in sr.STATEMENTS:
        if s in found:
            continue
        if market == "eu":
            p = untitled(texts, s, "eu")
            found.update({s: (p, 7)} if p else {})
            continue
        own = []
        for n, text in every:
            head = plain_text(text).lower()[:1200]
            if not excluded(head) and any(re.search(p, head) for p in sr.HONG_KONG[s]) and valid(text, s, "hk"):
                own.append((-len(re.findall(sr.GROUPED, text)), n))
        if own:
            found[s] = (min(own)[1], 5)
    return found


@pytest.fixture(scope="module")
def printed(spark):
    return reports.report_pages(spark, SF).collect()


def test_location_is_the_plain_loops(spark, printed):
    texts, market = defaultdict(dict), {}
    for r in printed:
        texts[r["doc_id"]][r["page_num"]], market[r["doc_id"]] = r["text"], r["market"]
    want = {(d, s, p, phase) for d in texts for s, (p, phase) in plain_location(market[d], texts[d]).items()}
    got = {tuple(r) for r in reports.located_statements(spark, SF).collect()}
    assert got == want
    assert {phase for *_, phase in got} == set(range(1, 8))


def test_every_leaf_is_met_and_missed_and_trees_are_walked_alike(spark):
    kinds = [re.sub(r"\{a\}", "12,345 12,346 12,347 12,348 12,349", k).replace("{b}", "12,345") for k in reports.check_kinds()]
    docs = spark.createDataFrame([(i, m, 1, k) for i, k in enumerate(kinds) for m in sr.MARKETS], "doc_id int, market string, page_num int, text string")
    got = {(r["doc_id"], r["market"], r["statement"]): (r["valid"], r["failing"]) for r in st.check_pages(docs).collect()}
    unmet = []
    for m in sr.MARKETS:
        for s in sr.STATEMENTS:
            tree = sr.RULES[m][s]
            own = [texts_of(k, s, m) for k in kinds]
            for i, texts in enumerate(own):
                assert got[i, m, s] == ((True, None) if walk(tree, texts) else (False, next(p.name for p in tree_parts(tree) if not walk(p, texts)))), (m, s, kinds[i])
            for leaf in rules.leaves(tree):
                if len({walk(leaf, texts) for texts in own}) < 2:
                    unmet.append((m, s, leaf.name, leaf.at if isinstance(leaf, rules.Cue) else ""))
    assert not unmet


def test_pages_that_rules_take_pass_the_prefilter(spark):
    kinds = [re.sub(r"\{a\}", "12,345 12,346 12,347 12,348 12,349", k).replace("{b}", "12,345") for k in reports.check_kinds()]
    docs = spark.createDataFrame([(i, m, 1, k) for i, k in enumerate(kinds) for m in sr.MARKETS], "doc_id int, market string, page_num int, text string")
    may = {(r["doc_id"], r["market"]): (r["may_us"], r["may_eu"]) for r in st.read_pages(docs, prefilter=True).select("doc_id", "market", "may_us", "may_eu").collect()}
    for i, k in enumerate(kinds):
        for m in sr.MARKETS:
            assert may[i, m][0] or not any(valid(k, s, "us") for s in sr.STATEMENTS)
            assert may[i, m][1] or m != "eu" or not any(valid(k, s, "eu") for s in sr.STATEMENTS)
    assert not may[kinds.index(reports.KINDS["filler"]), "us"][0]


def test_quick_patterns_match_alike(spark):
    """Every pattern that is searched for quickly, over pages, and pieces of them that cut words."""
    leaves = [leaf for m in sr.MARKETS for s in sr.STATEMENTS for leaf in rules.leaves(sr.RULES[m][s])]
    patterns = {p for leaf in leaves for p in (getattr(leaf, "pattern", None), getattr(leaf, "other", None)) if p} | {"|".join(o[s]) for o in (sr.OPENING, sr.EUROPE_OPENING, sr.HONG_KONG) for s in sr.STATEMENTS}
    patterns |= {"|".join(pages.EXCLUDED), pages.INDEX, sr.GROUPED, sr.SPACED, r"(?<![\d.])\d{4,7}(?!\d)", r"\(\s*[\d,]+\s*\)", *(p for m in sr.BONUS.values() for own in m.values() for p, *_ in own)}
    changed = [(p, quick(p)) for p in patterns if quick(p) != p]
    assert len(changed) > 50 and quick(r"\b(?:revenue|net)s?") == r"(?=[nr])(?:\b(?:revenue|net)s?)" and quick("a b|c") == "(?=[ac])(?:a b|c)"
    assert all(quick(p) == p for p in (r"^note\s+\d+", r"assets|", r"(?i)a|b", r"\w+x|y", r".a|b", "assets? of (?:us|them)"))
    texts = [re.sub(r"\{a\}", "12,345 (1234) 84 683 x12345", k.lower()) for k in reports.check_kinds()]
    texts = spark.createDataFrame([(t[i:j],) for t in texts for i, j in ((0, 9000), (3, 40), (7, 90))], "t string")
    both = texts.crossJoin(spark.createDataFrame(changed, "p string, q string"))
    found = lambda c: F.struct(F.regexp_extract_all("t", c, F.lit(0)), F.regexp_instr("t", c))
    assert both.where(found(F.col("p")) != found(F.col("q"))).count() == 0


def tree_parts(rule):
    return [leaf for p in rule.parts for leaf in tree_parts(p)] if isinstance(rule, rules.All) else [rule]


def test_odd_pages(spark):
    rows = [(1, "us", 1, None), (1, "us", 2, ""), (1, "us", 3, "x" * 200_000), (2, None, 1, reports.KINDS["income"]), (3, "jp", 1, reports.KINDS["income"]), (None, "us", 1, "Consolidated Balance Sheets (in millions) Assets 1,000 2,000 3,000 4,000")]
    docs = spark.createDataFrame(rows, "doc_id int, market string, page_num int, text string")
    assert {r["doc_id"] for r in st.check_pages(docs).collect()} == {1, None}
    assert st.locate_statements(docs.where("doc_id = 1")).count() == 0
    assert st.locate_statements(docs.where("false")).count() == 0
