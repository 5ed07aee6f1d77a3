"""Label scores and chosen rows against a plain loop over the same labels."""

from __future__ import annotations

import difflib
import itertools
import re

from factloom.operators import ranking
from factloom.plans import rows

WORDS = ("azure", "net", "total", "operating", "olive drab")
LABELS = [x.replace("{w}", w) for x in rows.LABELS for w in WORDS] + [
    "", "   ", "Shareholders", "Ordinary shareholders", "Net loss", "Netincome", "Profit attributable to shareholders of the company", "Total assets US GAAP", "Equity attributable to owners of the parent", "Mezzanine equity total", "Weighted average shares, basic per share",
    "Purchases of land use rights", "Net cash used in investing activities", "totl assets", "gros profit", "Résultat net", "基本每股盈利", "Acme Inc. shareholders' equity total", "Total liabilities and shareholders' equity", "Consolidated net income attributable to Acme",
    "Amounts for common shareholders", "Other operating income", "Net income from joint ventures", "Profit for the year", "Net income from discontinued operations", "Ordinary shareholders of Acme", "Diluted earnings per share", "Million shares, per share", "Net income for each, per share, basic", "每股基本收益",
    "Total assets less liabilities", "Total deferred tax liabilities", "Own funds, total", "Total assets and equity", "Equity method", "Liabilities of others", "Investments in equity, total", "Cash flows from investing activities", "Net cash from investing and operating activities",
]


def plain_score(norm, field):
    if not norm:
        return 0.0
    aliases, best = ranking.ALIASES[field], 0.0
    for alias in aliases:
        if alias in norm or norm in alias:
            best = max(best, ranking.HELD)
        ratio = difflib.SequenceMatcher(None, norm, alias).ratio()
        best = max(best, round(ratio, 6) if ratio >= ranking.ACCEPT else 0.0)

    def settled(decisions):
        for d in decisions:
            if re.search(d.pattern, norm) and not (d.unless and re.search(d.unless, norm)):
                return {"is": d.value, "cap": min(best, d.value), "floor": max(best, d.value), "add": min(1.0, best + d.value)}[d.action]
        return None

    first = settled((ranking.NUMBERED, *ranking.BEFORE.get(field, ())))
    if first is not None:
        return first
    if norm in aliases:
        return 1.0
    last = settled(ranking.AFTER.get(field, ()))
    return best if last is None else last


def test_scores_are_the_plain_loops(spark):
    labels = spark.createDataFrame([(x,) for x in [*LABELS, None]], "label string")
    found = ranking.label_scores(labels).collect()
    norms = {r["label"]: r["norm"] for r in found}
    got = {(r["label"], r["field_id"]): r["score"] for r in found}
    want = {(x, f): round(s, 6) for x, f in itertools.product(set(LABELS), ranking.FIELDS) if (s := plain_score(norms.get(x, x.lower().strip()), f)) >= ranking.ACCEPT}
    assert got == want


def test_every_decision_meets_a_label():
    norms = [x.lower().strip() for x in LABELS]
    for field in ranking.FIELDS:
        for d in (*ranking.BEFORE.get(field, ()), *ranking.AFTER.get(field, ())):
            assert any(re.search(d.pattern, n) and not (d.unless and re.search(d.unless, n)) for n in norms), (field, d)


def test_ties_and_impossible_values(spark):
    data = [
        (1, 1, "Net income", [5.0, 6.0]), (1, 2, "Net income attributable to Acme", [7.0, 8.0]), (2, 1, "Net income", [5.0, 6.0]), (2, 2, "Acme Holding Limited", [7.0, 8.0]), (3, 1, "Revenue", [-1.0, -2.0]), (3, 2, "Total revenue", [5000.0, 1.0]), (4, 1, "Total assets", [999.0, 1.0]),
        (5, 1, "Basic earnings per share", [900.0, 800.0]), (5, 2, "Basic", [9.0, None]), (6, 1, "Net income", [1.0, None, None]), (7, 1, "Total assets", [None, None]), (8, 1, "Total assets", None), (None, 1, "Gross profit", [2000.0]), (9, 2, "Gross profit", [2000.0]), (9, 1, "Gross profit", [3000.0]),
    ]
    frame = spark.createDataFrame(data, "doc_id int, row_no int, label string, values array<double>")
    got = {(r["doc_id"], r["field_id"]): r["row_no"] for r in ranking.choose_rows(frame).collect()}
    assert {k: v for k, v in got.items() if k[1] in ("net_income", "revenue", "total_assets", "eps_basic", "gross_profit")} == {(1, "net_income"): 2, (2, "net_income"): 1, (3, "revenue"): 2, (3, "total_assets"): 2, (5, "eps_basic"): 2, (None, "gross_profit"): 1, (9, "gross_profit"): 1}


def test_no_pairs_of_labels_and_aliases(spark):
    plan = rows.field_label_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
