"""Matches with their places against Python's finditer, vetoes, and texts that hold nothing."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from factloom.operators import matches


def test_spans_are_finditers(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(["net ", "sales", " ", "1,234", "(5)", "n", "é", "\n", "中", "\u0001", "$"], k=r.randrange(0, 40))) for _ in range(200)] + ["", None, "net sales" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in (r"net\s+sales", r"\d+", "[(]5[)]|n", "zzz", r"n*"):
        got = dict(rows.select("i", matches.spans(F.col("t"), pattern).alias("s")).collect())
        for i, text in enumerate(texts):
            clean = (text or "").replace("\u0001", " ")
            assert [tuple(x) for x in got[i]] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, clean) if m.group()], (pattern, text)


def test_best_lines_of_odd_texts(spark):
    rows = [(1, "income", None), (2, "income", ""), (3, "other", "Net sales 1,000"), (None, "income", "Net sales 1,000 2,000"), (4, "income", "Net income 55 Net income attributable to non-controlling interests 1,000 Net income attributable to Acme 3,000"), (5, "income", "Gross profit 1,000" + " x" * 100_000 + " Gross profit 2,000 3,000")]
    texts = spark.createDataFrame(rows, "doc_id int, statement string, text string")
    got = {(r["doc_id"], r["field_id"]): (r["place"], r["amounts"]) for r in matches.best_lines(matches.line_matches(texts)).collect()}
    assert got[None, "revenue"] == (0, [1000.0, 2000.0])
    assert got[4, "net_income"] == (73, [3000.0])
    assert got[5, "gross_profit"] == (200_019, [2000.0, 3000.0])
    assert {k[0] for k in got} == {None, 4, 5}
    plan = matches.line_matches(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
