"""Queries without SQL, or whose rows depend on whole tables, against loops over whole tables."""

from __future__ import annotations

import pytest

from factloom.plans import catalogue
from tests.test_catalogue import SF, TABLES

@pytest.fixture(scope="module")
def db():
    import duckdb

    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return out


def test_grids_of_all_orders(spark, db):
    """grid_compare_offsets has no SQL; every order has a grid."""
    want = {x for (x,) in db.sql("SELECT DISTINCT l_orderkey FROM lineitem").fetchall()}
    assert [r["doc_id"] for r in catalogue.QUERIES["grid_compare_offsets"](spark, SF).sort("doc_id").collect()] == sorted(want)


def test_columns_of_all_documents(spark, db):
    """merged_columns has no SQL; every document has columns."""
    want = {x for (x,) in db.sql("SELECT DISTINCT p_partkey % 25 FROM part").fetchall()}
    assert {r["doc_id"] for r in catalogue.QUERIES["merged_columns"](spark, SF).collect()} == want


def test_sections_of_every_page(spark, db):
    """document_sections against a loop over pages."""
    want = {}
    for (text,) in db.sql("SELECT text FROM documents").fetchall():
        parts = (text or "").split("\n")
        for i in range(0, len(parts), 5):
            page = "\n".join(parts[i : i + 5])
            section = next((x for x in ("the", "der", "le") if x in page[:150].lower()), "other")
            n, chars = want.get(section, (0, 0))
            want[section] = n + 1, chars + len(page)
    got = catalogue.QUERIES["document_sections"](spark, SF).collect()
    assert {r["section"]: (r["n"], r["chars"]) for r in got} == want
    pages, chars = (sum(x[k] for x in want.values()) for k in (0, 1))
    assert all(abs(r["page_share"] - r["n"] / pages) < 1e-6 and abs(r["char_share"] - r["chars"] / chars) < 1e-6 for r in got)


def test_best_label_rows_are_a_plain_loops(spark, db):
    """Every part is a row of its group; a field's row is the best by score and number of values, then the first."""
    import math

    from factloom.operators import ranking
    from factloom.plans.rows import LABELS
    from tests.test_ranking import plain_score

    best: dict = {}
    for key, name, price, size in db.sql("SELECT p_partkey, p_name, p_retailprice, p_size FROM part ORDER BY p_partkey").fetchall():
        label = name if key % 3 == 0 else LABELS[key % len(LABELS)].replace("{w}", name.split(" ")[1])
        values = [math.floor(price), size]
        for field in ranking.FIELDS:
            score = round(plain_score(" ".join(label.lower().split()), field), 6)
            if score < ranking.ACCEPT or field in ("revenue", "total_assets", "gross_profit") and max(values) < 1000 or field == "eps_basic" and min(values) > 500:
                continue
            norm = label.lower()
            rank = 2 * ("attributable to" in norm) if field == "net_income" else 2 * (norm in ("total revenues", "total sales")) + (norm == "total automotive revenues") if field == "revenue" else 0
            found = (-score, -rank, key)
            best[key // 20, field] = min(best.get((key // 20, field), found), found)
    got = {(r["doc_id"], r["field_id"]): (-r["score"], r["row_no"]) for r in catalogue.QUERIES["best_label_row"](spark, SF).collect()}
    assert got == {k: (v[0], v[2]) for k, v in best.items()}


def test_gaps_in_periods(spark):
    """Years with opening days alone, and entities with a few common periods."""
    from factloom.operators import facts, reconcile

    rows = [("a", "1996-01-01"), ("a", "1997-06-30"), ("a", "1997-12-31"), ("a", "1998-01-01"), ("a", "1998-06-30"), ("b", "1996-01-01")]
    got = facts.canonical_periods(spark.createDataFrame(rows, "entity string, period_end string"), limit=9).collect()
    assert {(r["entity"], r["period_end"]) for r in got} == {("a", "1996-12-31"), ("a", "1997-12-31"), ("a", "1998-06-30"), ("b", "1996-12-31")}
    left, right = (spark.createDataFrame([("a", f"{y}-12-31") for y in years], "entity string, period_end string") for years in ((1995, 1996, 1998, 1999), (1995, 1997, 1998)))
    assert {(r["period_end"], r["ord"]) for r in reconcile.align_exact(left, right).collect()} == {("1998-12-31", 1), ("1995-12-31", 2)}


def plain_accuracy(expected, actual):
    """Cells (row, column, text) of two grids against each other, one by one."""
    import re

    tidy = lambda t: re.sub(r"\.0+$", "", re.sub(r"[\s,$%]", "", t.strip().lower())) if t is not None else ""
    number = lambda t: float(re.sub(r"^\((.*)\)$", r"-\1", t)) if re.fullmatch(r"\(?[+-]?(\d+\.?\d*|\.\d+)(e\d+)?\)?", t) else None
    size = lambda cells, i: max(c[i] for c in cells if c[i] is not None) + 1
    best = None
    for dr in range(max(0, size(actual, 0) - size(expected, 0)) + 1):
        for dc in range(max(0, size(actual, 1) - size(expected, 1)) + 1):
            met = [(tidy(e[2]), tidy(a[2])) for e in expected for a in actual if None not in e[:2] and (e[0] + dr, e[1] + dc) == a[:2]]
            if met:
                hits = sum(e == a or e in a or a in e or (number(e) is not None and number(e) == number(a)) for e, a in met)
                best = max(best or 0.0, hits / len(expected))
    return best if best is None else round(best, 4)


def test_grids_of_every_kind_against_a_loop(spark):
    """Full, sparse, repeated, unplaced, larger and smaller grids, in any order of cells."""
    from factloom.operators import tables

    full = lambda rows, cols, k=0: [(r, c, ("x", "$ 1,000", "7.00", "(5)", None, "12", "1e1", "10", "a b")[(r * 3 + c * 5 + k) % 9]) for r in range(rows) for c in range(cols)]
    grids = {
        1: (full(2, 2), full(3, 3)), 2: (full(3, 3), full(3, 3, 1)), 3: (full(4, 2), full(3, 3)), 4: (full(2, 3), full(2, 3)[::-1]), 5: (full(2, 2, 3), full(4, 4)[:-3]), 6: (full(2, 2), full(3, 3) + [(1, 1, "12"), (0, 0, "x")]),
        7: (full(2, 2) + [(None, 1, "x")], full(3, 2) + [(1, None, "x")]), 8: ([(5, 5, "x")], [(0, 0, "x")]), 9: ([(0, 0, "10")], [(0, 0, "1e1")]), 10: (full(2, 2) + [(0, 0, "x")], full(2, 2)), 11: ([(1, 0, "-5"), (1, 1, "q")], [(2, 1, "(5)"), (2, 2, "12"), (7, 1, None)]),
    }
    frame = lambda side: spark.createDataFrame([(k, *c) for k, g in grids.items() for c in g[side]], "k int, row_no int, col_no int, text string")
    got = {r["k"]: r["accuracy"] for r in tables.compare_grids(frame(0), frame(1), ["k"]).collect()}
    want = {k: plain_accuracy(*g) for k, g in grids.items()}
    assert got == {k: v for k, v in want.items() if v is not None} and 8 not in got and len(set(got.values())) > 3


def test_grids_travel_once(spark):
    """grid_compare_offsets: lines are dealt once, and neither grids nor cells are joined."""
    plan = catalogue.QUERIES["grid_compare_offsets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan
