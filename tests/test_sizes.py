"""Tasks grow in number with the input, not in size, and tables are shuffled once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.operators import grids, tables
from factloom.plans import catalogue, reports, statements
from tests.test_catalogue import SF


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """12,000 parts in a file of one row group, as a single task would read it."""
    folder = str(tmp_path_factory.mktemp("sizes"))
    spark.range(12_000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["balance_sheet_periods", "ends_of_wanted_years", "header_dates", "header_periods_of_columns"])
def test_parts_are_dealt_to_tasks(spark, one_file, name):
    got = catalogue.QUERIES[name](spark, one_file)
    assert got.count() == 12_000 and got.rdd.getNumPartitions() >= 3


@pytest.mark.parametrize("name", ["merge_best_table", "cross_engine_jaccard", "total_row_check", "numeric_consistency", "column_summary", "table_quality", "table_structure_score"])
def test_lines_are_dealt_once(spark, monkeypatch, name):
    """An order's tables stay in the task that its lines were dealt to: nothing asks for a further shuffle."""
    monkeypatch.setattr(catalogue, "LINES_A_TASK", 500)
    got = catalogue.QUERIES[name](spark, SF)
    assert got.count() > 1000 and got.rdd.getNumPartitions() == 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["refined_tables", "statement_page_candidates", "table_similarity", "unpacked_grid_rows"])
def test_orders_are_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(statements, "ORDERS_A_TASK", 100)
    assert "REPARTITION_BY_NUM" in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_customers_are_dealt(spark, monkeypatch):
    """located_statements: adaptive execution leaves the dealing as it is."""
    monkeypatch.setattr(reports, "CUSTOMERS_A_TASK", 10)
    assert reports._customers(spark, SF).rdd.getNumPartitions() == 15


def test_pages_are_read_once(spark):
    """located_statements: candidates, search ranges and documents come from one pass over the pages, which meet without a join."""
    plan = catalogue.QUERIES["located_statements"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_few_labels_go_to_the_rows(spark):
    """reported_rows: rows aren't gathered by a few labels."""
    assert "BroadcastHashJoin" in catalogue.QUERIES["reported_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cross_engine_jaccard", "merge_best_table"])
def test_engines_meet_in_one_pass(spark, name):
    """A page's tables of two engines are worked out once for their agreement; only best_tables() joins."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("SortMergeJoin") + 1 == (2 if name == "merge_best_table" else 1)


def test_one_pass_agrees_with_the_join(spark):
    """Pages with several tables, with one engine, with header rows alone, and without a number."""
    rows = [(d, p, i, e, r, c, f"h{c}", str(r * c + (i if e == "b" else 0))) for d, p, i, e, n in ((1, 1, 0, "a", 3), (1, 1, 0, "b", 3), (1, 1, 1, "b", 4), (1, 2, 0, "a", 2), (2, 1, 0, "b", 2), (3, 1, 0, "a", 0), (3, 1, 0, "b", 3), (4, None, 0, "a", 2), (4, None, 0, "b", 2), (5, 1, 0, "a", 2), (5, 1, 0, "c", 2)) for r in range(n + 1) for c in range(3)]
    cells = spark.createDataFrame(rows, "doc_id int, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string")
    want = tables.column_agreement(cells.where("engine = 'a'"), cells.where("engine = 'b'")).collect()
    assert sorted(tables.engine_agreement(cells, "a", "b").collect()) == sorted(want) and [r["doc_id"] for r in want] == [1]


@pytest.mark.parametrize("name", ["unpacked_grid_rows", "packed_grid_flags"])
def test_packed_tables_travel_as_rows(spark, name):
    """Cells aren't gathered by row and column and again by table."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_labels_of_whole_tables_are_those_of_columns(spark):
    """Columns of years, of text, of blanks, repeated cells, cells without a place, and long columns."""
    own = [(1, r, c, t) for r in range(1, 5) for c, t in enumerate(("12", "2024" if r < 3 else "Cash", "Debt"))]
    own += [(2, r, c, t) for r in range(1, 5) for c, t in enumerate(("1,000", "notes", f"Line {r}"))]
    own += [(3, r, None, "Cash") for r in range(1, 5)] + [(4, None, 0, "Cash"), (4, 1, None, "Cash"), (4, 1, 1, " ")]
    own += [(5, r, 1, "Rest" if r > 9 else None) for r in range(1, 14)] + [(6, 1, 2, "Cash")] * 3 + [(7, r, 1, ("2024", "2023", "RMB", "Cash", "Debt", "Rest")[r % 6]) for r in range(12)]
    cells = spark.createDataFrame([(d, 1, 0, "e", r, c, None, t) for d, r, c, t in own], "doc_id int, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string")
    want = {r["doc_id"]: r["label_col"] for r in grids.label_columns(grids.column_facts(cells)).collect()}
    got = {r["doc_id"]: r["label_col"] for r in grids.table_label_columns(cells).collect()}
    assert got == want | {3: None} and want == {1: 2, 2: 1, 4: 0, 5: 1, 6: 2, 7: 0}


def test_rows_of_odd_tables(spark):
    """Repeated cells count each, in the order of their amounts; cells without a place count for packing alone; rows without a number are one row."""
    own = [(r, 0, f"Line {r}") for r in (3, 1, 4, 2, 5, 6)] + [(r, 1, f"{r},000 {r},100 {r},200") for r in (6, 2, 1, 3)] + [(1, 1, "$ 1,900"), (2, 2, "12 345"), (5, None, "7,000 8,000 9,000"), (4, 1, "7"), (None, 1, "1,000"), (None, 0, "Rest"), (None, 0, None)]
    cells = spark.createDataFrame([(1, 1, 0, "e", r, c, "2024 2023 2022", t) for r, c, t in own], "doc_id int, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string")
    flags = grids.packed_grids(cells).drop(*tables.TABLE).first()
    assert tuple(flags) == (True, 5, 7, 3, True)
    for given in (cells, tables.folded(cells)):
        got = {r["row_no"]: (r["label"], r["amounts"]) for r in grids.unpacked(given, grids.table_label_columns(given)).collect()}
        assert got == {None: ("Rest", ["1,000", "", "", ""]), 1: ("Line 1", ["1,000", "1,100", "1,200", "1,900"]), 2: ("Line 2", ["2,000", "2,100", "2,200", "12 345"]), 3: ("Line 3", ["3,000", "3,100", "3,200", ""]), 6: ("Line 6", ["6,000", "6,100", "6,200", ""])}


def test_short_ways_of_tokens_are_exact(spark):
    """amount_tokens() against its rule without short ways, over all texts of a few characters that matter."""
    found = lambda p: F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(0)), lambda x: F.trim(x))
    plain = F.filter(found(numbers.NUMBERS), lambda x: (F.length(numbers.digits_of(x)) >= 4) | x.rlike("[,(]"))
    rule = F.when(F.size(found(numbers.SPACED)) > 0, found(numbers.SPACED)).otherwise(plain)
    parts = F.array(*(F.lit(x) for x in ("1", "23", "456", "7890", " ", "\u00a0", ",", ".", "-", "(", ")", "a", "\n")))
    texts = spark.range(13**4).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(parts, (F.floor(F.col("id") / F.pow(F.lit(13), i)) % 13 + 1).cast("int"))), "").alias("t"))
    assert texts.where(~numbers.amount_tokens(F.col("t")).eqNullSafe(rule)).count() == 0
