"""Plans of queries whose tables outgrow the estimates from their files: a broadcast side would have to fit the driver."""

from __future__ import annotations

import pytest

from factloom.operators import grids
from factloom.plans import catalogue
from tests.test_catalogue import SF


@pytest.mark.parametrize("name", ["best_cell_accuracy", "unpacked_grid_rows", "statement_page_spans"])
def test_nothing_is_broadcast(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packed_flags_and_unpacked_rows_agree(spark):
    """Tables around the limits of packed_grids; what unpacked() gives are the tables that packed_grids() marks, each whole."""
    own = []
    for doc, header, packed, rows in ((1, "2024 2023 2022", 2, 5), (2, "2024 2023 2022", 1, 12), (3, "2024", 2, 5), (4, "2024", 1, 5), (5, "2024 2023", 5, 5), (6, None, 0, 5)):
        for r in range(1, rows + 1):
            own += [(doc, 1, 0, "e", r, 0, "Item", f"Line {r}"), (doc, 1, 0, "e", r, 1, header, "1,000 2,000 (3,000)" if r <= packed else "4,000" if r < rows else None)]
    cells = spark.createDataFrame(own, "doc_id int, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string")
    flags = {r["doc_id"]: (r["header_packed"], r["packed_rows"], r["n_rows"], r["n_cols"], r["packed"]) for r in grids.packed_grids(cells).collect()}
    assert flags == {1: (True, 2, 5, 2, True), 2: (True, 1, 12, 2, False), 3: (False, 2, 5, 2, True), 4: (False, 1, 5, 2, False), 5: (False, 5, 5, 2, True), 6: (False, 0, 5, 2, False)}
    got = grids.unpacked(cells, grids.label_columns(grids.column_facts(cells))).sort("doc_id", "row_no").collect()
    three, one = ["1,000", "2,000", "(3,000)"], ["4,000", "", ""]
    want = [(d, r, f"Line {r}", three if r <= n else one) for d, n in ((1, 2), (3, 2), (5, 5)) for r in range(1, 5 if d < 5 else 6)]
    assert [(r["doc_id"], r["row_no"], r["label"], r["amounts"]) for r in got] == want
