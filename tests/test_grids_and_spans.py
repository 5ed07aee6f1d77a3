"""Grids with repeated or missing cells, packed grids that open or stay, and texts of spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import grids
from factloom.operators import statements as st

CELLS = "doc_id int, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string"


def grid(spark, rows, headers, doc=1):
    return spark.createDataFrame([(doc, 1, 0, "e", r + 1, c, headers[c], t) for r, row in enumerate(rows) for c, t in enumerate(row)], CELLS)


def pages_of(spark, docs, text="December 31, 2024 and 2023"):
    from factloom.functions import periods

    out = spark.createDataFrame([(d, 1, text) for d in docs], "doc_id int, page_num int, text string")
    return out.withColumns({"periods": periods.statement_periods(F.col("text")), "calendar": F.create_map(F.lit(2024), F.lit("2024-12-31"))})


def test_repeated_and_lost_cells_end_no_job(spark):
    cells = grid(spark, [["Cash", "1,000", "2,000"], ["Debt", "3,000", "4,000"], ["Rest", "5,000", "6,000"]], ["Label", "December 31, 2024", "December 31, 2023"])
    odd = cells.unionByName(cells.where("row_no = 1")).unionByName(cells.where("row_no = 2 and col_no = 1").withColumn("text", F.lit("9,000"))).unionByName(cells.where("row_no = 1").withColumn("col_no", F.lit(None).cast("int")))
    columns = grids.period_columns(odd, pages_of(spark, [1]))
    rows = grids.statement_rows(odd, columns, grids.label_columns(grids.column_facts(odd)))
    assert sorted((r["label"], tuple(r["values"])) for r in rows.collect()) == [("Cash", ("1,000", "2,000")), ("Debt", ("3,000", "4,000")), ("Rest", ("5,000", "6,000"))]


def test_packed_grids_open_with_their_years_or_stay(spark):
    packed = [[f"Line {i}", f"{i},000 {i},100 {i},200"] for i in range(1, 6)]
    years = grid(spark, packed, ["Item", "2024 2023 2022"], 1)
    without = grid(spark, packed, ["Item", "amounts"], 2)
    few = grid(spark, packed[:3], ["Item", "2024 2023 2022"], 3)
    plain = grid(spark, [["Cash", "1,000"], ["Debt", "2,000"]], ["Item", "2024"], 4)
    cells = years.unionByName(without).unionByName(few).unionByName(plain)
    found = spark.createDataFrame([(d, 1, "In 2021" if d == 2 else "") for d in (1, 2, 3, 4)], "doc_id int, page_num int, text string")
    out = grids.expanded(cells, grids.label_columns(grids.column_facts(cells)), found)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], {})[r["row_no"], r["col_no"]] = (r["header"], r["text"])
    assert [got[1][1, c] for c in range(4)] == [("label", "Line 1"), ("2022", "1,000"), ("2023", "1,100"), ("2024", "1,200")]
    assert [got[2][5, c] for c in range(4)] == [("label", "Line 5"), ("2021", "5,000"), ("extra1", "5,100"), ("extra2", "5,200")]
    assert got[3] == {(r, c): (("Item", "2024 2023 2022")[c], packed[r - 1][c]) for r in (1, 2, 3) for c in (0, 1)}
    assert got[4][2, 1] == ("2024", "2,000")


def test_texts_of_documents_without_pages_end_with_their_totals(spark):
    texts = ["Cash flows (continued)", "Statements of cash flows", "Net cash from operating activities 5", "net cash used in investing activities 6", "Net cash used in financing activities 7", "more", None]
    found = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)] + [(2, 1, "Balance"), (2, 2, "x"), (2, 3, "Statements of operations")], "doc_id int, page_num int, text string")
    starts = spark.createDataFrame([(1, "cashflow", 2), (2, "balance", 1), (2, "income", 3), (9, "income", 1), (2, "income", 8)], "doc_id int, statement string, page_num int")
    got = {(r["doc_id"], r["statement"]): (r["start"], r["end"], r["text"]) for r in st.statement_texts(found, starts, walk_back=False).collect()}
    assert got == {(1, "cashflow"): (2, 5, "\n".join(texts[1:5])), (2, "balance"): (1, 2, "Balance\nx"), (2, "income"): (3, 3, "Statements of operations")}
    back = {(r["doc_id"], r["statement"]): (r["start"], r["end"]) for r in st.statement_spans(found, starts).collect()}
    assert back == {(1, "cashflow"): (2, 7), (2, "balance"): (1, 2), (2, "income"): (3, 3)}
    assert st.statement_texts(found.where("false"), starts).count() == 0
