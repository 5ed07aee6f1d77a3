"""Single operators on small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import labels, lines, numbers, periods
from factloom.operators import align, facts, glyphs, locate, markets, reconcile, refine, tables
from factloom.sources import packages, workbooks
from factloom.streaming import usage


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_to_number(spark):
    cases = {"1,234.5": 1234.5, "(36)": -36.0, "$ 5": 5.0, "—": None, "": None, None: None, "CHF 7": 7.0, "1_000": None, "1d": None, "nan": None, "−4": -4.0, "12%": None}
    assert column(spark, list(cases), numbers.to_number) == list(cases.values())


def test_line_amounts(spark):
    cases = {
        "Net sales $ 391,035 $ 383,285": [391035.0, 383285.0],
        "Loss (1,204) (88)": [-1204.0],
        "in 2024 and 2023": [],
        "note 12 total 456 789": [456.0, 789.0],
        "$ 2,024": [2024.0],
        "12345": [12345.0],
        "": [],
        None: [],
    }
    assert column(spark, list(cases), lambda v: numbers.line_amounts(v)) == list(cases.values())
    assert column(spark, ["1,000 2,000"], lambda v: numbers.line_amounts(v, 1000.0)) == [[1.0, 2.0]]
    assert column(spark, ["Basic $ 6.11 (0.20) 15"], numbers.per_share_amounts) == [[6.11, -0.2]]


def test_pairs_units_and_density(spark):
    assert column(spark, ["$ 1,000 $ 2,000", "$ 10 20", "(5) (6)", "7 8", "9"], numbers.amount_pair) == [["1,000", "2,000"], ["10", "20"], ["(5)", "(6)"], ["7", "8"], []]
    assert column(spark, ["(in millions)", "In thousands", "shares in thousands", "in thousands, except in millions"], numbers.unit_divisor) == [1.0, 1000.0, 1.0, 1.0]
    units = ["(in thousands, except number of shares in thousands)", "amounts in thousands; shares reflected in thousands", "All amounts in thousands" + " " * 4000 + "in millions", "(000s)"]
    assert column(spark, units, numbers.unit_divisor) == [1.0, 1.0, 1000.0, 1.0]
    assert column(spark, ["1,000 and $ 5 and (7) 12345"], numbers.table_density) == [2 + 1 + 1 + 1]
    assert [x["kind"] for x in column(spark, ["-5", "1,000", "a", "12.5%"], numbers.smart_value)] == ["text", "number", "text", "number"]


def test_labels(spark):
    assert column(spark, ["NNeett rreevveennuuee", "Net revenue", "aabb", "ok"], labels.repair_stutter) == ["Net revenue", "Net revenue", "ab", "ok"]
    assert column(spark, ["··", "", "Total", "ab", "x1"], labels.garbled_total) == [True, True, False, False, True]
    assert column(spark, ["Net income attributable to A", "Net income per share", "Net earnings", "Rent", "Net income before tax", "Net income attributable to common stock", "Other net income items", "Net income"], labels.net_income_score) == [60_000, -1, 50_000, 0, -1, 30_000, 0, 55_000]
    assert column(spark, ["Net cash from operating activities", "Net cash from investing activities"], lambda v: labels.cashflow_score(v, "operating")) == [20_000, -1]
    assert column(spark, ["RMB", "us$", None, "€"], lambda v: labels.currency_of(v, "HKD")) == ["CNY", "USD", "HKD", "EUR"]
    assert column(spark, ["<p>a&amp;b</p><script>x<y</script> c"], labels.html_blocks_text) == ["a&b c"]


def test_lines(spark):
    assert column(spark, ["Total revenue $ 1,000", "no amount here at all, only a label that goes on and on"], lines.label_before_amounts) == ["Total revenue ", "no amount here at all, only a label that goes on a"]
    assert column(spark, ["Total liabilities and equity 5 Liabilities 7", "Liabilities 5"], lines.before_liabilities) == ["Total liabilities and equity 5", "Liabilities 5"]
    assert column(spark, ["Basic 1.20 — Diluted 1.10", "Basic and diluted 1.20"], lines.basic_part) == ["Basic 1.20", "Basic and diluted 1.20"]
    assert column(spark, ["(in RMB) — 12 RMB 0.55", "0.55"], lines.without_footnote) == ["0.55", "0.55"]
    assert column(spark, ["(1,234)", "{2,l00}", "12", "$ 5,000", "—"], lines.cell_amount) == [-1234.0, -2100.0, None, 5000.0, None]
    assert column(spark, ["1.21", "5"], lambda v: lines.cell_amount(v, per_share=True)) == [1.21, None]
    assert column(spark, ["11223344", "12345678", "1122"], lines.doubled_digits) == ["1234", "12345678", "1122"]
    assert column(spark, ["1,234 (5) 7.5", None], numbers.amount_tokens) == [["1,234", "(5)"], []]


def test_alignment(spark):
    columns = [["2024-09-28", "2023-09-30", "2023-12-31"], []]
    assert column(spark, columns, lambda v: align.column_of_period(v, F.lit("2023-09-30")), "array<string>") == [1, None]
    assert column(spark, columns, lambda v: align.column_of_period(v, F.lit("2023-01-01")), "array<string>") == [2, None]
    rows = [("d", 0, "Cash", ["1", ""]), ("d", 1, "cash ", ["1", "2"]), ("d", 2, "CASH", ["3", "4"])]
    assert [r["grid_ord"] for r in align.merge_grids(spark.createDataFrame(rows, "doc_id string, grid_ord int, label string, values array<string>")).collect()] == [1]


def test_periods(spark):
    heads = ["September 28, 2024 September 30, 2023", "31 December 2023 and 31 December 2022", "2024 2023 note", "February 31, 2023 and March 1, 2022", "none"]
    assert column(spark, heads, periods.dates_in) == [["2024-09-28", "2023-09-30"], ["2023-12-31", "2022-12-31"], ["2024-12-31", "2023-12-31"], ["2023-02-28", "2022-03-01"], []]
    rows = [["2023-12-31", "2022-12-31", "2022-01-01"], ["2023-05-05", "2022-05-05", "2022-01-01"], ["2023-01-01"], ["2023-01-01", "2022-01-02"]]
    assert column(spark, rows, periods.reporting_periods, "array<string>") == [["2023-12-31", "2022-12-31"], ["2023-05-05", "2022-05-05"], ["2023-01-01"], []]


FACTS = "entity string, field_id string, period_end string, value double, ord int"


def test_statuses(spark):
    x = [("e", "revenue", "2024", 100.0, 0), ("e", "revenue", "2023", 50.0, 0), ("e", "revenue", "2023", 60.0, 1), ("e", "eps_basic", "2024", 1.21, 0), ("e", "capex", "2024", -5000.0, 0), ("e", "cash", "2024", 7.0, 0), ("e", "cfo", "2024", None, 0), ("e", "net_income", "2024", 10.0, 0)]
    d = [("e", "revenue", "2024", 100.9, 0), ("e", "revenue", "2023", 70.0, 0), ("e", "eps_basic", "2024", 12.05, 0), ("e", "capex", "2024", 5000.0, 0), ("e", "cfi", "2024", 3.0, 0), ("o", "revenue", "2020", 1.0, 0), ("e", "net_income", "2024", 10.0, 0)]
    skips = spark.createDataFrame([("e", "cash", None), ("e", "cfi", "2024"), ("e", "net_income", None)], "entity string, field_id string, period_end string")
    items = reconcile.reconcile(spark.createDataFrame(x, FACTS), spark.createDataFrame(d, FACTS), skips)
    got = {(r["entity"], r["field_id"], r["period_end"]): r for r in items.collect()}
    assert len(got) == 39
    status = lambda f, p="2024", e="e": got[e, f, p]["status"]
    assert status("revenue") == "matched" and status("revenue", "2023") == "mismatch" and got["e", "revenue", "2023"]["xbrl_value"] == 60.0
    assert status("eps_basic") == "matched" and status("capex") == "matched" and status("cash") == "skipped" and status("cfi") == "skipped"
    assert status("cfo") == "both_missing" and status("net_income") == "matched" and status("revenue", "2020", "o") == "pdf_only"
    assert got["e", "revenue", "2024"]["delta"] == 0.9 and got["e", "revenue", "2024"]["delta_pct"] == 0.009
    report = {r["entity"]: r for r in reconcile.report(items).collect()}
    assert report["e"]["matched"] == 4 and report["e"]["verification_rate"] == 0.8


def test_empty_sides(spark):
    none = spark.createDataFrame([], FACTS)
    assert reconcile.reconcile(none, none).count() == 0
    assert reconcile.report(reconcile.reconcile(none, none)).count() == 0


def test_identities(spark):
    rows = [("e", f, p, v, 0) for p, vs in (("a", (1000.0, 600.0, 400.0)), ("b", (1000.0, 600.0, 350.0)), ("c", (1.0, None, 1.0))) for f, v in zip(("total_assets", "total_liabilities", "total_equity"), vs, strict=True)]
    got = {r["period_end"]: (r["passed"], r["delta"]) for r in reconcile.identities(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {"a": (True, 0.0), "b": (False, 50.0)}


def test_greedy_period_matches(spark):
    rows = [("e", "2024", "d1", 3), ("e", "2024", "d2", 3), ("e", "2023", "d2", 5), ("e", "2023", "d1", 1), ("e", "2022", "d1", 1)]
    got = reconcile.match_periods(spark.createDataFrame(rows, "entity string, x_period string, d_period string, agreements long")).collect()
    assert sorted((r["x_period"], r["d_period"]) for r in got) == [("2023", "d1"), ("2024", "d2")]


def test_filings(spark):
    body = '{"us-gaap":{"A":{"USD":[{"start":"2023-01-01","end":"2023-12-31","val":5.0,"fp":"FY","form":"10-K","filed":"2024-02-01"},{"start":"2023-01-01","end":"2023-12-31","val":6.0,"form":"10-K/A","filed":"2024-03-01"},{"start":"2023-10-01","end":"2023-12-31","val":1.0,"fp":"FY","form":"10-K","filed":"2024-02-01"}]},"B":{"EUR":[{"start":"2012-01-01","end":"2012-12-31","val":9.0,"form":"20-F","filed":"2013-01-01"}]}}}'
    entries = facts.parse_filings(spark.createDataFrame([("e", body), ("bad", "no json"), ("none", None)], "entity string, body string"))
    annual = facts.annual_entries(entries, "revenue")
    assert annual.count() == 3 and facts.annual_entries(entries, "cash").count() == 0
    latest = facts.latest_filed(annual)
    assert {(r["tag"], r["val"]) for r in latest.collect()} == {("A", 6.0), ("B", 9.0)}
    assert [r["tag"] for r in facts.pick_tag(latest, ["B", "A"], 3).collect()] == ["A"]


def test_tables(spark):
    rows = [["item", "a", "b"], ["x", "1", "2"], ["y", "3", None], ["··", "4", "2"]]
    cells = [("d", 1, 0, "docling", r, c, rows[0][c], t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id string, page_num int, table_index int, engine string, row_no int, col_no int, header string, text string")
    total = tables.total_rows(df).first()
    assert (total["row_no"], total["matched"], total["numeric"], total["garbled"]) == (3, 2, 2, True)
    assert tables.numeric_consistency(df).first()["numeric"] == 1.0
    assert {(r["col_no"], r["total"], r["mean"]) for r in tables.column_summary(df).collect()} == {(1, 8.0, 2.67), (2, 4.0, 2.0)}
    assert tables.column_agreement(df, df).first()["agreement"] == 1.0
    part = df.where("row_no > 0 and col_no > 0").select("doc_id", (F.col("row_no") - 1).alias("row_no"), (F.col("col_no") - 1).alias("col_no"), "text")
    assert tables.compare_grids(part, df.select("doc_id", "row_no", "col_no", "text"), ["doc_id"]).first()["accuracy"] == 1.0
    twice = df.unionByName(df.withColumn("table_index", F.lit(1)))
    assert [r["table_index"] for r in tables.distinct_tables(twice).collect()] == [0]


def test_refining(spark):
    rows = [["(12", "5)", "x"], ["a", None, "(3)"], ["(", ")", ""]]
    assert column(spark, rows, refine.join_parentheses, "array<string>") == [["(125)", "", "x"], ["a", "", "(3)"], ["()", "", ""]]
    assert column(spark, [["a", "$ 1 $ 2", ""], ["a", "1 2", "3"]], refine.split_amounts, "array<string>") == [["a", "1", "2"], ["a", "1 2", "3"]]
    assert column(spark, [["item", "2024 2023", "note 2020"]], refine.split_year_headers, "array<string>") == [["item", "2024", "2023", "note 2020"]]
    assert column(spark, [["o1", " net  sales ", "q2", "As of December 31, 2024"]], refine.repair_headers, "array<string>") == [["o1", "net sales", "Q2", "2024"]]
    assert column(spark, [["Cash", "$", "1,234", "", "$ 5", ")"], ["x", "y"]], refine.compact_statement_rows, "array<string>") == [["Cash", "1,234", "5"], ["x", "y"]]
    wide = spark.createDataFrame([("t", 0, ["a", "b", "1", "c", "d", "2", "3", "4", "5"]), ("t", 1, ["e", "f", "1", "g", "h", "2", "3", "4", "5"])], "t string, row_no int, cells array<string>")
    assert [r["cells"] for r in refine.merge_fragments(wide, ["t"]).orderBy("row_no").collect()] == [["a b", "1", "c d", "2", "3", "4", "5"], ["e f", "1", "g h", "2", "3", "4", "5"]]
    pairs = spark.createDataFrame([("d", 1, 0, 0, 0.5), ("d", 1, 0, 1, 0.9), ("d", 1, 1, 1, 1.0), ("d", 1, 1, 0, 0.2)], "doc_id string, page_num int, a int, b int, score double")
    assert sorted((r["a"], r["b"]) for r in refine.greedy_pairs(pairs).collect()) == [(0, 1), (1, 0)]


def test_glyph_columns(spark):
    chars = [("d", 0, i, float(x), float(x + 8), c) for i, (x, c) in enumerate([(0, "a"), (8, "b"), (100, "c"), (300, "d")])]
    found = glyphs.words(spark.createDataFrame(chars, "doc_id string, line int, ord int, x0 double, x1 double, text string"))
    assert sorted(r["text"] for r in found.collect()) == ["ab", "c", "d"]
    columns = glyphs.column_clusters(found)
    assert sorted(r["center"] for r in columns.collect()) == [0.0, 100.0, 300.0]
    assert [r["center"] for r in glyphs.merge_close(columns, 150.0).orderBy("col").collect()] == [50.0, 300.0]
    assert {(r["text"], r["col"]) for r in glyphs.grid(glyphs.nearest_column(found, columns)).collect()} == {("ab", 0), ("c", 1), ("d", 2)}


def test_locating(spark):
    pages = spark.createDataFrame([("d", p, t) for p, t in enumerate(["contents", "balance sheet 1", "more", "cash flow statement", "end"], 1)], "doc_id string, page_num int, text string")
    titles = spark.createDataFrame([("balance", "balance sheet", 2), ("cashflow", "cash flow", 2)], "statement string, pattern string, strength int")
    picked = locate.pick_pages(locate.candidates(pages, titles, F.length("text")))
    assert {(r["statement"], r["page_num"]) for r in picked.collect()} == {("balance", 2), ("cashflow", 4)}
    spans = locate.page_spans(pages, picked.select("doc_id", "page_num"), F.col("text").contains("statement"))
    assert sorted((r["start"], r["page_num"]) for r in spans.collect()) == [(2, 2), (2, 3), (4, 4), (4, 5)]


def test_packages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("reports/x.xhtml", "<html/>")
        z.writestr("META/y.xml", "<y/>")
    got = packages.read_packages(spark, f"file://{tmp_path}")
    assert {(r["name"], bytes(r["content"])) for r in packages.read_packages(spark, f"file://{tmp_path}", "suffix = 'xhtml'").collect()} == {("reports/x.xhtml", b"<html/>")}
    assert got.where("suffix = 'xml'").count() == 1 and got.count() == 2


def test_html_and_json_cells(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1 <b>x</b></td></tr></table><table></table>"
    got = packages.html_table_cells(spark.createDataFrame([(1, html), (2, None), (3, "none")], "id long, html string"), "id", "html").collect()
    assert [(r["row_no"], r["col_no"], r["header"], r["text"]) for r in got] == [(0, 0, "a", "a"), (0, 1, "b", "b"), (1, 0, "a", "1 x"), (1, 1, "b", "")]
    answer = 'Sure: {"tables":[{"headers":["h","i"],"rows":[["1"],["2","3","4"]]},{"headers":["one"],"rows":[["x"]]}]} done'
    cells = packages.json_table_cells(spark.createDataFrame([(1, answer), (2, "no")], "id long, text string"), "id", "text").collect()
    assert [(r["row_no"], r["header"], r["text"]) for r in cells] == [(1, "h", "1"), (1, "i", ""), (2, "h", "2"), (2, "i", "3")]


def test_registry_lookups(spark):
    index = packages.ticker_index(spark.createDataFrame([('{"0":{"ticker":"aa","cik_str":1},"1":{"ticker":"AA","cik_str":2}}',)], "body string"))
    got = packages.resolve_ciks(spark.createDataFrame([("aa",), ("zz",)], "ticker string"), index).collect()
    assert {(r["ticker"], r["cik"], r["error"]) for r in got} == {("AA", "0000000002", None), ("ZZ", None, "unknown ticker: ZZ")}
    subs = spark.createDataFrame([("e", ["8-K", "10-K", "10-K"], ["a", "b", "c"], ["x", "y", "z"])], "entity string, form array<string>, accession array<string>, document array<string>")
    assert packages.latest_submission(subs, "10-K").first()["accession"] == "b"
    filings = spark.createDataFrame([("e", "2023-12-31", "fr", "u1"), ("e", "2023-06-30", "en", "u2"), ("e", "2022-12-31", "en", "u3"), ("o", "2020-12-31", "fr", "u4")], "entity string, period_end string, language string, url string")
    assert {(r["entity"], r["url"]) for r in packages.pick_filing(filings, 2023).collect()} == {("e", "u2"), ("o", "u4")}


def test_company_facts_of_both_taxonomies(spark):
    entry = "entity string, taxonomy string, tag string, unit string, ord int, start string, `end` string, val double, fp string, form string, filed string"
    year = lambda e, t, tag, y, v, unit="USD", filed="2025-01-01", start=True: (e, t, tag, unit, 0, f"{y}-01-01" if start else None, f"{y}-12-31", v, "FY", "10-K", filed)
    rows = [
        year("a", "us-gaap", "Revenues", 2023, 5e6), year("a", "us-gaap", "SalesRevenueNet", 2023, 7e6), year("a", "us-gaap", "Revenues", 2010, 1e6), year("a", "us-gaap", "EarningsPerShareBasic", 2023, 1.5, "USD/shares"),
        year("a", "us-gaap", "CashCashEquivalentsAndShortTermInvestments", 2023, 9e6, start=False), year("a", "us-gaap", "CashAndCashEquivalentsAtCarryingValue", 2023, 8e6, start=False), year("a", "ifrs-full", "Equity", 2023, 3e6, start=False),
        year("b", "ifrs-full", "Revenue", 2022, 4e6, "EUR"), year("b", "ifrs-full", "Revenue", 2022, 6e6, "EUR", "2026-01-01"), year("b", "ifrs-full", "Revenue", 2022, 1e6, "GBP"),
        ("c", "us-gaap", "Revenues", "USD", 0, "2023-01-01", "2023-03-31", 1e6, "Q1", "10-Q", "2023-05-01"),
    ]
    found, errors = markets.company_facts(spark.createDataFrame(rows, entry))
    got = {(r["entity"], r["field_id"], r["period_end"][:4], r["value"], r["currency"], r["standard"]) for r in found.collect()}
    assert got == {("a", "revenue", "2023", 7.0, "USD", "US-GAAP"), ("a", "eps_basic", "2023", 1.5, "USD", "US-GAAP"), ("a", "cash", "2023", 8.0, "USD", "US-GAAP"), ("b", "revenue", "2022", 6.0, "EUR", "IFRS")}
    assert {r["entity"]: r["n"] for r in errors.groupBy("entity").agg(F.count("*").alias("n")).collect()} == {"a": 10, "b": 12, "c": 13}


def test_hong_kong_codes(spark):
    assert column(spark, ["5.hk", " 0700.HK", "aapl", "12345"], markets.hk_code) == ["0005", "0700", "AAPL", "12345"]
    got = markets.with_listings(spark.createDataFrame([("9618",), ("x",)], "ticker string")).collect()
    assert {(r["code"], r["us_ticker"], r["industry"]) for r in got} == {("9618", "JD", "platform"), ("X", None, None)}


def test_workbook_opens_again(spark, tmp_path):
    items = reconcile.reconcile(spark.createDataFrame([("e", "revenue", "2024", 5.0, 0)], FACTS), spark.createDataFrame([("e", "revenue", "2024", 5.0, 0)], FACTS))
    workbooks.verified_workbook(items, reconcile.report(items), tmp_path / "w.xlsx", ["2024"])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet3.xml").decode()
        assert "<v>5.0</v>" in sheet and "<f>SUM(C2:C6)</f>" in sheet
    assert workbooks.json_report(items.select("entity", "field_id", "status")).count() == 1
    assert workbooks.safe_sheet_name("a/b" * 20, {("a_b" * 20)[:31]}) == ("a_b" * 20)[:29] + "_2"


def test_rejected_requests_do_not_count(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, at(s), 1) for i, s in enumerate((0, 10, 20, 59, 60, 61, 70))] + [(10, at(5), 2)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    got = {r["event_id"]: r["accepted"] for r in usage.rate_limited(events, 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 10: True}  # the second 60 is still within 60 seconds of the first


def test_stream_gives_what_batch_gives(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = sorted(map(tuple, usage.daily(spark.read.parquet(source)).collect()))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "events.parquet").symlink_to(source)
    query = usage.daily(usage.read_stream(spark, str(folder))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == batch


@pytest.mark.parametrize("value", [None, "", "x" * 10_000])
def test_scalars_take_odd_texts(spark, value):
    for f in (numbers.to_number, numbers.line_amounts, numbers.amount_pair, numbers.unit_divisor, labels.normal_label, labels.garbled_total, labels.html_blocks_text, periods.dates_in, tables.integral_text):
        column(spark, [value], f)


def test_numbers_of_cells_are_to_numbers(spark):
    """cell_number() takes short ways, with the same result as to_number(); words are told apart without it."""
    from factloom.functions.numbers import cell_number, to_number

    texts = ["12", "007", " 12 ", "12\n", "12 ", "12\u0085 ", "1,234.50", "(5)", "( 5 )", "--5", "−7", "1e3", "CHF 5", "€ 1", "¥12", "line 1", "Total", "1d", "NaN", "Infinity", "", "-", None, "1.2.3", "5%", "(12 )", "9" * 400, "٣", "+.5", "12f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cell_number(F.col("t")).alias("a"), to_number(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(r["b"] is not None for r in rows) >= 14
