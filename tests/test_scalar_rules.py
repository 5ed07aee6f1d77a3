"""Scalar rules case by case: what each says of single texts. Queries over printed values are in plans.printed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import labels, lines, numbers, pages, periods
from factloom.operators import grids, refine, tables

CASES = {}


def cases(name, kind, rule, pairs):
    CASES[name] = (rule, pairs)


def _joined(column):
    return F.array_join(column, "|")


def _ends(found):
    return F.array_join(F.transform(found, lambda x: x["period_end"]), ",")


cases("net_income_labels", "INTEGER", labels.net_income_score, {
    "Net income before tax": -1, "Net income attributable to common stock": 30_000, "Other net income items": 0, "Net income": 55_000, "Net earnings": 50_000, "Profit for the year": 58_000, "Net income attributable to Acme": 60_000,
    "Net income from continuing operations": -1, "Income from continuing operations": 1_000, "Net income attributable to non-controlling interests": -1, "Net income (loss)": 55_000, "Amounts attributable to Acme common shareholders": 60_000, "Comprehensive income": -1, "Net income per share": -1,
})
cases("normal_labels", "VARCHAR", labels.normal_label, {"NNeett  IInnccoommee": "net income", "Netincomeattributableto Baidu": "netincome attributable to baidu", "Gain/(loss)": "gain (loss)", "  Total\tAssets ": "total assets", "Less:net of tax": "less: net of tax", "attributabletothe parent": "attributable to the parent"})
cases("cells_like_amounts", "BOOLEAN", numbers.looks_like_amount, {"1,234": True, "2(z)": False, "12": True, "$ 5,000": True, "Note 1,234 x": True, "": False, "84 683": True, "abc": False, "-": False, "(36)": True})
cases("cells_with_digits", "BOOLEAN", numbers.has_digit, {"1,234": True, "": False, "n/a": False, "Q1": True})
cases("amounts_of_packed_cells", "VARCHAR", lambda t: _joined(numbers.amount_tokens(t)), {"1,234 (5) 7.5 and 2345": "1,234|(5)|2345", "84 683 12 345": "84 683|12 345", "note 12": "", "12,5": "12,5", "23,979  23,533": "23,979|23,533", "(1,204) -4,000": "(1,204)|-4,000"})
cases("displayed_amounts", "DOUBLE", numbers.display_amount, {"(1,234)": -1234.0, "$ 5": 5.0, "a -7.5": -7.5, "none": None, "12 of 3": 12.0, "( 36 )": -36.0})
cases("smart_values", "VARCHAR", lambda t: numbers.smart_value(t)["kind"], {"-5": "text", "1,000": "number", "a": "text", "12.5%": "number", "(36)": "number", "2024 Q1": "text"})
cases("stuttered_numbers", "VARCHAR", lines.doubled_digits, {"11223344": "1234", "12345678": "12345678", "1122": "1122", "1 234": "1234", "1177,,334455": "17345"})
cases("cells_to_check_in_text", "BOOLEAN", labels.needs_text, {"": True, "1177,,334455": True, "12,345": False, "11223344": True, "1,234": False, "   ": True})
cases("parsed_cells", "DOUBLE", lines.cell_amount, {"(1,234)": -1234.0, "{2,l00}": -2100.0, "12": None, "$ 5,000": 5000.0, "-": None, "999": None, "(5)": -5.0, "-7,500": -7500.0, "12 345": 12345.0, "note (I0)": -10.0})
cases("parsed_share_cells", "DOUBLE", lambda t: lines.cell_amount(t, True), {"1.21": 1.21, "5": None, "(0.20)": -0.2, "$ 6.11": 6.11, "-1.50": -1.5, "$ -0.75": -0.75})
cases("plain_page_text", "VARCHAR", pages.page_text, {"Annual   report\n2024 ..... 12": "Annual report 2024 12", "a b": "a b", "CCaasshh  ffllooww": "Cash flow", "": ""})
cases("amount_density", "INTEGER", numbers.table_density, {"1,000 and $ 5 and (7) 12345": 5, "no numbers": 0, "1,000,000 2,000": 4, "1234 1235 1236": 3, "$ 12 (34) 5678": 3})
cases("spaced_amount_density", "INTEGER", numbers.spaced_density, {"84 683 and 1,000": 4, "$ 12 (34) 5678": 3, "12345 1 000": 3, "": 0})
cases("digits_alone", "VARCHAR", numbers.digits_of, {"1,234 (5)": "12345", "none": "", "$ 7": "7"})
cases("currency_codes", "VARCHAR", grids.currency_code, {"RMB": "CNY", "cny": "CNY", "US$": "USD", "HKD": "HKD", "hk$": "HKD", "EUR": "EUR", "gbp": "GBP"})
cases("page_currencies", "VARCHAR", grids.preferred_currency, {"(in RMB millions)": "CNY", "Expressed in HKD": "HKD", "US$ millions": "USD", "nothing said": "CNY", "人民币 and USD": "CNY"})
cases("cut_before_liabilities", "VARCHAR", lines.before_liabilities, {"Total current assets 1,000 2,000 Liabilities Accounts payable": "Total current assets 1,000 2,000", "Total liabilities 500 400 and more": "Total liabilities 500 400 and more", "Assets 1 2 3 4 5 6 7 8 liabilities and equity": "Assets 1 2 3 4 5 6 7 8 liabilities and equity"})
cases("lines_without_footnotes", "VARCHAR", lines.without_footnote, {"(in RMB million) 12 0.55": "0.55", "— RMB 3.10": "3.10", "0.55": "0.55", ": 7(a) 1.20": "1.20", "US$ 4.40": "4.40"})
cases("operating_cash_totals", "BOOLEAN", lambda t: labels.is_cash_total(t, "operating"), {"Net cash provided by operating activities": True, "Cash generated by operating activities": True, "Net cash flows generated from/(used in) operating activities": True, "Changes in operating assets": False, "Net cash from operations": True, "Net cash used in investing activities": False})
cases("investing_cash_totals", "BOOLEAN", lambda t: labels.is_cash_total(t, "investing"), {"Net cash provided by / (used in) investing activities": True, "Cash generated by/(used in) investing activities": True, "Net cash used for investing activities": True, "Purchases of investments": False})
cases("cash_line_classes", "VARCHAR", labels.cash_line_class, {"Cash flows from operating activities": "section", "Dividends paid": "component", "Net cash provided by operating activities:": "section", "Net income": "other", "Purchases of property and equipment": "component", "Net cash used in financing activities": "other"})
cases("complete_cash_statements", "BOOLEAN", labels.cash_statement_complete, {"Net cash from operating activities 5 net cash used in investing activities 6 Net cash used in financing activities 7": True, "Net cash from operations 5 net cash used in investing activities": False, "cash generated by operating activities; cash generated by/(used in) investing activities; cash used in financing activities": True, "": False})
cases("report_headers", "BOOLEAN", lambda t: labels.looks_like_report(F.split(t, r"\|")), {"Item|2024|2023": True, "Item|$ m": True, "Item|2024|2024": False, "Item|Total": False, "CHF|x": True})
cases("financial_headers", "BOOLEAN", labels.financial_header, {"2024": True, "US$": True, "USD": False, "Name": False, "Amount": False, "in million": True, "Net sales": True, "Total assets": True, "EPS": True})
cases("repaired_headers", "VARCHAR", lambda t: _joined(refine.repair_headers(F.split(t, r"\|"))), {"o1|net   sales": "o1|net sales", "q 2|TOTAL": "Q 2|TOTAL", "year": "year", "For the year ended December 31, 2024|Unit  Price": "2024|Unit Price", "qty|BUDGET|item": "Qty|Budget|Item"})
cases("split_headers", "VARCHAR", lambda t: _joined(refine.split_year_headers(F.split(t, r"\|"))), {"item|2024 2023": "item|2024|2023", "item|2024": "item|2024"})
cases("integral_cells", "VARCHAR", tables.integral_text, {"25.00": "25", "(36.0)": "-36", "7.5": "7.5", "abc.": "abc.", "12": "12"})
cases("compact_rows", "VARCHAR", lambda t: _joined(refine.compact_statement_rows(F.split(t, r"\|"))), {"Cash|$|1,234||$|5,678": "Cash|1,234|5,678", "Loss|(12|)|(34|)": "Loss|(12|(34", "Only|one": "Only|one"})
cases("header_dates", "VARCHAR", lambda t: _ends(periods.statement_periods(t)), {
    "September 28, 2024 September 30, 2023": "2024-09-28,2023-09-30", "Year Ended December 31,\n2024 2023 2022": "2024-12-31,2023-12-31,2022-12-31", "截至2024年12月31日止 截至2023年12月31日止": "2024-12-31,2023-12-31", "2024年3月31日 2023年3月31日": "2024-03-31,2023-03-31",
    "31 December 2023 and 31 December 2022": "2023-12-31,2022-12-31", "Dec 31, 2024 Dec 31, 2023": "2024-12-31,2023-12-31", "2024 2023 note": "2024-12-31,2023-12-31", "January 1, 2024 December 31, 2023 and December 31, 2022": "2023-12-31,2022-12-31", "February 31, 2023 and March 1, 2022": "2023-02-28,2022-03-01",
    "As of Sept 30, 2022\nSept 30, 2021 Year Ended June 30 | 2024 2023": "2024-06-30,2023-06-30", "none": "",
})
cases("year_column_blocks", "VARCHAR", lambda t: _ends(periods.year_columns(t)), {"Year Ended December 31,\n2024 2023": "2024-12-31,2023-12-31", "Fiscal years to June 30, | 2024 | 2023 | 2022": "2024-06-30,2023-06-30,2022-06-30", "December 31, 2024": "", "none": ""})
cases("balance_sheet_periods", "VARCHAR", lambda t: _ends(periods.balance_periods(periods.statement_periods(F.get(F.split(t, "#"), F.lit(0))), periods.statement_periods(F.get(F.split(t, "#"), F.lit(1))))), {
    "December 31, 2024 December 31, 2023#June 30, 2024 June 30, 2023": "2024-12-31,2023-12-31", "nothing#June 30, 2024 June 30, 2023": "2024-06-30,2023-06-30", "2024#": "2024-12-31", "2024#June 30, 2024 June 30, 2023": "2024-06-30,2023-06-30", "#": "",
})
cases("header_periods_of_columns", "VARCHAR", lambda t: periods.period_of_header(t, F.create_map(F.lit(2023), F.lit("2023-09-30")), periods.statement_periods(F.lit("June 30, 2022 June 30, 2021"))), {"September 28, 2024": "2024-09-28", "2023": "2023-09-30", "FY 2022": "2022-06-30", "2019": "2019-12-31", "2021 2020": None, "Total": None, "Sep 30, 2023": "2023-09-30"})
cases("ends_of_wanted_years", "VARCHAR", lambda t: F.array_join(periods.ends_of_years(periods.statement_periods(t), F.array(F.lit(2024), F.lit(2021))), ","), {"September 28, 2024 September 30, 2023": "2024-09-28,2021-12-31", "none": "2024-12-31,2021-12-31"})
cases("reporting_period_lists", "VARCHAR", lambda t: F.array_join(periods.reporting_periods(F.split(t, ",")), ","), {"2023-12-31,2022-12-31,2022-01-01": "2023-12-31,2022-12-31", "2023-05-05,2022-05-05,2022-01-01": "2023-05-05,2022-05-05", "2023-01-01": "2023-01-01", "2023-01-01,2022-01-02": ""})
cases("balance_title_places", "INTEGER", lambda t: pages.title_at(t, pages.TITLES["balance"][0]), {"consolidated balance sheets as of 2024": 0, "consolidated balance sheets in the period": None, "12 acme consolidated balance sheet": 8, "nothing": None, "see consolidated balance sheets classification": 4, "x" * 600 + " consolidated balance sheets as of 2024": 601, "x" * 600 + " consolidated balance sheets were changed": None})
cases("excluded_heads", "BOOLEAN", pages.is_excluded, {"table of contents item 1": True, "table of contents consolidated balance sheets (in millions)": False, "notes to consolidated financial statements": True, "consolidated statements of income": False, "shareholder proposal two": True, "table of contents consolidated balance sheets": False})
cases("heads_without_noise", "VARCHAR", pages.without_head_noise, {"12 Annual Report 2024 Revenue": "Revenue", "Acme Holdings 5 Balance sheet": "Balance sheet", "Plain head": "Plain head", "7 Beta Inc. 8 Cash": "Cash"})


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    rule, pairs = CASES[name]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i int, t string")
    got = [r["found"] for r in rows.select("i", rule(F.col("t")).alias("found")).orderBy("i").collect()]
    assert got == list(pairs.values())
