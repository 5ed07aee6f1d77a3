"""Scalar rules over lines, cells and headers that are printed from each part's own values.

A query prints every part's values into one of its templates, applies the rule, and its SQL works
out from the values, or from the printed text, what the rule has to find.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.functions import labels, lines, numbers, pages, periods
from factloom.operators import facts as fx
from factloom.operators import grids, refine, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: A rule takes up to half a millisecond a part, so one task takes few.
PARTS_A_TASK = 4000

#: What templates may name: k 1 to 50, n a number of four digits or more with commas (i plain, n1 the next one), y a year and the two before, w a word, M a month with its day d.
def _values():
    key = F.col("p_partkey")
    months = F.array(*(F.lit(m.capitalize()) for m in periods.MONTHS))
    i = (1000 + key * 7 + F.col("p_size") * 997).cast("long")
    year = (2001 + F.col("p_size") % 20).cast("int")
    return {
        "k": F.col("p_size").cast("string"), "i": i.cast("string"), "n": F.format_number(i, 0), "n1": F.format_number(i + 1, 0), "y": year.cast("string"), "y1": (year - 1).cast("string"), "y2": (year - 2).cast("string"),
        "w": F.split("p_name", " ")[0], "M": F.get(months, (key % 12).cast("int")), "d": (1 + key % 28).cast("string"),
    }


_MONTHS_SQL = "[" + ", ".join(f"'{m.capitalize()}'" for m in periods.MONTHS) + "]"
_VALUES_SQL = f"""v AS (SELECT p_partkey, p_partkey AS key, p_size AS size, 1000 + p_partkey * 7 + p_size * 997 AS amount, 2001 + p_size % 20 AS year, p_partkey % 12 + 1 AS month, 1 + p_partkey % 28 AS day, split_part(p_name, ' ', 1) AS w FROM part),
    p AS (SELECT *, CAST(size AS VARCHAR) AS k, CAST(amount AS VARCHAR) AS i, format('{{:,}}', CAST(amount AS BIGINT)) AS n, format('{{:,}}', CAST(amount + 1 AS BIGINT)) AS n1, CAST(year AS VARCHAR) AS y, CAST(year - 1 AS VARCHAR) AS y1, CAST(year - 2 AS VARCHAR) AS y2, {_MONTHS_SQL}[month] AS mname, CAST(day AS VARCHAR) AS d, lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(day AS VARCHAR), 2, '0') AS md FROM v)"""
_FIELD = re.compile(r"\{(k|i|n1|n|y1|y2|y|w|M|d)\}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def printed(name: str, kind: str, rule, templates: dict[str, str]) -> None:
    """A query that gives every part one of the templates and applies the rule; the values are SQL for what it finds, over the values and the text t."""
    n = len(templates)

    def text(template, known):
        parts = [known[p] if j % 2 else F.lit(p) for j, p in enumerate(_FIELD.split(template)) if p or j % 2]
        return F.concat(*parts) if parts else F.lit("")

    def run(spark, sf_dir):
        known = _values()
        chosen = F.get(F.array(*(text(x, known) for x in templates)), (F.col("p_partkey") % n).cast("int"))
        parts = fx.dealt(fx.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", PARTS_A_TASK)
        return parts.select("p_partkey", chosen.alias("text")).select("p_partkey", rule(F.col("text")).alias("found"))

    run.__name__ = name
    shown = {"M": "mname"}
    sql_text = lambda t: " || ".join([shown.get(p, p) if j % 2 else _quoted(p) for j, p in enumerate(_FIELD.split(t)) if p or j % 2] or ["''"])
    texts = " ".join(f"WHEN {j} THEN {sql_text(t)}" for j, t in enumerate(templates))
    found = " ".join(f"WHEN {j} THEN ({sql})" for j, sql in enumerate(templates.values()))
    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_VALUES_SQL}, q AS (SELECT *, CASE p_partkey % {n} {texts} END AS t FROM p) SELECT p_partkey, CAST(CASE p_partkey % {n} {found} END AS {kind}) AS found FROM q"


def matched(name: str, kind: str, rule, templates: tuple[str, ...], sql: str) -> None:
    """The same with one SQL expression over the text t for all templates."""
    printed(name, kind, rule, dict.fromkeys(templates, sql))


def _joined(column):
    return F.array_join(column, "|")


def _ends(found):
    return F.array_join(F.transform(found, lambda x: x["period_end"]), ",")


# amounts ---------------------------------------------------------------------------------------

_SPACED = r"\(?\s*-?\d{1,3}(?: \d{3})+(?:\.\d+)?\s*\)?"
matched("cells_like_amounts", "BOOLEAN", numbers.looks_like_amount, ("{n}", "{k}(z)", "{k}", "$ {n}", "Note {n} x", "", "{k} 683", "{w}", "-", "({k})", "{w} {k}"), rf"regexp_full_match(trim(t), '{_SPACED}') OR regexp_matches(t, '\d{{1,3}}(?:,\d{{3}})+') OR regexp_matches(trim(t), '^[()$\s-]*\d[\d,]*(?:\.\d+)?[()$\s-]*$')")
matched("cells_with_digits", "BOOLEAN", numbers.has_digit, ("{n}", "", "{w}", "Q{k}", "{w} {y}"), r"regexp_matches(t, '[0-9]')")
printed("amounts_of_packed_cells", "VARCHAR", lambda t: _joined(numbers.amount_tokens(t)), {"{n} ({k}) 7.5 and {i}": "n || '|(' || k || ')|' || i", "{k} 683 {k} 345": "k || ' 683|' || k || ' 345'", "note {k}": "''", "{n}  {n1}": "n || '|' || n1", "({n}) -{n1}": "'(' || n || ')|-' || n1", "{k},5": "k || ',5'"})
printed("displayed_amounts", "DOUBLE", numbers.display_amount, {"({n})": "-amount", "$ {k}": "size", "{w} -{k}.5": "-(size + 0.5)", "{w}": "NULL", "{k} of 3": "size", "( {k} )": "-size"})
matched("smart_values", "VARCHAR", lambda t: numbers.smart_value(t)["kind"], ("-{k}", "{n}", "{w}", "{k}.5%", "({k})", "{y} Q{k}", "$ {n}"), r"CASE WHEN regexp_full_match(trim(t), '[$]?\s*\(?\d[\d,]*(\.\d+)?\)?%?') THEN 'number' ELSE 'text' END")
_UNDOUBLED = "'1122' || y"
for _digit in range(10):
    _UNDOUBLED = f"replace({_UNDOUBLED}, '{_digit}{_digit}', '{_digit}')"
printed("stuttered_numbers", "VARCHAR", lines.doubled_digits, {"1122{y}": _UNDOUBLED, "{i}": "i", "{k} 234": "k || '234'", "{w} {n}": "w || ' ' || n"})
printed("parsed_cells", "DOUBLE", lines.cell_amount, {"({n})": "-amount", "{k}": "NULL", "$ {n}": "amount", "-": "NULL", "({k})": "-size", "-{n}": "-amount", "{k} 345": "CAST(k || '345' AS DOUBLE)", "{{n}}": "-amount"})
printed("parsed_share_cells", "DOUBLE", lambda t: lines.cell_amount(t, True), {"{k}.21": "size + 0.21", "{k}": "NULL", "({k}.20)": "-(size + 0.2)", "$ {k}.11": "size + 0.11", "-{k}.50": "-(size + 0.5)", "$ -{k}.75": "-(size + 0.75)"})
_DENSE = r"2 * len(regexp_extract_all(t, '\b\d{1,3}(?:,\d{3})+\b')) + len(regexp_extract_all(t, '\$\s*[\d,]+')) + len(regexp_extract_all(t, '\(\s*[\d,]+\s*\)')) + least(12, len(list_filter(regexp_extract_all(t, '(?:^|[^\d.])(\d+)', 1), lambda x: length(x) BETWEEN 4 AND 7)))"
_LINES = ("{n} and $ {k} and ({k}) {i}", "{w}", "{n} {n1} {y}", "{y} {y1} {y2}", "$ {k} (34) {i}", "{k} 683 and {n}", "")
matched("amount_density", "INTEGER", numbers.table_density, _LINES, _DENSE)
matched("spaced_amount_density", "INTEGER", numbers.spaced_density, _LINES, _DENSE + r" + 2 * len(regexp_extract_all(t, '\b\d{1,3}(?: \d{3})+\b'))")
matched("digits_alone", "VARCHAR", numbers.digits_of, ("{n} ({k})", "{w}", "$ {k}", "{M} {d}, {y}"), r"regexp_replace(t, '[^0-9]', '', 'g')")
printed("unit_divisor", "DOUBLE", numbers.unit_divisor, {
    "{w} (in millions) {n}": "1", "{w}, all amounts in thousands {n}": "1000", "(in thousands, except number of shares in thousands) {n}": "1", "{n} in  thousands; {k} shares": "1000", "{w} shares are reflected in thousands, amounts in thousands": "1",
    "In millions, {w} in thousands": "1", "(000s) {n}": "1", "{w} {n}": "1", "in thousands {w}" + " " * 2600 + "in millions": "1000", " " * 2600 + "in thousands {w}": "1",
})
matched("integral_cells", "VARCHAR", tables.integral_text, ("{k}.00", "({k}.0)", "{k}.5", "{w}.", "{k}"), r"CASE WHEN regexp_full_match(t, '\(?[0-9]+\.0+\)?') THEN replace(regexp_replace(regexp_replace(t, '\.0+', ''), '\(', '-'), ')', '') ELSE t END")

# labels and headers ----------------------------------------------------------------------------

_NET = ("Net income before tax {k}", "Net income attributable to common stock", "{w} net income items", "Net income", "Net earnings", "Profit for the year {y}", "Net income attributable to {w}", "Net income from continuing operations", "Income from continuing operations", "Net income (loss)", "Amounts attributable to {w} common shareholders", "Comprehensive income {k}", "{w} per share")
matched("net_income_labels", "INTEGER", labels.net_income_score, _NET, r"""CASE WHEN regexp_matches(lower(t), 'comprehensive|before tax|per share|non[- ]?controlling|discontinued|\bnet income(/(expense))? from\b') THEN -1 ELSE
    CASE WHEN regexp_matches(lower(t), 'attributable to .+ common shareholders') THEN 60000 WHEN regexp_matches(lower(t), 'net (income|earnings)( \(loss\))? attributable to') AND NOT contains(lower(t), 'common stock') THEN 60000 WHEN contains(lower(t), 'attributable to common stock') THEN 30000 ELSE 0 END
    + CASE WHEN contains(lower(t), 'profit for the year') THEN 58000 ELSE 0 END + CASE WHEN lower(t) IN ('net income', 'net income (loss)') THEN 55000 WHEN lower(t) IN ('net earnings', 'net earning') THEN 50000 ELSE 0 END + CASE WHEN regexp_matches(lower(t), 'from (continuing|discontinued)') THEN 1000 ELSE 0 END END""")
printed("normal_labels", "VARCHAR", labels.normal_label, {"Netincomeattributableto {w}": "'netincome attributable to ' || w", "{w}/(loss)": "w || ' (loss)'", "  Total\t{w} ": "'total ' || w", "Less:net of {w}": "'less: net of ' || w", "NNeett  IInnccoommee": "'net income'", "{w}  attributabletothe parent": "w || ' attributable to the parent'"})
printed("line_label_scores", "INTEGER", lambda t: labels.revenue_priority(t) * 100_000 + labels.cashflow_score(t, "operating"), {"Total revenue {n}": "200000", "{w} segment revenue {k}": "100000", "Net cash from operating activities {n}": "20000", "{w} operating lines": "5000", "Net cash from investing {k}": "-1", "{w}": "0", "Total {w} sales": "100000"})
_CASH = tuple(x + " {n}" for x in ("Net cash provided by operating activities", "Cash generated by operating activities", "Net cash flows generated from/(used in) operating activities", "Changes in {w} assets", "Net cash from operations", "Net cash used in investing activities", "Net cash provided by / (used in) investing activities", "Net cash used for investing activities", "Purchases of {w}", "Cash generated by/(used in) investing activities"))
for _name, _activity in (("operating_cash_totals", "operating"), ("investing_cash_totals", "investing")):
    matched(_name, "BOOLEAN", lambda t, a=_activity: labels.is_cash_total(t, a), _CASH, rf"(contains(lower(t), '{_activity}') {'OR contains(lower(t), ' + _quoted('from operations') + ')' if _activity == 'operating' else ''}) AND contains(lower(t), 'cash')")
matched("cash_line_classes", "VARCHAR", labels.cash_line_class, ("Cash flows from operating activities {w}", "Dividends paid {n}", "{w} operating activities:", "Net income {n}", "Purchases of property {w}", "Net cash used in financing activities {k}", "{w} financing activities :"),
    r"CASE WHEN starts_with(t, 'Cash flows from') OR regexp_matches(t, 'activities *: *$') THEN 'section' WHEN starts_with(t, 'Dividends') OR starts_with(t, 'Purchases of property') THEN 'component' ELSE 'other' END")
_THREE = ("net cash from operating activities {n}", "net cash used in investing activities {n}", "Net cash used in financing activities {k}")
matched("complete_cash_statements", "BOOLEAN", labels.cash_statement_complete, ("; ".join(_THREE), "; ".join(_THREE[:2]), "{w}; ".join(_THREE), "; ".join(_THREE[1:]), "{w}"), "len(list_filter(['operating', 'investing', 'financing'], lambda a: contains(lower(t), a))) = 3")
matched("report_headers", "BOOLEAN", lambda t: labels.looks_like_report(F.split(t, r"\|")), ("{w}|{y}|{y1}", "Item|$ {w}", "{w}|{y}|{y}", "{w}|Total", "CHF|{w}", "{w} {y1} {y2}"), r"len(list_distinct(regexp_extract_all(t, '\b(?:20|19)\d\d\b'))) >= 2 OR contains(t, '$') OR contains(lower(t), 'chf')")
_HEADERS = ("{w}", "{y}", "{w} {y}", "Net sales {w}", "US$ {k}", "Amount {k}", "{w} million", "EPS", "Total assets", "Q{k}", "For the year ended {M} {d}, {y}", "qty", "Unit  Price {k}", "{w}   {y1}  growth")
_IS_FINANCIAL = f"regexp_matches(lower(t), '(20|19)\\d\\d|[$€£¥]|{'|'.join(labels.FINANCIAL_WORDS)}')"
matched("financial_headers", "BOOLEAN", labels.financial_header, _HEADERS, _IS_FINANCIAL)
matched("repaired_headers", "VARCHAR", lambda t: _joined(refine.repair_headers(F.array(t))), _HEADERS, rf"""CASE WHEN {_IS_FINANCIAL} THEN CASE WHEN len(regexp_extract_all(t, '20\d\d')) = 1 AND length(t) > 10 THEN regexp_extract(t, '20\d\d') ELSE regexp_replace(t, '\s+', ' ', 'g') END
    WHEN regexp_matches(lower(t), 'unit.*pri.*ce') THEN 'Unit Price' WHEN contains(lower(t), 'amount') THEN 'Amount' WHEN t = 'qty' THEN 'Qty' WHEN regexp_full_match(t, '[qQ][1-4]') THEN upper(t) ELSE t END""")
printed("split_headers", "VARCHAR", lambda t: _joined(refine.split_year_headers(F.split(t, r"\|"))), {"{w}|{y} {y1}": "concat_ws('|', w, y, y1)", "{w}|{y}": "w || '|' || y", "{y} {y1} {y2}|{k}": "concat_ws('|', y, y1, y2, k)"})
printed("compact_rows", "VARCHAR", lambda t: _joined(refine.compact_statement_rows(F.split(t, r"\|"))), {"{w}|$|{n}||$|{n1}": "concat_ws('|', w, n, n1)", "{w}|({k}|)|({k}|)": "concat_ws('|', w, '(' || k, '(' || k)", "{w}|{k}": "w || '|' || k"})
matched("currency_codes", "VARCHAR", grids.currency_code, ("RMB", "cny", "US$", "HKD", "hk$", "EUR", "{w}"), "CASE upper(replace(t, '$', '')) WHEN 'RMB' THEN 'CNY' WHEN 'US' THEN 'USD' WHEN 'HK' THEN 'HKD' ELSE upper(t) END")
matched("page_currencies", "VARCHAR", grids.preferred_currency, ("(in RMB millions) {n}", "Expressed in HKD {w}", "US$ {n}", "{w} {n}", "人民币 and USD {k}", "{w} usd {k}"), "CASE WHEN regexp_matches(upper(t), 'RMB|CNY|人民币') THEN 'CNY' WHEN contains(upper(t), 'HKD') THEN 'HKD' WHEN regexp_matches(upper(t), 'USD|US[$]') THEN 'USD' ELSE 'CNY' END")
printed("cut_before_liabilities", "VARCHAR", lines.before_liabilities, {"Total current {w} {n} {n1} Liabilities Accounts {k}": "'Total current ' || w || ' ' || n || ' ' || n1", "Total liabilities {n} and {w}": "t", "Assets {n} {n} {n} {n} liabilities and {w}": "t", "{w} {n}": "t"})
printed("lines_without_footnotes", "VARCHAR", lines.without_footnote, {"(in RMB million) {k} 0.55": "'0.55'", "— RMB {k}{k}{k}{k}.10": "k || k || k || k || '.10'", "0.{k}": "'0.' || k", ": 7(a) {w}": "w", "US$ {n}": "n"})

# periods ---------------------------------------------------------------------------------------

_END = "y || '-' || md"
_END1 = "y1 || '-' || md"
#: Opening days stand for no period; where a header has no other, its years count.
_OPENING = "md IN ('01-01', '01-02', '01-03')"
_BOTH = f"CASE WHEN {_OPENING} THEN y || '-12-31,' || y1 || '-12-31' ELSE {_END} || ',' || {_END1} END"
printed("header_dates", "VARCHAR", lambda t: _ends(periods.statement_periods(t)), {"{M} {d}, {y} {M} {d}, {y1}": _BOTH, "Year Ended {M} {d},\n{y} {y1}": _BOTH, "{d} {M} {y} and {d} {M} {y1}": _BOTH, "{y} {y1} {w}": "y || '-12-31,' || y1 || '-12-31'", "{w}": "''"})
printed("year_column_blocks", "VARCHAR", lambda t: _ends(periods.year_columns(t)), {"Year Ended {M} {d},\n{y} {y1}": f"{_END} || ',' || {_END1}", "{w} years to {M} {d}, | {y} | {y1} | {y2}": f"{_END} || ',' || {_END1} || CASE WHEN year > 2001 THEN ',' || y2 || '-' || md ELSE '' END", "{M} {d}, {y}": "''", "{w}": "''"})
_HALF = lambda t, i: periods.statement_periods(F.get(F.split(t, "#"), F.lit(i)))
printed("balance_sheet_periods", "VARCHAR", lambda t: _ends(periods.balance_periods(_HALF(t, 0), _HALF(t, 1))), {"December 31, {y} December 31, {y1}#June 30, {y} June 30, {y1}": "y || '-12-31,' || y1 || '-12-31'", "{w}#June 30, {y} June 30, {y1}": "y || '-06-30,' || y1 || '-06-30'", "{y}#": "y || '-12-31'", "{y}#June 30, {y} June 30, {y1}": "y || '-06-30,' || y1 || '-06-30'", "#": "''"})
printed("header_periods_of_columns", "VARCHAR", lambda t: periods.period_of_header(t, F.create_map(F.lit(2011), F.lit("2011-09-30")), periods.statement_periods(F.lit("June 30, 2010 June 30, 2009"))), {"{M} {d}, {y}": _END, "FY {y}": "CASE year WHEN 2011 THEN '2011-09-30' WHEN 2010 THEN '2010-06-30' WHEN 2009 THEN '2009-06-30' ELSE y || '-12-31' END", "{y} {y1}": "NULL", "{w}": "NULL"})
printed("ends_of_wanted_years", "VARCHAR", lambda t: F.array_join(periods.ends_of_years(periods.statement_periods(t), F.array(F.lit(2010), F.lit(2009))), ","), {"{M} {d}, {y} {M} {d}, {y1}": f"CASE WHEN {_OPENING} THEN '2010-12-31,2009-12-31' WHEN year = 2010 THEN '2010-' || md || ',2009-' || md WHEN year = 2009 THEN '2010-12-31,2009-' || md WHEN year = 2011 THEN '2010-' || md || ',2009-12-31' ELSE '2010-12-31,2009-12-31' END", "{w}": "'2010-12-31,2009-12-31'"})
printed("reporting_period_lists", "VARCHAR", lambda t: F.array_join(periods.reporting_periods(F.split(t, ",")), ","), {"{y}-12-31,{y1}-12-31,{y1}-01-01": "y || '-12-31,' || y1 || '-12-31'", "{y}-05-05,{y1}-05-05,{y1}-01-01": "y || '-05-05,' || y1 || '-05-05'", "{y}-01-01": "t", "{y}-01-01,{y1}-01-02": "''"})

# statement pages -------------------------------------------------------------------------------

printed("plain_page_text", "VARCHAR", pages.page_text, {"{w}   report\n{y} ..... {k}": "w || ' report ' || y || ' ' || k", "{w} {n}": "t", "CCaasshh  ffllooww": "'Cash flow'", "": "''"})
_FAR = "x" * 600
printed("balance_title_places", "INTEGER", lambda t: pages.title_at(t, pages.TITLES["balance"][0]), {"consolidated balance sheets as of {y}": "0", "consolidated balance sheets in the {w}": "NULL", "{k} {w} consolidated balance sheet": "length(k) + length(w) + 2", "{w}": "NULL", f"{_FAR} {{w}} consolidated balance sheets as of {{y}}": "602 + length(w)", f"{_FAR} {{w}} consolidated balance sheets were {{k}}": "NULL"})
printed("excluded_heads", "BOOLEAN", pages.is_excluded, {"table of contents {w} {k}": "true", "table of contents {w} consolidated balance sheets (in millions)": "false", "notes to consolidated financial statements {w}": "true", "{w} notes to consolidated financial statements": "false", "consolidated statements of {w}": "false", "shareholder proposal {k}": "true", "{w} plan assets at fair value": "true"})
printed("heads_without_noise", "VARCHAR", pages.without_head_noise, {"{k} Annual Report {y} Revenue": "'Revenue'", "{w} Holdings {k} Balance sheet": "'Balance sheet'", "Plain {w}": "t", "{k} {w} Inc. {k} Cash": "'Cash'"})

