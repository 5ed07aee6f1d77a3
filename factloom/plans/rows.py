"""Queries over labelled rows that are printed from parts and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as fx
from factloom.operators import matches, ranking

QUERIES: dict = {}
#: An order's lines are dealt to one task with those of others.
LINES_A_TASK = 200_000
ORACLE_SQL: dict[str, str] = {}

#: Labels of statements; {w} is a word of the part's name, or the order's priority.
LABELS = (
    "Revenue", "Total revenues", "Sales of {w} in all its regions", "Total automotive revenues", "Cost of revenue {w}", "Gross profit", "Income from operations", "Non-operating income {w}", "Net income", "Net income attributable to {w}", "Net income per share: basic", "Basic", "Basic and diluted earnings per share",
    "Consolidated net income", "Net income attributable to non-controlling interests", "Total assets", "Total assets under IFRS {w}", "Total liabilities", "Total current liabilities", "Total liabilities and equity", "Total equity", "Total shareholders' equity", "Cash and cash equivalents of {w} at the end of the year", "Net cash provided by operating activities",
    "Cash flows from operating activities", "Net cash used in financing activities", "Purchases of property and equipment", "Repurchase of {w} property", "Basic earnings per share 1,234", "{w} Group Holding Limited", "Income from continuing operations", "Capital expenditures",
)
#: Scores that no mere likeness of these labels reaches.
SURE = 0.84
_LABELS_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LABELS) + "]"


def _label(number, word):
    return F.replace(F.get(F.array(*map(F.lit, LABELS)), (number % len(LABELS)).cast("int")), F.lit("{w}"), word)


def _scores_sql(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT label, norm, '{f}' AS field_id, round({ranking.score_sql('norm', f)}, 6) AS score FROM distinct_labels" for f in ranking.FIELDS)
    return f"distinct_labels AS (SELECT DISTINCT label, lower(label) AS norm FROM {source}), scores AS (SELECT * FROM ({each}) WHERE score >= {ranking.ACCEPT})"


def field_label_scores(spark, sf_dir):
    """How well parts' labels fit the fields."""
    rows = fx.read(spark, sf_dir, "part").select("p_partkey", _label(F.col("p_partkey"), F.split("p_name", " ")[0]).alias("label"))
    scores = ranking.label_scores(rows).where(F.col("score") >= SURE)
    return rows.join(scores.hint("merge"), "label").select("p_partkey", "label", "field_id", "score")


def reported_rows(spark, sf_dir):
    """The rows of each order, one for each line and three more, that report fields: labels by order and line, values from price and quantity."""
    lines = fx.dealt(fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), "l_orderkey", LINES_A_TASK).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("pieces"))
    number = F.col("l_orderkey") * 5 + F.col("l_linenumber") * 7
    price, pieces = F.floor("price").cast("double"), F.col("pieces").cast("double")
    values = F.when(number % 3 == 0, F.array(price, pieces, price)).when(number % 3 == 1, F.array(price, F.lit(None).cast("double"), -pieces)).otherwise(F.array(pieces, F.lit(None).cast("double"), F.lit(None).cast("double")))
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_no"), _label(number, F.lit("acme")).alias("label"), values.alias("values"))
    return ranking.choose_rows(rows).where(F.col("score") >= SURE)


def best_label_row(spark, sf_dir):
    """Groups of twenty parts as statements: their names and labels by likeness as well; no SQL has that ratio."""
    parts = fx.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    label = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(_label(F.col("p_partkey"), F.split("p_name", " ")[1]))
    values = F.array(F.floor("p_retailprice").cast("double"), F.col("p_size").cast("double"))
    rows = parts.select(F.floor(F.col("p_partkey") / 20).cast("long").alias("doc_id"), F.col("p_partkey").alias("row_no"), label.alias("label"), values.alias("values"))
    return ranking.choose_rows(rows)


QUERIES |= {f.__name__: f for f in (field_label_scores, reported_rows, best_label_row)}
ORACLE_SQL["field_label_scores"] = f"""WITH rows_ AS (SELECT p_partkey, replace({_LABELS_SQL}[p_partkey % {len(LABELS)} + 1], '{{w}}', split_part(p_name, ' ', 1)) AS label FROM part), {_scores_sql("rows_")}
    SELECT p_partkey, r.label, field_id, CAST(score AS DOUBLE) AS score FROM rows_ r JOIN scores s ON r.label = s.label WHERE score >= {SURE}"""
ORACLE_SQL["reported_rows"] = f"""WITH lines AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS row_no, l_orderkey * 5 + l_linenumber * 7 AS number, floor(max(l_extendedprice)) AS price, max(l_quantity) AS pieces FROM lineitem GROUP BY l_orderkey, l_linenumber),
    rows_ AS (SELECT doc_id, row_no, replace({_LABELS_SQL}[number % {len(LABELS)} + 1], '{{w}}', 'acme') AS label, CASE number % 3 WHEN 0 THEN [price, pieces, price] WHEN 1 THEN [price, -pieces] ELSE [pieces] END AS vs FROM lines), {_scores_sql("rows_")},
    fit AS (SELECT doc_id, row_no, r.label, norm, field_id, score, round(score + len(vs) * {ranking.PER_VALUE}, 6) AS tie FROM rows_ r JOIN scores s ON r.label = s.label WHERE NOT (
        (field_id = 'net_income' AND len(vs) < 2 AND NOT regexp_matches(norm, 'attributable|holding')) OR (field_id = 'revenue' AND list_max(vs) <= 0)
        OR (field_id IN ('revenue', 'total_assets', 'gross_profit') AND list_max(list_transform(vs, lambda v: abs(v))) < 1000) OR (field_id = 'eps_basic' AND list_min(list_transform(vs, lambda v: abs(v))) > 500))),
    named AS (SELECT *, first_value(norm) OVER (PARTITION BY doc_id, field_id ORDER BY tie DESC, row_no) AS f FROM fit),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY tie DESC, CASE WHEN field_id = 'net_income' THEN CASE WHEN contains(norm, 'attributable to') THEN 2 WHEN ends_with(norm, 'holding limited') AND regexp_full_match(f, 'net income(?: \\(loss\\))?') THEN 1 ELSE 0 END
        WHEN field_id = 'revenue' THEN CASE WHEN regexp_matches(norm, '{ranking.TOTAL_REVENUE}') THEN 2 WHEN regexp_matches(norm, '{ranking.SEGMENT_REVENUE}') THEN 1 ELSE 0 END ELSE 0 END DESC, row_no) AS r FROM named)
    SELECT doc_id, field_id, row_no, label, CAST(score AS DOUBLE) AS score FROM ranked WHERE r = 1 AND score >= {SURE}"""


# lines of statements ---------------------------------------------------------------------------

#: Statements printed for each order: {a} and {b} are amounts of the order; of each the fields that are found, the words at which, and their amounts.
STATEMENTS = {
    ("income", 0): ("Net sales {a} {b} Cost of sales {b} Gross profit {b} {a} Operating income {a} {b} {a} Net income {b} {a}", {"revenue": ("net sales", "abb"), "gross_profit": ("gross profit", "baa"), "operating_income": ("operating income", "aba"), "net_income": ("net income", "ba")}),
    ("income", 1): ("Other operating income {b} {a} {a} Total net revenues {a} {b} {a} Net income before income taxes {a} and then what is left to all of the owners of the company and to the others, with all of the parts of it. Net income attributable to Acme {b} {a} {b}", {"revenue": ("total net revenues", "aba"), "net_income": ("net income attributable", "bab")}),
    ("income", 2): ("Sales, without a total. Net sales {b} {b} {b} Non-operating income {a} Gross margin {a} {b} 1995", {"revenue": ("net sales", "bbb"), "gross_profit": ("gross margin", "ab")}),
    ("income", 3): ("Comprehensive income {a} and nothing else", {}),
    ("balance", 0): ("Cash and cash equivalents {a} {b} Total assets {b} {a} Total liabilities {a} {b} Total liabilities and equity {b}", {"cash": ("cash and cash", "ab"), "total_assets": ("total assets", "ba")}),
    ("balance", 1): ("Cash and cash equivalents 150 and {a} Total assets {a} Total liabilities {b} {b} and that is all that there is to be said of the things that are owed to others, as of the end of the year", {"total_assets": ("total assets", "a"), "total_liabilities": ("total liabilities", "bb")}),
    ("balance", 2): ("Total assets of the year: none", {}),
    ("balance", 3): ("Total\nassets\t{b}   {a}", {"total_assets": ("total assets", "ba")}),
    ("cashflow", 0): ("Net cash provided by operating activities {a} {b}", {"cfo": ("net cash", "ab")}), ("cashflow", 1): ("Net cash (used in) operating activities ({a}) and ({b})", {"cfo": ("net cash", "AB")}),
    ("cashflow", 2): ("Net cash from investing activities {a}", {}), ("cashflow", 3): ("First {a}. Net cash from operating activities {b} {a} {a} {b}", {"cfo": ("net cash", "baa")}),
}


def _statement_texts(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    a, b = F.format_number(F.col("o_custkey") + 10_000, 0), F.format_number(F.floor("o_totalprice") + 10_000, 0)
    kinds = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for (s, _), (t, _) in STATEMENTS.items()))
    kind = F.get(kinds, (F.col("o_orderkey") % len(STATEMENTS)).cast("int"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), kind["s"].alias("statement"), F.replace(F.replace(kind["t"], F.lit("{a}"), a), F.lit("{b}"), b).alias("text"))


def located_lines(spark, sf_dir):
    """The line of each field in orders' statements: where it stands and its amounts."""
    found = matches.best_lines(matches.line_matches(_statement_texts(spark, sf_dir)))
    return found.select("doc_id", "field_id", "place", F.array_join(F.transform("amounts", lambda x: x.cast("long").cast("string")), "|").alias("amounts"))


def _located_lines_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = {"a": "a", "b": "b", "A": "-a", "B": "-b"}
    each = []
    for k, (text, fields) in enumerate(STATEMENTS.values()):
        shown = f"replace(replace({quoted(' '.join(text.split()))}, '{{a}}', format('{{:,}}', a)), '{{b}}', format('{{:,}}', b))"
        for field, (words, amounts) in fields.items():
            each.append(f"SELECT doc_id, '{field}' AS field_id, CAST(strpos(lower({shown}), {quoted(words)}) - 1 AS INTEGER) AS place, concat_ws('|', {', '.join(known[x] for x in amounts)}) AS amounts FROM v WHERE k = {k}")
    return f"WITH v AS (SELECT o_orderkey AS doc_id, o_orderkey % {len(STATEMENTS)} AS k, CAST(o_custkey + 10000 AS BIGINT) AS a, CAST(floor(o_totalprice) + 10000 AS BIGINT) AS b FROM orders) " + " UNION ALL ".join(each)


QUERIES["located_lines"] = located_lines
ORACLE_SQL["located_lines"] = _located_lines_sql()
