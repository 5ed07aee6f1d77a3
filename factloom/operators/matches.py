"""Values from located text: every match of many patterns with its place, the chunk behind it, vetoes, and the best line of each field.

Built-ins give a pattern's matches without their places. Here each match is put between two marks
that no text holds, the text is cut at the marks, and the lengths of the pieces give the places;
so all stays in the scan, and a document's text yields one small row for each match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import pages
from factloom.functions.labels import net_income_score
from factloom.functions.lines import before_liabilities, label_before_amounts
from factloom.functions.numbers import line_amounts
from factloom.functions.periods import let

OPEN, CLOSE = "\u0001", "\u0002"
#: Characters before a match that may veto it, those of a line from the match on, and how many amounts a line has at most.
LOOK_BACK, CHUNK, COLUMNS = 30, {"income": 140, "balance": 100, "cashflow": 280}, {"income": 3, "balance": 2, "cashflow": 3}


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern that aren't empty, as (start, end, found), from the left and without overlap; places count from 0. Marks in the text count as spaces."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]")
    # pieces outside matches and matches take turns, so that a match begins where all pieces before it end
    ends = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x)))
    found = lambda p, e: F.transform(p, lambda x, i: F.struct(F.get(e, i).alias("start"), F.get(e, i + 1).alias("end"), x.alias("found"), (i % 2 == 1).alias("inside")))
    every = let(parts, lambda p: let(ends(p), lambda e: found(p, e)))
    return F.transform(F.filter(every, lambda x: x["inside"] & (F.length(x["found"]) > 0)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))


@dataclass(frozen=True)
class Line:
    """Where a field's line begins, and what rules a match out: before it, or in the chunk that it opens."""

    field_id: str
    statement: str
    pattern: str
    veto_before: str = ""
    veto_chunk: str = ""
    least: float = 0.0


#: Lines of the fields and their vetoes, and the least size of an amount.
LINES = (
    Line("revenue", "income", r"total\s+(?:net\s+)?(?:revenues?|sales)", veto_chunk=r"operating income\s+includes|other operating income"),
    Line("revenue", "income", r"net sales"),
    Line("gross_profit", "income", r"gross (?:profit|margin)"),
    Line("operating_income", "income", r"operating (?:income|profit)|income from operations", r"non-operating|non-\s*$|other\s+$", r"operating income\s*(?:\(expense\)|margin)"),
    Line("net_income", "income", r"net (?:income|earnings)", veto_chunk=r"before income taxes|comprehensive income"),
    Line("total_assets", "balance", r"total assets"),
    Line("total_liabilities", "balance", r"total liabilities", veto_chunk=r"total\s+liabilities\s+and\s+(?:stockholders|shareholders|equity)"),
    Line("cash", "balance", r"cash and cash equivalents", least=1000.0),
    Line("cfo", "cashflow", r"net cash [a-z ()]{0,30}operating activities"),
)


def line_matches(texts: DataFrame, lines: tuple[Line, ...] = LINES) -> DataFrame:
    """(doc_id, statement, field_id, place, label, amounts) of every match in texts (doc_id, statement, text) that no veto rules out and that amounts follow.

    The text is read in one line; null texts have no matches. A statement only meets its own fields' lines.
    """
    flat = texts.select("doc_id", "statement", pages.page_text(F.col("text")).alias("flat")).withColumn("low", F.lower("flat"))

    def placed(i: int, line: Line) -> Column:
        return F.when(F.col("statement") == line.statement, F.transform(spans(F.col("low"), line.pattern), lambda x: F.struct(F.lit(line.field_id).alias("field_id"), F.lit(i).alias("line"), x["start"].alias("place"))))

    each = [placed(i, line) for i, line in enumerate(lines)]
    hits = flat.select("doc_id", "statement", "flat", "low", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("x")).select("doc_id", "statement", "flat", "low", "x.*")
    length = F.coalesce(*(F.when(F.col("statement") == s, n) for s, n in CHUNK.items()))
    before = F.substring("low", F.greatest(F.col("place") - LOOK_BACK, F.lit(0)) + 1, F.least(F.col("place"), F.lit(LOOK_BACK)))
    chunk = F.substring("flat", F.col("place") + 1, length)
    rows = hits.select("doc_id", "statement", "field_id", "line", "place", before.alias("before"), F.when(F.col("statement") == "balance", before_liabilities(chunk)).otherwise(chunk).alias("chunk"))
    vetoed = F.lit(False)
    for i, line in enumerate(lines):
        own = F.lit(False)
        if line.veto_before:
            own = own | F.col("before").rlike(line.veto_before)
        if line.veto_chunk:
            own = own | F.lower(F.substring("chunk", 1, 70)).rlike(line.veto_chunk)
        vetoed = vetoed | ((F.col("line") == i) & own)
    rows = rows.where(~vetoed).withColumns({"label": F.trim(label_before_amounts(F.col("chunk"))), "amounts": F.slice(line_amounts(F.col("chunk")), F.lit(1), F.coalesce(*(F.when(F.col("statement") == s, n) for s, n in COLUMNS.items())))})
    least = F.coalesce(*(F.when(F.col("line") == i, line.least) for i, line in enumerate(lines) if line.least), F.lit(0.0))
    rows = rows.where((F.size("amounts") > 0) & (F.abs(F.get("amounts", F.lit(0))) >= least))
    return rows.where((F.col("field_id") != "net_income") | (net_income_score(F.col("label")) >= 0)).select("doc_id", "statement", "field_id", "line", "place", "label", "amounts")


def best_lines(found: DataFrame) -> DataFrame:
    """(doc_id, field_id, place, label, amounts): of each field's matches the one of the earliest line in the list, then with the best net income label, then with more amounts, then the first."""
    score = F.when(F.col("field_id") == "net_income", net_income_score(F.col("label"))).otherwise(0)
    order = Window.partitionBy("doc_id", "field_id").orderBy("line", score.desc(), F.size("amounts").desc(), "place")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "field_id", "place", "label", "amounts")
