"""Aligning facts with columns, tags and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.reconcile import last_values, within_tolerance
from factloom.settings import FIELDS


def column_of_period(columns: Column, period: Column) -> Column:
    """Index (from 0) of the column with the period's end, else of the last column of its year; null if there is none."""
    exact = F.array_position(columns, period)
    places = F.filter(F.sequence(F.lit(0), F.size(columns) - 1), lambda i: F.substring(F.get(columns, i), 1, 4) == F.substring(period, 1, 4))
    return F.when(F.size(columns) == 0, F.lit(None)).when(exact > 0, exact - 1).otherwise(F.try_element_at(places, F.lit(-1))).cast("int")


def refine_tag(candidates: DataFrame, document: DataFrame, field: str) -> DataFrame:
    """(entity, tag, agreements): of the tags that could be field (entity, tag, tag_ord, period_end, value) the one that agrees with the document most often, at least once; the first of equals."""
    d = last_values(document).where(F.col("field_id") == field).select("entity", F.substring("period_end", 1, 4).alias("y"), F.col("value").alias("d"))
    met = candidates.withColumn("y", F.substring("period_end", 1, 4)).join(d, ["entity", "y"])
    good = met.where(within_tolerance(F.col("value"), F.col("d"), F.lit(field), F.lit("millions")))
    counted = good.groupBy("entity", "tag", "tag_ord").agg(F.count("*").alias("agreements"))
    order = Window.partitionBy("entity").orderBy(F.desc("agreements"), "tag_ord")
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("entity", "tag", "agreements")


def truth_hits(truth: DataFrame, facts: DataFrame, margin: float = 1.0) -> DataFrame:
    """(entity, total, hits): truth cells found with a value less than margin away, in their period or else in its year (the first fact of it)."""
    exact = last_values(facts).select("entity", "field_id", "period_end", F.col("value").alias("a"))
    by_year = facts.groupBy("entity", "field_id", F.substring("period_end", 1, 4).alias("y")).agg(F.min_by("value", F.struct("ord", "period_end")).alias("b"))
    rows = truth.withColumn("y", F.substring("period_end", 1, 4)).join(exact, ["entity", "field_id", "period_end"], "left").join(by_year, ["entity", "field_id", "y"], "left")
    hit = F.coalesce(F.abs(F.coalesce("a", "b") - F.col("value")) < margin, F.lit(False))
    return rows.groupBy("entity").agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"))


def field_coverage(facts: DataFrame, periods: int) -> DataFrame:
    """(entity, filled, coverage): distinct cells with a value, of all fields in so many periods."""
    filled = facts.where("value is not null").groupBy("entity").agg(F.countDistinct("field_id", "period_end").alias("filled"))
    return filled.withColumn("coverage", F.round(F.col("filled") / (len(FIELDS) * periods), 4))


def merge_grids(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, grid_ord, label, values) of several grids of a statement: of equal labels the one with most filled values, the first of equals."""
    filled = F.size(F.filter("values", lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    order = Window.partitionBy("doc_id", F.lower(F.trim("label"))).orderBy(F.desc("filled"), "grid_ord")
    return rows.withColumn("filled", filled).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def statement_scores(pages: DataFrame, signals: DataFrame, text: str = "text", most: int = 500) -> DataFrame:
    """(doc_id, page_num, statement, score): for each signal (statement, pattern, points) found in a page its points; pages without any signal of a statement give no row for it.

    The signals, ``most`` at most, become expressions of the scan, so pages meet no join and no shuffle.
    """
    rows = signals.select("statement", "pattern", "points").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} signals")
    each = []
    for statement in dict.fromkeys(r["statement"] for r in rows):
        points = F.array_compact(F.array(*(F.when(F.col(text).rlike(r["pattern"]), F.lit(r["points"]).cast("long")) for r in rows if r["statement"] == statement)))
        each.append(F.struct(F.lit(statement).alias("statement"), F.when(F.size(points) > 0, F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x)).alias("score")))
    if not each:
        return pages.select("doc_id", "page_num", F.lit("").alias("statement"), F.lit(0).cast("long").alias("score")).limit(0)
    met = pages.select("doc_id", "page_num", F.explode(F.array(*each)).alias("x")).where("x.score is not null")
    return met.select("doc_id", "page_num", "x.statement", "x.score")
