"""Refining extracted grids whose rows are arrays of cells: (table key..., row_no, cells ARRAY<STRING>).

Cell counts are those of a page's table, so folds over a row are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.labels import financial_header, garbled_total
from factloom.functions.numbers import amount_pair, to_number


def blank(cell: Column) -> Column:
    return F.coalesce(F.trim(cell), F.lit("")) == ""


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("cells", lambda c: ~blank(c)))


def join_parentheses(cells: Column) -> Column:
    """A cell that opens a parenthesis takes in the next cell that closes it; the emptied cell stays blank."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        opened = (F.size(acc) > 0) & last.rlike(r"^\([^)]*$") & F.coalesce(c, F.lit("")).rlike(r"^[^(]*\)$")
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.trim(c)), F.lit("")))
        return F.when(F.size(acc) == 0, F.array(F.coalesce(c, F.lit("")))).when(opened, joined).otherwise(F.array_append(acc, F.coalesce(c, F.lit(""))))

    return F.aggregate(cells, F.array().cast("array<string>"), step)


def split_amounts(cells: Column) -> Column:
    """A cell with two amounts moves its second one into a blank right neighbour; else it stays."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        pair = amount_pair(last)
        spill = (F.size(acc) > 0) & (F.size(pair) == 2) & blank(c)
        spilled = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), pair)
        return F.when(F.size(acc) == 0, F.array(F.coalesce(c, F.lit("")))).when(spill, spilled).otherwise(F.array_append(acc, F.coalesce(c, F.lit(""))))

    return F.aggregate(cells, F.array().cast("array<string>"), step)


def split_year_headers(header: Column) -> Column:
    """A header with two or more years becomes that many columns."""
    years = lambda h: F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return F.flatten(F.transform(header, lambda h: F.when(F.size(years(h)) >= 2, years(h)).otherwise(F.array(h))))


#: Names of columns that are written in one way.
UNIT_PRICE = r"unit.*pri.*ce|^unitpri$"
TITLE_HEADERS, QUANTITY_HEADERS = ("item", "name", "region", "department", "budget", "actual", "variance", "score"), ("qty", "quantity")


def repair_headers(header: Column) -> Column:
    """Financial headers with their spaces collapsed, or cut to the one year of a longer date; others by the common names of columns, and else only trimmed."""

    def repair(h: Column) -> Column:
        own = F.trim(F.coalesce(h, F.lit("")))
        low = F.regexp_replace(F.lower(own), r"(?U)\s+", "")
        years = F.regexp_extract_all(own, F.lit(r"(20\d{2})"), F.lit(1))
        financial = F.when((F.size(years) == 1) & (F.length(own) > 10), F.get(years, F.lit(0))).otherwise(F.regexp_replace(own, r"(?U)\s+", " "))
        named = F.when(low.rlike(UNIT_PRICE), "Unit Price").when(low.rlike("amount"), "Amount").when(low.isin(*TITLE_HEADERS), F.initcap(own)).when(low.isin(*QUANTITY_HEADERS), "Qty").when(low.rlike("^q[1-4]$"), F.upper(own))
        return F.when(financial_header(own), financial).otherwise(F.coalesce(named, own))

    return F.transform(header, repair)


def merge_fragments(rows: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """In tables of more than ``most`` columns, neighbours without digits are joined in pairs, from the left."""
    per = Window.partitionBy(*keys)
    wide = F.max(F.size("cells")).over(per)
    cells = rows.select(*keys, F.posexplode("cells").alias("_c", "_t")).groupBy(*keys, "_c").agg(F.bool_or(F.coalesce(F.col("_t").rlike(r"\d"), F.lit(False))).alias("digits"))
    flags = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_c", "digits"))), lambda x: x["digits"]).alias("digits"))

    def step(acc: Column, i: Column) -> Column:
        free = ~F.array_contains(acc, i) & ~F.get(F.col("digits"), i) & ~F.get(F.col("digits"), i + 1)
        return F.when(free, F.concat(acc, F.array(i + 1))).otherwise(acc)

    second = F.when(F.size("digits") > 1, F.aggregate(F.sequence(F.lit(0), F.size("digits") - 2), F.array().cast("array<int>"), step)).otherwise(F.array().cast("array<int>"))
    flags = flags.withColumn("second", second).drop("digits")
    placed = rows.withColumn("_wide", wide).join(flags, keys)
    n = F.size("cells")
    place = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains("second", i))
    text = lambda i: F.trim(F.concat_ws(" ", F.get("cells", i), F.when(F.array_contains("second", i + 1), F.get("cells", i + 1))))
    merged = F.when((F.col("_wide") > most) & (n > 0), F.transform(place, text)).otherwise(F.col("cells"))
    return placed.withColumn("cells", merged).drop("_wide", "second")


def compact_statement_rows(cells: Column) -> Column:
    """label, then the row's amounts: ``$ | 1,234 | blank`` layouts collapse; a lone ``(`` or ``)`` belongs to its number."""
    words = F.filter(cells, lambda c: ~blank(c) & ~F.trim(c).rlike(r"^[$€£¥%)]$"))
    label = F.get(F.filter(words, lambda c: c.rlike(r"(?U)\p{L}")), F.lit(0))
    amounts = F.filter(F.transform(words, lambda c: F.regexp_replace(F.trim(c), r"^[$€£¥]\s*", "")), lambda c: to_number(F.when(c.rlike(r"^\([^)]*$"), F.concat(c, F.lit(")"))).otherwise(c)).isNotNull())
    return F.when(F.size(amounts) >= 2, F.concat(F.array(F.coalesce(label, F.lit(""))), amounts)).otherwise(cells)


def greedy(rows: Column) -> Column:
    """Of a page's pairs (a, minus, b), sorted, an array of (a, b, score): a's tables in order take the best unused table of b."""
    start = F.struct(F.array().cast("array<int>").alias("xs"), F.array().cast("array<int>").alias("ys"), F.array().cast("array<struct<a:int,b:int,score:double>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        free = ~F.array_contains(acc["xs"], r["a"]) & ~F.array_contains(acc["ys"], r["b"])
        return F.when(free, F.struct(F.array_append(acc["xs"], r["a"]).alias("xs"), F.array_append(acc["ys"], r["b"]).alias("ys"), F.array_append(acc["out"], F.struct(r["a"].alias("a"), r["b"].alias("b"), (-r["minus"]).alias("score"))).alias("out"))).otherwise(acc)

    return F.aggregate(rows, start, step)["out"]


def greedy_pairs(scores: DataFrame) -> DataFrame:
    """(page..., a, b, score) one-to-one: a's tables in order take the best unused table of b; a fold over a page's few tables."""
    rows = scores.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("a", (-F.col("score")).alias("minus"), "b"))).alias("rows"))
    return rows.select("doc_id", "page_num", F.explode(greedy(F.col("rows"))).alias("m")).select("doc_id", "page_num", "m.a", "m.b", "m.score")


def total_label(rows: DataFrame, keys: list[str], label: str = "合计", tolerance: float = 0.02) -> DataFrame:
    """The last row's first cell becomes the label of a total if it is garbled or says total or sum, and the row holds the columns' sums in at least half of the columns that have numbers above; a garbled one also if any other cell is a number."""
    above = Window.partitionBy(*keys, "c").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.select(*keys, "row_no", F.posexplode("cells").alias("c", "t")).withColumn("v", to_number(F.col("t")).cast("decimal(20,4)"))
    cells = cells.withColumns({"s": F.sum("v").over(above), "last": F.max("row_no").over(Window.partitionBy(*keys))}).where(F.col("row_no") == F.col("last"))
    checked = F.col("v").isNotNull() & F.col("s").isNotNull()
    facts = cells.groupBy(*keys).agg(F.count_if(checked).alias("checked"), F.count_if(checked & (F.abs(F.col("v") - F.col("s")) <= tolerance)).alias("hits"), F.count_if((F.col("c") > 0) & F.col("v").isNotNull()).alias("numeric"), F.max("last").alias("last"))
    first = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    garbled = garbled_total(first)
    fix = ((garbled | first.rlike("total|sum")) & (F.col("checked") > 0) & (F.col("hits") * 2 >= F.col("checked"))) | (garbled & (F.col("numeric") >= 1))
    own = rows.join(facts, keys).withColumn("several", F.count("*").over(Window.partitionBy(*keys)) >= 2)
    named = F.concat(F.array(F.lit(label)), F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))))
    return own.withColumn("cells", F.when(F.col("several") & (F.col("row_no") == F.col("last")) & fix, named).otherwise(F.col("cells"))).select(*rows.columns)


def refine_tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All repairs of a table in their fixed order: blank rows, parentheses, fragments, headers (row 0), the total row, whole numbers, blank rows again."""
    from factloom.operators.tables import integral_text

    out = drop_empty_rows(rows.withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))))
    out = merge_fragments(out.withColumn("cells", join_parentheses(F.col("cells"))), keys)
    head, body = out.where("row_no = 0"), out.where("row_no > 0")
    body = total_label(body, keys).withColumn("cells", F.transform("cells", integral_text))
    return drop_empty_rows(head.withColumn("cells", repair_headers(F.col("cells"))).unionByName(body))
