"""From extracted grids to statement rows: which columns hold amounts of which period, labels, packed cells.

Grids are cells as in ``tables``; row_no counts from 1 below the header row. Arrays hold a table's columns or
cells, so their length is bounded by a page's table. Packed grids are opened as whole tables; folded() ones are taken as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.labels import normal_label
from factloom.functions.lines import cell_amount
from factloom.functions.numbers import amount_tokens, has_digit, looks_like_amount, split_values
from factloom.functions.periods import MONTH, let, period_of_header
from factloom.operators.tables import TABLE, folded

#: Fixed values.
CURRENCY = r"(?i)\b(RMB|CNY|USD|US\$|HKD|HK\$|EUR|GBP)(?![A-Za-z])"
CHINESE_MONEY = r"\bRMB\b|CNY|人民币"
HEADER_CELL = rf"(?i)^(?:20\d{{2}}(?:\s+20\d{{2}})*|(?:RMB|USD|US\$|CNY|HKD)(?:\s+(?:RMB|USD|US\$|CNY|HKD))*|notes?)$|{MONTH}\s+\d{{1,2}},?\s+20\d{{2}}"


def currency_code(token: Column) -> Column:
    up = F.replace(F.upper(token), F.lit("$"), F.lit(""))
    return F.when(up.isin("RMB", "CNY"), "CNY").when(up.isin("US", "USD"), "USD").when(up.isin("HK", "HKD"), "HKD").when(up != "", up)


def preferred_currency(page_text: Column) -> Column:
    """Of a page by the first 2,500 characters; renminbi where nothing is said."""
    head = F.upper(F.substring(F.coalesce(page_text, F.lit("")), 1, 2500))
    return F.when(head.rlike(CHINESE_MONEY), "CNY").when(head.rlike(r"\bHKD\b|港元|港幣"), "HKD").when(head.rlike(r"\bUSD\b|US\$"), "USD").otherwise("CNY")


def _is_text(row_no: Column, text: Column) -> Column:
    """Whether a trimmed cell near a table's top is text."""
    return (row_no <= 12) & (text != "") & ~text.rlike(r"^[\d$,.\s()-]+$")


def _is_header(texts: Column) -> Column:
    """Of a column's first cells that aren't blank."""
    like = F.size(F.filter(texts, lambda x: x.rlike(HEADER_CELL)))
    return F.array_join(texts, " ").rlike(r"20\d{2}") & (F.size(texts) > 0) & (like >= F.greatest(F.lit(1), F.floor(F.size(texts) / 2)))


def column_facts(cells: DataFrame) -> DataFrame:
    """(table, col_no, density, currency, is_note, is_header, text_rows) of every column.

    density: cells that look like amounts; currency: of the lowest of the first eight rows that names one;
    is_note: a column of note numbers; is_header: at least half of its first cells are years, dates or currencies.
    """
    cells, text = cells.where("col_no is not null"), F.trim(F.coalesce("text", F.lit("")))
    top = F.col("row_no") <= 8
    code = F.when(top, currency_code(F.regexp_extract(text, CURRENCY, 1)))
    shown = F.sort_array(F.collect_list(F.when(top & (text != ""), F.struct("row_no", text.alias("t")))))
    out = cells.groupBy(*TABLE, "col_no").agg(
        F.count_if(looks_like_amount(F.col("text"))).alias("density"),
        F.max_by(code, F.when(code.isNotNull(), F.col("row_no"))).alias("currency"),
        F.first("header", ignorenulls=True).alias("header"),
        shown.alias("shown"),
        F.count_if(_is_text(F.col("row_no"), text)).alias("text_rows"),
    )
    sample = F.lower(F.array_join("shown.t", " "))
    return out.select(
        *TABLE, "col_no", "density", "currency",
        (F.lower(F.coalesce("header", F.lit(""))).rlike(r"\bnote\b") | (sample == "note") | sample.startswith("note ")).alias("is_note"),
        _is_header(F.col("shown.t")).alias("is_header"),
        "text_rows",
    )


def label_columns(facts: DataFrame) -> DataFrame:
    """(table, label_col): the first column with three text cells near its top that is no header of periods, else 0."""
    good = (F.col("text_rows") >= 3) & ~((F.col("col_no") > 0) & F.col("is_header"))
    return facts.groupBy(*TABLE).agg(F.coalesce(F.min(F.when(good, F.col("col_no"))), F.lit(0)).alias("label_col"))


def table_label_columns(cells: DataFrame) -> DataFrame:
    """label_columns(column_facts(cells)) of whole tables, each worked out where it stands; label_col is null where no cell has a column."""
    text = lambda c: F.trim(F.coalesce(c["text"], F.lit("")))
    text_rows = lambda at: F.size(F.filter("cells", lambda c: (c["col_no"] == at) & _is_text(c["row_no"], text(c))))
    shown = lambda at: F.transform(F.filter("cells", lambda c: (c["col_no"] == at) & (c["row_no"] <= 8) & (text(c) != "")), text)
    good = F.filter(F.sort_array(F.array_distinct("cells.col_no")), lambda at: (text_rows(at) >= 3) & ~((at > 0) & let(shown(at), _is_header)))
    return folded(cells).select(*TABLE, F.when(F.array_max("cells.col_no").isNotNull(), F.coalesce(F.get(good, F.lit(0)), F.lit(0))).alias("label_col"))


def header_periods(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(table, headers): (col_no, period_end) of the header row, or of the first of six rows below it, that stands for two periods or more.

    pages: (doc_id, page_num, periods, calendar).
    """
    headers = cells.select(*TABLE, F.lit(0).alias("row_no"), "col_no", F.col("header").alias("text")).distinct()
    rows = headers.unionByName(cells.where("row_no <= 6").select(*TABLE, "row_no", "col_no", "text")).join(pages.select("doc_id", "page_num", "periods", "calendar"), ["doc_id", "page_num"])
    dated = rows.withColumn("period_end", period_of_header(F.col("text"), F.col("calendar"), F.col("periods"))).where("period_end is not null")
    lists = dated.groupBy(*TABLE, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "period_end"))).alias("headers")).where(F.size("headers") >= 2)
    return lists.groupBy(*TABLE).agg(F.min_by("headers", "row_no").alias("headers"))


def amount_columns(headers: Column, density: Column, notes: Column, currencies: Column, n_rows: Column, n_cols: Column, preferred: Column) -> Column:
    """The column of amounts for each header's period, in order.

    A header's own column, or the next one where that has no amounts, or the first dense one behind a note column; if these
    are dense enough and in the preferred currency. Else the last dense columns, as many as periods; and if
    there are too few, each header takes its own or the next free column.
    """
    dense = lambda c: F.coalesce(F.try_element_at(density, c), F.lit(0))
    least = F.greatest(F.lit(2), F.floor(n_rows / 12)).cast("int")
    after = lambda c: F.when(c + 1 < n_cols, F.sequence(c + 1, n_cols - 1)).otherwise(F.array().cast("array<int>"))
    in_currency = lambda c: (preferred == "USD") | (F.coalesce(F.try_element_at(currencies, c), preferred) == preferred)
    is_note = lambda c: F.array_contains(notes, c)
    next_has = lambda c: (c + 1 < n_cols) & (dense(c) == 0) & (dense(c + 1) > 0)

    def own(h: Column) -> Column:
        c = h["col_no"]
        return F.when(is_note(c), F.coalesce(F.get(F.filter(after(c), lambda x: dense(x) >= least), F.lit(0)), c)).when(next_has(c), c + 1).otherwise(c)

    def free(taken: Column, h: Column) -> Column:
        c = h["col_no"]
        first = F.when(is_note(c), F.coalesce(F.get(F.filter(after(c), lambda x: ~F.array_contains(taken, x) & (dense(x) > 0)), F.lit(0)), c)).when(next_has(c), c + 1).otherwise(c)
        other = F.get(F.filter(F.sequence(c, n_cols - 1), lambda x: ~F.array_contains(taken, x) & (dense(x) > 0)), F.lit(0))
        return F.array_append(taken, F.when(F.array_contains(taken, first), F.coalesce(other, first)).otherwise(first))

    aligned = F.transform(headers, own)
    fits = F.forall(aligned, lambda c: (dense(c) >= F.greatest(F.lit(1), F.floor(least / 2))) & in_currency(c))
    n = F.size(headers)
    amounts = F.filter(F.when(n_cols > 1, F.sequence(F.lit(1), n_cols - 1)).otherwise(F.array().cast("array<int>")), lambda c: dense(c) >= least)
    right = F.filter(amounts, in_currency)
    amounts = F.when(F.size(right) >= n, right).otherwise(amounts)
    return F.when(fits, aligned).when(F.size(amounts) >= n, F.slice(amounts, F.size(amounts) - n + 1, n)).otherwise(F.aggregate(headers, F.array().cast("array<int>"), free))


def period_columns(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(table, ord, col_no, period_end): the columns of amounts of each grid with two or more periods.

    pages: (doc_id, page_num, text, periods, calendar). Of several columns of one period the first in the page's currency stays, else the first.
    """
    cells = cells.where("col_no is not null")
    facts = column_facts(cells)
    whole = cells.groupBy(*TABLE).agg(F.max("row_no").alias("n_rows"), (F.max("col_no") + 1).cast("int").alias("n_cols"))
    folded = facts.groupBy(*TABLE).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col_no").cast("int"), F.col("density").cast("int")))).alias("density"),
        F.collect_list(F.when(F.col("is_note"), F.col("col_no").cast("int"))).alias("notes"),
        F.map_from_entries(F.collect_list(F.when(F.col("currency").isNotNull(), F.struct(F.col("col_no").cast("int"), "currency")))).alias("currencies"),
    )
    found = header_periods(cells.withColumn("col_no", F.col("col_no").cast("int")), pages).join(folded, TABLE).join(whole, TABLE).join(pages.select("doc_id", "page_num", preferred_currency(F.col("text")).alias("preferred"), F.upper(F.substring("text", 1, 2500)).rlike(CHINESE_MONEY).alias("chinese")), ["doc_id", "page_num"])
    # a grid that names no currency has the page's, or else dollars
    every = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.struct(c, F.when(F.col("chinese"), "CNY").otherwise("USD"))))
    found = found.withColumn("currencies", F.when(F.size("currencies") > 0, F.col("currencies")).otherwise(every))
    columns = amount_columns(F.col("headers"), F.col("density"), F.col("notes"), F.col("currencies"), F.col("n_rows"), F.col("n_cols"), F.col("preferred"))
    pairs = found.withColumn("columns", columns).select(*TABLE, "preferred", "currencies", F.posexplode(F.arrays_zip("columns", F.col("headers.period_end").alias("period_end"))).alias("ord", "x"))
    own = F.coalesce(F.try_element_at("currencies", F.col("x.columns")), F.col("preferred")) == F.col("preferred")
    best = pairs.groupBy(*TABLE, F.col("x.period_end").alias("period_end")).agg(F.min("ord").alias("first"), F.min_by("x.columns", F.struct((~own).alias("other"), "ord")).alias("col_no"))
    return best.select(*TABLE, (F.row_number().over(Window.partitionBy(*TABLE).orderBy("first")) - 1).alias("ord"), "col_no", "period_end")


def _rows_of_tables(cells: DataFrame, label_col: Column) -> DataFrame:
    """cells as whole tables, and beside what packed_grids() says of them rows: (row_no, label, amounts, several), several where a cell holds three amounts or more."""
    years = lambda h: F.size(F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(r"\b(20\d{2})\b"), F.lit(1)))
    several = lambda tokens: F.size(tokens) >= 3
    text = lambda r: F.get(F.filter(r, lambda c: (c["col_no"] == label_col) & c["text"].isNotNull()), F.lit(0))["text"]
    tokens = lambda r: F.sort_array(F.transform(F.filter(r, lambda c: c["col_no"] != label_col), lambda c: F.struct(c["col_no"].alias("col_no"), amount_tokens(c["text"]).alias("tokens"))))["tokens"]
    # the other cells' amounts are looked for only where these have too few
    others = lambda r: F.exists(r, lambda c: (c["col_no"].isNull() | (c["col_no"] == label_col)) & several(amount_tokens(c["text"])))
    row = lambda r: let(tokens(r), lambda ts: F.struct(F.get(r, F.lit(0))["row_no"].alias("row_no"), F.trim(text(r)).alias("label"), F.flatten(ts).alias("amounts"), (F.exists(ts, several) | others(r)).alias("several")))
    begins = lambda own: F.array_compact(F.transform(own, lambda c, i: F.when((i == 0) | ~F.get(own, i - 1)["row_no"].eqNullSafe(c["row_no"]), i + 1)))
    cut = lambda own: let(begins(own), lambda ats: F.transform(ats, lambda at, i: let(F.slice(own, at, F.coalesce(F.get(ats, i + 1), F.size(own) + 1) - at), row)))
    out = cells.select(*TABLE, let(F.sort_array("cells"), cut).alias("rows"), F.array_max(F.transform(F.array_distinct("cells.header"), years)).alias("years"), F.array_max("cells.col_no").alias("last"))
    out = out.withColumns({"packed_rows": F.size(F.filter("rows.several", lambda x: x)).cast("bigint"), "n_rows": F.size("rows").cast("bigint"), "header_packed": F.col("years") >= 3, "n_cols": F.col("last") + 1})
    narrow = (F.col("n_cols") <= 2) & (F.col("packed_rows") >= F.greatest(F.lit(2), F.floor(F.col("n_rows") / 6)))
    return out.withColumn("packed", (F.col("header_packed") & (F.col("packed_rows") >= 2)) | ((F.col("header_packed") | (F.col("n_cols") <= 3)) & narrow))


def packed_grids(cells: DataFrame) -> DataFrame:
    """(table, header_packed, packed_rows, n_rows, n_cols, packed): grids whose amounts stand several in a cell."""
    return _rows_of_tables(folded(cells), F.lit(0)).select(*TABLE, "header_packed", "packed_rows", "n_rows", "n_cols", "packed")


def unpacked(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(table, row_no, label, amounts) of packed grids: each row's amounts from all its cells, filled up to the widest row.

    Rows without a label or amounts, and those of years, currencies or notes, go; a grid with fewer than four rows left has none.
    A table travels as one row; labels outgrow what is estimated from the files, so they may not be broadcast.
    """
    own = _rows_of_tables(folded(cells).join(labels.hint("merge"), TABLE), F.col("label_col"))
    good = lambda r: (F.size(r["amounts"]) > 0) & (r["label"] != "") & ~r["label"].rlike(r"^20\d{2}(?:\s+20\d{2})*$|(?i)^(?:RMB|USD|notes?)\b")
    widest = F.array_max(F.transform("rows.amounts", lambda a: F.size(a)))
    left = let(F.filter("rows", good), lambda rows: F.when(F.size(rows) >= 4, rows))
    # tables go here, as a filter would be pushed down and everything below be worked out twice
    found = own.withColumn("widest", widest).select(*TABLE, "widest", F.explode(F.when(F.col("packed") & (F.col("widest") >= 2), left)).alias("x")).select(*TABLE, "widest", "x.*")
    return found.select(*TABLE, "row_no", "label", F.concat("amounts", F.array_repeat(F.lit(""), F.col("widest") - F.size("amounts"))).alias("amounts"))


def packed_years(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(table, years): the years, ascending, that the headers, the first four rows and the page's first 800 characters name. pages: (doc_id, page_num, text)."""
    named = lambda text: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    own = cells.where("row_no <= 4").select(*TABLE, F.explode(F.array_distinct(F.concat(named(F.col("header")), named(F.col("text"))))).alias("y")).unionByName(cells.select(*TABLE, F.explode(F.array_distinct(named(F.col("header")))).alias("y")))
    found = own.groupBy(*TABLE).agg(F.collect_set("y").alias("own"))
    heads = pages.select("doc_id", "page_num", named(F.substring("text", 1, 800)).alias("page"))
    tables = cells.select(*TABLE).distinct().join(found.hint("merge"), TABLE, "left").join(heads.hint("merge"), ["doc_id", "page_num"], "left")
    return tables.select(*TABLE, F.array_sort(F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<int>")), F.coalesce("page", F.array().cast("array<int>"))))).alias("years"))


def expanded(cells: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """cells with every packed grid that unpacked() opens replaced by its label column and one column for each amount; all others are unchanged.

    The columns' headers are the last years that the grid or its page names; where these are fewer, the further ones are
    extra1, extra2 and so on by their place, and without any year col0, col1. Rows are numbered anew from 1.
    """
    rows = unpacked(cells, labels)
    opened = rows.join(packed_years(cells, pages).hint("merge"), TABLE).withColumn("row_no", F.row_number().over(Window.partitionBy(*TABLE).orderBy("row_no")))
    n = F.size("amounts")
    own_years = F.when(F.size("years") >= n, F.slice("years", F.size("years") - n + 1, n)).otherwise(F.col("years"))
    header = lambda i: F.coalesce(F.get(own_years, i).cast("string"), F.concat(F.when(F.size("years") > 0, "extra").otherwise("col"), i.cast("string")))
    columns = F.transform("amounts", lambda t, i: F.struct((i + 1).alias("col_no"), header(i).alias("header"), t.alias("text")))
    label = F.array(F.struct(F.lit(0).alias("col_no"), F.lit("label").alias("header"), F.col("label").alias("text")))
    fresh = opened.select(*TABLE, "row_no", F.explode(F.concat(label, columns)).alias("x")).select(*TABLE, "row_no", "x.*")
    kept = cells.join(rows.select(*TABLE).distinct().hint("merge"), TABLE, "left_anti")
    return kept.select(*TABLE, "row_no", "col_no", "header", "text").unionByName(fresh)


def statement_rows(cells: DataFrame, columns: DataFrame, labels: DataFrame) -> DataFrame:
    """(table, row_no, label, values) of rows with amounts, values in the order of the grid's periods.

    A label is the label cell and the text cells between it and the first amounts. Labels that run over two lines are
    joined: a row that starts with ``and`` takes the last label that stood without amounts; ``Basic`` or
    ``Diluted`` takes the last heading with ``per share``, once.
    """
    spans = columns.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("col_no").cast("int").alias("c")))).alias("cols"), F.min("col_no").alias("first_data"))
    own = cells.where("col_no is not null").join(spans, TABLE).join(labels, TABLE)
    text = F.trim(F.coalesce("text", F.lit("")))
    in_label = (F.col("col_no") == F.col("label_col")) | ((F.col("col_no") > F.col("label_col")) & (F.col("col_no") < F.col("first_data")))
    parts = F.sort_array(F.collect_set(F.when(in_label & (text != "") & ~looks_like_amount(F.col("text")), F.struct("col_no", text.alias("t")))))
    # of a cell that is given more than once the first text in order counts
    given = F.sort_array(F.collect_list(F.struct(F.col("col_no").cast("int").alias("c"), text.alias("t"))))
    filled = F.map_from_entries(let(given, lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["c"] != x["c"]))))
    rows = own.groupBy(*TABLE, "row_no", "cols").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("label"), filled.alias("at"))
    rows = rows.withColumn("values", F.transform("cols", lambda x: F.coalesce(F.try_element_at(F.col("at"), x["c"]), F.lit("")))).where(~F.col("label").rlike(r"^(20\d{2})?$"))
    amounts = F.exists("values", has_digit)
    share = F.col("label").rlike("(?i)per share")
    follows = F.col("label").rlike(r"(?i)^and\s+")
    kind = F.lower(F.trim("label")).isin("basic", "diluted")
    # what the last row that set or used a carried label left behind
    pending = F.when(~amounts, F.when(share, "").when(~follows, F.col("label"))).when(follows, "")
    section = F.when(~amounts, F.when(share, F.col("label"))).when(kind, "")
    before = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"amounts": amounts, "p": pending, "s": section}).withColumns({"pending": F.coalesce(F.last("p", True).over(before), F.lit("")), "section": F.coalesce(F.last("s", True).over(before), F.lit(""))})
    joined = F.when(follows & (F.col("pending") != ""), F.concat_ws(" ", "pending", "label")).when(follows & F.col("label").rlike("(?i)intangible assets"), F.concat(F.lit("Purchase of property, equipment and software "), "label")).otherwise(F.col("label"))
    joined = F.when(kind & (F.col("section") != ""), F.concat_ws(" ", "section", "label")).otherwise(joined)
    return rows.where("amounts").select(*TABLE, "row_no", F.trim(joined).alias("label"), F.slice(split_values(F.col("values")), F.lit(1), F.size("cols")).alias("values"))


def orphan_cash(rows: DataFrame) -> DataFrame:
    """(table, row_no, values): the first of a balance sheet's first four rows whose label was lost but for a money mark, if it holds an amount."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*TABLE).orderBy("row_no"))).where("_n <= 4")
    lost = ranked.where(normal_label(F.col("label")).isin("$", "($", "")).withColumn("values", F.transform("values", lambda v: cell_amount(v))).where(F.exists("values", lambda v: v.isNotNull()))
    return lost.groupBy(*TABLE).agg(F.min_by("values", "row_no").alias("values"), F.min("row_no").alias("row_no"))
