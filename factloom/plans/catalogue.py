"""All queries of the library by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import labels, lines, numbers, periods
from factloom.operators import facts as fx
from factloom.operators import align, glyphs, locate, markets, reconcile, refine, tables
from factloom.plans import oracles, printed, reports, rows, statements
from factloom.streaming import usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = oracles.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sides(spark, sf_dir):
    official = fx.official_facts(spark, sf_dir)
    return official, fx.document_facts(official)


def _skips(spark, sf_dir):
    """capex of entities with an even number, as whole fields; cash of 1996 as single cells."""
    nation = fx.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity"), "n_nationkey")
    whole = nation.where("n_nationkey % 2 = 0").select("entity", F.lit("capex").alias("field_id"), F.lit(None).cast("string").alias("period_end"))
    return whole.unionByName(nation.select("entity", F.lit("cash").alias("field_id"), F.lit("1996-12-31").alias("period_end")))


def _items(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    gaps = official.where(~((F.substring("entity", 2, 2).cast("int") + F.col("fiscal_year")) % 9 == 1))
    return reconcile.reconcile(gaps, document, _skips(spark, sf_dir))


# reconciliation -----------------------------------------------------------------------------


@query
def reconcile_nation_year(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    return reconcile.reconcile(official, document).where("field_id = 'revenue'").select("entity", "period_end", "xbrl_value", "doc_value", "status", "trust_level", "delta", "authoritative_value", "authoritative_source")


@query
def reconcile_all_fields(spark, sf_dir):
    return _items(spark, sf_dir).drop("delta_pct")


@query
def reconcile_report(spark, sf_dir):
    return reconcile.report(_items(spark, sf_dir))


@query
def reconcile_pdf_only(spark, sf_dir):
    return reconcile.reconcile_document_only(_sides(spark, sf_dir)[1], _skips(spark, sf_dir).where("period_end is null"))


@query
def pdf_only_report(spark, sf_dir):
    return reconcile.document_report(reconcile_pdf_only(spark, sf_dir))


@query
def reconcile_orders_vs_lines(spark, sf_dir):
    """Orders' totals against their lines' sums; both sides are hash-partitioned by the order once."""
    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("x"))
    lines = fx.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("d"))
    both = orders.join(lines, "o_orderkey", "left")
    near = F.abs(F.col("x") - F.col("d")) * 20 <= F.greatest("x", "d")
    return both.select("o_orderkey", "x", "d", F.when(F.col("d").isNull(), "xbrl_only").when(near, "matched").otherwise("mismatch").alias("status"))


@query
def verification_flags(spark, sf_dir):
    official, _ = _sides(spark, sf_dir)
    return reconcile.flag_facts(official, _items(spark, sf_dir)).select("entity", "field_id", "period_end", "value", "pdf_verified")


@query
def trust_score_by_region(spark, sf_dir):
    nation = fx.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity"), "n_regionkey")
    region = fx.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return reconcile.report(_items(spark, sf_dir).join(nation.join(region, "n_regionkey"), "entity"), ["r_name"])


@query
def production_ready_entities(spark, sf_dir):
    ready = reconcile.report(_items(spark, sf_dir))
    return reconcile.production_ready(ready, 0.7).select("entity", "verification_rate", "mismatch", "production_ready")


@query
def identity_balance(spark, sf_dir):
    return reconcile.identities(_sides(spark, sf_dir)[1])


@query
def identity_pass_rate(spark, sf_dir):
    return reconcile.identity_report(identity_balance(spark, sf_dir))


def _errors(spark, sf_dir):
    """Error lines by key arithmetic: a field, a statement, and lines that say nothing."""
    names = F.array(*(F.lit(x) for x in ("revenue", "cash", "capex", "eps_basic", "nothing")))
    line = F.when(F.col("n") % 4 == 0, F.concat(F.lit("Missing XBRL tag: "), F.get(names, F.col("n") % 5))).when(F.col("n") % 4 == 1, F.concat(F.lit("PDF extraction failed for: "), F.get(names, F.col("n") % 3))).when(F.col("n") % 4 == 2, "Missing statement pages: cashflow").otherwise("other trouble")
    rows = fx.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity"), F.explode(F.sequence(F.col("n_nationkey"), F.col("n_nationkey") + 3)).alias("n"))
    return rows.select("entity", F.col("n").alias("ord"), line.alias("line"))


@query
def skipped_fields(spark, sf_dir):
    return reconcile.skipped_fields(_errors(spark, sf_dir))


@query
def skipped_cells(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    official = official.where("not (fiscal_year = 1997 and field_id in ('cfo', 'cfi'))")
    return reconcile.skipped_cells(official, document, _sides(spark, sf_dir)[0])


@query
def finalized_errors(spark, sf_dir):
    _, document = _sides(spark, sf_dir)
    gone = document.where("not (field_id = 'cash' and substring(entity, 3, 1) in ('1', '4'))")
    return reconcile.final_errors(gone, _errors(spark, sf_dir), reconcile.skipped_fields(_errors(spark, sf_dir).where("line like 'Missing statement%'")))


@query
def portfolio_rollup(spark, sf_dir):
    """Items by region and nation with subtotals."""
    nation = fx.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("entity"), "n_regionkey")
    rows = _items(spark, sf_dir).join(nation, "entity")
    return rows.rollup("n_regionkey", "entity").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "mismatch").alias("mismatch"))


@query
def portfolio_summary(spark, sf_dir):
    per = reconcile.production_ready(reconcile.report(_items(spark, sf_dir)), 0.7)
    return per.agg(F.count("*").alias("entities"), F.count_if("production_ready").alias("ready"), F.round(F.avg(F.col("trust_score").cast("decimal(10,4)")).cast("double"), 3).alias("avg_trust"), F.sum("mismatch").alias("mismatches"))


@query
def tier_verdict(spark, sf_dir):
    """Micro accuracy by tier and overall, with the verdict for each."""
    tiered = _items(spark, sf_dir).where("status in ('matched', 'mismatch')").withColumn("tier", F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.substring("entity", 2, 2).cast("int") % 3))
    out = tiered.rollup("tier").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "matched").alias("hits"))
    rate = F.col("hits") / F.col("total")
    return out.select(F.coalesce("tier", F.lit("all")).alias("tier"), "total", "hits", F.round(rate, 4).alias("rate"), F.when(rate >= 0.9, "GO").when(rate < 0.8, "STOP").otherwise("HOLD").alias("verdict"))


@query
def eps_split_match(spark, sf_dir):
    """Per-share values that agree only after a split."""
    part = fx.read(spark, sf_dir, "part").select("p_partkey", F.lit("eps_basic").alias("field"), (F.col("p_size") * 10).cast("double").alias("x"), (F.col("p_size") * 10 * (F.col("p_partkey") % 13)).cast("double").alias("d"))
    return part.select("p_partkey", reconcile.within_tolerance(F.col("x"), F.col("d"), F.col("field"), F.lit("per_share")).alias("agrees"))


@query
def capex_magnitude_match(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    pair = official.where("field_id = 'capex'").join(document.where("field_id = 'capex'").select("entity", "period_end", F.col("value").alias("d")), ["entity", "period_end"])
    return pair.select("entity", "period_end", reconcile.within_tolerance(F.col("value"), F.col("d"), F.lit("capex"), F.lit("millions")).alias("agrees"))


@query
def value_matched_periods(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    shifted = document.withColumn("period_end", F.concat(F.substring("period_end", 1, 4), F.lit("-09-30")))
    return reconcile.match_periods(reconcile.value_matches(official, shifted).where("agreements >= 2"))


@query
def align_periods(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    return reconcile.align_exact(official, document)


@query
def authoritative_pivot(spark, sf_dir):
    """Field by period of the authoritative values; the periods are listed, so no job looks for them."""
    years = [f"{y}-12-31" for y in range(1995, 2002)]
    out = _items(spark, sf_dir).groupBy("entity", "field_id").pivot("period_end", years).agg(F.first("authoritative_value"))
    return out.select("entity", "field_id", *(F.col(y).alias("y" + y[:4]) for y in years))


# periods and filings ------------------------------------------------------------------------


def _dates(spark, sf_dir):
    """Period ends of customers' orders by nation: some fiscal ends, some opening days."""
    own = fx.read(spark, sf_dir, "orders").join(fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    day = F.when(F.col("o_orderkey") % 3 == 0, "-12-31").when(F.col("o_orderkey") % 3 == 1, "-01-01").otherwise("-06-30")
    return own.select(F.col("c_nationkey").cast("string").alias("entity"), F.concat(F.year("o_orderdate").cast("string"), day).alias("period_end")).distinct()


@query
def canonical_periods(spark, sf_dir):
    return fx.canonical_periods(_dates(spark, sf_dir))


@query
def remap_facts_to_canonical(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("string").alias("entity"), F.lit("revenue").alias("field_id"), F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.date_format("o_orderdate", "MM-dd")).alias("period_end"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"))
    return fx.remap_to_canonical(rows, fx.canonical_periods(rows))


@query
def annual_filter(spark, sf_dir):
    return fx.annual_entries(fx.parse_filings(fx.filings_json(spark, sf_dir)), "revenue").select("entity", "tag", "end", "val", "form", "filed")


@query
def dedupe_latest_filed(spark, sf_dir):
    return fx.latest_filed(fx.parse_filings(fx.filings_json(spark, sf_dir))).select("entity", "end", "val", "form", "filed")


@query
def pick_tag_entries(spark, sf_dir):
    entries = fx.latest_filed(fx.annual_entries(fx.parse_filings(fx.filings_json(spark, sf_dir)), "revenue"))
    return fx.pick_tag(entries, ["Revenues", "SalesRevenueNet"], 3, by_value=True).select("entity", "tag", "end", "val", F.col("rank").cast("int").alias("rank"))


@query
def unit_preference(spark, sf_dir):
    lines = fx.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("string").alias("entity"), F.lit("us-gaap").alias("taxonomy"), F.col("o_orderpriority").alias("tag"), F.element_at(F.array(F.lit("EUR"), F.lit("CNY"), F.lit("USD"), F.lit("GBP")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("unit"), "o_orderkey")
    return fx.preferred_unit(lines, ["CNY", "USD"]).groupBy("entity", "tag", "unit").agg(F.count("*").alias("n"))


@query
def derive_liabilities(spark, sf_dir):
    official, _ = _sides(spark, sf_dir)
    wanted = official.where("field_id in ('total_assets', 'total_equity')").select("entity", "period_end", "field_id", "value")
    parts = official.where("field_id = 'total_liabilities'").select("entity", "period_end", F.explode(F.array(F.struct(F.lit("current").alias("field_id"), F.floor(F.col("value") * 40).alias("value")), F.struct(F.lit("non_current").alias("field_id"), F.floor(F.col("value") * 60).alias("value")))).alias("p")).where("period_end > '1996'").select("entity", "period_end", "p.field_id", (F.col("p.value") / 100).alias("value"))
    return fx.derive_liabilities(wanted.unionByName(parts))


@query
def fiscal_calendar(spark, sf_dir):
    """Each order year's most telling label: a full date over one that holds the year, over the bare year."""
    rows = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    label = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("December 31, "), "y")).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("FY "), "y")).otherwise(F.col("y").cast("string"))
    power = F.when(F.col("label").rlike("^[A-Z][a-z]+ [0-9]+, "), 3).when(F.col("label").rlike("[A-Z]"), 2).otherwise(1)
    return rows.withColumn("label", label).withColumn("power", power).groupBy("y").agg(F.max_by("label", F.struct("power", (-F.col("o_orderkey")).alias("k"))).alias("label"), F.max("power").alias("power"))


@query
def period_headers(spark, sf_dir):
    """Dates parsed out of headers that were printed from order dates, moved into this century."""
    day = F.add_months("o_orderdate", 120)
    rows = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Year ended "), F.date_format(day, "MMMM d, yyyy"), F.lit(" and "), F.date_format(F.add_months(day, -12), "MMMM d, yyyy")).alias("head"))
    return rows.select("o_orderkey", F.array_join(periods.dates_in(F.col("head")), ",").alias("found"))


# numbers and labels -------------------------------------------------------------------------


@query
def parse_amounts_roundtrip(spark, sf_dir):
    """Prices printed into a statement line and read back."""
    rows = fx.read(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    line = F.concat(F.lit("Total revenue $ "), numbers.display_number(F.when(F.col("o_orderkey") % 3 == 0, -F.col("v")).otherwise(F.col("v")).cast("double"), F.lit(False)))
    return rows.select("o_orderkey", F.element_at(F.concat(numbers.line_amounts(line), F.array(F.lit(None).cast("double"))), 1).alias("amount"))


@query
def amount_pair_split(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("$ "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" $ "), F.format_number("p_partkey", 0)).alias("cell"))
    pair = numbers.amount_pair(F.col("cell"))
    return rows.select("p_partkey", numbers.to_number(F.get(pair, F.lit(0))).alias("a"), numbers.to_number(F.get(pair, F.lit(1))).alias("b"))


@query
def stutter_repair(spark, sf_dir):
    """Part names with every character doubled, repaired."""
    rows = fx.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.regexp_replace("p_name", "(.)", "$1$1").alias("twice"))
    return rows.select("p_partkey", labels.repair_stutter(F.col("twice")).alias("repaired"))


@query
def label_normalize(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower(F.trim(F.concat(F.upper("p_name"), F.lit("   "), "p_brand"))), r"\s+", " ").alias("label"))


@query
def number_density_pages(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"[0-9]+")).alias("numbers"), F.regexp_count("html", F.lit(r"<li>")).alias("items"), F.length("html").alias("size"))


@query
def html_block_scores(spark, sf_dir):
    """Each page's visible length, tags and the share of links."""
    rows = fx.read(spark, sf_dir, "pages").withColumn("shown", labels.html_blocks_text(F.col("html")))
    return rows.select("page_id", F.length("shown").alias("shown_chars"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).alias("links"))


# tables -------------------------------------------------------------------------------------


#: A line becomes ten cells or so; the tables of so many lines are one task's.
LINES_A_TASK = 75_000


def _tables(spark, sf_dir):
    """Orders of up to 7 lines as tables of two engines: quantity, price and tax, then a total row. The second engine loses some cells.

    A table is a row with its cells as an array; an order's lines are dealt to one task, which then has all of its tables.
    """
    lines = fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_quantity").cast("bigint").alias("q"), F.floor("l_extendedprice").cast("bigint").alias("p"), F.round(F.col("l_tax") * 100).cast("bigint").alias("t"))
    one = fx.dealt(lines, "l_orderkey", LINES_A_TASK).groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("q"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    orders = one.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q", "p", "t"))).alias("lines"), F.sum("q").alias("q"), F.sum("p").alias("p"), F.when(F.col("doc_id") % 60 == 0, 0).otherwise(F.sum("t")).alias("t"))
    named = lambda **parts: F.named_struct(*(x for k, v in parts.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))))
    body = F.transform("lines", lambda x, i: named(row_no=i + 1, label=F.concat(F.lit("line "), x["l_linenumber"].cast("string")), q=x["q"], p=x["p"], t=x["t"]))
    rows = F.concat(body, F.array(named(row_no=F.size("lines") + 1, label="Total", q=F.col("q"), p=F.col("p"), t=F.col("t"))))
    engines = orders.select("doc_id", rows.alias("rows")).select("doc_id", "rows", F.explode(F.array(F.lit("docling"), F.lit("pdfplumber"))).alias("engine"))

    def text(row, c, value):
        lost = (F.col("engine") == "pdfplumber") & ((F.col("doc_id") + row["row_no"] * 3 + c) % 11 == 0)
        return F.when(~lost, value)

    heads = ("item", "qty", "price", "tax")
    every = lambda values: F.flatten(F.array_repeat(F.array(*(F.lit(v) for v in values)), F.size("rows")))
    texts = F.transform("rows", lambda x: F.array(text(x, 0, x["label"]), *(text(x, c, x[h[0]].cast("string")) for c, h in enumerate(heads[1:], 1))))
    # cells are zipped from a table's arrays: structs made one by one in a lambda take most of the time
    parts = engines.withColumns({"row_no": F.flatten(F.transform("rows", lambda x: F.array_repeat(x["row_no"], len(heads)))), "col_no": every(range(len(heads))), "header": every(heads), "text": F.flatten(texts)})
    return parts.select("doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("table_index"), "engine", F.arrays_zip("row_no", "col_no", "header", "text").alias("cells"))


def _cells(spark, sf_dir):
    """The cells of _tables(), a row each. No table is empty; an outer explode has no filter, which would print every table twice."""
    return _tables(spark, sf_dir).select("doc_id", "page_num", "table_index", "engine", F.explode_outer("cells").alias("c")).select("doc_id", "page_num", "table_index", "c.row_no", "c.col_no", "c.header", "c.text", "engine")


@query
def table_structure_score(spark, sf_dir):
    return tables.structure_scores(_tables(spark, sf_dir)).select("doc_id", "engine", F.round("structure", 6).alias("structure"))


@query
def numeric_consistency(spark, sf_dir):
    return tables.numeric_consistency(_cells(spark, sf_dir).where("engine = 'docling'")).select("doc_id", "numeric")


@query
def cross_engine_jaccard(spark, sf_dir):
    return tables.engine_agreement(_tables(spark, sf_dir), "docling", "pdfplumber").select("doc_id", F.round("agreement", 6).alias("agreement"))


@query
def table_quality(spark, sf_dir):
    return tables.table_scores(_tables(spark, sf_dir)).select("doc_id", "engine", "n_rows", "n_cols", F.round("score", 6).alias("score"))


@query
def merge_best_table(spark, sf_dir):
    cells = _tables(spark, sf_dir)
    cross = tables.engine_agreement(cells, "docling", "pdfplumber")
    return tables.best_tables(tables.table_scores(cells), cross).select("doc_id", "engine")


@query
def total_row_check(spark, sf_dir):
    return tables.total_rows(_cells(spark, sf_dir).where("engine = 'docling'")).select("doc_id", F.col("row_no").cast("int").alias("row_no"), "matched", "numeric")


@query
def column_summary(spark, sf_dir):
    return tables.column_summary(_cells(spark, sf_dir).where("engine = 'docling'")).select("doc_id", "col_no", "total", "mean")


@query
def grid_compare_offsets(spark, sf_dir):
    """The second engine's grid against the first's without its first row, over all shifts."""
    both = tables.side_by_side(_tables(spark, sf_dir), ["doc_id"], "pdfplumber", "docling")
    up = lambda cells, n, text: F.transform(cells, lambda c: F.struct((c["row_no"] - n).alias("row_no"), c["col_no"].alias("col_no"), text(c["text"]).alias("text")))
    second = up(F.filter("expected", lambda c: c["row_no"] > 1), 2, lambda t: F.coalesce(t, F.lit("?")))
    return tables.grid_accuracy(both.select("doc_id", second.alias("expected"), up("actual", 1, lambda t: t).alias("actual")), ["doc_id"])


@query
def page_confidence(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 / 4.0).alias("cross"), (F.col("doc_id") % 3 / 2.0).alias("structure"), F.when(F.col("doc_id") % 4 == 0, 0.3).otherwise(1.0).alias("numeric"), F.least("n_chars", F.lit(400)).alias("char_count"), (F.col("doc_id") % 2 == 0).alias("has_tables"), (F.col("doc_id") % 7 == 0).alias("merged_cells"), F.when(F.col("doc_id") % 6 == 0, "scanned").otherwise("text_native").alias("page_type"))
    return tables.page_confidence(docs).select("doc_id", "score", "gated", F.size("reasons").alias("n_reasons"))


@query
def page_risk_reasons(spark, sf_dir):
    """How often each reason stands, and its three lowest pages: a top-k per group."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 / 4.0).alias("cross"), (F.col("doc_id") % 3 / 2.0).alias("structure"), F.when(F.col("doc_id") % 4 == 0, 0.3).otherwise(1.0).alias("numeric"), F.least("n_chars", F.lit(400)).alias("char_count"), (F.col("doc_id") % 2 == 0).alias("has_tables"), (F.col("doc_id") % 7 == 0).alias("merged_cells"), F.when(F.col("doc_id") % 6 == 0, "scanned").otherwise("text_native").alias("page_type"))
    rows = tables.page_confidence(docs).select("doc_id", "score", F.explode("reasons").alias("reason"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("reason").orderBy("score", "doc_id"))).where("n <= 3")
    return ranked.groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("worst")).join(rows.groupBy("reason").agg(F.count("*").alias("pages")), "reason")


@query
def page_type_classify(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "pages").select("page_id", (F.length("html") % 100).alias("chars"), (F.length("html") % 13 / 1000.0).alias("area"), (F.col("page_id") % 10 / 10.0).alias("image"))
    return rows.select("page_id", tables.page_type(F.col("chars"), F.col("area"), F.col("image")).alias("page_type"))


@query
def grid_unpivot_facts(spark, sf_dir):
    """Statement grids of nations unpivoted to facts."""
    official, _ = _sides(spark, sf_dir)
    wide = official.where("field_id in ('revenue', 'cash')").groupBy("entity", "field_id").agg(F.sort_array(F.collect_list(F.struct("period_end", "value"))).alias("v"))
    rows = wide.groupBy("entity").agg(F.first(F.transform("v", lambda x: x["period_end"])).alias("period_ends"), F.sort_array(F.collect_list(F.struct(F.col("field_id").alias("label"), F.transform("v", lambda x: x["value"].cast("string")).alias("values")))).alias("rows"))
    return tables.unpivot_grid(rows.select(F.col("entity").alias("doc_id"), F.lit("income").alias("statement"), "period_ends", "rows")).select("doc_id", "row_no", "label", "period_end", F.col("raw").try_cast("double").alias("value"))


@query
def segment_totals(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).alias("doc_id"), F.col("o_orderkey").alias("row_no"), (F.col("o_orderkey") % 7 == 0).alias("is_total"), F.floor("o_totalprice").cast("bigint").alias("value"))
    return tables.segment_totals(rows).select("doc_id", "row_no", "part_sum", "stated")


@query
def feedback_corrections(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("engine = 'docling'")
    edits = fx.read(spark, sf_dir, "events").select((F.col("event_id") % 500 * 20).alias("doc_id"), F.lit(0).alias("table_index"), (F.col("event_id") % 3 + 1).cast("int").alias("row_no"), (F.col("user_id") % 4).cast("int").alias("col_no"), F.col("event_type").alias("corrected"), F.col("ts"))
    return tables.apply_corrections(cells, edits).where("edited").select("doc_id", "row_no", "col_no", "text")


# glyphs -------------------------------------------------------------------------------------


def _glyphs(spark, sf_dir):
    """Characters of part names set at eight units each, blanks at forty."""
    part = fx.read(spark, sf_dir, "part")
    chars = part.select((F.col("p_partkey") % 25).alias("doc_id"), F.col("p_partkey").alias("line"), "p_name", F.posexplode(F.split("p_name", "")).alias("ord", "text")).where("text <> '' and text <> ' '")
    blanks = F.col("ord") - F.length(F.regexp_replace(F.substring(F.col("p_name"), F.lit(1), F.col("ord")), " ", ""))
    return chars.withColumn("x0", (F.col("ord") * 8 + blanks * 40).cast("double")).withColumn("x1", F.col("x0") + 8).drop("p_name")


@query
def word_islands(spark, sf_dir):
    return glyphs.words(_glyphs(spark, sf_dir))


@query
def column_clusters(spark, sf_dir):
    return glyphs.column_clusters(glyphs.words(_glyphs(spark, sf_dir)), 40.0).select("doc_id", "col", F.round("center", 6).alias("center"))


@query
def nearest_column(spark, sf_dir):
    found = glyphs.words(_glyphs(spark, sf_dir))
    return glyphs.nearest_column(found, glyphs.column_clusters(found, 40.0)).select("doc_id", "line", F.col("word").cast("int").alias("word"), "text", "col")


@query
def merged_columns(spark, sf_dir):
    found = glyphs.words(_glyphs(spark, sf_dir))
    return glyphs.merge_close(glyphs.column_clusters(found, 5.0)).select("doc_id", F.col("col").cast("int").alias("col"), F.round("center", 4).alias("center"))


# locating and ranking -----------------------------------------------------------------------


@query
def locate_pages_topk(spark, sf_dir):
    pages = locate.into_pages(fx.read(spark, sf_dir, "documents"))
    titles = spark.createDataFrame([("income", "the and", 3), ("income", "that is", 1), ("balance", "of the", 2)], "statement string, pattern string, strength int")
    return locate.pick_pages(locate.candidates(pages, titles, F.length("text")), top=2).select("doc_id", "statement", "page_num", "score")


# usage --------------------------------------------------------------------------------------


@query
def usage_by_day(spark, sf_dir):
    return usage.daily(fx.read(spark, sf_dir, "events"))


@query
def rate_limit_sliding(spark, sf_dir):
    return usage.sliding_counts(fx.read(spark, sf_dir, "events"), 3600)


@query
def rate_limit_stateful(spark, sf_dir):
    """Accepted and rejected requests per user; rejected ones don't count, which takes state."""
    return usage.rate_limited(fx.read(spark, sf_dir, "events"), 3600, 1).groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query
def session_usage(spark, sf_dir):
    return usage.sessions(fx.read(spark, sf_dir, "events"))


@query
def log_summary(spark, sf_dir):
    return usage.log_summary(fx.read(spark, sf_dir, "events"))


# lines, tags and truth ----------------------------------------------------------------------


@query
def label_prefixes(spark, sf_dir):
    line = F.concat(F.lit("Total revenue "), F.format_number("o_totalprice", 0), F.lit(" more"))
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", lines.label_before_amounts(line).alias("label"))


@query
def eps_line_parts(spark, sf_dir):
    shown = F.format_number(F.col("o_totalprice") / 1000, 2)
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Basic "), shown, F.lit(" — Diluted 1.00"))).otherwise(F.concat(F.lit("Basic and diluted "), shown))
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.get(numbers.per_share_amounts(F.replace(lines.basic_part(line), F.lit(","), F.lit(""))), F.lit(0)), 2).alias("eps"))


@query
def cell_amounts(spark, sf_dir):
    price = F.format_number("o_totalprice", 0)
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("{"), price, F.lit("}"))).when(F.col("o_orderkey") % 3 == 1, price).otherwise(F.col("o_orderkey").cast("string"))
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", lines.cell_amount(cell).alias("amount"))


@query
def repaired_parentheses(spark, sf_dir):
    cells = F.array(F.col("p_name"), F.concat(F.lit("("), F.col("p_size").cast("string")), F.concat(F.col("p_partkey").cast("string"), F.lit(")")), F.lit("x"))
    return fx.read(spark, sf_dir, "part").select("p_partkey", F.array_join(refine.join_parentheses(cells), "|").alias("cells"))


@query
def spilled_amounts(spark, sf_dir):
    cells = F.array(F.lit("row"), F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(" $ "), F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("9"))
    return fx.read(spark, sf_dir, "part").select("p_partkey", F.array_join(refine.split_amounts(cells), "|").alias("cells"))


@query
def period_columns(spark, sf_dir):
    columns = F.array(*(F.lit(x) for x in ("1997-12-31", "1996-06-30", "1996-12-31", "1995-09-30")))
    period = F.concat(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "-12-31").otherwise("-06-30"))
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", align.column_of_period(columns, period).alias("col"))


@query
def equity_tag_refine(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    equity = official.where("field_id = 'total_equity'")
    tags = F.explode(F.array(F.struct(F.lit("Equity").alias("tag"), F.lit(0).alias("tag_ord"), F.lit(1.0).alias("by")), F.struct(F.lit("EquityAll").alias("tag"), F.lit(1).alias("tag_ord"), F.when(F.col("fiscal_year") % 2 == 0, 1.0).otherwise(3.0).alias("by")), F.struct(F.lit("Other").alias("tag"), F.lit(2).alias("tag_ord"), F.lit(2.0).alias("by"))))
    rows = equity.select("entity", "period_end", "value", tags.alias("t")).select("entity", "period_end", "t.tag", "t.tag_ord", (F.col("value") * F.col("t.by")).alias("value"))
    return align.refine_tag(rows, document, "total_equity")


@query
def truth_hits(spark, sf_dir):
    official, document = _sides(spark, sf_dir)
    return align.truth_hits(official, document)


@query
def field_coverage(spark, sf_dir):
    return align.field_coverage(_sides(spark, sf_dir)[1], 7)


@query
def merged_grids(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).cast("int").alias("doc_id"), F.col("p_partkey").alias("grid_ord"), F.col("p_name").alias("label"), F.array(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("values"))
    return align.merge_grids(rows).select("doc_id", "label", "grid_ord", "filled")


@query
def page_signals(spark, sf_dir):
    """Documents' pages scored by signal words of two kinds."""
    pages = locate.into_pages(fx.read(spark, sf_dir, "documents"))
    signals = spark.createDataFrame([("a", "the", 1000), ("a", "100", -5000), ("b", "ing", 300)], "statement string, pattern string, points int")
    return align.statement_scores(pages, signals)


@query
def document_sections(spark, sf_dir):
    """Pages by an ordered list of key words in their first 150 characters, with shares of the whole."""
    head = F.lower(F.substring("text", 1, 150))
    bucket = F.when(head.contains("the"), "the").when(head.contains("der"), "der").when(head.contains("le"), "le").otherwise("other")
    rows = locate.into_pages(fx.read(spark, sf_dir, "documents")).withColumn("section", bucket)
    counted = rows.groupBy("section").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    whole = counted.agg(F.sum("n").alias("all_n"), F.sum("chars").alias("all_chars"))
    return counted.crossJoin(F.broadcast(whole)).select("section", "n", "chars", F.round(F.col("n") / F.col("all_n"), 6).alias("page_share"), F.round(F.try_divide("chars", "all_chars"), 6).alias("char_share"))


# markets ------------------------------------------------------------------------------------


@query
def company_facts_extract(spark, sf_dir):
    found, _ = markets.company_facts(fx.parse_filings(fx.filings_json(spark, sf_dir)))
    return found.select("entity", "field_id", "period_end", F.round(F.col("value") * 1e6, 2).alias("value"), "currency", "standard", "tag")


@query
def company_facts_errors(spark, sf_dir):
    return markets.company_facts(fx.parse_filings(fx.filings_json(spark, sf_dir)))[1].groupBy("line").agg(F.count("*").alias("entities"))


@query
def industry_skips(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c in ("5.hk", "0700.HK", "2318", "883", "AAPL", "1211")))
    companies = fx.read(spark, sf_dir, "supplier").select(F.get(codes, (F.col("s_suppkey") % 6).cast("int")).alias("ticker"))
    return markets.industry_skips(companies)


QUERIES |= statements.QUERIES
ORACLE_SQL |= statements.ORACLE_SQL
QUERIES |= reports.QUERIES
ORACLE_SQL |= reports.ORACLE_SQL
QUERIES |= printed.QUERIES
ORACLE_SQL |= printed.ORACLE_SQL
QUERIES |= rows.QUERIES
ORACLE_SQL |= rows.ORACLE_SQL
