"""Facts from the star schema: both sides of a reconciliation, JSON filings, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.functions.numbers import display_number, to_number
from factloom.functions.periods import days_between, is_fiscal_end, is_opening
from factloom.settings import ANNUAL_FORMS, FIELDS, INSTANT_FIELDS

#: How each field is measured over the lines of a nation's suppliers in a year, in ten-thousandths of money or hundredths of a piece.
MEASURES = {
    "revenue": "sum(cents * 100)",
    "gross_profit": "sum(cents * (100 - disc))",
    "operating_income": "sum(cents * (100 - disc - tax))",
    "net_income": "sum(cents * (90 - disc - tax))",
    "eps_basic": "sum(pieces * 1000) / count(*)",
    "total_assets": "sum(cents * 100)",
    "total_liabilities": "sum(cents * (100 - disc))",
    "total_equity": "sum(cents * disc)",
    "cash": "sum(cents * tax)",
    "cfo": "sum(cents * (50 - disc))",
    "cfi": "-sum(cents * tax)",
    "cff": "-sum(cents * disc)",
    "capex": "-sum(cents * 2 * tax)",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """rows by key in about ``each`` a task: they are counted first (of a file, its footers), as a small file would be read in one task and a large one in few."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def official_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of money (pieces a line for per-share fields) by supplier nation and ship year; one scan, one pre-aggregated shuffle."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"), F.round("l_quantity").cast("bigint").alias("pieces"))
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    wide = lines.join(nation, "l_suppkey").groupBy("s_nationkey", "y").agg(*(F.expr(e).cast("double").alias(f) for f, e in MEASURES.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_id"), (F.floor(F.col(f) / (10.0 if f == "eps_basic" else 100_000.0) + 0.5) / 100.0).alias("value")) for f in MEASURES)))
    return wide.select(F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("entity"), F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("period_end"), F.col("y").alias("fiscal_year"), pairs.alias("p")).select("entity", "p.field_id", "period_end", "fiscal_year", F.col("p.value").alias("value"), F.lit("xbrl").alias("source"), F.lit(0).alias("ord"))


def _number() -> F.Column:
    """A cell's number by key arithmetic, for planned defects."""
    field = F.array_position(F.array(*(F.lit(f[0]) for f in FIELDS)), F.col("field_id")) - 1
    return F.substring("entity", 2, 2).cast("int") * 13 + F.col("fiscal_year") * 5 + field * 7


def document_facts(official: DataFrame) -> DataFrame:
    """The same facts as a document would print them, read back from the text; some cells dropped, doubled, with the sign turned or off by a little."""
    k, v = F.col("k"), F.col("value")
    defect = F.when(k % 11 == 3, v * 2).when(k % 13 == 4, -v).when(k % 17 == 5, v + 0.4).otherwise(v)
    # each step is a column of its own: the next ones use it several times
    rows = official.withColumn("k", _number()).where(k % 7 != 2).withColumn("shown", F.round(defect, 2)).withColumn("text", display_number(F.col("shown"), F.lit(True)))
    return rows.select("entity", "field_id", "period_end", "fiscal_year", to_number(F.col("text")).alias("value"), F.when(k % 2 == 0, "pdf_text").otherwise("esef_grid").alias("source"), F.lit(0).alias("ord"))


ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("start", "end")] + [T.StructField("val", T.DoubleType()), T.StructField("fp", T.StringType()), T.StructField("form", T.StringType()), T.StructField("filed", T.StringType())])
COMPANY_FACTS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(ENTRY))))


def filings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, body): orders as company facts, taxonomy -> tag -> unit -> entries, in JSON text. One per customer nation."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    y = F.year("o_orderdate")
    quarter = F.quarter("o_orderdate")
    rows = orders.groupBy("c_nationkey", y.alias("y"), quarter.alias("q")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))
    form = F.when(F.col("q") == 1, "10-K").when(F.col("q") == 2, "10-K/A").when(F.col("q") == 3, "10-Q").otherwise("20-F")
    entry = F.struct(
        F.when(F.col("q") != 4, F.concat(F.col("y").cast("string"), F.lit("-01-01"))).alias("start"), F.concat(F.col("y").cast("string"), F.when(F.col("q") == 3, "-09-30").otherwise("-12-31")).alias("end"), (F.col("cents") / 100.0).alias("val"),
        F.when(F.col("q") == 2, "Q2").otherwise("FY").alias("fp"), form.alias("form"), F.concat((F.col("y") + 1).cast("string"), F.lit("-0"), F.col("q").cast("string"), F.lit("-15")).alias("filed"),
    )
    by_nation = rows.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    tag = F.when(F.col("c_nationkey") % 2 == 0, "Revenues").otherwise("SalesRevenueNet")
    body = F.to_json(F.create_map(F.lit("us-gaap"), F.create_map(tag, F.create_map(F.lit("USD"), F.col("entries")))))
    return by_nation.select(F.concat(F.lit("C"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("entity"), body.alias("body"))


def parse_filings(filings: DataFrame) -> DataFrame:
    """(entity, taxonomy, tag, unit, ord, start, end, val, fp, form, filed) from company facts in JSON; bodies that don't parse give no rows."""
    tree = filings.select("entity", F.from_json("body", COMPANY_FACTS).alias("t"))
    tags = tree.select("entity", F.explode("t").alias("taxonomy", "tags")).select("entity", "taxonomy", F.explode("tags").alias("tag", "units"))
    units = tags.select("entity", "taxonomy", "tag", F.explode("units").alias("unit", "entries"))
    return units.select("entity", "taxonomy", "tag", "unit", F.posexplode("entries").alias("ord", "e")).select("entity", "taxonomy", "tag", "unit", "ord", "e.*")


def annual_entries(entries: DataFrame, field_id: str) -> DataFrame:
    """Annual forms only; instants have no start, durations 340 to 400 days (per-share ones any)."""
    shape = F.col("start").isNull() if field_id in INSTANT_FIELDS else F.col("start").isNotNull() & (F.lit(field_id == "eps_basic") | days_between(F.col("start"), F.col("end")).between(340, 400))
    return entries.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("fp").isNull() | (F.col("fp") == "FY")) & shape)


def latest_filed(entries: DataFrame) -> DataFrame:
    """For each tag and period the entry filed last; of equals the first."""
    order = Window.partitionBy("entity", "taxonomy", "tag", "unit", "end").orderBy(F.desc("filed"), "ord")
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pick_tag(entries: DataFrame, tags: list[str], periods: int, by_value: bool = False, stale_years: int = 8) -> DataFrame:
    """The newest periods of one tag for each entity: tags far behind the newest are out, of those as new the first listed (or with the largest newest value)."""
    listed = F.create_map(*(x for i, t in enumerate(tags) for x in (F.lit(t), F.lit(i))))
    own = entries.where(F.col("tag").isin(*tags)).withColumn("tag_ord", listed[F.col("tag")])
    by_tag = own.groupBy("entity", "tag", "tag_ord").agg(F.max("end").alias("newest"), F.max_by(F.abs("val"), F.struct("end", F.abs("val"))).alias("size"))
    year = lambda c: F.substring(c, 1, 4).cast("int")
    fresh = by_tag.withColumn("top", F.max("newest").over(Window.partitionBy("entity"))).where((year("top") - year("newest") <= stale_years) & (F.col("newest") == F.col("top")))
    order = Window.partitionBy("entity").orderBy(*([F.desc("size")] if by_value else []), "tag_ord")
    chosen = fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("entity", "tag")
    rows = own.join(chosen, ["entity", "tag"], "left_semi")
    newest = Window.partitionBy("entity").orderBy(F.desc("end"), "ord")
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= periods)


def preferred_unit(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries of one unit for each tag: the first of order that it has, else the smallest name."""
    place = F.coalesce(*(F.when(F.col("unit") == u, i) for i, u in enumerate(order)), F.lit(len(order)))
    chosen = entries.groupBy("entity", "taxonomy", "tag").agg(F.min(F.struct(place.alias("p"), "unit")).alias("best")).select("entity", "taxonomy", "tag", "best.unit")
    return entries.join(chosen, ["entity", "taxonomy", "tag", "unit"], "left_semi")


def canonical_periods(periods: DataFrame, limit: int = 3) -> DataFrame:
    """(entity, year, period_end): for each year the latest fiscal end, else the latest that is no opening day, else 31 December; the newest years."""
    p = F.col("period_end")
    year = F.substring(p, 1, 4)
    by_year = periods.groupBy("entity", year.alias("year")).agg(F.max(F.when(is_fiscal_end(p), p)).alias("a"), F.max(F.when(~is_opening(p), p)).alias("b"))
    out = by_year.select("entity", "year", F.coalesce("a", "b", F.concat("year", F.lit("-12-31"))).alias("period_end"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("year")))).where(F.col("ord") <= limit)


def remap_to_canonical(facts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Facts moved to their year's canonical period; of several for a cell one that stood at a fiscal end, else the first."""
    year = F.substring(F.col("period_end"), 1, 4)
    moved = facts.withColumn("year", year).join(canonical.select("entity", "year", F.col("period_end").alias("canonical")), ["entity", "year"])
    order = Window.partitionBy("entity", "field_id", "canonical").orderBy(F.desc(is_fiscal_end(F.col("period_end"))), "ord")
    return moved.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("entity", "field_id", F.col("canonical").alias("period_end"), "value")


def derive_liabilities(facts: DataFrame) -> DataFrame:
    """(entity, period_end, liabilities): assets less equity; with current and non-current parts, their sum unless both ways differ by more than 1 or 2 %."""
    pick = lambda f: F.max(F.when(F.col("field_id") == f, F.col("value")))
    wide = facts.groupBy("entity", "period_end").agg(pick("total_assets").alias("a"), pick("total_equity").alias("e"), pick("current").alias("c"), pick("non_current").alias("n"))
    equation, parts = F.col("a") - F.col("e"), F.col("c") + F.col("n")
    far = F.abs(equation - parts) > F.greatest(F.lit(1.0), F.abs(equation) * 0.02)
    return wide.select("entity", "period_end", F.round(F.when(parts.isNull() | far, equation).otherwise(parts), 2).alias("liabilities")).dropna()


def keep_periods(facts: DataFrame, periods: DataFrame, matched: DataFrame | None = None, by_year: bool = True) -> DataFrame:
    """facts on the wanted periods (entity, period_end) alone: a fact's own, else the one that its period was matched with (entity, x_period, d_period), else (by_year) the entity's period of its year, the last of several."""
    wanted = periods.select("entity", "period_end").distinct()
    rows = facts.join(wanted.select("entity", "period_end", F.lit(True).alias("own")), ["entity", "period_end"], "left")
    if matched is not None:
        rows = rows.join(matched.select("entity", F.col("d_period").alias("period_end"), F.col("x_period").alias("other")), ["entity", "period_end"], "left")
    else:
        rows = rows.withColumn("other", F.lit(None).cast("string"))
    years = wanted.groupBy("entity", F.substring("period_end", 1, 4).alias("y")).agg(F.max("period_end").alias("same_year"))
    rows = rows.withColumn("y", F.substring("period_end", 1, 4)).join(years, ["entity", "y"], "left")
    end = F.when(F.col("own"), F.col("period_end")).otherwise(F.coalesce("other", F.col("same_year") if by_year else F.lit(None).cast("string")))
    return rows.withColumn("period_end", end).where("period_end is not null").select(*facts.columns)


def of_statement(facts: DataFrame, statement: str) -> DataFrame:
    """The facts whose field belongs to a statement."""
    return facts.where(F.col("field_id").isin(*(f for f, s, _ in FIELDS if s == statement)))
