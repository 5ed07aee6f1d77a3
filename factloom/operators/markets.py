"""What differs between markets: tags of the two taxonomies, cross-listed and industry codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.facts import preferred_unit
from factloom.settings import ANNUAL_FORMS, FIELDS, INSTANT_FIELDS

#: Tags that report a field, in order of preference.
US_GAAP = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "eps_basic": ("EarningsPerShareBasic",),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "total_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"),
    "cfo": ("NetCashProvidedByUsedInOperatingActivities",),
    "cfi": ("NetCashProvidedByUsedInInvestingActivities",),
    "cff": ("NetCashProvidedByUsedInFinancingActivities",),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
}
IFRS = {
    "revenue": ("Revenue", "RevenueFromContractsWithCustomers", "RevenueAndOperatingIncome"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("ProfitLossFromOperatingActivities", "OperatingProfitLoss"),
    "net_income": ("ProfitLoss", "ProfitLossAttributableToOwnersOfParent"),
    "eps_basic": ("BasicEarningsLossPerShare",),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "total_equity": ("Equity",),
    "cash": ("CashAndCashEquivalents",),
    "cfo": ("CashFlowsFromUsedInOperatingActivities",),
    "cfi": ("CashFlowsFromUsedInInvestingActivities",),
    "cff": ("CashFlowsFromUsedInFinancingActivities",),
    "capex": ("PurchaseOfPropertyPlantAndEquipment",),
}
TAXONOMIES = (("us-gaap", US_GAAP), ("ifrs-full", IFRS))
#: Hong Kong code -> US ticker, Hong Kong code -> industry, industry -> fields that it doesn't report.
CROSS_LISTED = {
    "0700": "TCEHY", "9988": "BABA", "3690": "MPNGY", "9618": "JD", "9888": "BIDU", "1024": "KUASF", "1810": "XIACY", "1299": "AIA", "0941": "CHL", "0005": "HSBC", "9999": "NTES", "2015": "LI", "9868": "XPEV", "9866": "NIO",
}
INDUSTRY = {
    "0700": "platform", "9988": "platform", "3690": "platform", "9618": "platform", "9888": "platform", "1024": "platform", "1810": "platform", "1299": "insurance", "0941": "telecom", "0005": "bank",
    "9999": "platform", "2015": "platform", "9868": "platform", "9866": "platform", "2318": "insurance", "2628": "insurance", "0939": "bank", "0883": "energy", "1211": "automotive",
}
UNREPORTED = {
    "insurance": ("gross_profit", "operating_income", "capex"),
    "telecom": ("gross_profit",),
    "bank": ("gross_profit", "operating_income", "capex"),
    "platform": ("gross_profit",),
    "energy": ("gross_profit", "operating_income"),
    "automotive": ("gross_profit",),
}
UNIT_ORDER = ("CNY", "USD", "HKD", "EUR", "GBP")


def hk_code(ticker: Column) -> Column:
    """Upper case without .HK; digits are filled up to four."""
    bare = F.replace(F.upper(F.trim(ticker)), F.lit(".HK"), F.lit(""))
    return F.when(bare.rlike("^[0-9]+$"), F.lpad(bare, F.greatest(F.length(bare), F.lit(4)), F.lit("0"))).otherwise(bare)


def _dim(spark: SparkSession, table: dict, key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} string")


def with_listings(companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """companies with code, us_ticker and industry; fixed tables are the broadcast sides."""
    spark = companies.sparkSession
    out = companies.withColumn("code", hk_code(F.col(ticker)))
    return out.join(F.broadcast(_dim(spark, CROSS_LISTED, "code", "us_ticker")), "code", "left").join(F.broadcast(_dim(spark, INDUSTRY, "code", "industry")), "code", "left")


def industry_skips(companies: DataFrame, ticker: str = "ticker") -> DataFrame:
    """(code, field_id) that a company's industry doesn't report."""
    listed = with_listings(companies, ticker).where("industry is not null").select("code", "industry").distinct()
    rows = [(i, f) for i, fields in UNREPORTED.items() for f in fields]
    return listed.join(F.broadcast(companies.sparkSession.createDataFrame(rows, "industry string, field_id string")), "industry").select("code", "field_id")


def tags(spark: SparkSession) -> DataFrame:
    scale = {f: s for f, _, s in FIELDS}
    rows = [(t, x, name, f, i, scale[f]) for x, (t, table) in enumerate(TAXONOMIES) for f, names in table.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "taxonomy string, tax_ord int, tag string, field_id string, tag_ord int, scale string")


def company_facts(entries: DataFrame, periods: int = 3, stale_years: int = 8) -> tuple[DataFrame, DataFrame]:
    """(facts, errors) of all fields and entities in one plan.

    Of an entity's taxonomies the first with any fact counts. Annual entries only, the last filed
    of each period; a field's tag is the one with the newest period (for revenue the largest value
    decides between equals, else the tags' order); values in millions unless per share. A field
    without facts gives an error line.
    """
    spark = entries.sparkSession
    rows = entries.join(F.broadcast(tags(spark)), ["taxonomy", "tag"])
    units = [u for c in UNIT_ORDER for u in (c, f"{c}/shares")]
    rows = preferred_unit(rows, units)
    instant = F.col("field_id").isin(*INSTANT_FIELDS)
    days = F.datediff(F.to_date(F.try_to_timestamp("end", F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp("start", F.lit("yyyy-MM-dd"))))
    duration = F.col("start").isNotNull() & ((F.col("scale") == "per_share") | days.between(340, 400))
    rows = rows.where(F.col("form").isin(*ANNUAL_FORMS) & (F.col("fp").isNull() | (F.col("fp") == "FY")) & F.when(instant, F.col("start").isNull()).otherwise(duration))
    filed = Window.partitionBy("entity", "taxonomy", "tag", "field_id", "end").orderBy(F.desc("filed"), "ord")
    rows = rows.withColumn("_n", F.row_number().over(filed)).where("_n = 1")
    first = F.min("tax_ord").over(Window.partitionBy("entity"))
    rows = rows.withColumn("_first", first).where("tax_ord = _first")
    per_tag, per_field = Window.partitionBy("entity", "field_id", "tag"), Window.partitionBy("entity", "field_id")
    year = lambda c: F.substring(c, 1, 4).cast("int")
    rows = rows.withColumns({"newest": F.max("end").over(per_tag), "size": F.max_by(F.abs("val"), "end").over(per_tag), "top": F.max("end").over(per_field)}).where((F.col("newest") == F.col("top")) & (year("top") - year("newest") <= stale_years))
    best = F.dense_rank().over(per_field.orderBy(F.desc(F.when(F.col("field_id") == "revenue", F.col("size")).otherwise(0.0)), "tag_ord"))
    rows = rows.withColumn("_best", best).where("_best = 1").withColumn("rank", F.row_number().over(per_field.orderBy(F.desc("end")))).where(F.col("rank") <= periods)
    value = F.when(F.col("scale") == "per_share", F.col("val")).otherwise(F.col("val") / 1e6)
    facts = rows.select("entity", "field_id", F.col("end").alias("period_end"), value.alias("value"), F.split_part("unit", F.lit("/"), F.lit(1)).alias("currency"), F.when(F.col("taxonomy") == "ifrs-full", "IFRS").otherwise("US-GAAP").alias("standard"), "tag", "form", "filed")
    every = entries.select("entity").distinct().join(F.broadcast(spark.createDataFrame([(f, i) for i, (f, _, _) in enumerate(FIELDS)], "field_id string, field_ord int")), F.lit(True))
    missing = every.join(facts.select("entity", "field_id").distinct(), ["entity", "field_id"], "left_anti")
    return facts, missing.select("entity", "field_ord", F.concat(F.lit("Missing XBRL tag: "), "field_id").alias("line"))
