"""Reconciliation of two independent sets of facts, cell by cell, and what follows from it.

Facts are long: (entity, field_id, period_end, value, ord). Every operator takes all entities at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.settings import ANCHORS, DEFAULTS, FIELDS, KNOWN_SOURCES, SPLIT_FACTORS

CELL = ["entity", "field_id", "period_end"]


def fields(spark: SparkSession) -> DataFrame:
    """The 13 fields in output order; broadcast it freely."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FIELDS)], "field_ord int, field_id string, statement string, scale string")


def last_values(facts: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """One fact for each cell: that with the largest ord."""
    rows = facts if keep_nulls else facts.where("value is not null")
    order = Window.partitionBy(*CELL).orderBy(F.desc("ord"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "ord")


def within_tolerance(x: Column, d: Column, field: Column, scale: Column, absolute: float = DEFAULTS.abs_tolerance, relative: float = DEFAULTS.rel_tolerance) -> Column:
    """Whether two values agree: money within the larger of both tolerances (capex by magnitude), per-share values absolutely or by a split factor."""
    x, d = F.when(field == "capex", F.abs(x)).otherwise(x), F.when(field == "capex", F.abs(d)).otherwise(d)
    money = F.abs(x - d) <= F.greatest(F.lit(absolute), F.greatest(F.abs(x), F.abs(d), F.lit(1.0)) * relative)
    share_tolerance = max(absolute, 0.02)
    factors = F.array(*(F.lit(float(f)) for f in SPLIT_FACTORS))
    split = F.exists(factors, lambda f: (F.abs(x * f - d) <= share_tolerance) | (F.abs(x - d * f) <= share_tolerance))
    return F.when(scale == "per_share", (F.abs(x - d) <= share_tolerance) | split).otherwise(money)


def spine(periods: DataFrame) -> DataFrame:
    """Every field for every (entity, period_end); the fixed field list is the broadcast side."""
    return periods.select("entity", "period_end").distinct().join(F.broadcast(fields(periods.sparkSession)), F.lit(True))


def reconcile(official: DataFrame, document: DataFrame, skipped: DataFrame | None = None, absolute: float = DEFAULTS.abs_tolerance, relative: float = DEFAULTS.rel_tolerance) -> DataFrame:
    """A row for every field and period of an entity (the official periods; the document's where it has no official ones).

    skipped: (entity, field_id, period_end) or period_end null for whole fields; it counts only where a side is missing.
    """
    own = official.select("entity", "period_end").distinct()
    lacking = document.select("entity", "period_end").distinct().join(own.select("entity").distinct(), "entity", "left_anti")
    cells = spine(own.unionByName(lacking))
    x = last_values(official).select(*CELL, F.col("value").alias("x"), *([F.col("source").alias("x_source")] if "source" in official.columns else [F.lit("xbrl").alias("x_source")]))
    d = last_values(document).select(*CELL, F.col("value").alias("d"))
    joined = cells.join(x, CELL, "left").join(d, CELL, "left")
    if skipped is None:
        joined = joined.withColumn("skip", F.lit(False))
    else:
        whole = skipped.where("period_end is null").select("entity", "field_id").distinct().withColumn("s1", F.lit(True))
        exact = skipped.where("period_end is not null").select(*CELL).distinct().withColumn("s2", F.lit(True))
        joined = joined.join(whole, ["entity", "field_id"], "left").join(exact, CELL, "left").withColumn("skip", F.coalesce("s1", "s2", F.lit(False)))
    x, d, skip = F.col("x"), F.col("d"), F.col("skip")
    both = x.isNotNull() & d.isNotNull()
    agree = within_tolerance(x, d, F.col("field_id"), F.col("scale"), absolute, relative)
    status = F.when(both, F.when(agree, "matched").otherwise("mismatch")).when(skip, "skipped").when(x.isNotNull(), "xbrl_only").when(d.isNotNull(), "pdf_only").otherwise("both_missing")
    out = joined.withColumn("status", status)
    trust = F.when(F.col("status") == "matched", "verified").when(F.col("status") == "mismatch", "review_required").when(F.col("status").isin("xbrl_only", "pdf_only"), "unverified").otherwise("missing")
    shown = F.col("status").isin("skipped", "both_missing")
    source = F.when(F.col("status") == "matched", "xbrl_verified").when(F.col("status") == "mismatch", "xbrl_flagged").when(F.col("status") == "xbrl_only", F.col("x_source")).when(F.col("status") == "pdf_only", "pdf_text").otherwise("")
    return out.select(
        "entity", "field_ord", "field_id", "statement", "period_end", F.col("x").alias("xbrl_value"), F.col("d").alias("doc_value"), "status", trust.alias("trust_level"),
        F.when(both, F.round(d - x, 4)).alias("delta"), F.when(both & (x != 0), F.round((d - x) / F.abs(x), 6)).alias("delta_pct"),
        F.when(~shown, F.coalesce(x, d)).alias("authoritative_value"), source.alias("authoritative_source"),
    )


def reconcile_document_only(document: DataFrame, skipped_fields: DataFrame | None = None) -> DataFrame:
    """The document alone: skipped first, then missing, else verified with the fact's own source."""
    cells = spine(document)
    d = last_values(document).select(*CELL, F.col("value").alias("doc_value"), F.col("source"))
    out = cells.join(d, CELL, "left")
    out = out.withColumn("skip", F.lit(False)) if skipped_fields is None else out.join(skipped_fields.select("entity", "field_id").distinct().withColumn("skip", F.lit(True)), ["entity", "field_id"], "left")
    status = F.when(F.coalesce("skip", F.lit(False)), "skipped").when(F.col("doc_value").isNull(), "both_missing").otherwise("pdf_only")
    out = out.withColumn("status", status)
    filled = F.col("status") == "pdf_only"
    return out.select("entity", "field_ord", "field_id", "period_end", F.when(filled, F.col("doc_value")).alias("doc_value"), "status", F.when(filled, "verified").otherwise("missing").alias("trust_level"), F.when(filled, F.coalesce("source", F.lit("pdf"))).otherwise("").alias("authoritative_source"))


def report(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and ratios of reconciled cells: verification, trust and coverage, 0 where there is nothing to count."""
    has = lambda s: F.count_if(F.col("status") == s)
    total = F.count_if(F.col("status") != "skipped")
    weight = F.sum(F.when(F.col("status") == "matched", 10).when(F.col("status") == "xbrl_only", 7).when(F.col("status") == "pdf_only", 5).otherwise(0))
    with_x = F.count_if((F.col("status") != "skipped") & F.col("xbrl_value").isNotNull())
    with_both = F.count_if(F.col("status").isin("matched", "mismatch"))
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))
    out = items.groupBy(*(["entity"] if keys is None else keys)).agg(
        total.alias("total"), has("matched").alias("matched"), has("mismatch").alias("mismatch"), has("xbrl_only").alias("xbrl_only"), has("pdf_only").alias("pdf_only"),
        ratio(has("matched"), with_both).alias("verification_rate"), ratio(weight, total * 10).alias("trust_score"), ratio(with_both, with_x).alias("coverage_rate"),
    )
    return out


def document_report(items: DataFrame) -> DataFrame:
    """Ratios of reconcile_document_only(): coverage, and trust weighted by how well the source is known."""
    total = F.count_if(F.col("status") != "skipped").cast("double")
    filled = F.count_if(F.col("status") == "pdf_only").cast("double")
    weight = F.sum(F.when(F.col("status") == "pdf_only", F.when(F.col("authoritative_source").isin(*KNOWN_SOURCES), 1.0).otherwise(0.75)).otherwise(0.0))
    ratio = lambda a: F.coalesce(F.round(F.try_divide(a, total), 4), F.lit(0.0))
    return items.groupBy("entity").agg(ratio(filled).alias("coverage_rate"), ratio(weight).alias("trust_score"))


def production_ready(reports: DataFrame, threshold: float = DEFAULTS.verification) -> DataFrame:
    return reports.withColumn("production_ready", (F.col("verification_rate") >= threshold) & (F.col("mismatch") == 0))


def flag_facts(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with pdf_verified: true if matched, false if mismatched, else null."""
    flags = items.select(*CELL, F.when(F.col("status") == "matched", True).when(F.col("status") == "mismatch", False).alias("pdf_verified"))
    return facts.join(flags, CELL, "left")


def identities(facts: DataFrame, absolute: float = DEFAULTS.abs_tolerance, relative: float = DEFAULTS.rel_tolerance) -> DataFrame:
    """Assets against liabilities plus equity, for every period that has all three."""
    known = last_values(facts.where(F.col("field_id").isin("total_assets", "total_liabilities", "total_equity")), keep_nulls=False)
    pick = lambda f: F.max(F.when(F.col("field_id") == f, F.col("value")))
    out = known.groupBy("entity", "period_end").agg(pick("total_assets").alias("assets"), pick("total_liabilities").alias("liabilities"), pick("total_equity").alias("equity")).dropna()
    right = F.col("liabilities") + F.col("equity")
    base = F.greatest(F.abs("assets"), F.abs(right), F.lit(1.0))
    delta = F.col("assets") - right
    return out.select("entity", "period_end", "assets", right.alias("claims"), F.round(delta, 3).alias("delta"), F.round(F.abs(delta) / base, 6).alias("delta_rel"), (F.abs(delta) <= F.greatest(F.lit(absolute), base * relative)).alias("passed"))


def identity_report(checks: DataFrame) -> DataFrame:
    return checks.groupBy("entity").agg(F.count_if("passed").alias("pass_count"), F.count_if(~F.col("passed")).alias("fail_count"), F.bool_and("passed").alias("all_passed"))


#: How error lines begin.
ERROR_PREFIXES = {"tag": "Missing XBRL tag: ", "text": "PDF extraction failed for: ", "pages": "Missing statement pages: ", "grid": "Missing statement grid: "}


def skipped_fields(errors: DataFrame) -> DataFrame:
    """(entity, field_id) that error lines (entity, line) name, by field or by statement."""
    named = F.coalesce(*(F.nullif(F.regexp_extract("line", f"^{ERROR_PREFIXES[k]}(\\w+)", 1), F.lit("")) for k in ("tag", "text")))
    statement = F.coalesce(*(F.nullif(F.regexp_extract("line", f"^{ERROR_PREFIXES[k]}(\\w+)", 1), F.lit("")) for k in ("pages", "grid")))
    own = fields(errors.sparkSession)
    lines = errors.select("entity", named.alias("named"), statement.alias("s"))
    by_field = lines.join(F.broadcast(own.select("field_id")), F.col("named") == F.col("field_id"))
    by_statement = lines.join(F.broadcast(own.select("field_id", "statement")), F.col("s") == F.col("statement"))
    return by_field.select("entity", "field_id").union(by_statement.select("entity", "field_id")).distinct()


def skipped_cells(official: DataFrame, document: DataFrame, periods: DataFrame) -> DataFrame:
    """Cells that can't be compared because a side lacks the year, by which sides have the field at all."""
    year = F.substring("period_end", 1, 4)

    def has(facts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = facts.where("value is not null")
        return own.select("entity", "field_id", year.alias("y")).distinct().withColumn(f"{name}_year", F.lit(True)), own.select("entity", "field_id").distinct().withColumn(f"{name}_any", F.lit(True))

    out = spine(periods).withColumn("y", year)
    for facts, name in ((document, "d"), (official, "x")):
        by_year, anywhere = has(facts, name)
        out = out.join(by_year, ["entity", "field_id", "y"], "left").join(anywhere, ["entity", "field_id"], "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    d, x, any_d, any_x = on("d_year"), on("x_year"), on("d_any"), on("x_any")
    skip = (any_d & ~d & (~any_x | x)) | (any_x & ~x & d) | ((any_d | any_x) & ~d & ~x)
    return out.where(skip).select(*CELL)


def final_errors(facts: DataFrame, errors: DataFrame, skipped: DataFrame) -> DataFrame:
    """(entity, ord, line): each line once, without failures of fields that do have a value, then a line for every missing field in field order."""
    have = facts.where("value is not null").select("entity", "field_id").distinct()
    failed = F.regexp_extract("line", f"^{ERROR_PREFIXES['text']}(\\w+)", 1)
    kept = errors.withColumn("field_id", failed).join(have, ["entity", "field_id"], "left_anti").groupBy("entity", "line").agg(F.min("ord").alias("ord"))
    missing = errors.select("entity").union(facts.select("entity")).distinct().join(F.broadcast(fields(facts.sparkSession)), F.lit(True)).join(have, ["entity", "field_id"], "left_anti").join(skipped, ["entity", "field_id"], "left_anti")
    added = missing.select("entity", F.concat(F.lit(ERROR_PREFIXES["text"]), "field_id").alias("line"), (F.col("field_ord") + 1_000_000).cast("long").alias("ord"))
    fresh = added.join(kept.select("entity", "line"), ["entity", "line"], "left_anti")
    every = kept.select("entity", "line", F.col("ord").cast("long").alias("ord")).unionByName(fresh)
    return every.select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("ord", "line")).alias("ord"), "line")


def value_matches(official: DataFrame, document: DataFrame) -> DataFrame:
    """(entity, x_period, d_period, agreements): periods of both sides that share anchor values; an equi-join on field with a range condition."""
    x = last_values(official).where(F.col("field_id").isin(*ANCHORS)).select("entity", "field_id", F.col("period_end").alias("x_period"), F.col("value").alias("x"))
    d = last_values(document).where(F.col("field_id").isin(*ANCHORS)).select("entity", "field_id", F.col("period_end").alias("d_period"), F.col("value").alias("d"))
    close = within_tolerance(F.col("x"), F.col("d"), F.col("field_id"), F.lit("millions"))
    return x.join(d, ["entity", "field_id"]).where(close).groupBy("entity", "x_period", "d_period").agg(F.count("*").alias("agreements"))


def match_periods(matches: DataFrame) -> DataFrame:
    """Greedy one-to-one choice in each entity: the newest official period takes the unused document period with most agreements (the newest of equals).

    An entity has a handful of periods, so a fold over its sorted rows is bounded.
    """
    rows = matches.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("x_period", "agreements", "d_period")), asc=False).alias("rows"))
    start = F.struct(F.array().cast("array<string>").alias("xs"), F.array().cast("array<string>").alias("ds"), F.array().cast("array<struct<x_period:string,d_period:string,agreements:bigint>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        free = ~F.array_contains(acc["xs"], r["x_period"]) & ~F.array_contains(acc["ds"], r["d_period"])
        taken = F.struct(
            F.array_append(acc["xs"], r["x_period"]).alias("xs"),
            F.array_append(acc["ds"], r["d_period"]).alias("ds"),
            F.array_append(acc["out"], F.struct(r["x_period"].alias("x_period"), r["d_period"].alias("d_period"), r["agreements"].alias("agreements"))).alias("out"),
        )
        return F.when(free, taken).otherwise(acc)

    return rows.select("entity", F.explode(F.aggregate("rows", start, step)["out"]).alias("m")).select("entity", "m.x_period", "m.d_period", "m.agreements")


def align_exact(official: DataFrame, document: DataFrame, limit: int = 3) -> DataFrame:
    """The newest common periods of both sides."""
    common = official.select("entity", "period_end").intersect(document.select("entity", "period_end"))
    return common.withColumn("ord", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("period_end")))).where(F.col("ord") <= limit)
