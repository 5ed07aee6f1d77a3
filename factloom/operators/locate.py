"""Finding statements in paged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import pages
from factloom.functions.numbers import table_density
from factloom.functions.quick import quick


def into_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = 5) -> DataFrame:
    """(doc_id, page_num, text): every ``lines`` lines a page, from 1."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    n = F.ceil(F.size(parts) / lines).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, i * lines + 1, F.lit(lines)), "\n"))
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(pages).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_num"), "text")


def candidates(pages: DataFrame, titles: DataFrame, density: Column, head_chars: int = 1500, most: int = 200) -> DataFrame:
    """(doc_id, statement, page_num, score): pages whose head holds a title (pattern, strength): density, nearness of the title to the top and its strength.

    The titles, ``most`` at most, become expressions of the scan, so pages are not multiplied by them.
    """
    rows = titles.select("statement", "pattern", "strength").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} titles")
    if not rows:
        return pages.select("doc_id", F.lit("").alias("statement"), "page_num", F.lit(0).alias("score")).limit(0)
    head = F.lower(F.substring("text", 1, head_chars))
    at = lambda r: F.regexp_instr(F.col("head"), F.lit(r["pattern"]))
    found = F.array_compact(F.array(*(F.when(at(r) > 0, F.struct(F.lit(r["statement"]).alias("statement"), F.lit(r["strength"]).alias("strength"), (-at(r)).alias("p"))) for r in rows)))
    met = pages.withColumns({"head": head, "density": density}).select("doc_id", "page_num", "density", F.explode(found).alias("b"))
    best = met.groupBy("doc_id", F.col("b.statement").alias("statement"), "page_num", "density").agg(F.max(F.struct("b.strength", "b.p")).alias("b"))
    return best.select("doc_id", "statement", "page_num", (F.col("density") + F.floor(F.greatest(F.lit(0), 500 + F.col("b.p")) / 2) + F.col("b.strength") * 50).cast("int").alias("score"))


def statement_candidates(found: DataFrame, weak: bool = False, least: int = 8) -> DataFrame:
    """(doc_id, statement, page_num, score) of pages (doc_id, page_num, text) that have amounts and a valid title in their head and are no contents, audit report or notes.

    Score: density of amounts, nearness of the title to the top (up to 250) and 50 for each step of its strength.
    """
    plain = pages.page_text(F.col("text"))
    rows = found.select("doc_id", "page_num", plain.alias("plain")).withColumns({"head": F.lower(F.substring("plain", 1, pages.HEAD)), "density": table_density(F.col("plain"))})
    rows = rows.where(~pages.is_excluded(F.col("head")) & (F.col("density") >= least))
    each = F.array(*(F.struct(F.lit(k).alias("statement"), pages.best_title(F.col("head"), v).alias("t")) for k, v in pages.titles(weak).items()))
    met = rows.select("doc_id", "page_num", "density", F.explode(each).alias("x")).where("x.t is not null")
    bonus = F.floor(F.greatest(F.lit(0), pages.TITLE_ZONE - F.col("x.t.pos")) / 2)
    return met.select("doc_id", F.col("x.statement").alias("statement"), "page_num", (F.col("density") + bonus + F.col("x.t.strength") * 50).cast("int").alias("score"))


def names_index(low: Column) -> Column:
    return F.substring(low, 1, 3000).rlike(quick(pages.INDEX))


def is_audit(low: Column) -> Column:
    return F.substring(low, 1, 3500).rlike(pages.AUDIT)


def search_ranges(found: DataFrame, before: int = 2, after: int = 130, audit: int = 15, long: int = 30) -> DataFrame:
    """(doc_id, ord, kind, start, end): pages (from 1, end excluded) in which statements are looked for, in this order (ord from 0): around the first page that names an index of statements, behind audit reports, and the last third of long documents."""
    low = F.lower(pages.page_text(F.col("text")))
    rows = found.select("doc_id", "page_num", names_index(low).alias("index"), is_audit(low).alias("audit"))
    return rows.groupBy("doc_id").agg(*range_marks()).select("doc_id", F.posexplode(ranges(before, after, audit, long)).alias("ord", "r")).select("doc_id", "ord", "r.*")


def range_marks() -> list[Column]:
    """A document's pages (page_num, index, audit) as ranges() takes them."""
    return [F.max("page_num").alias("n"), F.min(F.when(F.col("index"), F.col("page_num"))).alias("anchor"), F.collect_list(F.when(F.col("audit"), F.col("page_num"))).alias("audits")]


def ranges(before: int = 2, after: int = 130, audit: int = 15, long: int = 30) -> Column:
    """The search ranges (kind, start, end) of a document's range_marks(), in order."""
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    n = F.col("n")
    return F.concat(
        F.array_compact(F.array(F.when(F.col("anchor").isNotNull(), span("index", F.greatest(F.lit(1), F.col("anchor") - before), F.least(n + 1, F.col("anchor") + after))))),
        F.transform(F.array_sort("audits"), lambda p: span("audit", p, F.least(n + 1, p + audit))),
        F.array_compact(F.array(F.when(n >= long, span("tail", F.floor(n * 2 / 3) + 1, n + 1)))),
    )


def pick_pages(found: DataFrame, share: float = 0.92, top: int = 1) -> DataFrame:
    """Of pages within ``share`` of a statement's best score the first ones."""
    per = Window.partitionBy("doc_id", "statement")
    near = found.withColumn("best", F.max("score").over(per)).where(F.col("score") >= F.col("best") * share)
    return near.withColumn("rank", F.row_number().over(per.orderBy("page_num"))).where(F.col("rank") <= top).drop("best")


def page_spans(pages: DataFrame, starts: DataFrame, stop: Column, most: int = 5) -> DataFrame:
    """Pages from each start up to the page before the next that meets stop, ``most`` at most: a range join on page numbers.

    Pages, and starts, outgrow what is estimated from the files, so no side may be broadcast.
    """
    marks = pages.where(stop).select("doc_id", F.col("page_num").alias("mark"))
    ends = starts.join(marks.hint("merge"), (starts["doc_id"] == marks["doc_id"]) & (marks["mark"] > starts["page_num"]), "left").groupBy(starts["doc_id"], starts["page_num"]).agg(F.min("mark").alias("mark"))
    ends = ends.select(F.col("doc_id").alias("d"), F.col("page_num").alias("start"), F.least(F.coalesce(F.col("mark") - 1, F.col("page_num") + most - 1), F.col("page_num") + most - 1).alias("end"))
    return pages.join(ends.hint("merge"), (F.col("doc_id") == F.col("d")) & F.col("page_num").between(F.col("start"), F.col("end"))).select("doc_id", "start", "page_num", "text")
