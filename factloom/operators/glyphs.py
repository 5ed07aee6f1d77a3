"""Words, columns and grids from positioned glyphs: gaps and islands by windows.

Glyphs: (doc_id, line, ord, x0, x1, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def words(glyphs: DataFrame, gap: float = 20.0) -> DataFrame:
    """(doc_id, line, word, x0, x1, text): a new word where the gap to the glyph before is larger."""
    order = Window.partitionBy("doc_id", "line").orderBy("x0", "ord")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(order) > gap).cast("int"), F.lit(0))
    marked = glyphs.withColumn("new", new).withColumn("word", F.sum("new").over(order))
    return marked.groupBy("doc_id", "line", "word").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))), lambda x: x["text"]), "").alias("text"))


def column_clusters(found: DataFrame, tolerance: float = 80.0) -> DataFrame:
    """(doc_id, col, center): words' left edges, split where the distance to the one before is larger."""
    order = Window.partitionBy("doc_id").orderBy("x0", "line", "word")
    new = F.coalesce((F.col("x0") - F.lag("x0").over(order) > tolerance).cast("int"), F.lit(0))
    marked = found.withColumn("new", new).withColumn("col", F.sum("new").over(order).cast("int"))
    return marked.groupBy("doc_id", "col").agg(F.avg("x0").alias("center"))


def merge_close(columns: DataFrame, width: float = 80.0) -> DataFrame:
    """Columns nearer than width to the last kept one move it to their midpoint; a fold over the few columns of a document."""
    sorted_centers = columns.groupBy("doc_id").agg(F.array_sort(F.collect_list("center")).alias("centers"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (x - last < width)
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array((last + x) / 2))).otherwise(F.array_append(acc, x))

    merged = F.aggregate("centers", F.array().cast("array<double>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))
    return sorted_centers.select("doc_id", F.posexplode(merged).alias("col", "center"))


def nearest_column(found: DataFrame, columns: DataFrame) -> DataFrame:
    """Each word with its document's nearest column (the leftmost of equals)."""
    near = found.join(columns, "doc_id").groupBy("doc_id", "line", "word", "x0", "text").agg(F.min(F.struct(F.abs(F.col("x0") - F.col("center")).alias("d"), "col")).alias("best"))
    return near.select("doc_id", "line", "word", "x0", "text", F.col("best.col").alias("col"))


def grid(assigned: DataFrame) -> DataFrame:
    """(doc_id, line, col, text): words of a cell joined in order."""
    return assigned.groupBy("doc_id", "line", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"]), " ").alias("text"))
