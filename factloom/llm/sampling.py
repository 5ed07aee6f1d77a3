"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut


def held_out(key) -> F.Column:
    """Whether crc32 of the key as text leaves 2 modulo 4; null keys aren't held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_chars: int, key: str = "doc_id", text: str = "text", max_bytes: int = 64 << 20) -> list[tuple[bytes, int]]:
    """(text, label) of at most max_docs labelled rows that aren't held out, in an order fixed by the key's hash, as long as the texts together take no more than max_bytes.

    Texts beyond max_chars and rows with a null key or label are left out of fitting; a key with
    several labels takes the smallest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    chosen = cut(known.orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(max_docs))
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")).where(F.length("_text") <= max_chars)
    # at most max_docs rows are broadcast, and as many stay
    order = [F.xxhash64("_id", F.lit(17)), F.col("_id"), F.col("_text")]
    rows = cut(texts.join(F.broadcast(chosen), "_id").orderBy(*order).limit(max_docs))
    sizes = [r["n"] for r in rows.orderBy(*order).select(F.octet_length("_text").alias("n")).collect()]
    fits, total = 0, 0
    while fits < len(sizes) and total + sizes[fits] <= max_bytes:
        total, fits = total + sizes[fits], fits + 1
    return [(r["_text"].encode(), r["_label"]) for r in rows.orderBy(*order).limit(fits).collect()]
