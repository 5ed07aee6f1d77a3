"""Helpers that the training-data operators share: reading tables, the shared folder, cutting lineage, bit filters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bits of the filter that keeps documents which no later step needs out of a shuffle: 32 MB at most. Beyond
#: some ten million keys it lets more and more rows pass, which then are shuffled; results stay whole.
MAX_FILTER_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on this machine alone (master local) gets a temporary folder; on a
    cluster that is an error, as no other machine would see its files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path() named."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, base: str) -> str:
    """base, with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files: reliable if executors are lost."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    trim_driver(df.sparkSession)
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about limit bytes of a text or binary column, or one longer value."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bytes of an Arrow batch on its way to Python; Spark's own limit of 64 MB would be held several times over by each task.
ARROW_BYTES = 4 << 20


def give_back() -> None:
    """Free what allocators keep: Python workers outlive their tasks, and later stages need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM: long plans leave it hundreds of MB of freed native memory beside its heap. Nothing where the JVM can't."""
    jvm = spark._jvm
    with contextlib.suppress(Exception):
        # the server's own class is hidden from Py4J, its interface isn't
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes (a longer row is one batch), and memory given back after each task.

    Lowers spark.sql.execution.arrow.maxBytesPerBatch of the session to ARROW_BYTES if it is larger.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.match(r"-?\d+", conf.get(name)).group()) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def batch_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column in UTF-8; null is empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


#: A-Z to a-z, for bytes.translate.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def word_pieces(text: bytes, word: re.Pattern, border: re.Pattern, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's words, those of about size bytes at a time; border matches a byte that is part of no word."""
    at = 0
    while at < len(text):
        stop = border.search(text, at + size)
        end = stop.start() if stop else len(text)
        yield word.findall(text, at, end)
        at = end


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of the keys as 64-bit words; its size follows their number up to MAX_FILTER_BITS."""
    n = keys.count()
    bits = min(MAX_FILTER_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    word, bit = F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["w"].to_numpy()] = found["v"].to_numpy(np.int64).view(np.uint64)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(words: list[int] | tuple[int, ...]) -> Column:
    """An array<bigint> that the optimizer folds to one literal; a plan should hold it once, behind let()."""
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def bit_of(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


def gathered_words(spots: DataFrame, bits: int) -> list[int]:
    """Column p of set positions -> the bit array's 64-bit words; only they reach the driver."""
    words = [0] * (bits // 64)
    for row in spots.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(bit_of(F.col("p"))).alias("v")).collect():
        words[row["w"]] = row["v"]
    return words


class BitArray:
    """A Bloom filter of hashes for native plans, tested without a join: four bits for each, among 64 bits a hash, or among fewer (16 at least) where max_bits asks for it."""

    def __init__(self, hashes: DataFrame, max_bits: int):
        n = max(1, hashes.count())
        self.bits = min(max(1 << 14, 1 << math.ceil(math.log2(n * 64))), max_bits)
        self.fits = n * 16 <= self.bits
        self.words = gathered_words(hashes.select(F.explode(F.array(*self._spots(F.col("hash")))).alias("p")), self.bits) if self.fits else []

    def _spots(self, h: Column) -> list[Column]:
        mask = F.lit(self.bits - 1).cast("bigint")
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(h, 32)
        return [(low + high * i if i else low).bitwiseAND(mask) for i in range(4)]

    def literal(self) -> Column:
        return constant(self.words)

    def holds(self, words: Column, h: Column) -> Column:
        tests = [F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(bit_of(p)) != 0 for p in self._spots(h)]
        return reduce(lambda a, b: a & b, tests)
