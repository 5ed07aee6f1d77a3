"""Benchmark decontamination by template windows, in native expressions only.

Numbers, names (capitalised words) and units behind numbers become typed placeholders, all else
lower-case words. A capitalised word that opens a sentence may be a name or not, so texts are read
in two ways: such openers as plain words, and as names. Windows of ``window`` template tokens are hashed from
hashes of four tokens. A bit array of the benchmark's window hashes, tested in
the scan, lets only documents with a possible hit go on; these are hash-joined window by window.
A matching window counts if its slots are consistent: equal values of the item stand for equal
values of the document and the other way round, so a question with other numbers or names is
caught, and a text that only has the same shape is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BitArray, cut, let

#: Marks of the slot types; they sort below every letter.
NUMBER, NAME, UNIT, OPENER = "\x01", "\x02", "\x03", "\x04"
#: The two ways to read an opener: as a name?
READINGS = (False, True)
#: Units that are slots when they follow a number.
UNITS = (
    "mm cm dm km m kg mg g t lb lbs oz ml cl dl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mile miles inch inches foot feet yard yards meter meters metre metres gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents "
    "percent degree degrees watt watts volt volts mph kmh hz khz mhz ghz kb mb gb tb"
).split()
_NAME = r"(?<=[\p{L}\p{M}\p{N},;]\s)\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_OPENER = rf"(?<![\p{{L}}\p{{M}}{NAME}])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}]*"
_UNIT = rf"(?i)(?<=[0-9]\s?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
_TOKEN = rf"[{NAME}{OPENER}]?[\p{{L}}\p{{M}}]+|{UNIT}[\p{{L}}]+|[0-9]+(?:[.,][0-9]+)*"


def tokens(text: Column) -> Column:
    """Words in lower case; names, openers and units behind their marks; numbers. Null gives null."""
    text = text.cast("string")
    marked = F.regexp_replace(text, F.lit(_NAME), F.lit(f"{NAME}$0"))
    marked = F.regexp_replace(marked, F.lit(_OPENER), F.lit(f"{OPENER}$0"))
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(marked, F.lit(_UNIT), F.lit(f"{UNIT}$0"))).otherwise(marked)
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def _template(token: Column, named: bool) -> Column:
    opener = F.lit(NAME) if named else F.substring(token, 2, 1 << 30)
    return F.when(token >= "A", token).when(token < NAME + "￿", F.lit(NAME)).when(token < UNIT + "￿", F.lit(UNIT)).when(token < OPENER + "￿", opener).otherwise(F.lit(NUMBER))


def _is_slot(token: Column, named: bool) -> Column:
    return token < "A" if named else (token < OPENER) | token.between("0", "A")


def gram_hashes(found: Column, step: int, named: bool) -> Column:
    """Hash of the step template tokens from each token on, as far as there are."""

    def of(single: Column) -> Column:
        n = F.size(single) - step + 1
        return F.when(n > 0, F.transform(F.slice(single, F.lit(1), n), lambda x, i: F.xxhash64(x, *(F.get(single, i + k) for k in range(1, step))))).otherwise(F.array().cast("array<bigint>"))

    return F.when(found.isNotNull(), let(F.transform(found, lambda t: F.xxhash64(_template(t, named))), of))


def window_hashes(grams: Column, step: int, window: int) -> Column:
    """Hash of the window from each token on, as far as there is one, from the grams that cover it (the last two may overlap)."""
    n = F.size(grams) + step - window
    places = sorted({*range(0, window - step, step), window - step})
    return F.when(n > 0, F.transform(F.slice(grams, F.lit(1), n), lambda x, i: F.xxhash64(x, *(F.get(grams, i + k) for k in places[1:])))).otherwise(F.array().cast("array<bigint>"))


def _lengths(items: DataFrame, window: int, least: int) -> list[int]:
    """The window, and the lengths of the items that are shorter (least tokens or more)."""
    short = items.where(F.size("tokens").between(least, window - 1)).select(F.size("tokens").alias("n")).distinct()
    return [window, *sorted(r["n"] for r in short.collect())]


def _slots(tokens: Column, at: Column, length: int, named: bool) -> Column:
    """The values of a window's slots in order; openers that are names look like other names."""
    return F.transform(F.filter(F.slice(tokens, at + 1, F.lit(length)), lambda t: _is_slot(t, named)), lambda t: F.translate(t, OPENER, NAME))


def _exact(tokens: Column, shape: Column, at: Column, length: int, named: bool) -> Column:
    """A window's hash: of its template (shape) if half of its tokens are literal words, else of its slots' values too."""
    return let(_slots(tokens, at, length, named), lambda s: F.when(F.size(s) * 2 > length, F.xxhash64(shape, s)).otherwise(shape))


def _described(tokens: Column, grams: Column, step: int, length: int, named: bool, bits: BitArray | None, words: Column | None) -> Column:
    """length, named, at, shape, hash, slots of each window (with bits only of those they hold), as an array."""

    def of(hashes: Column) -> Column:
        exact = lambda i: _exact(tokens, F.get(hashes, i), i, length, named)
        places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
        if words is not None:
            places = F.filter(places, lambda i: bits.holds(words, F.get(hashes, i)) & bits.holds(words, exact(i)))
        return F.transform(places, lambda i: F.struct(F.lit(length).alias("length"), F.lit(named).alias("named"), i.alias("at"), F.get(hashes, i).alias("shape"), exact(i).alias("hash"), _slots(tokens, i, length, named).alias("slots")))

    return let(window_hashes(grams, step, length), of)


def _step(lengths: list[int]) -> int:
    return min(4, *lengths)


def _windows(rows: DataFrame, keys: list[str], lengths: list[int], only: dict[int, Column], bits: BitArray | None = None) -> DataFrame:
    """keys, length, named, at, shape, hash, slots: a row for each window in each reading, which carries nothing of the text but these.

    only: which rows have windows of a length (else all). rows must be materialised: what
    their tokens come from would be computed for every window. The generator is an outer one, as
    Spark tests the arrays of others beforehand and so computes them twice.
    """
    step = _step(lengths)

    def reading(words: Column | None, named: bool) -> Column:
        def of(grams: Column) -> Column:
            parts = []
            for n in lengths:
                part = _described(F.col("tokens"), grams, step, n, named, bits, words)
                parts.append(F.when(only[n], part).otherwise(F.filter(part, lambda _: F.lit(False))) if n in only else part)
            return F.concat(*parts)

        return let(gram_hashes(F.col("tokens"), step, named), of)

    each = lambda words: F.concat(*(reading(words, named) for named in READINGS))
    found = let(bits.literal(), each) if bits is not None and bits.fits else each(None)
    return rows.select(*keys, F.explode_outer(found).alias("w")).where("w is not null").select(*keys, "w.*")


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str, window: int, least: int, max_bits: int) -> tuple[DataFrame, DataFrame, list[int], BitArray]:
    """(docs with _hit: may the row share a window; the items' windows; window lengths; the items' bit array)."""
    items = cut(benchmark.select("item", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= least))
    lengths = _lengths(items, window, least)
    known = cut(_windows(items, ["item"], lengths, {n: F.size("tokens") == n for n in lengths[1:]}))
    bits = BitArray(known.select(F.explode(F.array("shape", "hash")).alias("hash")).distinct(), max_bits)
    found = tokens(F.col(f"`{text}`"))

    step = _step(lengths)
    either = lambda parts: reduce(lambda a, b: a | b, parts)

    def any_held(t: Column, w: Column, g: Column, n: int, named: bool) -> Column:
        return F.exists(window_hashes(g, step, n), lambda h: bits.holds(w, h)) & (F.size(F.filter(window_hashes(g, step, n), lambda h, i: bits.holds(w, h) & bits.holds(w, _exact(t, h, i, n, named)))) > 0)

    def held(t: Column, w: Column) -> Column:
        read = lambda named: let(gram_hashes(t, step, named), lambda g: either(any_held(t, w, g, n, named) for n in lengths))
        return either(map(read, READINGS))

    if bits.fits:
        hit = let(bits.literal(), lambda w: let(found, lambda t: held(t, w)))
    else:  # too large a benchmark to test in the scan: every row goes to the join
        hit = F.lit(True)
    return docs.withColumn("_hit", F.coalesce(hit, F.lit(False))), known, lengths, bits


def matches(rows: DataFrame, known: DataFrame, lengths: list[int], bits: BitArray, text: str, max_broadcast: int = 64 << 20) -> DataFrame:
    """row, item, n_windows (distinct windows of the item that the row has with consistent slots), n_changed (of those with other values).

    The items' windows are broadcast if they take at most max_broadcast bytes, else both sides are shuffled by hash.
    """
    found = cut(rows.select("_row", tokens(F.col(f"`{text}`")).alias("tokens")))
    windows = _windows(found, ["_row"], lengths, {}, bits)
    theirs = known.select("item", F.col("length").alias("n"), F.col("named").alias("item_named"), F.col("at").alias("item_at"), F.col("hash").alias("h"), F.col("slots").alias("item_slots"))
    size = known.agg(F.sum(100 + 8 * F.size("slots") + F.aggregate("slots", F.lit(0), lambda n, s: n + F.octet_length(s)))).first()[0]
    if (size or 0) <= max_broadcast:
        theirs = F.broadcast(theirs)
    met = windows.join(theirs, (F.col("hash") == F.col("h")) & (F.col("length") == F.col("n")))
    distinct = lambda c: F.size(F.array_distinct(c))

    def bijective(pairs: Column) -> Column:
        return (distinct(pairs) == distinct(F.transform(pairs, lambda x: x["slots"]))) & (distinct(pairs) == distinct(F.transform(pairs, lambda x: x["item_slots"])))

    met = met.where(F.size("slots") == F.size("item_slots")).withColumn("pairs", F.arrays_zip("slots", "item_slots")).where(bijective(F.col("pairs")))
    met = met.withColumn("changed", (F.col("slots") != F.col("item_slots")).cast("int"))
    # values must agree along the whole passage too, in the readings that met; windows with the item's own values count in any case
    along = met.groupBy("_row", "item", "named", "item_named", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("all"), F.collect_set(F.struct("item_at", "changed")).alias("spots"))
    spots = along.select("_row", "item", F.explode(F.when(bijective(F.col("all")), F.col("spots")).otherwise(F.filter("spots", lambda x: x["changed"] == 0))).alias("x"))
    spots = spots.groupBy("_row", "item", "x.item_at").agg(F.min("x.changed").alias("changed"))
    return spots.groupBy("_row", "item").agg(F.count("*").alias("n_windows"), F.sum("changed").alias("n_changed"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, least: int = 6, max_bits: int = 1 << 25) -> DataFrame:
    """doc key, item key, n_windows, n_changed: every document that shares a consistent template window with an item.

    Items of fewer than window template tokens are matched whole, those of fewer than least never
    (they are common phrases); windows of which more than half are slots count with the item's own
    values only. Null texts
    have no tokens. Repeated rows give a row each; an empty table gives none. A text of any length is
    read whole by one task, which holds its tokens and window hashes (some 30 bytes for each token).
    """
    marked, known, lengths, bits = with_hits(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")), benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")), "text", window, least, max_bits)
    rows = cut(marked.where("_hit").drop("_hit").withColumn("_row", F.monotonically_increasing_id()))
    found = matches(rows, known, lengths, bits, "text").join(rows.select("_row", "_key"), "_row")
    return found.select(F.col("_key").alias(key), F.col("item").alias(item), "n_windows", "n_changed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, least: int = 6, max_bits: int = 1 << 25) -> DataFrame:
    """docs without the rows that find_leaks() would name; only rows with a possible hit are joined. Columns keep their names.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty; long texts are read as in find_leaks().
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    body = names[[c.lower() for c in docs.columns].index(text.lower())]
    marked, known, lengths, bits = with_hits(docs.toDF(*names), benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")), body, window, least, max_bits)
    marked = cut(marked)
    rows = cut(marked.where("_hit").drop("_hit").withColumn("_row", F.monotonically_increasing_id()))
    leaks = matches(rows, known, lengths, bits, body).select("_row").distinct()
    return marked.where("not _hit").drop("_hit").unionByName(rows.join(leaks, "_row", "left_anti").drop("_row")).toDF(*docs.columns)
