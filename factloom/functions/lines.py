"""Cutting statement lines to the part that is about one field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.labels import repair_stutter
from factloom.functions.numbers import AMOUNT, adjacent_repeats, digits_of


def label_before_amounts(chunk: Column) -> Column:
    """Text before the first amount, else the first 50 characters."""
    at = F.regexp_instr(chunk, F.lit(AMOUNT))
    return F.when(at > 0, F.substring(chunk, F.lit(1), at - 1)).otherwise(F.substring(chunk, 1, 50))


def before_liabilities(chunk: Column) -> Column:
    """Cut before the heading Liabilities where it first stands behind character 20; ``Total liabilities`` and ``liabilities and`` are no headings."""
    at = F.regexp_instr(chunk, F.lit(r"(?i)(?<!total\s)\s+Liabilities\b(?!\s+and\b)"))
    return F.when(at > 21, F.substring(chunk, F.lit(1), at - 1)).otherwise(chunk)


def basic_part(chunk: Column) -> Column:
    """A per-share line up to ``diluted``, unless it reads ``basic and diluted``; a dash before it goes too."""
    at = F.regexp_instr(F.lower(chunk), F.lit(r"(?<!basic and )(?<!, )\bdiluted\b"))
    return F.when(at > 1, F.regexp_replace(F.substring(chunk, F.lit(1), at - 1), r"[\s—–-]+$", "")).otherwise(chunk)


#: What may stand before a per-share line's numbers, in the order in which it goes.
FOOTNOTES = (r"(?i)^\([^)]*(?:rmb|yuan|us\$|hkd|share|million)[^)]*\)\s*", r"^[\s–\-—:]+", r"(?i)^(\d{1,3}[()a-z]*)(?!\.\d)\s*", r"(?i)^(?:us\$?|rmb|hkd|hk\$)\s*")


def without_footnote(text: Column) -> Column:
    """Without a leading currency note, dash, note number and currency token."""
    out = F.trim(text)
    for pattern in FOOTNOTES:
        out = F.regexp_replace(out, pattern, "")
    return out


def cell_amount(text: Column, per_share: bool = False) -> Column:
    """A statement cell's amount: negative in parentheses at any size; per share only with decimals; else the first number if it is 1,000 or more. Braces count as parentheses, I and l in them as 1."""
    raw = F.translate(repair_stutter(F.trim(text)), "{}", "()")
    inside = F.regexp_extract(raw, r"\(\s*([^)]+)\)", 1)
    fixed = F.regexp_replace(F.translate(inside, "Il", "11"), r"[\s,]", "")
    inner = F.when(fixed.rlike(r"^\d+$"), fixed).otherwise(F.regexp_extract(raw, r"\(\s*([\d,]+(?:\.\d+)?)\s*\)", 1))
    number = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double")
    negative = F.when(inner != "", -number(doubled_digits(inner)))
    plain = doubled_digits(raw)
    if per_share:
        value = number(F.regexp_extract(plain, r"\$?\s*-?([\d,]+\.\d+)", 1))
        return F.coalesce(negative, F.when(plain.rlike(r"^-|^\(-|\$ -"), -value).otherwise(value))
    value = F.regexp_extract(F.regexp_replace(plain, r"[$,]", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.coalesce(negative, F.when(F.abs(value) >= 1000, value))


def doubled_digits(text: Column) -> Column:
    """A number of eight or more digits of which at least 35 % repeat the one before: one of each pair goes. Else the text without stutter and without spaces between digits."""
    clean = F.regexp_replace(repair_stutter(F.trim(text)), r"(?<=\d)[ \u00a0\u202f\u2009]+(?=\d)", "")
    digits = digits_of(clean)
    return F.when((F.length(digits) >= 8) & (adjacent_repeats(digits) >= F.length(digits) * 0.35), F.regexp_replace(digits, r"([0-9])\1", "$1")).otherwise(clean)
