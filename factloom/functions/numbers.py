"""Text to numbers: native expressions for the amounts of cells and statement lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.quick import quick

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(text: Column, junk: str = r"[,\s¥$€£]|CHF") -> Column:
    """A double, negative in parentheses; blanks, dashes and all else that is no number are null."""
    # one chain that names the text once, so that plans which inline it stay small
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), junk, ""), "−", "-")
    signed = F.regexp_replace(F.regexp_replace(clean, r"^\((.*)\)$", "-$1"), "^--", "")
    return F.regexp_extract(signed, NUMERIC, 0).try_cast("double")


#: A whole number without marks, and all characters that a text of to_number() may have (the last three, as $ takes them for a line's end).
WHOLE, MAYBE = r"^[0-9]+\z", r"^[0-9.,\s¥$€£CHF−()eE+\u0085\u2028\u2029-]*\z"


def plain_or(rule: Callable[[Column], Column], text: Column) -> Column:
    """rule(text), but whole numbers without marks stay as they are."""
    return F.when(text.rlike(WHOLE), text).otherwise(rule(text))


def cell_number(text: Column) -> Column:
    """to_number() with its default marks, for cells, most of which are whole numbers or words: it names the text three times, so give it a column."""
    return F.when(text.rlike(WHOLE), text.try_cast("double")).when(text.rlike(MAYBE), to_number(text))


def clean_cell(text: Column) -> Column:
    """A cell's text for comparison: no thousands marks, spaces or currency; null is empty."""
    return F.coalesce(F.translate(F.trim(text), "−, \t\n\x0b\f\r¥$", "-"), F.lit(""))


def grid_cell(text: Column) -> Column:
    """A cell as grids are compared: lower case, no space or money marks, no zero decimals."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[\s,¥$%]", ""), r"\.0+$", ""), F.lit(""))


def plain_header(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)\s+", "")


#: Characters of a page's head, and what names the unit of its amounts there.
UNIT_HEAD, IN_MILLIONS, IN_THOUSANDS = 2500, r"\bin\s+millions\b", r"in\s+thousands"
SHARES_IN_THOUSANDS = r"shares?.{0,40}(?:are\s+)?(?:reflected\s+|denominated\s+)?in\s+thousands|except\s+(?:number\s+of\s+)?shares?.{0,30}thousands"


def unit_divisor(page_text: Column) -> Column:
    """1000 for statements whose head (2,500 characters) says thousands, else 1: also where it says millions as well, or thousands of shares in the same breath."""
    head = F.lower(F.substring(page_text, 1, UNIT_HEAD))
    return F.when(head.rlike(IN_THOUSANDS) & ~head.rlike(IN_MILLIONS) & ~head.rlike(SHARES_IN_THOUSANDS), 1000.0).otherwise(1.0)


#: Fixed value: the five shapes of an amount in a line, in the order in which they are tried.
AMOUNT = r"\$\s*\(?[\d,]+(?:\.\d+)?\)?|\([\d,]+(?:\.\d+)?\)|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\b\d{4,7}\b|\b\d{2,3}\b"


def line_amounts(text: Column, divisor: Column | float = 1.0) -> Column:
    """All accepted amounts of a statement line in order, divided by its unit.

    Years (1990 to 2035 without a comma or point) are no amounts; money marks, parentheses and
    commas ask for 100 or more, bare numbers of two or three digits for 50 to 999, others for 1000.
    """
    unit = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(0))

    def judged(token: Column) -> Column:
        digits = F.regexp_replace(token, r"[^\d.]", "")
        value = F.when(digits.rlike(NUMERIC), digits.try_cast("double"))
        marked = token.rlike(r"[$(,]")
        year = ~token.rlike(r"[,.$(]") & value.between(1990, 2035)
        bare = ~marked & (F.length(digits) <= 3)
        good = F.when(year, False).when(marked, value.between(100, 999_999_999_999)).when(bare, value.between(50, 999)).otherwise(value >= 1000)
        return F.when(good, F.when(token.contains("("), -value).otherwise(value) / unit)

    return F.array_compact(F.transform(tokens, judged))


def per_share_amounts(text: Column) -> Column:
    """Amounts with decimals only."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(?\$?\s*\d+\.\d+\)?"), F.lit(0))
    return F.array_compact(F.transform(tokens, lambda t: to_number(t)))


def amount_pair(text: Column) -> Column:
    """A cell with two periods' amounts as an array of two texts: ``$ a $ b``, ``$ a b``, ``(a) (b)`` or ``a b``; else empty."""
    number = r"[\d,]+(?:\.\d+)?"
    shapes = (rf"^\$\s*({number})\s*\$\s*({number})$", rf"^\$\s*({number})\s+({number})$", rf"^(\({number}\))\s*(\({number}\))$", rf"^({number})\s+({number})$")
    out = F.array().cast("array<string>")
    for shape in reversed(shapes):
        pair = F.array(F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2))
        out = F.when(text.rlike(shape), pair).otherwise(out)
    return out


def table_density(text: Column) -> Column:
    """How table-like a page is: twice its comma numbers, its money marks, its parenthesised numbers and up to 12 plain ones."""
    count = lambda p: F.regexp_count(text, F.lit(quick(p)))
    plain = F.least(count(r"(?<![\d.])\d{4,7}(?!\d)"), F.lit(12))
    return 2 * count(r"\b\d{1,3}(?:,\d{3})+\b") + count(r"\$\s*[\d,]+") + count(r"\(\s*[\d,]+\s*\)") + plain


def display_number(value: Column, per_share: Column) -> Column:
    """As a document prints it: thousands marks, parentheses for negatives, cents per share only."""
    body = F.when(per_share, F.format_number(F.abs(value), 2)).otherwise(F.format_number(F.abs(value), 0))
    return F.when(value < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)


def smart_value(text: Column) -> Column:
    """(kind, text, number): number if the text is digits with thousands marks and decimals, else text; a minus keeps it text."""
    shaped = F.trim(text).rlike(r"^[$¥]?\s*\(?\d[\d,]*(?:\.\d+)?\)?%?$")
    return F.struct(F.when(shaped, "number").otherwise("text").alias("kind"), text.alias("text"), F.when(shaped, to_number(F.regexp_replace(text, "%", ""))).alias("number"))


#: Thousands set apart by a space, and the numbers of a cell that holds several.
SPACED = r"\(?\s*-?\d{1,3}(?:[ \u00a0\u202f\u2009]\d{3})+(?:\.\d+)?\s*\)?"
NUMBERS = r"\(\s*-?[\d,]+(?:\.\d+)?\s*\)|-?[\d,]+(?:\.\d+)?"
#: What a cell without amount_tokens() lacks (a comma, a parenthesis or four digits), and what it has where and only where SPACED is found in it.
SOME_AMOUNT, HAS_SPACED = r"[,(]|[0-9](?:[^0-9]*+[0-9]){3}", r"\d[ \u00a0\u202f\u2009]\d{3}"


def has_digit(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\d")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d]", "")


def looks_like_amount(text: Column) -> Column:
    """Whether a cell is an amount rather than a label or a note's number such as 2(z)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.rlike(f"^(?:{SPACED})$") | t.rlike(r"\d{1,3}(?:,\d{3})+") | (t.rlike(r"\d") & t.rlike(r"^[()$\s-]*[\d,]+(?:\.\d+)?[()$\s-]*$"))


def amount_tokens(text: Column) -> Column:
    """The amounts that a packed cell holds: those with spaced thousands if there are any, else numbers of four digits, with a comma or in parentheses."""
    t = F.coalesce(text, F.lit(""))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    # what has neither comma nor parenthesis is digits with a sign and a point at most
    plain = F.filter(found(NUMBERS), lambda x: x.contains(",") | x.contains("(") | (F.length(F.translate(x, "-.", "")) >= 4))
    return F.when(~t.rlike(SOME_AMOUNT), F.array().cast("array<string>")).when(t.rlike(HAS_SPACED), F.transform(found(SPACED), lambda x: F.trim(x))).otherwise(plain)


def split_values(texts: Column) -> Column:
    """A row's value cells with those that hold several numbers split up."""
    one = lambda t: F.when(F.trim(t).rlike(f"^(?:{SPACED})$"), F.array(t)).otherwise(_several(t))
    return F.flatten(F.transform(texts, one))


def _several(text: Column) -> Column:
    spaced = F.regexp_extract_all(text, F.lit(SPACED), F.lit(0))
    found = F.filter(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)), lambda x: x.rlike(r"\d"))
    return F.when(F.size(spaced) > 1, F.transform(spaced, lambda x: F.trim(x))).when(F.size(found) > 1, F.transform(found, lambda x: F.trim(x))).otherwise(F.array(text))


def display_amount(text: Column) -> Column:
    """The first number of a printed cell at any size; negative in parentheses."""
    inner = F.regexp_extract(text, r"\(\s*([\d,]+(?:\.\d+)?)\s*\)", 1)
    plain = F.regexp_extract(F.trim(F.regexp_replace(text, r"[$,]", "")), r"-?\d+(?:\.\d+)?", 0)
    return F.when(inner != "", -F.replace(inner, F.lit(","), F.lit("")).try_cast("double")).otherwise(plain.try_cast("double"))


def spaced_density(text: Column) -> Column:
    """table_density() for statements that set thousands apart by spaces."""
    return table_density(text) + 2 * F.regexp_count(text, F.lit(quick(r"\b\d{1,3}(?: \d{3})+\b")))


def adjacent_repeats(digits: Column) -> Column:
    """How many characters equal the one behind them."""
    same = lambda i: (F.substring(digits, i, F.lit(1)) == F.substring(digits, i + 1, F.lit(1))) & (F.substring(digits, i + 1, F.lit(1)) != "")
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), same))
