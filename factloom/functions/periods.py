"""Reporting periods: dates in text, fiscal ends and their arithmetic. ISO strings throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.settings import FISCAL_ENDS, OPENING_DAYS

#: Month names by number, and how headers print them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: Dates in headers, and which groups hold year, month and day.
MONTH_FIRST = (rf"(?i){MONTH}\s+(\d{{1,2}}),?\s+(20\d{{2}})", (3, 1, 2))
MONTH_FIRST_LOOSE = (rf"(?i){MONTH}\s+(\d{{1,2}}),?\s*(?:\n\s*)?(20\d{{2}})", (3, 1, 2))
CHINESE_ENDED = (r"截至\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", (1, 2, 3))
CHINESE = (r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", (1, 2, 3))
DAY_FIRST = (rf"(?i)(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(20\d{{2}})", (3, 2, 1))
YEAR_ENDED = rf"(?i)Year Ended[\s\S]{{0,80}}{MONTH}\s+(\d{{1,2}}),?"
MONTH_DAY = rf"(?i){MONTH}\s+(\d{{1,2}}),"
YEAR = r"\b(20\d{2})\b"
PERIOD = "struct<period_end:string,label:string,year:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd with the day cut to the month's end; months outside 1 to 12 are null."""

    def in_month(x: Column) -> Column:
        first = F.when(x["m"].between(1, 12) & x["y"].between(1, 9999), F.make_date(x["y"].cast("int"), F.when(x["m"].between(1, 12), x["m"]).otherwise(1).cast("int"), F.lit(1)))
        return let(first, lambda f: F.date_format(F.date_add(f, F.least(x["d"].cast("int"), F.dayofmonth(F.last_day(f))) - 1), "yyyy-MM-dd"))

    # inside of other lambdas nothing is computed once by itself
    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), in_month)


def month_number(name: Column) -> Column:
    """Of a month's name, short or long, or of its number in digits."""
    at = lambda n: F.call_function("instr", F.lit("".join(m[:3] for m in MONTHS)), F.lower(F.substring(n, 1, 3)))
    return let(name, lambda n: F.when(n.rlike("^[0-9]+$"), n.cast("int")).when(F.length(n) >= 3, let(at(n), lambda i: F.when(i % 3 == 1, ((i + 2) / 3).cast("int")))))


def _ends(periods: Column) -> Column:
    return F.transform(periods, lambda x: x["period_end"])


def _first_of_each(periods: Column) -> Column:
    """Without periods whose end came before."""
    return let(periods, lambda own: F.filter(own, lambda x, i: F.array_position(_ends(own), x["period_end"]) == i + 1))


def _dated(head: Column, shape: tuple) -> Column:
    pattern, (y, m, d) = shape
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    dated = lambda x, year: F.struct(iso_date(year, month_number(part(x, m)), part(x, d).cast("int")).alias("period_end"), F.trim(x).alias("label"), year.alias("year"))
    one = lambda x: let(part(x, y).cast("int"), lambda year: dated(x, year))
    found = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), one)
    return _first_of_each(F.filter(found, lambda x: x["period_end"].isNotNull()))


def year_columns(head: Column) -> Column:
    """Periods of a header that names one day and then two or more years: ``Year Ended December 31, | 2024 | 2023``."""
    ended = F.regexp_extract(head, YEAR_ENDED, 0)
    found = F.struct(F.when(ended != "", ended).otherwise(F.regexp_extract(head, MONTH_DAY, 0)).alias("text"), F.when(ended != "", F.regexp_instr(head, F.lit(YEAR_ENDED))).otherwise(F.regexp_instr(head, F.lit(MONTH_DAY))).alias("at"))

    def block(a: Column) -> Column:
        tail = F.substring(head, a["at"] + F.length(a["text"]), F.lit(400))
        part = lambda i: F.regexp_extract(a["text"], rf"(?i){MONTH}\s+(\d{{1,2}}),?$", i)
        one = lambda y: F.struct(iso_date(y.cast("int"), month_number(part(1)), part(2).cast("int")).alias("period_end"), F.concat(part(1), F.lit(" "), part(2), F.lit(", "), y).alias("label"), y.cast("int").alias("year"))
        years = F.array_distinct(F.regexp_extract_all(tail, F.lit(YEAR), F.lit(1)))
        return let(years, lambda y: F.when((a["at"] > 0) & (F.size(y) >= 2), F.transform(y, one)).otherwise(F.array().cast(f"array<{PERIOD}>")))

    return let(found, block)


def _reporting(periods: Column) -> Column:
    """reporting_periods() of periods with labels; fewer than two stay."""
    return let(F.struct(periods.alias("own"), reporting_periods(_ends(periods)).alias("keep")), lambda x: F.filter(x["own"], lambda p: F.array_contains(x["keep"], p["period_end"])))


def statement_periods(text: Column, most: int = 5) -> Column:
    """Reporting periods of a statement page's header in column order, at most ``most``: array of (period_end, label, year).

    Ways to read them are tried in order, and the first that gives two reporting periods wins: full dates with the
    month first, such dates over a line break, Chinese dates, dates with the day first. A column block (one
    day, several years) that reaches a later year wins over each; it and then bare years of the first
    1,000 characters, as 31 December, are what is left.
    """
    latest = lambda a: F.array_max(F.transform(a, lambda x: x["year"]))
    bare = lambda y: F.struct(F.concat(y, F.lit("-12-31")).alias("period_end"), y.alias("label"), y.cast("int").alias("year"))

    def read(head: Column) -> Column:
        chinese = F.when(head.rlike(CHINESE_ENDED[0]), _dated(head, CHINESE_ENDED)).otherwise(_dated(head, CHINESE))
        years = F.transform(F.array_distinct(F.regexp_extract_all(F.substring(head, 1, 1000), F.lit(YEAR), F.lit(1))), bare)
        ways = (_dated(head, MONTH_FIRST), _dated(head, MONTH_FIRST_LOOSE), chinese, _dated(head, DAY_FIRST))
        # coalesce stops at the first way that is good; the others are not read
        found = F.coalesce(*(let(_reporting(w), lambda r: F.when(F.size(r) >= 2, r)) for w in ways))
        return F.struct(found.alias("found"), _reporting(year_columns(head)).alias("block"), years.alias("years"))

    def chosen(x: Column) -> Column:
        block = F.size(x["block"]) > 0
        return F.when(x["found"].isNotNull() & ~(block & (latest(x["block"]) > latest(x["found"]))), x["found"]).when(block, x["block"]).otherwise(x["years"])

    return F.slice(let(let(F.substring(F.coalesce(text, F.lit("")), 1, 3000), read), chosen), 1, most)


def dates_in(text: Column) -> Column:
    """Ends of statement_periods()."""
    return F.transform(statement_periods(text), lambda x: x["period_end"])


def balance_periods(balance: Column, income: Column, most: int = 5) -> Column:
    """A balance sheet's periods, or the income statement's where its header has an opening day or fewer than two ends."""

    def chosen(x: Column) -> Column:
        own, other = x["balance"], x["income"]
        closing = F.filter(own, lambda p: ~is_opening(p["period_end"]))
        opening = F.exists(own, lambda p: is_opening(p["period_end"]))
        some = F.size(other) > 0
        return F.when(some & (opening | (F.size(own) < 2)), other).when(F.size(closing) >= 2, closing).when(some, other).otherwise(own)

    return F.slice(let(F.struct(balance.alias("balance"), income.alias("income")), chosen), 1, most)


def period_of_header(header: Column, calendar: Column, page: Column) -> Column:
    """The period end that a column header stands for, or null: its full date, else the one year that it names, by calendar (map of year to end), by the page's periods, or 31 December."""
    text = F.trim(F.coalesce(header, F.lit("")))
    pattern, (y, m, d) = (r"(?i)" + MONTH + r"\s+(\d{1,2}),?\s+(20\d{2})", (3, 1, 2))
    part = lambda i: F.regexp_extract(text, pattern, i)
    years = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))
    year = F.get(years, F.lit(0))
    own = F.get(F.filter(page, lambda x: x["year"] == year.cast("int")), F.lit(0))["period_end"]
    by_year = F.coalesce(F.try_element_at(calendar, year.cast("int")), own, F.concat(year, F.lit("-12-31")))
    return F.when(text.rlike(pattern), iso_date(part(y).cast("int"), month_number(part(m)), part(d).cast("int"))).when(F.size(years) == 1, by_year)


def ends_of_years(page: Column, years: Column) -> Column:
    """For each year the page's period end of that year (the last that it names), else 31 December."""
    own = lambda y: F.element_at(F.concat(F.array(F.concat(y.cast("string"), F.lit("-12-31"))), F.transform(F.filter(page, lambda x: x["year"] == y), lambda x: x["period_end"])), -1)
    return F.transform(years, own)


def is_opening(period: Column) -> Column:
    return F.substring(period, 6, 5).isin(*OPENING_DAYS)


def is_fiscal_end(period: Column) -> Column:
    return F.substring(period, 6, 5).isin(*FISCAL_ENDS)


def reporting_periods(periods: Column) -> Column:
    """Fiscal ends if there are two, else all but opening days if there are two, else none; fewer than two stay."""

    def kept(own: Column) -> Column:
        closing, fiscal = F.filter(own, lambda p: ~is_opening(p)), F.filter(own, is_fiscal_end)
        return F.when((F.size(own) < 2) | (F.size(fiscal) >= 2), F.when(F.size(own) < 2, own).otherwise(fiscal)).when(F.size(closing) >= 2, closing).otherwise(F.array().cast("array<string>"))

    return let(periods, kept)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(F.try_to_timestamp(end, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(start, F.lit("yyyy-MM-dd"))))
