"""Format-preserving pseudonyms for personal data, in native expressions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel network, so the
same value becomes the same pseudonym in every document and two values never share one:

- payment cards: 13 to 19 digits with a valid Luhn digit; the issuer's six digits stay, the account
  digits are permuted, the check digit is made anew, so the pseudonym is valid too;
- phone numbers of the +1 plan: the seven digits behind the area code, within valid exchanges;
  separators stay;
- IPv4 addresses: the two low octets, as a number below 65,536;
- dates (2020-01-31, 01/31/2020, 31.01.2020): the day's number within 400 years;
- e-mail addresses: each letter and digit of the local part, among its kind, length kept;
- access keys and long hexadecimal secrets: each character within its alphabet.

A round's function is SHA-2 of key, kind, round and the other half; halves may differ in size, so
every domain is permuted in itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import free_name, let

#: The alphabets that characters stay in.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Days in 400 years of the Gregorian calendar, as a product, and the first day of those that are permuted.
CYCLE, FIRST_DAY = (773, 189), "1800-01-01"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


@dataclass(frozen=True)
class Kind:
    """A kind of value: the pattern that finds it, and how to replace one found string. Kinds are tried in order."""

    name: str
    pattern: str


#: Fixed values. Boundaries keep a value from starting or ending inside a longer one.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9][A-Za-z0-9.\-]{0,250}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    Kind("secret", r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{18,64}(?<=[a-f][0-9a-f]{0,63})(?![0-9a-z])"),
    Kind("phone", r"(?<![\d+])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d])"),
    Kind("card", r"(?<![\d.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-]|\.\d)"),
    Kind("ip", rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)"),
    Kind("iso_date", r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"),
    Kind("month_date", r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"),
    Kind("day_date", r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?![\d]|\.\d)"),
)


def _number(seed: Column) -> Column:
    """A number below 2**60 that depends on all of seed."""
    return F.conv(F.substring(F.sha2(F.encode(seed, "UTF-8"), 256), 1, 15), 16, 10).cast("bigint")


def permute_pair(high: Column, low: Column, a: int, b: int, key: str, kind: str, rounds: int = 10) -> Column:
    """A keyed permutation of pairs (high < a, low < b): halves take turns in adding a function of the other."""

    def step(now: Column, i: Column) -> Column:
        seed = lambda half: F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
        return F.when(i % 2 == 0, F.struct(F.pmod(now["high"] + _number(seed(now["low"])), F.lit(a).cast("bigint")).alias("high"), now["low"].alias("low"))).otherwise(
            F.struct(now["high"].alias("high"), F.pmod(now["low"] + _number(seed(now["high"])), F.lit(b).cast("bigint")).alias("low"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low")), step)


def permute_text(text: Column, key: str, kind: str, alphabets: tuple[str, ...], rounds: int = 10) -> Column:
    """A keyed permutation of strings that keeps each character in its alphabet and all others as they are: halves of up to 64 characters take turns."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other)

        def moved(stream: Column) -> Column:
            def one(j: Column) -> Column:
                c = F.substring(half, j, F.lit(1))
                by = F.conv(F.substring(stream, 2 * j - 1, F.lit(2)), 16, 10).cast("int")
                out = c
                for letters in alphabets:
                    at = F.call_function("instr", F.lit(letters), c)
                    out = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")

        return F.when(F.length(half) == 0, half).otherwise(let(F.sha2(F.encode(seed, "UTF-8"), 512), moved))

    def step(now: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(shifted(now["l"], now["r"], i).alias("l"), now["r"].alias("r"))).otherwise(F.struct(now["l"].alias("l"), shifted(now["r"], now["l"], i).alias("r")))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step), lambda x: F.concat(x["l"], x["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    place = lambda j: F.length(_digits(F.substring(shape, F.lit(1), j)))
    one = lambda j: F.when(F.substring(shape, j, F.lit(1)).rlike(r"\d"), F.substring(digits, place(j), F.lit(1))).otherwise(F.substring(shape, j, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def _card(m: Column, key: str) -> Column:
    def remade(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 6), permute_text(F.substring(digits, F.lit(7), n - 7), key, "card", (DIGITS,)))
        check = lambda b: F.concat(b, F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(b, d))), F.lit(0)))
        return F.when(F.call_function("luhn_check", digits), _refill(m, let(body, check))).otherwise(m)

    return let(_digits(m), remade)


def _phone(m: Column, key: str) -> Column:
    """The last seven digits, on 800 exchanges (200 to 999) of 10,000 lines; other exchanges aren't valid."""
    tail = F.substring(_digits(m), -7, 7)

    def remade(t: Column) -> Column:
        pair = permute_pair(F.substring(t, 1, 3).cast("bigint") - 200, F.substring(t, 4, 4).cast("bigint"), 800, 10_000, key, "phone")
        new = let(pair, lambda x: F.concat((x["high"] + 200).cast("string"), F.lpad(x["low"].cast("string"), 4, "0")))
        fresh = _refill(F.substring(m, -8, 8), new)
        return F.when(F.substring(t, 1, 1) >= "2", F.concat(F.substring(m, F.lit(1), F.length(m) - 8), fresh)).otherwise(m)

    return let(tail, remade)


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(m, r"\."), F.lit(i))
    pair = permute_pair(octet(2).cast("bigint"), octet(3).cast("bigint"), 256, 256, key, "ip")
    return let(pair, lambda x: F.concat_ws(".", octet(0), octet(1), x["high"].cast("string"), x["low"].cast("string")))


def _date(m: Column, key: str, shape: str) -> Column:
    """Days of 1800 to 2199; what is no such day stays as it is."""
    day = F.to_date(F.try_to_timestamp(m, F.lit(shape)))

    def remade(d: Column) -> Column:
        number = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        pair = permute_pair(F.floor(number / CYCLE[1]), F.pmod(number, F.lit(CYCLE[1])), *CYCLE, key, "date")
        new = let(pair, lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["high"] * CYCLE[1] + x["low"]).cast("int")), shape))
        return F.when(d.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), new).otherwise(m)

    return let(day, remade)


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one found string; a string that fails its kind's validation stays."""
    email = F.concat(permute_text(F.substring_index(m, "@", 1), key, "email", (DIGITS, LOWER, UPPER)), F.substring(m, F.locate("@", m), F.length(m)))
    whole = lambda kind: m.rlike(f"^(?:{kind.pattern})$")
    by_name = {
        "email": email,
        "secret": F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), permute_text(F.substring(m, 5, 16), key, "key", (DIGITS + UPPER,)))).otherwise(permute_text(m, key, "hex", (HEX,))),
        "phone": _phone(m, key),
        "card": _card(m, key),
        "ip": _ip(m, key),
        "iso_date": _date(m, key, "yyyy-MM-dd"),
        "month_date": _date(m, key, "MM/dd/yyyy"),
        "day_date": _date(m, key, "dd.MM.yyyy"),
    }
    out = m
    for kind in reversed(KINDS):
        out = F.when(whole(kind), by_name[kind.name]).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """docs with text rewritten, and how many values were replaced in each.

    Equal values get equal pseudonyms under one key, in every document; within a kind no two get
    the same. A null text stays null and counts 0; other columns stay as they are, but for one called
    like count. Text around the values is kept to the byte. Only texts with a digit or an @ are
    searched. Repeated rows are rewritten alike, an empty table stays empty; a text of any length is
    rewritten whole, and its values are held at once.
    """
    whole = "|".join(f"(?:{k.pattern})" for k in KINDS)
    # the one back reference must point at its group's number in the joint pattern
    before = sum(k.pattern.count("([ ") for k in KINDS[: [k.name for k in KINDS].index("card")])
    whole = whole.replace(r"\1", rf"\{before + 1}")
    column = F.col(f"`{text}`").cast("string")
    searched = column.rlike("[0-9@]")
    found = F.when(searched, F.regexp_extract_all(column, F.lit(whole), F.lit(0)))
    old, fresh = free_name(docs, "_found"), free_name(docs, "_new")
    staged = docs.withColumn(old, found)
    staged = staged.withColumn(fresh, F.when(F.size(old) > 0, F.transform(F.col(old), lambda m: pseudonym(m, key))))
    pieces = F.split(column, whole, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(fresh)), F.col(fresh), lambda a, b: F.concat(a, b)), ""), F.get(pieces, F.size(fresh)))
    changed = F.size(F.filter(F.arrays_zip(F.col(old).alias("a"), F.col(fresh).alias("b")), lambda x: x["a"] != x["b"]))
    return staged.withColumns({text: F.when(F.size(fresh) > 0, joined).otherwise(column), count: F.when(F.size(fresh) > 0, changed).otherwise(0)}).drop(old, fresh)
