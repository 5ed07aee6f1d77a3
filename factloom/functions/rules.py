"""Rule trees over a text's zones as data, and what they compile to: one boolean column, and the name of the leaf that fails."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.quick import quick


@dataclass(frozen=True)
class Cue:
    """pattern stands at least so often in the characters [start, end) of the text named at.

    Patterns keep to what Java, RE2 and Python read alike: no lookaround.
    """

    name: str
    pattern: str
    end: int
    start: int = 0
    at: str = "page"
    least: int = 1
    example: str = ""


@dataclass(frozen=True)
class Before:
    """pattern stands in the zone, and no other before it."""

    name: str
    pattern: str
    other: str
    end: int
    example: str = ""


@dataclass(frozen=True)
class Beyond:
    """pattern stands in the zone more often than the longer pattern other, which begins with it."""

    name: str
    pattern: str
    other: str
    end: int
    example: str = ""


@dataclass(frozen=True)
class Titled:
    """The page has a title near its head."""

    name: str = "title"


@dataclass(frozen=True)
class Not:
    part: object

    @property
    def name(self) -> str:
        return f"not {self.part.name}"


@dataclass(frozen=True)
class All:
    name: str
    parts: tuple


@dataclass(frozen=True)
class Any:
    name: str
    parts: tuple


def leaves(rule) -> list:
    """All leaves of a tree, in order."""
    if isinstance(rule, (All, Any)):
        return [leaf for part in rule.parts for leaf in leaves(part)]
    return leaves(rule.part) if isinstance(rule, Not) else [rule]


def needed(rule, titles: tuple[str, ...]) -> tuple[str, ...]:
    """Patterns of which one stands in the page wherever the tree holds; none where no such are known.

    titles are those that make a page titled. Zones may cut words, so edges of words don't count;
    patterns bound to a zone's start or end, and texts other than parts of the page, tell nothing.
    """
    if isinstance(rule, (Cue, Titled)):
        own = titles if isinstance(rule, Titled) else (rule.pattern,) if rule.at != "before" else ()
        bound = any(mark in p.replace("(?:", "") for p in own for mark in ("^", "$", "(?"))
        return () if bound else tuple(p.replace(r"\b", "") for p in own)
    if isinstance(rule, Any):
        each = [needed(p, titles) for p in rule.parts]
        return tuple(dict.fromkeys(p for own in each for p in own)) if all(each) else ()
    if isinstance(rule, All):
        return min(filter(None, (needed(p, titles) for p in rule.parts)), key=len, default=())
    return ()


def _zone(text: Column, start: int, end: int) -> Column:
    return F.substring(text, start + 1, end - start)


def holds(rule, texts: dict[str, Column]) -> Column:
    """The tree over the texts (page, title, before) as one boolean column; a text that is null meets no cue."""
    if isinstance(rule, Cue):
        zone = _zone(texts[rule.at], rule.start, rule.end)
        return F.coalesce(zone.rlike(quick(rule.pattern)) if rule.least == 1 else F.regexp_count(zone, F.lit(quick(rule.pattern))) >= rule.least, F.lit(False))
    if isinstance(rule, Before):
        zone = _zone(texts["page"], 0, rule.end)
        own, other = F.regexp_instr(zone, F.lit(quick(rule.pattern))), F.regexp_instr(zone, F.lit(quick(rule.other)))
        return (own > 0) & ((other == 0) | (own < other))
    if isinstance(rule, Beyond):
        zone = _zone(texts["page"], 0, rule.end)
        return F.regexp_count(zone, F.lit(rule.pattern)) > F.regexp_count(zone, F.lit(rule.other))
    if isinstance(rule, Titled):
        return texts["title"].isNotNull()
    if isinstance(rule, Not):
        return ~holds(rule.part, texts)
    return reduce((lambda a, b: a & b) if isinstance(rule, All) else (lambda a, b: a | b), [holds(p, texts) for p in rule.parts])


def failing(rule, texts: dict[str, Column]) -> Column:
    """The name of the first part that fails, null where the tree holds. Of an any-rule its own name is given."""
    if isinstance(rule, All):
        return F.coalesce(*(failing(p, texts) for p in rule.parts))
    return F.when(~holds(rule, texts), F.lit(rule.name))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def place_sql(text: str, pattern: str) -> str:
    """DuckDB: where a pattern first stands (from 0), or null."""
    return f"CASE WHEN regexp_matches({text}, {_quoted(pattern)}) THEN length(regexp_extract({text}, {_quoted('(?s)^(.*?)(?:' + pattern + ')')}, 1)) END"


def holds_sql(rule, texts: dict[str, str]) -> str:
    """The tree in DuckDB's SQL."""
    if isinstance(rule, Cue):
        zone = f"substr({texts[rule.at]}, {rule.start + 1}, {rule.end - rule.start})"
        return f"coalesce(regexp_matches({zone}, {_quoted(rule.pattern)}), false)" if rule.least == 1 else f"len(regexp_extract_all({zone}, {_quoted(rule.pattern)})) >= {rule.least}"
    if isinstance(rule, Before):
        zone = f"substr({texts['page']}, 1, {rule.end})"
        return f"coalesce(({place_sql(zone, rule.pattern)}) < coalesce({place_sql(zone, rule.other)}, {rule.end}), false)"
    if isinstance(rule, Beyond):
        zone = f"substr({texts['page']}, 1, {rule.end})"
        return f"len(regexp_extract_all({zone}, {_quoted(rule.pattern)})) > len(regexp_extract_all({zone}, {_quoted(rule.other)}))"
    if isinstance(rule, Titled):
        return f"{texts['title']} IS NOT NULL"
    if isinstance(rule, Not):
        return f"NOT ({holds_sql(rule.part, texts)})"
    return "(" + (" AND " if isinstance(rule, All) else " OR ").join(holds_sql(p, texts) for p in rule.parts) + ")"


def failing_sql(rule, texts: dict[str, str]) -> str:
    if isinstance(rule, All):
        return "coalesce(" + ", ".join(failing_sql(p, texts) for p in rule.parts) + ")"
    return f"CASE WHEN NOT ({holds_sql(rule, texts)}) THEN {_quoted(rule.name)} END"
