"""Which row of a statement reports a field: label scores by aliases and ordered decisions, and the choice of a row.

A field's decisions are a list that is read from the top; the first whose pattern stands in the
label (and whose exception doesn't) settles the score. The lists compile to one column, and to SQL.
Labels are made distinct first; aliases are a fixed list, so nothing is joined or paired.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.labels import normal_label

#: What a field is called in statements.
ALIASES = {
    "revenue": ("revenue", "revenues", "total revenues", "net sales", "total net sales", "total net revenues", "total revenue", "turnover", "operating revenue", "ventes", "chiffre d'affaires", "chiffre d affaires", "produits", "营业收入", "营业总收入", "收入"),
    "gross_profit": ("gross profit", "gross margin", "毛利", "毛利润"),
    "operating_income": ("operating income", "income from operations", "operating profit", "operating income (loss)", "loss from operations", "earnings from operations", "résultat opérationnel", "经营溢利", "经营利润", "营业利润"),
    "net_income": ("net income", "net earnings", "net income (loss)", "net earnings (loss)", "profit for the year", "profit attributable to equity holders", "profit attributable to owners", "profit attributable to shareholders", "résultat net", "résultat net de l'ensemble consolidé", "résultat net, part du groupe", "part attribuable aux actionnaires", "本公司权益持有人应占溢利", "本公司拥有人应占溢利", "股东应占溢利", "净利润"),
    "eps_basic": ("basic earnings per share", "basic net income per share", "basic eps", "basic and diluted earnings per share", "net income per share: basic", "net income per share basic", "earnings per share basic", "基本每股盈利", "每股基本盈利", "– basic", "- basic", "basic"),
    "total_assets": ("total assets", "total actif", "total de l'actif", "total de l actif", "总资产", "资产总值", "资产总额"),
    "total_liabilities": ("total liabilities", "total des passifs", "passif", "总负债", "负债总额", "负债总值"),
    "total_equity": ("total stockholders' equity", "total shareholders' equity", "total equity", "total equity attributable to equity shareholders of the bank", "equity attributable to owners of the parent", "equity attributable to equity holders of the parent", "total des capitaux propres", "capitaux propres", "股东权益", "权益总额", "权益总值", "本公司权益持有人应占权益", "本公司拥有人应占权益"),
    "cash": ("cash and cash equivalents", "cash and deposits with central banks", "cash and amounts due from banks", "现金及现金等价物", "现金及等同现金项目", "cash & equivalents"),
    "cfo": ("net cash provided by operating activities", "net cash from operating activities", "net cash from operations", "net cash provided by (used in) operating activities", "cash generated by operating activities", "cash flows from operating activities", "经营活动所得现金流量净额", "经营活动产生的现金流量净额", "经营业务所得现金净额", "cash from operations"),
    "cfi": ("net cash used in investing activities", "net cash provided by investing activities", "net cash provided by (used in) investing activities", "cash flows from investing activities", "投资活动所得现金流量净额", "投资活动产生的现金流量净额", "cash from investing"),
    "cff": ("net cash used in financing activities", "net cash provided by financing activities", "net cash used in (provided by) financing activities", "cash flows from financing activities", "融资活动所得现金流量净额", "筹资活动产生的现金流量净额", "cash from financing"),
    "capex": ("purchases of property and equipment", "purchase of property, plant and equipment", "purchase of property, equipment and software", "capital expenditures", "purchase of property", "购置物业", "购建固定资产", "资本开支", "capex"),
}
#: The score of a label that holds an alias or stands in one; the least that counts; what a further value adds.
HELD, ACCEPT, PER_VALUE = 0.92, 0.55, 0.01


@dataclass(frozen=True)
class Decision:
    """Where pattern stands and unless doesn't: "is" sets the score, "cap" and "floor" bound the one from the aliases, "add" raises it, up to 1."""

    action: str
    value: float
    pattern: str
    unless: str = ""


def veto(pattern: str, unless: str = "") -> Decision:
    return Decision("is", 0.0, pattern, unless)


ANY = "."
_COMBINED = r"equity.{0,40}\s+and\s+liabilit|liabilit(?:ies|y).{0,60}\s+and\s+(?:shareholders?.?|stockholders?.?|equity)\b|and\s+(?:stockholders|shareholders|equity)\b|passif.{0,40}\s+et\s+.{0,40}capitaux propres|capitaux propres.{0,40}\s+et\s+.{0,40}passif"
TOTAL_REVENUE = r"^total(?:\s+net)?\s+(?:revenues?|sales)$"
SEGMENT_REVENUE = r"^total\s+(?:automotive|energy|services|segment|product|geographic|regional|cloud|compute|data\s*center|advertising|mobile|storage|networking|graphics)\s+revenues?$"
ACTIVITIES = {"cfo": "operating", "cfi": "investing", "cff": "financing"}
#: What settles a score before aliases are looked at; numbers in a label do for every field.
BEFORE = {
    "total_liabilities": (veto(_COMBINED), veto(r"\bequity\b", "liabilit")),
    "total_equity": (veto(_COMBINED), veto(r"\bliabilit", "equity"), Decision("is", 0.85, "^total equity$")),
}
NUMBERED = veto(r"\d{1,3},\d{3}")
#: What settles the score of a label that is no alias itself.
AFTER = {
    "revenue": (veto("cost"), Decision("cap", 0.72, SEGMENT_REVENUE), Decision("is", 1.0, TOTAL_REVENUE), Decision("add", 0.08, "total")),
    "operating_income": (veto("non-operating"), veto("^other operating income"), Decision("add", 0.1, "(?:income|loss) from operations")),
    "net_income": (
        Decision("cap", 0.80, r"^consolidated net income(?: \(loss\))?$"), Decision("is", 1.0, "consolidated net income attributable to ", "consolidated net income attributable to non[- ]?controlling"), veto(r"^net income(?:/(?:expense))? from\b"),
        Decision("is", 1.0, "profit for the year|r[eé]sultat net"), veto("per share"), veto("discontinued"), Decision("is", 1.0, "continuing"), veto("non[- ]?controlling"), Decision("is", 1.0, "profit attributable to shareholders of (?:the )?company", "ordinary"),
        Decision("cap", 0.88, "ordinary shareholders"), Decision("cap", 0.85, r"^net income(?: \(loss\))?$"), Decision("is", 0.9, r"^net (?:income|loss)(?: \(loss\))?$"), Decision("cap", 0.85, r"^netincome(?:\(loss\))?$"), Decision("is", 1.0, "attributable to"),
        Decision("is", 0.96, r"(?:group\s+)?holding\s+limited$", "shareholders? of"), Decision("cap", 0.72, r"^(?:ordinary\s+)?shareholders of\b"), Decision("cap", 0.55, "^shareholders$"), Decision("is", 1.0, "common shareholders"),
    ),
    "eps_basic": (
        Decision("is", 0.88, r"^(?:basic|[–-]\s*basic)$"), veto(ANY, "per share|基本每股|每股基本"), veto("diluted"), veto("shares outstanding|weighted.average shares|million shares"), Decision("is", 1.0, r"earnings per share.*\bbasic\b|\bbasic\b.*earnings per share"),
        Decision("is", 1.0, "net income.*per share.*basic|basic.*net income per share"), Decision("is", 0.95, "基本每股|每股基本"),
    ),
    "total_assets": (Decision("cap", 0.45, r"\bus gaap\b"), Decision("is", 1.0, r"\b(?:eu[- ]?ifrs|ifrs)\b"), veto(ANY, "total"), veto("liabilit")),
    "total_liabilities": (
        veto("uncertain tax|income tax|deferred tax|pension|lease liabilit|contract liabilit|accrued and other|provisions?", "^total liabilities$"), veto(r"\bown funds\b"), veto(r"\bcurrent\b", "^total liabilities$"), veto(ANY, "total"), veto(r"\btotal assets\b"),
    ),
    "total_equity": (
        veto(r"\btotal assets\b"), veto(ANY, "total"), veto("mezzanine|investments? in equity|non[- ]?controlling"),
        Decision("is", 1.0, r"(?:inc\.?|ltd\.?|corp\.?|company|parent).{0,40}shareholders?.? equity|shareholders?.? equity.{0,40}(?:inc\.?|ltd\.?|company)|equity attributable to (?:the )?(?:company|parent|owners|shareholders)"), Decision("cap", 0.90, "^total shareholders?.? equity$"),
    ),
    **{f: (veto(ANY, a), veto("|".join(x for x in ACTIVITIES.values() if x != a)), veto("^cash flows from (?:operating|investing|financing)"), Decision("add", 0.08, "^net cash")) for f, a in ACTIVITIES.items()},
    "capex": (veto("land use rights|repurchase|time deposits|wealth management"), Decision("floor", 0.95, "property.{0,40}equipment|equipment.{0,40}software|intangible assets")),
}
FIELDS = tuple(ALIASES)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def alias_ratios(labels: pd.Series) -> pd.Series:
    """Of each distinct label the best Ratcliff-Obershelp ratio (no built-in is one) to an alias of each field; 0 where letter counts alone keep it below ACCEPT."""

    def best(label: str) -> list[float]:
        out = []
        for field in FIELDS:
            top = 0.0
            for alias in ALIASES[field]:
                match = difflib.SequenceMatcher(None, label, alias)
                if match.real_quick_ratio() >= max(top, ACCEPT) and match.quick_ratio() >= max(top, ACCEPT):
                    top = max(top, match.ratio())
            out.append(round(top, 6) if top >= ACCEPT else 0.0)
        return out

    return pd.Series([best(x or "") for x in labels])


def _settled(norm: Column, decisions: tuple[Decision, ...], best: Column) -> list[Column]:
    """A condition and score for each decision, null where it doesn't apply."""
    out = []
    for d in decisions:
        value = {"is": F.lit(d.value), "cap": F.least(best, F.lit(d.value)), "floor": F.greatest(best, F.lit(d.value)), "add": F.least(F.lit(1.0), best + d.value)}[d.action]
        applies = norm.rlike(d.pattern) & ~norm.rlike(d.unless) if d.unless else norm.rlike(d.pattern)
        out.append(F.when(applies, value))
    return out


def score_of(norm: Column, field: str, ratio: Column) -> Column:
    """A normal label's score for a field, given its best ratio to the field's aliases."""
    aliases = ALIASES[field]
    held = norm.rlike("|".join(_plain(a) for a in aliases)) | F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(a, norm))
    best = F.when(held, F.greatest(F.lit(HELD), ratio)).otherwise(ratio)
    first = _settled(norm, (NUMBERED, *BEFORE.get(field, ())), best)
    return F.when(norm == "", 0.0).otherwise(F.coalesce(*first, F.when(norm.isin(*aliases), 1.0), *_settled(norm, AFTER.get(field, ()), best), best))


def _plain(text: str) -> str:
    """A pattern for the text itself."""
    return "".join(f"\\{c}" if c in r".()[]{}*+?^$|\\" else c for c in text)


def label_scores(labels: DataFrame) -> DataFrame:
    """(label, field_id, score) of every distinct label and each field for which its score is ACCEPT or more. Null and empty labels score for none."""
    distinct = labels.select("label").where("label is not null").distinct().withColumn("norm", normal_label(F.col("label")))
    rated = distinct.withColumn("ratios", alias_ratios("norm"))
    each = F.array(*(F.struct(F.lit(f).alias("field_id"), F.round(score_of(F.col("norm"), f, F.get("ratios", F.lit(i))), 6).alias("score")) for i, f in enumerate(FIELDS)))
    return rated.select("label", "norm", F.explode(F.filter(each, lambda x: x["score"] >= ACCEPT)).alias("x")).select("label", "norm", "x.*")


def revenue_rank(norm: Column) -> Column:
    """2 for the company's total, 1 for a segment's, else 0."""
    return F.when(norm.rlike(TOTAL_REVENUE), 2).when(norm.rlike(SEGMENT_REVENUE), 1).otherwise(0)


def choose_rows(rows: DataFrame, n_periods: int = 3, few: int = 50_000) -> DataFrame:
    """(doc_id, field_id, row_no, label, score): of rows (doc_id, row_no, label, values ARRAY<DOUBLE>) the one that reports each field.

    Null values don't count; a row without values, or with values that the field can't have, is out.
    The best score wins, a hundredth more for each value; of equals the first row, but for net income one
    that names who it is attributable to, or a holding after a plain "net income", and for revenue the company's total.
    """
    # labels are counted first: few go to the rows, as rows that came to their labels would be as many tasks as there are labels
    n_labels = rows.select("label").distinct().limit(few + 1).count()
    scored = label_scores(rows).hint("broadcast" if n_labels <= few else "merge")
    own = rows.withColumn("values", F.filter("values", lambda v: v.isNotNull())).where(F.size("values") > 0).join(scored, "label")
    field, norm, n = F.col("field_id"), F.col("norm"), F.size("values")
    every = lambda test: F.forall("values", test)
    out = (field == "net_income") & (n < max(2, n_periods - 1)) & ~norm.rlike("attributable|holding")
    out = out | ((field == "revenue") & every(lambda v: v <= 0)) | (field.isin("revenue", "total_assets", "gross_profit") & every(lambda v: F.abs(v) < 1000)) | ((field == "eps_basic") & every(lambda v: F.abs(v) > 500))
    own = own.where(~out).withColumn("tie", F.round(F.col("score") + n * PER_VALUE, 6))
    per = Window.partitionBy("doc_id", "field_id")
    own = own.withColumn("first", F.first("norm").over(per.orderBy(F.desc("tie"), "row_no")))
    named = F.when(norm.contains("attributable to"), 2).when(norm.rlike(r"(?:group\s+)?holding\s+limited$") & F.col("first").rlike(r"^net income(?: \(loss\))?$"), 1).otherwise(0)
    rank = F.when(field == "net_income", named).when(field == "revenue", revenue_rank(norm)).otherwise(0)
    best = own.withColumn("r", F.row_number().over(per.orderBy(F.desc("tie"), rank.desc(), "row_no"))).where("r = 1")
    return best.select("doc_id", "field_id", "row_no", "label", "score")


def score_sql(norm: str, field: str) -> str:
    """DuckDB: score_of() for labels whose ratios don't matter."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    aliases = "[" + ", ".join(map(quoted, ALIASES[field])) + "]"
    best = f"CASE WHEN len(list_filter({aliases}, lambda a: contains({norm}, a) OR contains(a, {norm}))) > 0 THEN {HELD} ELSE 0.0 END"

    def settled(decisions):
        for d in decisions:
            value = {"is": f"{d.value}", "cap": f"least({best}, {d.value})", "floor": f"greatest({best}, {d.value})", "add": f"least(1.0, {best} + {d.value})"}[d.action]
            unless = f" AND NOT regexp_matches({norm}, {quoted(d.unless)})" if d.unless else ""
            yield f"WHEN regexp_matches({norm}, {quoted(d.pattern)}){unless} THEN {value}"

    return f"CASE {' '.join(settled((NUMBERED, *BEFORE.get(field, ()))))} WHEN list_contains({aliases}, {norm}) THEN 1.0 {' '.join(settled(AFTER.get(field, ())))} ELSE {best} END"
