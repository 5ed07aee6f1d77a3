"""Queries over reports that are printed for every customer, page by page, from the customer's own amounts.

A report's market and layout follow from the customer's key; the kinds of pages are the inputs of
the rules, what the rules say of them is computed on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import pages, rules
from factloom.functions import statement_rules as sr
from factloom.operators import facts as fx
from factloom.operators import statements as st

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Kinds of pages; {a} are five amounts of the report, {b} a single one.
KINDS = {
    "filler": "Remarks on the year without figures", "cover": "Annual report 2024", "contents": "Table of Contents Item 1 Business 3 Item 8 Controls 40", "index": "Index to Consolidated Financial Statements",
    "audit": "Opinion We have audited the accompanying consolidated statements of the group",
    "income": "Consolidated Statements of Operations (in millions) Years ended December 31, 2024 Revenue {a}",
    "balance": "Consolidated Balance Sheets (in millions) As of December 31, 2024 Total assets {a}",
    "cashflow": "Consolidated Statements of Cash Flows (in millions) Operating activities Net income {a}",
    "income report": "Statements of Income (in thousands) Net sales {a}", "balance report": "Balance Sheets (in thousands) Assets {a}", "cashflow report": "Statements of Cash Flows (in thousands) Operating activities {a}",
    "income plain": "Years ended December 31, 2024 Total revenues and revenue {a} as in the consolidated statements", "balance plain": "December 31, 2024 Cash and cash equivalents {b} Assets Total assets {a}", "cashflow plain": "Years ended December 31, 2024 Operating activities: net cash from operating activities {a}",
    "mention": "The consolidated balance sheets in the period show {a}", "few": "Consolidated Balance Sheets (in millions) Assets {b}",
    "comprehensive": "Consolidated Statements of Comprehensive Income (in millions) Other comprehensive income {a}",
    "position": "Consolidated Statements of Financial Position (in millions) Assets {a}",
    "position with notes": "Consolidated Balance Sheets (in millions) Assets {a} consolidated statement of financial position, see notes to the consolidated financial statements",
    "income in review": "Consolidated Statements of Operations (in millions) Revenue {a} {a} business review",
    "profit": "Statement of Comprehensive Income (in thousands) Revenue {a}", "position short": "Statements of Financial Position rmb'000 Assets {a}", "cash short": "Statements of Cash Flows (in thousands) Operating activities {a}",
    "french income": "Compte de résultat consolidé en millions d'euros Chiffre d'affaires 84 683 {a}", "french balance": "Bilan consolidé en millions d'euros Total actif 84 683 {a}", "french cash": "Tableau des flux de trésorerie en millions d'euros Flux des activités opérationnelles 84 683 {a}",
    "company balance": "Company balance sheet. Consolidated Balance Sheets (in millions) As of December 31, 2024 Total assets {a}",
    "french plain": "Exercice 2024 chiffre d'affaires et produits 84 683 {a} {a}", "actif plain": "Exercice 2024 actif courant, immobilisations 84 683 {a} total actif", "cash plain": "Exercice 2024 capacité d'autofinancement 84 683 {a}",
}
_BELOW = "words on the year, " * 30
#: Further pages that the checks tell apart: by what they lack, or by what stands further down.
MORE_KINDS = (
    "Preferred stock balance, revenue {a} years ended December 31, 2024 consolidated statements", "Table of contents for the holders; Consolidated Balance Sheets (in millions) Assets {a}", "December 31, 2024 plan assets at fair value, total assets {a}",
    "Parent company Statements of Cash Flows (in thousands) Operating activities {a}", "Parent company years ended December 31, 2024 operating activities {a}", "Statements of Cash Flows (in thousands) Profit before tax {a} Adjustments {a}",
    "Profit before tax {a} {a} adjustments for net cash from operating", "Changes in equity, years ended December 31, 2024 operating activities {a}", "Bilan consolidé 4 Compte de résultat consolidé 5", f"Bilan consolidé 4 Compte de résultat consolidé 5 {_BELOW} {{a}}",
    "The year in review, Financial statements, Annual report 2024", f"The year in review, Financial statements, Annual report 2024 {_BELOW} {{a}} ventes", "Ventes 84 683 84 684 x 84 685 x 84 686 x 84 687", "Commentaires sur les ventes {a} capacité d'autofinancement",
    "Tableau des flux de trésorerie, income before income taxes {a} adjustments", "Capitaux propres consolidés, operating activities {a}",
)
_US = (
    (("cover", 1), ("contents", 1), ("index", 1), ("filler", 5), ("income", 1), ("balance", 1), ("cashflow", 1)),
    (("index", 1), ("filler", 1), ("income report", 1), ("balance report", 1), ("cashflow report", 1), ("mention", 1)),
    (("filler", 29), ("audit", 1), ("filler", 1), ("income plain", 1), ("balance plain", 1), ("cashflow plain", 1)),
    (("index", 1), ("position", 1), ("position with notes", 1), ("balance", 1), ("comprehensive", 1), ("income", 1), ("cashflow report", 1)),
    (("cover", 1), ("mention", 1), ("few", 1), ("filler", 3)),
    (("filler", 20), ("income", 1), ("filler", 12), ("balance report", 1), ("cashflow plain", 1), ("balance plain", 1)),
)
LAYOUTS = {
    "us": _US,
    "hk": ((("index", 1), ("income in review", 1), ("balance", 1), ("cashflow", 1), ("income report", 1)), (("cover", 1), ("profit", 1), ("position short", 1), ("cash short", 1)), _US[0], _US[2], (("cover", 1),), _US[5]),
    "eu": ((("index", 1), ("french income", 1), ("french balance", 1), ("french cash", 1)), (("index", 1), ("company balance", 1), ("french balance", 1), ("income", 1), ("cash plain", 1)), (("index", 1), ("french plain", 1), ("actif plain", 1), ("filler", 1)), _US[0], _US[1], _US[2]),
}


def layout_pages(market: str, layout: int) -> list[str]:
    return [kind for kind, n in LAYOUTS[market][layout] for _ in range(n)]


def check_kinds() -> list[str]:
    """Pages that meet every example of a rule: each before a page that else would be a statement."""
    examples = [leaf.example for market in sr.MARKETS for s in sr.STATEMENTS for leaf in rules.leaves(sr.RULES[market][s]) if getattr(leaf, "example", "")]
    return [*KINDS.values(), *MORE_KINDS, *(f"{e} {KINDS[s]}" for e in dict.fromkeys(examples) for s in sr.STATEMENTS)]


def _printed(template, amount):
    """A template's page with the amounts that begin with a bigint column."""
    shown = [F.format_number(amount + i, 0) for i in range(5)]
    return F.replace(F.replace(template, F.lit("{a}"), F.concat_ws(" ", *shown)), F.lit("{b}"), shown[0])


_AMOUNT_SQL = "CAST(10000 + floor(abs(c_acctbal)) AS BIGINT)"


def _printed_sql(template: str, amount: str) -> str:
    shown = [f"format('{{:,}}', {amount} + {i})" for i in range(5)]
    return f"replace(replace({template}, '{{a}}', concat_ws(' ', {', '.join(shown)})), '{{b}}', {shown[0]})"


#: A customer's pages take some five milliseconds.
CUSTOMERS_A_TASK = 500


def _customers(spark, sf_dir):
    # the table is one small file here, and printing should not be one task, nor adaptive execution make it one again
    rows = fx.dealt(fx.read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", CUSTOMERS_A_TASK).select("c_custkey", (F.floor(F.abs("c_acctbal")) + 10_000).cast("long").alias("amount"))
    market = F.get(F.array(*map(F.lit, sr.MARKETS)), (F.col("c_custkey") % 3).cast("int"))
    return rows.select(F.col("c_custkey").alias("doc_id"), market.alias("market"), F.floor(F.col("c_custkey") / 3).cast("long").alias("n"), "amount")


def report_pages(spark, sf_dir):
    """(doc_id, market, page_num, text) of a report for each customer."""
    layouts = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.array(*(F.lit(KINDS[k]) for k in layout_pages(m, i))).alias("p")) for m in sr.MARKETS for i in range(len(LAYOUTS[m]))))
    own = F.get(F.filter(layouts, lambda x: (x["m"] == F.col("market")) & (x["i"] == F.col("n") % len(_US))), F.lit(0))["p"]
    rows = _customers(spark, sf_dir).select("doc_id", "market", "amount", F.posexplode(own).alias("p", "template"))
    # most pages have no amounts
    text = F.when(F.col("template").contains("{"), _printed(F.col("template"), F.col("amount") + 1000 * F.col("p"))).otherwise(F.col("template"))
    return rows.select("doc_id", "market", (F.col("p") + 1).alias("page_num"), text.alias("text"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else rules._quoted(x) for x in row) + ")" for row in rows)


_CUSTOMERS_SQL = f"""customers AS (SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'hk' ELSE 'eu' END AS market, c_custkey // 3 AS n, {_AMOUNT_SQL} AS amount FROM customer)"""
_PAGES_SQL = f"""{_CUSTOMERS_SQL},
    layouts(market, layout, p, template) AS (VALUES {_values([(m, i, p, KINDS[k]) for m in sr.MARKETS for i in range(len(_US)) for p, k in enumerate(layout_pages(m, i))])}),
    printed AS (SELECT doc_id, c.market, p + 1 AS page_num, {_printed_sql("template", "(amount + 1000 * p)")} AS text FROM customers c JOIN layouts l ON l.market = c.market AND l.layout = n % {len(_US)})"""


def _zone(n: int, text: str = "page") -> str:
    return f"substr({text}, 1, {n})"


def _matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rules._quoted(pattern)})"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {rules._quoted(pattern)}))"


def _opening_sql(statement: str, market: str) -> str:
    if market == "eu":
        return f"least({', '.join(rules.place_sql(_zone(st.EU_SCAN), p) for p in sr.EUROPE_OPENING[statement])})"
    most = st.OPENS_WITHIN[statement]
    scan = f"regexp_replace({_zone(most + 120)}, '^table of contents\\s+', '')"
    part, spots = f"substr({scan}, 1, {most + 80})", []
    for p in sr.OPENING[statement]:
        at = rules.place_sql(part, p)
        tail = f"substr({scan}, ({at}) + 1 + length(regexp_extract({part}, {rules._quoted(p)})), 48)"
        spots.append(f"CASE WHEN ({at}) <= {most} AND NOT {_matches(tail, pages.MENTIONED)} THEN ({at}) END")
    return f"least({', '.join(spots)})"


def _texts_sql(statement: str, market: str) -> dict[str, str]:
    at = st.opening_column(statement, market)
    before = f"trim({_zone_to(at)})"
    for pattern in pages.HEAD_NOISE:
        before = f"regexp_replace({before}, {rules._quoted(pattern)}, '')"
    return {"page": "page", "title": f"CASE WHEN {at} IS NOT NULL THEN substr(page, {at} + 1, {st.READ}) END", "before": f"CASE WHEN {at} IS NOT NULL THEN trim({before}) END"}


def _zone_to(at: str) -> str:
    return f"substr(page, 1, {at})"


_DENSITY = rf"2 * {_count('plain', sr.GROUPED)} + {_count('plain', r'\$\s*[\d,]+')} + {_count('plain', r'\(\s*[\d,]+\s*\)')} + least(12, len(list_filter(regexp_extract_all(plain, '(?:^|[^\d.])(\d+)', 1), lambda x: length(x) BETWEEN 4 AND 7)))"


def _excluded_sql(n: int) -> str:
    zone = f"substr(head, 1, {n})"
    part = lambda k: f"substr({zone}, 1, {k})"
    contents = f"({_matches(part(400), '(?i)table of contents')} AND NOT ({_matches(part(700), pages.AMOUNT_HEAD)} OR {_matches(part(600), pages.FISCAL_HEAD)}) AND ({_matches(part(700), pages.CONTENTS_ENTRY)} OR NOT {_matches(part(500), pages.STATEMENT_HEAD)}))"
    return f"({contents} OR {_matches(zone, '|'.join(pages.EXCLUDED))})"


#: Pages with all that rules read of them, and whether they hold for each market and statement.
_READ_SQL = f"""low AS (SELECT *, text AS plain, lower(text) AS low, substr(lower(text), 1, {st.READ}) AS page, substr(lower(text), 1, {pages.HEAD}) AS head FROM printed),
    opened AS (SELECT *, {", ".join(f"{_opening_sql(s, m)} AS {st.opening_column(s, m)}" for m in ("us", "eu") for s in sr.STATEMENTS)}, {_DENSITY} AS us_density, {_DENSITY} + 2 * {_count("plain", sr.SPACED)} AS eu_density FROM low)"""


def _title_sql(market: str, titles) -> str:
    """(3 - strength) * 10000 + place of the best title in the head."""
    spots = []
    for p in titles:
        at = rules.place_sql("head", p)
        end = f"({at}) + length(regexp_extract(head, {rules._quoted(p)}))"
        tail = f"substr(head, {end} + 1, 48)"
        strength = (3 if "consolid" in p else 2) if market == "eu" else pages.strength_of(p)
        low = "" if market == "eu" else f" AND (({at}) <= {pages.TITLE_ZONE} OR {_matches(tail, pages.ANNOUNCED)}) AND NOT {_matches(f'substr(head, ({at}) + 1, length(regexp_extract(head, {rules._quoted(p)})) + 24)', '(?i)balance sheet classification')}"
        spots.append(f"CASE WHEN ({at}) IS NOT NULL AND NOT {_matches(tail, pages.MENTIONED)}{low} THEN {(3 - strength) * 10_000} + ({at}) END")
    return f"least({', '.join(spots)}, NULL)"


def _score_sql(phase: st.Phase, s: str) -> str:
    density = "eu_density" if phase.market == "eu" else "us_density"
    if phase.kind == "titles":
        t = f"t_{phase.number}_{s}"
        return f"CASE WHEN NOT excluded AND {density} >= {phase.least} THEN {density} + greatest(0, {pages.TITLE_ZONE} - {t} % 10000) // 2 + 50 * (3 - {t} // 10000) END"
    if phase.kind == "named":
        return f"CASE WHEN NOT excluded AND {_matches(_zone(st.HK_HEAD), '|'.join(phase.titles[s]))} THEN {_count('text', sr.GROUPED)} END"
    points = [f"CASE WHEN {_matches(_zone(n), p)} THEN {k} ELSE 0 END" for p, n, k in sr.BONUS[phase.market][s]]
    if s == "cashflow":
        (a, n), (b, m) = sr.BOTH[phase.market]
        points.append(f"CASE WHEN {_matches(_zone(n), a)} AND {_matches(_zone(m), b)} THEN 150 ELSE 0 END")
    total = f"({' + '.join([density, *points])})"
    return f"CASE WHEN NOT {'eu_excluded' if phase.market == 'eu' else 'excluded'} AND {total} >= {phase.least} THEN {total} END"


def _ranks_sql(market: str, s: str) -> str:
    """Ranks as one number, the first weighing most."""
    if market == "eu":
        plain = f"NOT {_matches(_zone(750), sr.CONSOLIDATED_HEAD)}"
        tests = [_matches(_zone(600), sr.EU_NO_PRIMARY[0].pattern), _matches(_zone(900), sr.EU_NO_PRIMARY[3].pattern), plain if s == "cashflow" else f"{plain} AND NOT {_matches(_zone(700), sr.EU_WORDS)}"]
    else:
        tests = [_matches(_zone(500), sr.NOTES_HEAD), "false" if s == "cashflow" else f"NOT {_matches(_zone(500), sr.PRIMARY_HEAD)}", f"{_matches(_zone(500), 'comprehensive\\s+income')} AND NOT {_matches(_zone(3000), sr.REVENUE_BODY)}" if s == "income" else "false"]
    return " + ".join(f"{w} * CAST({t} AS INTEGER)" for w, t in zip((4, 2, 1), tests, strict=True))


def _located_sql() -> str:
    phases = (*st.COMMON, *st.OWN["hk"], *st.OWN["eu"])
    checked = ", ".join(f"{rules.holds_sql(sr.RULES[m][s], _texts_sql(s, m))} AS {m}_{s}" for m in sr.MARKETS for s in sr.STATEMENTS)
    titled = ", ".join(f"{_title_sql(p.market, p.titles[s])} AS t_{p.number}_{s}" for p in phases if p.kind == "titles" for s in sr.STATEMENTS)
    each = []
    for s in sr.STATEMENTS:
        own = "CASE market " + " ".join(f"WHEN '{m}' THEN {m}_{s}" for m in sr.MARKETS) + " END"
        for p in phases:
            fits = f"{p.market}_{s}" if p.number < st.FIRST_OWN else f"market = '{p.market}' AND {p.market}_{s}"
            each.append(f"SELECT doc_id, market, page_num, '{s}' AS statement, {p.number} AS phase, {str(p.ranged).lower()} AS ranged, '{p.choose}' AS choose, {_score_sql(p, s)} AS score, {own} AS own_valid, {_ranks_sql(p.market, s)} AS ranks FROM titled WHERE {fits}")
    return f"""WITH {_PAGES_SQL}, {_READ_SQL},
    checked AS (SELECT *, {checked}, {_excluded_sql(pages.EXCLUDED_ZONE)} AS excluded, {_excluded_sql(st.EU_UNTITLED_HEAD)} AS eu_excluded FROM opened),
    titled AS (SELECT *, {titled} FROM checked),
    candidates AS ({" UNION ALL ".join(each)}),
    marks AS (SELECT doc_id, max(page_num) AS n, min(CASE WHEN {_matches("substr(low, 1, 3000)", pages.INDEX)} THEN page_num END) AS anchor FROM low GROUP BY doc_id),
    ranges AS (
        SELECT doc_id, 0 AS ord, greatest(1, anchor - 2) AS a, least(n + 1, anchor + 130) AS b FROM marks WHERE anchor IS NOT NULL
        UNION ALL SELECT l.doc_id, page_num, page_num, least(n + 1, page_num + 15) FROM low l JOIN marks USING (doc_id) WHERE {_matches("substr(low, 1, 3500)", pages.AUDIT)}
        UNION ALL SELECT doc_id, 100000, n * 2 // 3 + 1, n + 1 FROM marks WHERE n >= 30),
    found AS (SELECT *, 0 AS ord FROM candidates WHERE NOT ranged AND score IS NOT NULL
        UNION ALL SELECT c.*, r.ord FROM candidates c JOIN ranges r ON r.doc_id = c.doc_id AND page_num >= a AND page_num < b WHERE ranged AND score IS NOT NULL),
    steps AS (SELECT *, CASE WHEN phase IN (3, 7) THEN 0 ELSE ord END AS step FROM found),
    ranked AS (SELECT *, max(score) OVER (PARTITION BY doc_id, statement, phase, step) AS most FROM steps),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, statement, phase, step ORDER BY CASE WHEN choose = 'near' THEN ranks ELSE ord END, page_num) AS r FROM ranked WHERE score >= most * CASE WHEN choose = 'near' THEN 0.92 ELSE 1.0 END),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, statement, phase < {st.FIRST_OWN} ORDER BY phase, step) AS k FROM best WHERE r = 1),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, statement ORDER BY phase) AS j FROM firsts WHERE k = 1 AND (phase >= {st.FIRST_OWN} OR own_valid))
    SELECT doc_id, statement, CAST(page_num AS INTEGER) AS page_num, CAST(phase AS INTEGER) AS phase FROM chosen WHERE j = 1"""


def located_statements(spark, sf_dir):
    """Where the statements of each customer's report stand, and the phase that found them."""
    return st.locate_statements(report_pages(spark, sf_dir))


def _checked_pages(spark, sf_dir):
    """Every customer's three pages of kinds that its key picks, printed with its amounts, so that all kinds occur."""
    kinds = check_kinds()
    template = F.get(F.array(*map(F.lit, kinds)), ((F.col("doc_id") + 7 * F.col("page_num")) % len(kinds)).cast("int"))
    rows = _customers(spark, sf_dir).withColumn("page_num", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rows.select("doc_id", "market", "page_num", _printed(template, F.col("amount")).alias("text"))


def _checked_sql() -> str:
    kinds = check_kinds()
    each = []
    for s in sr.STATEMENTS:
        failing = "CASE market " + " ".join(f"WHEN '{m}' THEN {rules.failing_sql(sr.RULES[m][s], _texts_sql(s, m))}" for m in sr.MARKETS) + " END"
        each.append(f"SELECT doc_id, market, page_num, '{s}' AS statement, {failing} AS failing FROM opened")
    return f"""WITH {_CUSTOMERS_SQL}, kinds(k, template) AS (VALUES {_values(enumerate(kinds))}),
    printed AS (SELECT doc_id, market, page_num, {_printed_sql("template", "amount")} AS text FROM customers, unnest([1, 2, 3]) AS u(page_num) JOIN kinds ON k = (doc_id + 7 * page_num) % {len(kinds)}), {_READ_SQL},
    out AS ({" UNION ALL ".join(each)})
    SELECT doc_id, market, CAST(page_num AS INTEGER) AS page_num, statement, failing IS NULL AS valid, failing FROM out"""


def statement_page_checks(spark, sf_dir):
    """Whether pages are primary statements by their market's rules, and the first rule that fails."""
    return st.check_pages(_checked_pages(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (located_statements, statement_page_checks)}
ORACLE_SQL |= {"located_statements": _located_sql(), "statement_page_checks": _checked_sql()}


# spans ---------------------------------------------------------------------------------------

#: Fixed kinds of pages around a statement; {s} is its title, {n} what opens the next one.
SPAN_KINDS = ("{s} {b}", "{s} (continued) {b}", "Amounts (continued) {b}", "Amounts {b}", "More amounts {b}", "Further amounts {b}", "Rest {b}", "{n} {b}")
SPAN_NAMES = {"income": ("Statements of Operations", "Balance Sheet"), "balance": ("Consolidated Balance Sheets", "Statements of Operations"), "cashflow": ("Statements of Cash Flows", "Notes to Consolidated Statements")}
SPAN_PAGES = 12


def _span_pages(spark, sf_dir):
    """Twelve pages for each customer: kinds that its key deals out, amounts of its own."""
    rows = _customers(spark, sf_dir).withColumn("page_num", F.explode(F.sequence(F.lit(1), F.lit(SPAN_PAGES))))
    kind = F.get(F.array(*map(F.lit, SPAN_KINDS)), _dealt(F.col("doc_id"), F.col("page_num")).cast("int"))
    names = F.get(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, (a, b) in SPAN_NAMES.items())), (F.col("doc_id") % 3).cast("int"))
    text = _printed(F.replace(F.replace(kind, F.lit("{s}"), names["a"]), F.lit("{n}"), names["b"]), F.col("amount") + F.col("page_num"))
    return rows.select("doc_id", "page_num", names["s"].alias("statement"), text.alias("text"))


def _dealt(doc, page):
    """A kind for each page: blocks of alike pages and single ones, as the key has it."""
    return (doc * 31 + F.floor((page + doc % 5) / (1 + doc % 3)) * 13 + F.floor(doc / 7)) % len(SPAN_KINDS)


_SPAN_SQL = f"""{_CUSTOMERS_SQL},
    kinds(k, template) AS (VALUES {_values(enumerate(SPAN_KINDS))}),
    names(m, statement, own, following) AS (VALUES {_values([(i, s, a, b) for i, (s, (a, b)) in enumerate(SPAN_NAMES.items())])}),
    dealt AS (SELECT c.*, CAST(page_num AS INTEGER) AS page_num, (doc_id * 31 + (page_num + doc_id % 5) // (1 + doc_id % 3) * 13 + doc_id // 7) % {len(SPAN_KINDS)} AS k FROM customers c, unnest(range(1, {SPAN_PAGES + 1})) AS u(page_num)),
    p AS (SELECT doc_id, page_num, statement, {_printed_sql("replace(replace(template, '{s}', own), '{n}', following)", "(amount + page_num)")} AS text FROM dealt JOIN kinds USING (k) JOIN names ON m = doc_id % 3),
    marks AS (SELECT *, contains(lower(text), '(continued)') AS goes_on, CASE statement {" ".join(f"WHEN '{s}' THEN {_matches('lower(text)', '|'.join(st.SPAN_TITLES[s]))}" for s in sr.STATEMENTS)} END AS titled,
        CASE statement {" ".join(f"WHEN '{s}' THEN {_matches('lower(text)', '|'.join(st.NEXT_STATEMENT[s]))}" for s in sr.STATEMENTS)} END AS opens FROM p)"""
_WALKED_SQL = f"""WITH RECURSIVE {_SPAN_SQL},
    back(doc_id, q) AS (SELECT doc_id, CAST(1 + doc_id % {SPAN_PAGES} AS INTEGER) FROM customers UNION ALL SELECT doc_id, q - 1 FROM back JOIN marks USING (doc_id) WHERE page_num = q AND goes_on AND q > 1),
    first AS (SELECT doc_id, min(q) AS q FROM back GROUP BY doc_id),
    earlier(doc_id, q, stop) AS (SELECT doc_id, q, false FROM first UNION ALL
        SELECT e.doc_id, q - 1, NOT b.goes_on FROM earlier e JOIN marks b ON b.doc_id = e.doc_id AND b.page_num = q - 1 JOIN marks c ON c.doc_id = e.doc_id AND c.page_num = q WHERE NOT stop AND b.titled AND (b.goes_on OR NOT c.goes_on)),
    starts AS (SELECT doc_id, min(q) AS a FROM earlier GROUP BY doc_id),
    onward(doc_id, a, q) AS (SELECT doc_id, a, a FROM starts UNION ALL
        SELECT o.doc_id, a, q + 1 FROM onward o JOIN marks m ON m.doc_id = o.doc_id AND m.page_num = q + 1 WHERE NOT opens AND q + 1 - a <= CASE statement {" ".join(f"WHEN '{s}' THEN {n}" for s, n in st.FOLLOWING.items())} END),
    spans AS (SELECT doc_id, a, max(q) AS b FROM onward GROUP BY doc_id, a)
    SELECT s.doc_id, statement, a AS start, b AS "end", string_agg(text, chr(10) ORDER BY page_num) AS text FROM spans s JOIN p ON p.doc_id = s.doc_id AND page_num BETWEEN a AND b GROUP BY ALL"""


def statement_texts(spark, sf_dir):
    """Each customer's statement from the page that its key names: back over continued pages, on to the next statement."""
    found = _span_pages(spark, sf_dir)
    starts = _customers(spark, sf_dir).select("doc_id", F.get(F.array(*map(F.lit, SPAN_NAMES)), (F.col("doc_id") % 3).cast("int")).alias("statement"), (1 + F.col("doc_id") % SPAN_PAGES).alias("page_num"))
    return st.statement_texts(found.drop("statement"), starts)


QUERIES["statement_texts"] = statement_texts
ORACLE_SQL["statement_texts"] = _WALKED_SQL
