"""The catalogue's queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

FIELD_LIST = "('revenue','income',0),('gross_profit','income',1),('operating_income','income',2),('net_income','income',3),('eps_basic','income',4),('total_assets','balance',5),('total_liabilities','balance',6),('total_equity','balance',7),('cash','balance',8),('cfo','cashflow',9),('cfi','cashflow',10),('cff','cashflow',11),('capex','cashflow',12)"

BASE = f"""
fields(field_id, statement, field_ord) AS (VALUES {FIELD_LIST}),
m AS (SELECT s_nationkey AS n, year(l_shipdate) AS y, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_quantity) AS BIGINT) AS q
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
w AS (SELECT n, y, CAST(sum(c*100) AS DOUBLE) AS revenue, CAST(sum(c*(100-d)) AS DOUBLE) AS gross_profit, CAST(sum(c*(100-d-t)) AS DOUBLE) AS operating_income, CAST(sum(c*(90-d-t)) AS DOUBLE) AS net_income,
    CAST(sum(q*1000) AS DOUBLE) / count(*) AS eps_basic, CAST(sum(c*100) AS DOUBLE) AS total_assets, CAST(sum(c*(100-d)) AS DOUBLE) AS total_liabilities, CAST(sum(c*d) AS DOUBLE) AS total_equity, CAST(sum(c*t) AS DOUBLE) AS cash,
    CAST(sum(c*(50-d)) AS DOUBLE) AS cfo, CAST(-sum(c*t) AS DOUBLE) AS cfi, CAST(-sum(c*d) AS DOUBLE) AS cff, CAST(-sum(c*2*t) AS DOUBLE) AS capex FROM m GROUP BY n, y),
long AS (UNPIVOT w ON revenue, gross_profit, operating_income, net_income, eps_basic, total_assets, total_liabilities, total_equity, cash, cfo, cfi, cff, capex INTO NAME field_id VALUE v),
official AS (SELECT 'N' || lpad(CAST(n AS VARCHAR), 2, '0') AS entity, field_id, y || '-12-31' AS period_end, y, n,
    floor(v / CASE WHEN field_id = 'eps_basic' THEN 10.0 ELSE 100000.0 END + 0.5) / 100.0 AS value FROM long),
keyed AS (SELECT o.*, o.n * 13 + o.y * 5 + f.field_ord * 7 AS k FROM official o JOIN fields f USING (field_id)),
document AS (SELECT entity, field_id, period_end, y, n, k, round(CASE WHEN k % 11 = 3 THEN value * 2 WHEN k % 13 = 4 THEN -value WHEN k % 17 = 5 THEN value + 0.4 ELSE value END, 2) AS value, CASE WHEN k % 2 = 0 THEN 'pdf_text' ELSE 'esef_grid' END AS source FROM keyed WHERE k % 7 <> 2)
"""

AGREE = """CASE WHEN field_id = 'eps_basic' THEN abs(x - d) <= 1.0 OR len(list_filter([2,3,4,5,6,8,10,12,20], lambda f: abs(x * f - d) <= 1.0 OR abs(x - d * f) <= 1.0)) > 0
    WHEN field_id = 'capex' THEN abs(abs(x) - abs(d)) <= greatest(1.0, greatest(abs(x), abs(d), 1.0) * 0.001)
    ELSE abs(x - d) <= greatest(1.0, greatest(abs(x), abs(d), 1.0) * 0.001) END"""


def _items(name: str, official: str, skip: str) -> str:
    return f"""
{name}_cells AS (SELECT p.entity, p.period_end, f.field_id, f.statement, f.field_ord FROM (SELECT DISTINCT entity, period_end FROM {official}) p CROSS JOIN fields f),
{name}_both AS (SELECT c.*, o.value AS x, e.value AS d, {skip} AS skip FROM {name}_cells c LEFT JOIN {official} o USING (entity, field_id, period_end) LEFT JOIN document e USING (entity, field_id, period_end)),
{name}_s AS (SELECT *, CASE WHEN x IS NOT NULL AND d IS NOT NULL THEN CASE WHEN {AGREE} THEN 'matched' ELSE 'mismatch' END WHEN skip THEN 'skipped' WHEN x IS NOT NULL THEN 'xbrl_only' WHEN d IS NOT NULL THEN 'pdf_only' ELSE 'both_missing' END AS status FROM {name}_both),
{name} AS (SELECT entity, field_ord, field_id, statement, period_end, x AS xbrl_value, d AS doc_value, status,
    CASE WHEN status = 'matched' THEN 'verified' WHEN status = 'mismatch' THEN 'review_required' WHEN status IN ('xbrl_only', 'pdf_only') THEN 'unverified' ELSE 'missing' END AS trust_level,
    round(d - x, 4) AS delta, CASE WHEN status NOT IN ('skipped', 'both_missing') THEN coalesce(x, d) END AS authoritative_value,
    CASE status WHEN 'matched' THEN 'xbrl_verified' WHEN 'mismatch' THEN 'xbrl_flagged' WHEN 'xbrl_only' THEN 'xbrl' WHEN 'pdf_only' THEN 'pdf_text' ELSE '' END AS authoritative_source FROM {name}_s)
"""


WHOLE = _items("items", "official", "false")
GAPS = """gaps AS (SELECT * FROM official WHERE NOT ((n + y) % 9 = 1)), """ + _items("items", "gaps", "((field_id = 'capex' AND CAST(substr(entity, 2, 2) AS INT) % 2 = 0) OR (field_id = 'cash' AND period_end = '1996-12-31'))")


def _report(keys: str, source: str = "items") -> str:
    return f"""SELECT {keys}, count(*) FILTER (status <> 'skipped') AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'xbrl_only') AS xbrl_only, count(*) FILTER (status = 'pdf_only') AS pdf_only,
    coalesce(round(count(*) FILTER (status = 'matched') / nullif(count(*) FILTER (status IN ('matched', 'mismatch')), 0)::DOUBLE, 4), 0.0) AS verification_rate,
    coalesce(round(sum(CASE status WHEN 'matched' THEN 10 WHEN 'xbrl_only' THEN 7 WHEN 'pdf_only' THEN 5 ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (status <> 'skipped') * 10, 0)::DOUBLE, 4), 0.0) AS trust_score,
    coalesce(round(count(*) FILTER (status IN ('matched', 'mismatch')) / nullif(count(*) FILTER (status <> 'skipped' AND xbrl_value IS NOT NULL), 0)::DOUBLE, 4), 0.0) AS coverage_rate
    FROM {source} GROUP BY {keys}"""


REPORT = f"report AS ({_report('entity')})"
PDF_ONLY = """pdf AS (SELECT c.entity, f.field_ord, f.field_id, c.period_end, d.value, d.source, CASE WHEN f.field_id = 'capex' AND CAST(substr(c.entity, 2, 2) AS INT) % 2 = 0 THEN 'skipped' WHEN d.value IS NULL THEN 'both_missing' ELSE 'pdf_only' END AS status
    FROM (SELECT DISTINCT entity, period_end FROM document) c CROSS JOIN fields f LEFT JOIN document d ON d.entity = c.entity AND d.period_end = c.period_end AND d.field_id = f.field_id)"""
IDENTITY = """ids AS (SELECT entity, period_end, max(value) FILTER (field_id = 'total_assets') AS a, max(value) FILTER (field_id = 'total_liabilities') AS l, max(value) FILTER (field_id = 'total_equity') AS e FROM document GROUP BY ALL HAVING a IS NOT NULL AND l IS NOT NULL AND e IS NOT NULL),
checks AS (SELECT entity, period_end, a AS assets, l + e AS claims, round(a - (l + e), 3) AS delta, round(abs(a - (l + e)) / greatest(abs(a), abs(l + e), 1.0), 6) AS delta_rel, abs(a - (l + e)) <= greatest(1.0, greatest(abs(a), abs(l + e), 1.0) * 0.001) AS passed FROM ids)"""
ERRORS = """errors AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS entity, k AS ord,
    CASE k % 4 WHEN 0 THEN 'Missing XBRL tag: ' || ['revenue', 'cash', 'capex', 'eps_basic', 'nothing'][k % 5 + 1] WHEN 1 THEN 'PDF extraction failed for: ' || ['revenue', 'cash', 'capex', 'eps_basic', 'nothing'][k % 3 + 1] WHEN 2 THEN 'Missing statement pages: cashflow' ELSE 'other trouble' END AS line
    FROM nation, unnest(range(n_nationkey, n_nationkey + 4)) AS u(k))"""
CELLS = """
l AS (SELECT l_orderkey, l_linenumber, sum(CAST(round(l_quantity) AS BIGINT)) AS q, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS p, sum(CAST(round(l_tax * 100) AS BIGINT)) AS t FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS row_no, 'line ' || l_linenumber AS label, q, p, t FROM l),
rr AS (SELECT * FROM r UNION ALL SELECT doc_id, max(row_no) + 1, 'Total', sum(q), sum(p), CASE WHEN doc_id % 60 = 0 THEN 0 ELSE sum(t) END FROM r GROUP BY doc_id),
base AS (SELECT doc_id, row_no, u.c AS col_no, ['item', 'qty', 'price', 'tax'][u.c + 1] AS header, CASE u.c WHEN 0 THEN label WHEN 1 THEN CAST(q AS VARCHAR) WHEN 2 THEN CAST(p AS VARCHAR) ELSE CAST(t AS VARCHAR) END AS text, CASE u.c WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN t END AS v FROM rr, (VALUES (0), (1), (2), (3)) u(c)),
cells AS (SELECT *, 'docling' AS engine FROM base UNION ALL SELECT doc_id, row_no, col_no, header, CASE WHEN (doc_id + row_no * 3 + col_no) % 11 <> 0 THEN text END, CASE WHEN (doc_id + row_no * 3 + col_no) % 11 <> 0 THEN v END, 'pdfplumber' FROM base)"""
AGREEMENT = """sets AS (SELECT engine, doc_id, header, list_distinct(list(text) FILTER (text IS NOT NULL)) AS s FROM cells WHERE row_no > 0 GROUP BY engine, doc_id, header),
cross_ AS (SELECT a.doc_id, avg(CASE WHEN len(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(a.s, []), coalesce(b.s, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))) END) AS agreement
    FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.header = b.header AND a.engine = 'docling' AND b.engine = 'pdfplumber' GROUP BY a.doc_id)"""
QUALITY = """quality AS (SELECT doc_id, engine, count(DISTINCT row_no) AS n_rows, count(DISTINCT col_no) AS n_cols, avg(CASE WHEN coalesce(trim(text), '') = '' THEN 0.0 ELSE 1.0 END) * sqrt((count(DISTINCT row_no) * count(DISTINCT col_no))::DOUBLE) AS score FROM cells GROUP BY ALL)"""
ENTRIES = """raw AS (SELECT c_nationkey AS n, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
entries AS (SELECT 'C' || lpad(CAST(n AS VARCHAR), 2, '0') AS entity, CASE WHEN n % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS tag, CASE WHEN q <> 4 THEN y || '-01-01' END AS start, y || CASE WHEN q = 3 THEN '-09-30' ELSE '-12-31' END AS "end", cents / 100.0 AS val, CASE WHEN q = 2 THEN 'Q2' ELSE 'FY' END AS fp, CASE q WHEN 1 THEN '10-K' WHEN 2 THEN '10-K/A' WHEN 3 THEN '10-Q' ELSE '20-F' END AS form, (y + 1) || '-0' || q || '-15' AS filed FROM raw),
annual AS (SELECT entity, tag, "end", val, form, filed FROM entries WHERE form IN ('10-K', '10-K/A', '20-F', '20-F/A') AND fp = 'FY' AND start IS NOT NULL AND date_diff('day', CAST(start AS DATE), CAST("end" AS DATE)) BETWEEN 340 AND 400)"""
CONFIDENCE = """c0 AS (SELECT doc_id, (doc_id % 5) / 4.0 AS cross_, (doc_id % 3) / 2.0 AS st, CASE WHEN doc_id % 4 = 0 THEN 0.3 ELSE 1.0 END AS nu, least(n_chars, 400) AS ch, doc_id % 2 = 0 AS has, doc_id % 7 = 0 AS merged, doc_id % 6 = 0 AS scanned FROM documents),
c1 AS (SELECT *, st::DOUBLE * 0.25::DOUBLE + cross_::DOUBLE * 0.25::DOUBLE + nu::DOUBLE * 0.2::DOUBLE + (CASE WHEN scanned THEN 0.6 ELSE 1.0 END)::DOUBLE * 0.15::DOUBLE + least(0.95::DOUBLE, 0.5::DOUBLE + ch / 200.0::DOUBLE) * 0.15::DOUBLE AS total FROM c0),
conf AS (SELECT doc_id, round(total, 3) AS score, total < 0.85 OR cross_ < 0.55 OR (merged AND st < 0.7) OR (scanned AND total < 0.9) OR (scanned AND NOT has) AS gated,
    list_filter([CASE WHEN cross_ < 0.55 THEN 'engines disagree' END, CASE WHEN nu < 0.7 THEN 'totals inconsistent' END, CASE WHEN scanned THEN 'scanned page' END, CASE WHEN ch <= 50 THEN 'little text' END, CASE WHEN merged AND st < 0.7 THEN 'merged cells' END, CASE WHEN scanned AND NOT has THEN 'scanned without tables' END], lambda x: x IS NOT NULL) AS reasons FROM c1)"""
GLYPHS = """chars AS (SELECT p_partkey % 25 AS doc_id, p_partkey AS line, i - 1 AS ord, substr(p_name, i, 1) AS text, i - 1 - length(replace(substr(p_name, 1, i - 1), ' ', '')) AS blanks FROM part, unnest(range(1, length(p_name) + 1)) AS u(i) WHERE substr(p_name, i, 1) <> ' '),
placed AS (SELECT *, CAST(ord * 8 + blanks * 40 AS DOUBLE) AS x0 FROM chars),
cuts AS (SELECT *, CASE WHEN x0 - lag(x0 + 8) OVER (PARTITION BY doc_id, line ORDER BY x0, ord) > 20 THEN 1 ELSE 0 END AS new FROM placed),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line ORDER BY x0, ord) AS word FROM cuts),
words AS (SELECT doc_id, line, CAST(word AS BIGINT) AS word, min(x0) AS x0, max(x0 + 8) AS x1, string_agg(text, '' ORDER BY x0, ord) AS text FROM numbered GROUP BY doc_id, line, word)"""


def _clusters(tolerance: float) -> str:
    return f"""k0 AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0, line, word) > {tolerance} THEN 1 ELSE 0 END AS new FROM words),
k1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY x0, line, word) AS INT) AS col FROM k0),
clusters AS (SELECT doc_id, col, avg(x0) AS center FROM k1 GROUP BY doc_id, col)"""


LABELS = "['Net income attributable to parent', 'Net income per share', 'Net earnings', 'Other income', 'Total revenue', 'Segment revenue']"
REMAP = """r AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS entity, strftime(o_orderdate, '%Y-%m-%d') AS p, o_totalprice AS value, o_orderkey AS ord FROM orders),
canon AS (SELECT entity, substr(p, 1, 4) AS y, coalesce(max(p) FILTER (substr(p, 6) IN ('12-31', '03-31', '06-30', '09-30')), max(p) FILTER (substr(p, 6) NOT IN ('01-01', '01-02', '01-03')), substr(p, 1, 4) || '-12-31') AS period_end, row_number() OVER (PARTITION BY entity ORDER BY substr(p, 1, 4) DESC) AS o FROM r GROUP BY entity, substr(p, 1, 4))"""

SQL: dict[str, str] = {
    "reconcile_nation_year": f"WITH {BASE}, {WHOLE} SELECT entity, period_end, xbrl_value, doc_value, status, trust_level, delta, authoritative_value, authoritative_source FROM items WHERE field_id = 'revenue'",
    "reconcile_all_fields": f"WITH {BASE}, {GAPS} SELECT * FROM items",
    "reconcile_report": f"WITH {BASE}, {GAPS} {_report('entity')}",
    "reconcile_pdf_only": f"WITH {BASE}, {PDF_ONLY} SELECT entity, field_ord, field_id, period_end, CASE WHEN status = 'pdf_only' THEN value END AS doc_value, status, CASE WHEN status = 'pdf_only' THEN 'verified' ELSE 'missing' END AS trust_level, CASE WHEN status = 'pdf_only' THEN source ELSE '' END AS authoritative_source FROM pdf",
    "pdf_only_report": f"WITH {BASE}, {PDF_ONLY} SELECT entity, round(count(*) FILTER (status = 'pdf_only')::DOUBLE / count(*) FILTER (status <> 'skipped'), 4) AS coverage_rate, round(sum(CASE WHEN status = 'pdf_only' THEN CASE WHEN source = 'pdf_text' THEN 1.0 ELSE 0.75 END ELSE 0.0 END)::DOUBLE / count(*) FILTER (status <> 'skipped'), 4) AS trust_score FROM pdf GROUP BY entity",
    "reconcile_orders_vs_lines": """WITH s AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS d FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS x, CAST(d AS BIGINT) AS d FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
        SELECT o_orderkey, x, d, CASE WHEN d IS NULL THEN 'xbrl_only' WHEN abs(x - d) * 20 <= greatest(x, d) THEN 'matched' ELSE 'mismatch' END AS status FROM j""",
    "verification_flags": f"WITH {BASE}, {GAPS} SELECT o.entity, o.field_id, o.period_end, o.value, CASE i.status WHEN 'matched' THEN true WHEN 'mismatch' THEN false END AS pdf_verified FROM official o LEFT JOIN items i USING (entity, field_id, period_end)",
    "trust_score_by_region": f"WITH {BASE}, {GAPS}, ri AS (SELECT i.*, r_name FROM items i JOIN nation ON i.entity = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') JOIN region ON n_regionkey = r_regionkey) {_report('r_name', 'ri')}",
    "production_ready_entities": f"WITH {BASE}, {GAPS}, {REPORT} SELECT entity, verification_rate, mismatch, verification_rate >= 0.7 AND mismatch = 0 AS production_ready FROM report",
    "identity_balance": f"WITH {BASE}, {IDENTITY} SELECT * FROM checks",
    "identity_pass_rate": f"WITH {BASE}, {IDENTITY} SELECT entity, count(*) FILTER (passed) AS pass_count, count(*) FILTER (NOT passed) AS fail_count, bool_and(passed) AS all_passed FROM checks GROUP BY entity",
    "skipped_fields": f"WITH fields(field_id, statement, field_ord) AS (VALUES {FIELD_LIST}), {ERRORS} SELECT DISTINCT e.entity, f.field_id FROM errors e JOIN fields f ON e.line = 'Missing XBRL tag: ' || f.field_id OR e.line = 'PDF extraction failed for: ' || f.field_id OR e.line = 'Missing statement pages: ' || f.statement",
    "skipped_cells": f"""WITH {BASE}, x AS (SELECT * FROM official WHERE NOT (y = 1997 AND field_id IN ('cfo', 'cfi'))),
        c AS (SELECT p.entity, f.field_id, p.period_end FROM (SELECT DISTINCT entity, period_end FROM official) p CROSS JOIN fields f),
        h AS (SELECT c.*, EXISTS (SELECT 1 FROM document d WHERE d.entity = c.entity AND d.field_id = c.field_id AND substr(d.period_end, 1, 4) = substr(c.period_end, 1, 4)) AS d, EXISTS (SELECT 1 FROM x WHERE x.entity = c.entity AND x.field_id = c.field_id AND substr(x.period_end, 1, 4) = substr(c.period_end, 1, 4)) AS x,
            EXISTS (SELECT 1 FROM document d WHERE d.entity = c.entity AND d.field_id = c.field_id) AS dd, EXISTS (SELECT 1 FROM x WHERE x.entity = c.entity AND x.field_id = c.field_id) AS xx FROM c)
        SELECT entity, field_id, period_end FROM h WHERE (dd AND NOT d AND (NOT xx OR x)) OR (xx AND NOT x AND d) OR ((dd OR xx) AND NOT d AND NOT x)""",
    "finalized_errors": f"""WITH {BASE}, {ERRORS}, have AS (SELECT DISTINCT entity, field_id FROM document WHERE NOT (field_id = 'cash' AND substr(entity, 3, 1) IN ('1', '4'))),
        skips AS (SELECT DISTINCT e.entity, f.field_id FROM errors e JOIN fields f ON e.line = 'Missing statement pages: ' || f.statement),
        kept AS (SELECT entity, line, min(ord) AS ord FROM errors e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.entity = e.entity AND e.line = 'PDF extraction failed for: ' || h.field_id) GROUP BY entity, line),
        added AS (SELECT e.entity, 'PDF extraction failed for: ' || f.field_id AS line, f.field_ord + 1000000 AS ord FROM (SELECT entity FROM errors UNION SELECT entity FROM document) e CROSS JOIN fields f WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.entity = e.entity AND h.field_id = f.field_id) AND NOT EXISTS (SELECT 1 FROM skips s WHERE s.entity = e.entity AND s.field_id = f.field_id)),
        whole AS (SELECT * FROM kept UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.entity = a.entity AND k.line = a.line))
        SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY ord, line) AS INT) AS ord, line FROM whole""",
    "portfolio_rollup": f"WITH {BASE}, {GAPS} SELECT n_regionkey, entity, count(*) AS items, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'mismatch') AS mismatch FROM items JOIN nation ON entity = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') GROUP BY ROLLUP (n_regionkey, entity)",
    "portfolio_summary": f"WITH {BASE}, {GAPS}, {REPORT} SELECT count(*) AS entities, count(*) FILTER (verification_rate >= 0.7 AND mismatch = 0) AS ready, round(CAST(sum(CAST(trust_score AS DECIMAL(10,4))) AS DOUBLE) / count(*), 3) AS avg_trust, CAST(sum(mismatch) AS BIGINT) AS mismatches FROM report",
    "tier_verdict": f"""WITH {BASE}, {GAPS}, t AS (SELECT ['A', 'B', 'C'][CAST(substr(entity, 2, 2) AS INT) % 3 + 1] AS tier, status FROM items WHERE status IN ('matched', 'mismatch')),
        g AS (SELECT tier, count(*) AS total, count(*) FILTER (status = 'matched') AS hits FROM t GROUP BY ROLLUP (tier))
        SELECT coalesce(tier, 'all') AS tier, total, hits, round(hits / total::DOUBLE, 4) AS rate, CASE WHEN hits / total::DOUBLE >= 0.9 THEN 'GO' WHEN hits / total::DOUBLE < 0.8 THEN 'STOP' ELSE 'HOLD' END AS verdict FROM g""",
    "eps_split_match": "WITH v AS (SELECT p_partkey, CAST(p_size * 10 AS DOUBLE) AS x, CAST(p_size * 10 * (p_partkey % 13) AS DOUBLE) AS d FROM part) SELECT p_partkey, abs(x - d) <= 1.0 OR len(list_filter([2,3,4,5,6,8,10,12,20], lambda f: abs(x * f - d) <= 1.0 OR abs(x - d * f) <= 1.0)) > 0 AS agrees FROM v",
    "capex_magnitude_match": f"WITH {BASE} SELECT o.entity, o.period_end, abs(abs(o.value) - abs(d.value)) <= greatest(1.0, greatest(abs(o.value), abs(d.value), 1.0) * 0.001) AS agrees FROM official o JOIN document d USING (entity, field_id, period_end) WHERE field_id = 'capex'",
    "align_periods": f"WITH {BASE}, c AS (SELECT entity, period_end FROM official INTERSECT SELECT entity, period_end FROM document), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS INT) AS ord FROM c) SELECT * FROM r WHERE ord <= 3",
    "authoritative_pivot": f"WITH {BASE}, {GAPS} SELECT entity, field_id, " + ", ".join(f"max(authoritative_value) FILTER (period_end = '{y}-12-31') AS y{y}" for y in range(1995, 2002)) + " FROM items GROUP BY entity, field_id",
    "canonical_periods": """WITH d AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS entity, year(o_orderdate) || ['-12-31', '-01-01', '-06-30'][o_orderkey % 3 + 1] AS p FROM orders JOIN customer ON o_custkey = c_custkey),
        y AS (SELECT entity, substr(p, 1, 4) AS year, coalesce(max(p) FILTER (substr(p, 6) IN ('12-31', '03-31', '06-30', '09-30')), max(p) FILTER (substr(p, 6) NOT IN ('01-01', '01-02', '01-03')), substr(p, 1, 4) || '-12-31') AS period_end FROM d GROUP BY entity, substr(p, 1, 4)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS INT) AS ord FROM y) SELECT * FROM r WHERE ord <= 3""",
    "remap_facts_to_canonical": f"""WITH {REMAP}, j AS (SELECT r.entity, c.period_end, r.value, row_number() OVER (PARTITION BY r.entity, c.period_end ORDER BY substr(r.p, 6) IN ('12-31', '03-31', '06-30', '09-30') DESC, r.ord) AS n FROM r JOIN canon c ON r.entity = c.entity AND substr(r.p, 1, 4) = c.y AND c.o <= 3)
        SELECT entity, 'revenue' AS field_id, period_end, value FROM j WHERE n = 1""",
    "annual_filter": f"WITH {ENTRIES} SELECT * FROM annual",
    "dedupe_latest_filed": f"WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, tag, \"end\" ORDER BY filed DESC, coalesce(start, '') , val) AS n FROM entries) SELECT entity, \"end\", val, form, filed FROM r WHERE n = 1",
    "pick_tag_entries": f"WITH {ENTRIES}, d AS (SELECT *, row_number() OVER (PARTITION BY entity, tag, \"end\" ORDER BY filed DESC) AS n FROM annual), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY \"end\" DESC) AS INT) AS rank FROM d WHERE n = 1) SELECT entity, tag, \"end\", val, rank FROM r WHERE rank <= 3",
    "unit_preference": """WITH r AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS entity, o_orderpriority AS tag, ['EUR', 'CNY', 'USD', 'GBP'][o_orderkey % 4 + 1] AS unit FROM orders), b AS (SELECT entity, tag, arg_min(unit, (CASE unit WHEN 'CNY' THEN 0 WHEN 'USD' THEN 1 ELSE 2 END, unit)) AS unit FROM r GROUP BY ALL) SELECT entity, tag, unit, count(*) AS n FROM r JOIN b USING (entity, tag, unit) GROUP BY ALL""",
    "derive_liabilities": f"""WITH {BASE}, s AS (SELECT entity, period_end, max(value) FILTER (field_id = 'total_assets') AS a, max(value) FILTER (field_id = 'total_equity') AS e, max(value) FILTER (field_id = 'total_liabilities' AND period_end > '1996') AS l FROM official GROUP BY ALL),
        p AS (SELECT entity, period_end, a - e AS q, floor(l * 40) / 100 + floor(l * 60) / 100 AS s FROM s)
        SELECT entity, period_end, round(CASE WHEN s IS NULL OR abs(q - s) > greatest(1.0, abs(q) * 0.02) THEN q ELSE s END, 2) AS liabilities FROM p WHERE q IS NOT NULL OR s IS NOT NULL""",
    "fiscal_calendar": """WITH r AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE o_orderkey % 5 WHEN 0 THEN 'December 31, ' || year(o_orderdate) WHEN 1 THEN 'FY ' || year(o_orderdate) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS label, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS power FROM orders)
        SELECT CAST(y AS INT) AS y, arg_max(label, (power, -o_orderkey)) AS label, max(power) AS power FROM r GROUP BY y""",
    "period_headers": "WITH r AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS a FROM orders), d AS (SELECT *, CAST(a - INTERVAL 12 MONTH AS DATE) AS b FROM r) SELECT o_orderkey, CASE WHEN month(a) = 1 AND day(a) <= 3 THEN year(a) || '-12-31,' || (year(a) - 1) || '-12-31' ELSE a || ',' || b END AS found FROM d",
    "parse_amounts_roundtrip": "WITH v AS (SELECT o_orderkey, floor(o_totalprice) AS v FROM orders) SELECT o_orderkey, CASE WHEN v < 100 THEN NULL WHEN o_orderkey % 3 = 0 THEN -v ELSE v END AS amount FROM v",
    "amount_pair_split": "SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS a, CAST(p_partkey AS DOUBLE) AS b FROM part",
    "stutter_repair": "SELECT p_partkey, p_name AS repaired FROM part",
    "label_normalize": "SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS label FROM part",
    "number_density_pages": "SELECT page_id, CAST(len(regexp_extract_all(html, '[0-9]+')) AS INT) AS numbers, CAST((length(html) - length(replace(html, '<li>', ''))) / 4 AS INT) AS items, CAST(length(html) AS INT) AS size FROM pages",
    "html_block_scores": r"""WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
        SELECT page_id, CAST(length(t) AS INT) AS shown_chars, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS INT) AS paragraphs, CAST((length(html) - length(replace(html, '<a ', ''))) / 3 AS INT) AS links FROM b""",
    "table_structure_score": f"""WITH {CELLS}, n AS (SELECT doc_id, engine, max(row_no) + 1 AS n FROM cells GROUP BY ALL), w AS (SELECT c.*, CASE WHEN row_no < CASE WHEN n > 10 THEN 5 ELSE 3 END THEN 5 WHEN row_no >= n - 2 THEN 7 ELSE 10 END AS w FROM cells c JOIN n USING (doc_id, engine))
        SELECT doc_id, engine, round(1.0 - least(2.0 * sum(CASE WHEN text IS NULL THEN w ELSE 0 END)::DOUBLE / sum(w), 0.5), 6) AS structure FROM w GROUP BY ALL""",
    "numeric_consistency": f"WITH {CELLS}, b AS (SELECT doc_id, label, row_no, t, max(abs(t)) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM rr) SELECT doc_id, CASE WHEN bool_or(label = 'Total' AND abs(t) < 0.01 AND coalesce(most, 0) >= 0.01) THEN 0.3 ELSE 1.0 END::DOUBLE AS numeric FROM b GROUP BY doc_id",
    "cross_engine_jaccard": f"WITH {CELLS}, {AGREEMENT} SELECT doc_id, round(agreement, 6) AS agreement FROM cross_",
    "table_quality": f"WITH {CELLS}, {QUALITY} SELECT doc_id, engine, n_rows, n_cols, round(score, 6) AS score FROM quality",
    "merge_best_table": f"WITH {CELLS}, {AGREEMENT}, {QUALITY}, ranked AS (SELECT q.doc_id, q.engine, row_number() OVER (PARTITION BY q.doc_id ORDER BY q.score DESC, CASE WHEN (q.engine = 'docling') = (coalesce(c.agreement, 1.0) >= 0.85) THEN 0 ELSE 1 END) AS n FROM quality q LEFT JOIN cross_ c USING (doc_id)) SELECT doc_id, engine FROM ranked WHERE n = 1",
    "total_row_check": f"""WITH {CELLS}, s AS (SELECT doc_id, row_no, label, q, p, t, sum(q) OVER o AS sq, sum(p) OVER o AS sp, sum(t) OVER o AS st FROM rr WINDOW o AS (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id, row_no, CAST((q = sq)::INT + (p = sp)::INT + (t = st)::INT AS BIGINT) AS matched, 3::BIGINT AS numeric FROM s WHERE label = 'Total' AND 2 * ((q = sq)::INT + (p = sp)::INT + (t = st)::INT) >= 3""",
    "column_summary": f"WITH {CELLS} SELECT doc_id, col_no, round(CAST(sum(v) AS DOUBLE), 2) AS total, round(CAST(sum(v) AS DOUBLE) / count(v), 2) AS mean FROM base WHERE col_no > 0 GROUP BY ALL HAVING count(v) >= 2",
    "page_confidence": f"WITH {CONFIDENCE} SELECT doc_id, score, gated, CAST(len(reasons) AS INT) AS n_reasons FROM conf",
    "page_risk_reasons": f"WITH {CONFIDENCE}, e AS (SELECT doc_id, score, unnest(reasons) AS reason FROM conf), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY score, doc_id) AS n FROM e) SELECT reason, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 3) AS worst, count(*) AS pages FROM r GROUP BY reason",
    "page_type_classify": "SELECT page_id, CASE WHEN length(html) % 100 < 10 AND ((page_id % 10) / 10.0 > 0.3 OR (length(html) % 13) / 1000.0 < 0.001) THEN 'scanned' WHEN length(html) % 100 > 50 AND (length(html) % 13) / 1000.0 > 0.001 THEN 'text_native' ELSE 'mixed' END AS page_type FROM pages",
    "grid_unpivot_facts": f"WITH {BASE} SELECT entity AS doc_id, CASE field_id WHEN 'cash' THEN 0 ELSE 1 END AS row_no, field_id AS label, period_end, value FROM official WHERE field_id IN ('revenue', 'cash')",
    "segment_totals": """WITH r AS (SELECT o_custkey % 30 AS doc_id, o_orderkey AS row_no, o_orderkey % 7 = 0 AS tot, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders),
        s AS (SELECT *, coalesce(sum(tot::INT) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM r)
        SELECT doc_id, max(row_no) FILTER (tot) AS row_no, CAST(sum(value) FILTER (NOT tot) AS BIGINT) AS part_sum, max(value) FILTER (tot) AS stated FROM s GROUP BY doc_id, seg HAVING max(row_no) FILTER (tot) IS NOT NULL""",
    "feedback_corrections": f"WITH {CELLS}, e AS (SELECT event_id % 500 * 20 AS doc_id, CAST(event_id % 3 + 1 AS INT) AS row_no, CAST(user_id % 4 AS INT) AS col_no, arg_max(event_type, (ts, event_type)) AS text FROM events GROUP BY 1, 2, 3) SELECT b.doc_id, b.row_no, b.col_no, e.text FROM base b JOIN e USING (doc_id, row_no, col_no)",
    "word_islands": f"WITH {GLYPHS} SELECT * FROM words",
    "column_clusters": f"WITH {GLYPHS}, {_clusters(40.0)} SELECT doc_id, col, round(center, 6) AS center FROM clusters",
    "nearest_column": f"WITH {GLYPHS}, {_clusters(40.0)} SELECT w.doc_id, w.line, CAST(w.word AS INT) AS word, w.text, arg_min(c.col, (abs(w.x0 - c.center), c.col)) AS col FROM words w JOIN clusters c ON w.doc_id = c.doc_id GROUP BY w.doc_id, w.line, w.word, w.text, w.x0",
    "locate_pages_topk": r"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), pg AS (SELECT doc_id, CAST(i + 1 AS INT) AS page_num, array_to_string(p[i * 5 + 1 : i * 5 + 5], chr(10)) AS text FROM parts, unnest(range(0, CAST(ceil(len(p) / 5.0) AS BIGINT))) AS u(i)),
        titles(statement, pattern, strength) AS (VALUES ('income', 'the and', 3), ('income', 'that is', 1), ('balance', 'of the', 2)),
        h AS (SELECT doc_id, page_num, statement, length(text) AS density, strength, instr(lower(substr(text, 1, 1500)), pattern) AS pos FROM pg, titles),
        b AS (SELECT doc_id, page_num, statement, density, max((strength, -pos)) AS b FROM h WHERE pos > 0 GROUP BY ALL),
        s AS (SELECT doc_id, statement, page_num, CAST(density + floor(greatest(0, 500 + b[2]) / 2.0) + b[1] * 50 AS INT) AS score FROM b),
        r AS (SELECT *, max(score) OVER (PARTITION BY doc_id, statement) AS best FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, statement ORDER BY page_num) AS n FROM r WHERE score >= best * 0.92) SELECT doc_id, statement, page_num, score FROM k WHERE n <= 2""",
    "usage_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY ALL",
    "rate_limit_stateful": """WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE ts IS NOT NULL),
        passed(user_id, r, ts) AS (SELECT user_id, r, ts FROM o WHERE r = 1 UNION ALL
            SELECT p.user_id, min(o.r), arg_min(o.ts, o.r) FROM passed p JOIN o ON o.user_id = p.user_id AND o.r > p.r AND o.ts > p.ts + INTERVAL 3600 SECONDS GROUP BY p.user_id),
        n AS (SELECT user_id, count(*) AS accepted FROM passed GROUP BY user_id)
        SELECT user_id, accepted, count(*) - accepted AS rejected FROM o JOIN n USING (user_id) GROUP BY user_id, accepted""",
    "rate_limit_sliding": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events",
    "session_usage": """WITH l AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM l)
        SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""",
    "log_summary": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "label_prefixes": "SELECT o_orderkey, 'Total revenue ' AS label FROM orders",
    "cell_amounts": "WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -round_even(o_totalprice, 0) WHEN 1 THEN round_even(o_totalprice, 0) ELSE CAST(o_orderkey AS DOUBLE) END AS v FROM orders) SELECT o_orderkey, CASE WHEN abs(v) >= 1000 THEN v END AS amount FROM v",
    "repaired_parentheses": "SELECT p_partkey, p_name || '|(' || p_size || p_partkey || ')||x' AS cells FROM part",
    "spilled_amounts": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'row|' || p_size || '|' || p_partkey ELSE 'row|$ ' || p_size || ' $ ' || p_partkey || '|9' END AS cells FROM part",
    "period_columns": "WITH v AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 2 = 0 AS e FROM orders) SELECT o_orderkey, CAST(CASE y WHEN 1997 THEN 0 WHEN 1996 THEN CASE WHEN e THEN 2 ELSE 1 END WHEN 1995 THEN 3 END AS INT) AS col FROM v",
    "equity_tag_refine": f"""WITH {BASE}, t(tag, tag_ord) AS (VALUES ('Equity', 0), ('EquityAll', 1), ('Other', 2)), c AS (SELECT o.entity, o.period_end, t.tag, t.tag_ord, o.value * CASE t.tag_ord WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN o.y % 2 = 0 THEN 1.0 ELSE 3.0 END ELSE 2.0 END AS value FROM official o, t WHERE field_id = 'total_equity'),
        g AS (SELECT c.entity, c.tag, c.tag_ord, count(*) AS agreements FROM c JOIN document d ON d.entity = c.entity AND d.field_id = 'total_equity' AND d.period_end = c.period_end WHERE abs(c.value - d.value) <= greatest(1.0, greatest(abs(c.value), abs(d.value), 1.0) * 0.001) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY agreements DESC, tag_ord) AS k FROM g) SELECT entity, tag, agreements FROM ranked WHERE k = 1""",
    "truth_hits": f"WITH {BASE} SELECT o.entity, count(*) AS total, count(*) FILTER (abs(d.value - o.value) < 1.0) AS hits FROM official o LEFT JOIN document d USING (entity, field_id, period_end) GROUP BY o.entity",
    "field_coverage": f"WITH {BASE} SELECT entity, count(*) AS filled, round(count(*) / 91.0::DOUBLE, 4) AS coverage FROM document GROUP BY entity",
    "merged_grids": "WITH r AS (SELECT CAST(p_partkey % 10 AS INT) AS doc_id, p_partkey AS grid_ord, p_name AS label, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS filled FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(label)) ORDER BY filled DESC, grid_ord) AS n FROM r) SELECT doc_id, label, grid_ord, CAST(filled AS INT) AS filled FROM k WHERE n = 1",
    "page_signals": r"""WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), pg AS (SELECT doc_id, CAST(i + 1 AS INT) AS page_num, array_to_string(p[i * 5 + 1 : i * 5 + 5], chr(10)) AS text FROM parts, unnest(range(0, CAST(ceil(len(p) / 5.0) AS BIGINT))) AS u(i)), s(statement, pattern, points) AS (VALUES ('a', 'the', 1000), ('a', '100', -5000), ('b', 'ing', 300))
        SELECT doc_id, page_num, statement, CAST(sum(points) AS BIGINT) AS score FROM pg JOIN s ON contains(text, pattern) GROUP BY ALL""",
    "document_sections": """WITH p AS (SELECT u.i, string_split(coalesce(text, ''), chr(10))[5 * u.i + 1 : 5 * u.i + 5] AS lines FROM documents, unnest(range(0, CAST(ceil(len(string_split(coalesce(text, ''), chr(10))) / 5.0) AS BIGINT))) AS u(i)),
        v AS (SELECT array_to_string(lines, chr(10)) AS t FROM p), h AS (SELECT lower(substr(t, 1, 150)) AS h, length(t) AS n_chars FROM v),
        c AS (SELECT CASE WHEN contains(h, 'the') THEN 'the' WHEN contains(h, 'der') THEN 'der' WHEN contains(h, 'le') THEN 'le' ELSE 'other' END AS section, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM h GROUP BY 1)
        SELECT section, n, chars, round(n / sum(n) OVER (), 6) AS page_share, round(chars / sum(chars) OVER (), 6) AS char_share FROM c""",
    "company_facts_extract": f"""WITH {ENTRIES}, d AS (SELECT *, row_number() OVER (PARTITION BY entity, tag, "end" ORDER BY filed DESC) AS n FROM annual), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY "end" DESC) AS r FROM d WHERE n = 1)
        SELECT entity, 'revenue' AS field_id, "end" AS period_end, round(val / 1e6 * 1e6, 2) AS value, 'USD' AS currency, 'US-GAAP' AS standard, tag FROM k WHERE r <= 3""",
    "company_facts_errors": f"WITH fields(field_id, statement, field_ord) AS (VALUES {FIELD_LIST}) SELECT 'Missing XBRL tag: ' || field_id AS line, (SELECT count(DISTINCT c_nationkey) FROM customer JOIN orders ON o_custkey = c_custkey) AS entities FROM fields WHERE field_id <> 'revenue'",
    "industry_skips": "WITH u(code, field_id) AS (VALUES ('0005', 'gross_profit'), ('0005', 'operating_income'), ('0005', 'capex'), ('0700', 'gross_profit'), ('2318', 'gross_profit'), ('2318', 'operating_income'), ('2318', 'capex'), ('0883', 'gross_profit'), ('0883', 'operating_income'), ('1211', 'gross_profit')) SELECT * FROM u",
}
