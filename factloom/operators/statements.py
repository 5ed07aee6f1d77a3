"""Statement pages of reports: page checks by rule trees, and location in phases for three markets in one plan.

All phases are rows of one frame of candidates: (document, statement, step, page, score, ranks). A
step is a phase, or a phase within one of the document's search ranges. Of each step the best page
stays, and of a document's statement the first step that has one, so that a later phase decides
only what no earlier one settled. Markets other than the first check what the common phases found
with their own rules before their own phases count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import pages, rules
from factloom.functions import statement_rules as sr
from factloom.functions.labels import cash_statement_complete
from factloom.functions.numbers import spaced_density, table_density
from factloom.functions.periods import let
from factloom.functions.quick import quick
from factloom.operators import locate

#: Characters of a page that any rule reads; of its head, by which pages are ranked.
READ, NEAR_HEAD = 4000, 900
#: How far into a page a statement's opening title may stand; how far European titles are looked for.
OPENS_WITHIN = {"income": 220, "balance": 160, "cashflow": 220}
EU_SCAN, EU_UNTITLED_HEAD = 870, 600
#: An untitled page's least score; the share of the best score that counts as about the same; characters of the Hong Kong fallback.
UNTITLED_LEAST, ABOUT_THE_SAME, HK_HEAD = 40, 0.92, 1200


#: Titles that a page must have to be one statement's earlier page, what opens the next statement, and how many pages may follow the first.
SPAN_TITLES = {
    "income": (r"statements?\s+of\s+operations", r"statements?\s+of\s+comprehensive\s+income", r"statements?\s+of\s+comprehensive\s+loss", r"consolidated\s+income\s+statements?"),
    "balance": (r"consolidated\s+balance\s+sheets?", r"statements?\s+of\s+financial\s+position"),
    "cashflow": (r"statements?\s+of\s+cash\s+flows?",),
}
NEXT_STATEMENT = {
    "income": (r"\bbalance sheets?\b", r"statements?\s+of\s+financial\s+position", r"综合(?:财务)?状况表", r"资产负债表", r"december 31,\s+\d{4}.{0,120}intangible assets", r"total non-current assets", r"statements of cash flows?", r"changes in (?:shareholders?.?\s+equity|stockholders?.?\s+equity)", r"statement of changes in equity"),
    "balance": (r"consolidated statements of cash flows?", r"\bcash flows?\s+statements?\b", r"\bcash flows?\s+from\s+operating", r"consolidated\s+statements?\s+of\s+comprehensive\s+income", r"statements?\s+of\s+operations"),
    "cashflow": (r"notes to consolidated", r"see accompanying notes"),
}
CONTINUED, SPAN_HEAD, MARK_HEAD = r"\(continued\)", 600, 400
FOLLOWING = {"income": 4, "balance": 4, "cashflow": 6}


@dataclass(frozen=True)
class Phase:
    """Candidates of one kind: titles or none, least density, whole document or search ranges, and how the best page is chosen ('near': ranks among about equal scores; 'best': score, then place)."""

    number: int
    market: str
    kind: str
    ranged: bool
    least: int = 0
    choose: str = "near"
    titles: dict | None = None


COMMON = (
    Phase(1, "us", "titles", False, 8, "near", sr.STRICT),
    Phase(2, "us", "titles", True, 4, "near", sr.REPORT),
    Phase(3, "us", "untitled", True, UNTITLED_LEAST, "best"),
)
OWN = {
    "us": (),
    "hk": (Phase(4, "hk", "titles", True, 4, "best", sr.merged(sr.REPORT, sr.HONG_KONG)), Phase(5, "hk", "named", False, 0, "best", sr.HONG_KONG)),
    "eu": (Phase(6, "eu", "titles", True, 4, "near", sr.merged(sr.REPORT, sr.HONG_KONG, sr.FRENCH)), Phase(7, "eu", "untitled", True, UNTITLED_LEAST, "best")),
}
FIRST_OWN = 4


def opening(page: Column, statement: str, market: str) -> Column:
    """Where the earliest opening title stands near a page's head (from 0), null without one.

    Outside Europe a heading "table of contents" is left out of the count, and mentions in running text don't count.
    """
    patterns = (sr.EUROPE_OPENING if market == "eu" else sr.OPENING)[statement]
    any_of = quick("|".join(patterns))
    if market == "eu":
        return F.nullif(F.regexp_instr(F.substring(page, 1, EU_SCAN), F.lit(any_of)), F.lit(0)) - 1
    most = OPENS_WITHIN[statement]
    scan = F.regexp_replace(F.substring(page, 1, most + 120), r"^table of contents\s+", "")

    def place(whole: Column) -> Column:
        part = F.substring(whole, 1, most + 80)

        def spot(p: str) -> Column:
            tail = lambda at: F.substring(whole, at + F.length(F.regexp_extract(part, p, 0)), F.lit(48))
            return let(F.regexp_instr(part, F.lit(quick(p))), lambda at: F.when(at.between(1, most + 1) & ~tail(at).rlike(pages.MENTIONED), at - 1))

        # most pages hold none of them
        return F.when(part.rlike(any_of), F.array_min(F.array(*map(spot, patterns))))

    return let(scan, place)


def texts_of(statement: str, market: str) -> dict[str, Column]:
    """The columns of read_pages() that a rule tree reads."""
    at = opening_column(statement, market)
    return {"page": F.col("page"), "title": F.col(f"{at}_title"), "before": F.col(f"{at}_before")}


def opening_column(statement: str, market: str) -> str:
    return f"at_{statement}_{'eu' if market == 'eu' else 'us'}"


def read_pages(found: DataFrame, prefilter: bool = False) -> DataFrame:
    """Pages (doc_id, market, page_num, text) with plain, low and page (one line, lower-cased, and its part that rules read), head and places of opening titles.

    Opening titles of Europe are looked for in its pages alone; with prefilter all of them only where the
    columns may_us and may_eu say that one of the markets' rules may hold.
    """
    rows = found.select("doc_id", "market", "page_num", "text", pages.page_text(F.col("text")).alias("plain")).withColumn("low", F.lower("plain"))
    rows = rows.withColumns({"page": F.substring("low", 1, READ), "head": F.substring("low", 1, pages.HEAD)})
    own = {"us": F.col("market").isin(*sr.MARKETS), "eu": F.col("market") == "eu"}
    if prefilter:
        rows = rows.withColumns({f"may_{m}": F.coalesce(own[m] & may_hold(F.col("page"), m), F.lit(False)) for m in own})
        own = {m: F.col(f"may_{m}") for m in own}
    kinds = {opening_column(s, m): F.when(own[m], opening(F.col("page"), s, m)) for m in own for s in sr.STATEMENTS}
    parts = {}
    for at in kinds:
        parts[f"{at}_title"] = F.when(F.col(at).isNotNull(), F.substring("page", F.col(at) + 1, F.lit(READ)))
        parts[f"{at}_before"] = F.when(F.col(at).isNotNull(), pages.without_head_noise(F.substring("page", F.lit(1), F.col(at))))
    return rows.withColumns(kinds).withColumns(parts)


def may_hold(page: Column, market: str) -> Column:
    """False only where none of a market's rules holds: one pattern of what its pages must have."""
    titles = sr.EUROPE_OPENING if market == "eu" else sr.OPENING
    each = [rules.needed(sr.RULES[market][s], titles[s]) for s in sr.STATEMENTS]
    return page.rlike(quick("|".join(dict.fromkeys(p for own in each for p in own)))) if all(each) else F.lit(True)


def check_pages(found: DataFrame) -> DataFrame:
    """(doc_id, market, page_num, statement, valid, failing): whether a page may be that statement by its market's rules, and else the first rule that fails. Pages of other markets are left out; a null text is an empty page."""
    rows = read_pages(found.where(F.col("market").isin(*sr.MARKETS)))
    each = []
    for s in sr.STATEMENTS:
        by_market = [(m, sr.RULES[m][s], texts_of(s, m)) for m in sr.MARKETS]
        failing = F.coalesce(*(F.when(F.col("market") == m, rules.failing(tree, texts)) for m, tree, texts in by_market))
        each.append(F.struct(F.lit(s).alias("statement"), failing.alias("failing")))
    out = rows.select("doc_id", "market", "page_num", F.explode(F.array(*each)).alias("x"))
    return out.select("doc_id", "market", "page_num", "x.statement", F.col("x.failing").isNull().alias("valid"), "x.failing")


def _title_patterns(market: str, s: str) -> tuple[str, ...]:
    """All titles of the phases that read pages as this market's; Hong Kong's are those that the common phases don't have."""
    common = sr.merged(sr.STRICT, sr.REPORT)[s]
    return {"us": common, "hk": tuple(p for p in sr.merged(sr.REPORT, sr.HONG_KONG)[s] if p not in common), "eu": OWN["eu"][0].titles[s]}[market]


def _title_places(market: str, s: str) -> Column:
    """(weak, pos) in a page's head for each of _title_patterns(), null where the title isn't valid; Europe's are never too low on the page, and strong where they say consolidated."""
    head, spots = F.col("head"), []
    for p in _title_patterns(market, s):
        if market == "eu":
            at = F.regexp_instr(head, F.lit(p))
            tail = F.substring(head, at + F.length(F.regexp_extract(head, p, 0)), F.lit(48))
            spots.append(F.when((at > 0) & ~tail.rlike(pages.MENTIONED), F.struct(F.lit(-3 if "consolid" in p else -2).alias("weak"), (at - 1).alias("pos"))))
        else:
            spots.append(pages.weak_title(head, p))
    return F.array(*spots)


def _titled(phase: Phase, s: str) -> Column:
    """(weak, pos) of the best title of a phase: the strongest, the first of equals; null without one."""
    places = {p: (m, i) for m in (("eu",) if phase.market == "eu" else ("us", "hk")) for i, p in enumerate(_title_patterns(m, s))}
    return F.array_min(F.array(*(F.get(f"titles_{m}_{s}", F.lit(i)) for m, i in (places[p] for p in phase.titles[s]))))


def _score(phase: Phase, s: str) -> Column:
    """A page's score in a phase, null where it is no candidate; validity apart."""
    density = F.col(f"{'eu' if phase.market == 'eu' else 'us'}_density")
    if phase.kind == "titles":
        bonus = lambda t: F.floor(F.greatest(F.lit(0), pages.TITLE_ZONE - t["pos"]) / 2) - t["weak"] * 50
        return F.when(~F.col("excluded") & (density >= phase.least), density + let(_titled(phase, s), bonus))
    if phase.kind == "named":
        head = F.substring("page", 1, HK_HEAD)
        return F.when(~F.col("excluded") & head.rlike(quick("|".join(phase.titles[s]))), F.regexp_count(F.col("text"), F.lit(quick(sr.GROUPED))))
    points = [F.when(F.substring("page", 1, n).rlike(quick(p)), k).otherwise(0) for p, n, k in sr.BONUS[phase.market][s]]
    if s == "cashflow":
        (a, n), (b, m) = sr.BOTH[phase.market]
        points.append(F.when(F.substring("page", 1, n).rlike(a) & F.substring("page", 1, m).rlike(b), 150).otherwise(0))
    total = density + sum(points, F.lit(0))
    return F.when(~F.col("eu_excluded" if phase.market == "eu" else "excluded"), let(total, lambda n: F.when(n >= phase.least, n)))


def _ranks(market: str, s: str) -> list[Column]:
    """What comes last among pages of about the same score, as 0 or 1 each."""
    zone = lambda n: F.substring("page", 1, n)
    if market == "eu":
        company, contents = sr.EU_NO_PRIMARY[0].pattern, sr.EU_NO_PRIMARY[3].pattern
        plain = ~zone(750).rlike(sr.CONSOLIDATED_HEAD)
        tests = [zone(600).rlike(company), zone(NEAR_HEAD).rlike(contents), plain & ~zone(700).rlike(sr.EU_WORDS) if s != "cashflow" else plain]
    else:
        goes_on = ~zone(500).rlike(sr.PRIMARY_HEAD) if s != "cashflow" else F.lit(False)
        alone = zone(500).rlike(r"comprehensive\s+income") & ~zone(3000).rlike(quick(sr.REVENUE_BODY)) if s == "income" else F.lit(False)
        tests = [zone(500).rlike(sr.NOTES_HEAD), goes_on, alone]
    return [t.cast("int") for t in tests]


def _any(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n), F.lit(False)) for n in names])


def _shared(market_rules: dict) -> tuple:
    """The parts that all statements' trees of a market have."""
    first, *others = market_rules.values()
    return tuple(p for p in first.parts if all(p in tree.parts for tree in others))


def _valid_pages(rows: DataFrame) -> DataFrame:
    """read_pages() with us_, hk_ and eu_ by statement: whether a market's rules take the page; of other markets than a page's own, only the common ones (us) are worked out.

    What a statement asks for comes first; what the statements have in common is read once, of pages that passed.
    """
    for m, trees in (("us", sr.US_RULES), ("eu", sr.EU_RULES)):
        own = {f"{m}_has_{s}": F.col(f"may_{m}") & rules.holds(rules.All(s, tuple(reversed([p for p in trees[s].parts if p not in _shared(trees)]))), texts_of(s, m)) for s in sr.STATEMENTS}
        rows = rows.withColumns(own).withColumn(f"{m}_rest", F.when(_any(list(own)), rules.holds(rules.All("shared", _shared(trees)), {"page": F.col("page")})))
        valid = {s: F.coalesce(F.col(f"{m}_has_{s}") & F.col(f"{m}_rest"), F.lit(False)) for s in sr.STATEMENTS}
        rows = rows.withColumns({f"{m}_{s}": v if m == "us" else F.when(F.col("market") == "eu", v) for s, v in valid.items()})
    # Hong Kong's are the common ones and two more
    more = rules.holds(rules.All("more", sr.HK_RULES["income"].parts[:2]), {"page": F.col("page")})
    rows = rows.withColumn("hk_more", F.when((F.col("market") == "hk") & _any([f"us_{s}" for s in sr.STATEMENTS]), more))
    return rows.withColumns({f"hk_{s}": F.when(F.col("market") == "hk", F.col(f"us_{s}") & F.col("hk_more")) for s in sr.STATEMENTS})


def marked_pages(found: DataFrame) -> DataFrame:
    """(doc_id, page_num, index, audit, found): whether a page names an index or is an audit report, and, as an array of (market, page_num, statement, phase, ranged, choose, score, own_valid, ranks), every phase of its market that takes it.

    A page is read once. Each step is worked out only where the ones before it leave something to find: most pages are no statements.
    """
    phases = (*COMMON, *OWN["hk"], *OWN["eu"])
    rows = _valid_pages(read_pages(found, prefilter=True))
    common, europe = _any([f"us_{s}" for s in sr.STATEMENTS]), _any([f"eu_{s}" for s in sr.STATEMENTS])
    plain = F.col("plain")
    rows = rows.withColumns({"excluded": F.when(common | europe, pages.is_excluded(F.col("head"))), "eu_excluded": F.when(europe, pages.is_excluded(F.substring("head", 1, EU_UNTITLED_HEAD))), "us_density": F.when(common, table_density(plain)), "eu_density": F.when(europe, spaced_density(plain))})
    rows = rows.withColumns({f"titles_{m}_{s}": F.when(F.col(f"{m}_{s}"), _title_places(m, s)) for m in sr.MARKETS for s in sr.STATEMENTS})
    fits = {(p.number, s): F.col(f"{p.market}_{s}") if p.number < FIRST_OWN else (F.col("market") == p.market) & F.col(f"{p.market}_{s}") for p in phases for s in sr.STATEMENTS}
    rows = rows.withColumns({f"score_{p.number}_{s}": F.when(fits[p.number, s], _score(p, s)).cast("long") for p in phases for s in sr.STATEMENTS})
    scores = {(m, s): F.coalesce(*(F.col(f"score_{p.number}_{s}") for p in phases if (p.market == "eu") == (m == "eu"))) for m in ("us", "eu") for s in sr.STATEMENTS}
    rows = rows.withColumns({f"ranks_{m}_{s}": F.when(score.isNotNull(), F.array(*_ranks(m, s))) for (m, s), score in scores.items()})
    each = []
    for s in sr.STATEMENTS:
        own_valid = F.coalesce(*(F.when(F.col("market") == m, F.col(f"{m}_{s}")) for m in sr.MARKETS))
        for p in phases:
            score = F.col(f"score_{p.number}_{s}")
            one = F.struct(
                "market", "page_num", F.lit(s).alias("statement"), F.lit(p.number).alias("phase"), F.lit(p.ranged).alias("ranged"), F.lit(p.choose).alias("choose"),
                score.alias("score"), own_valid.alias("own_valid"), F.col(f"ranks_{'eu' if p.market == 'eu' else 'us'}_{s}").alias("ranks"),
            )
            each.append(F.when(score.isNotNull(), one))
    some = F.coalesce(*scores.values()).isNotNull()
    return rows.select("doc_id", "page_num", locate.names_index(F.col("low")).alias("index"), locate.is_audit(F.col("low")).alias("audit"), F.when(some, F.filter(F.array(*each), lambda x: x.isNotNull())).alias("found"))


def locate_statements(found: DataFrame) -> DataFrame:
    """(doc_id, statement, page_num, phase): the page of each statement in pages (doc_id, market, page_num, text), and the phase that found it.

    Markets are us, hk and eu; documents of others, and statements without a page, give no row.
    Page numbers start at 1 and should be distinct in a document; of repeated pages either may win.
    Null texts are empty pages. Pages are dealt by document once, and the windows keep that; a
    document's candidates meet its search ranges in one row.
    """
    marks = marked_pages(found.where(F.col("doc_id").isNotNull()))
    whole = marks.groupBy("doc_id").agg(*locate.range_marks(), F.collect_list("found").alias("found"))
    rows = whole.select("doc_id", locate.ranges().alias("ranges"), F.flatten("found").alias("found")).select("doc_id", "ranges", F.explode("found").alias("x")).select("doc_id", "ranges", "x.*")
    # what isn't bound to ranges meets the whole document as one
    inside = F.array_compact(F.transform("ranges", lambda r, i: F.when((F.col("page_num") >= r["start"]) & (F.col("page_num") < r["end"]), i)))
    rows = rows.withColumn("ord", F.explode(F.when(F.col("ranged"), inside).otherwise(F.array(F.lit(-1))))).drop("ranges")
    # untitled pages of all ranges compete in one step
    step = F.struct("phase", F.when((F.col("choose") == "best") & F.col("phase").isin(3, 7), 0).otherwise(F.col("ord")).alias("range"))
    rows = rows.withColumn("step", step)
    per_step = Window.partitionBy("doc_id", "statement", "step")
    near = rows.withColumn("most", F.max("score").over(per_step)).where(F.col("score") >= F.col("most") * F.when(F.col("choose") == "near", ABOUT_THE_SAME).otherwise(1.0))
    first = F.when(F.col("choose") == "near", F.struct("ranks", F.lit(0).alias("o"), "page_num")).otherwise(F.struct(F.array(F.lit(0)).alias("ranks"), F.col("ord").alias("o"), "page_num"))
    best = near.groupBy("doc_id", "market", "statement", "step").agg(F.min(F.struct(first.alias("first"), "own_valid")).alias("b"))
    best = best.select("doc_id", "market", "statement", "step", F.col("b.first.page_num").alias("page_num"), F.col("b.own_valid").alias("own_valid"))
    # the common phases' page counts if its market's rules take it, else the market's own first step
    common = F.min(F.when(F.col("step.phase") < FIRST_OWN, F.struct("step", "page_num", "own_valid")))
    own = F.min(F.when(F.col("step.phase") >= FIRST_OWN, F.struct("step", "page_num", "own_valid")))
    chosen = best.groupBy("doc_id", "statement").agg(common.alias("common"), own.alias("own")).select("doc_id", "statement", F.when(F.col("common.own_valid"), F.col("common")).otherwise(F.col("own")).alias("c"))
    return chosen.where("c is not null").select("doc_id", "statement", "c.page_num", F.col("c.step.phase").alias("phase"))


def _by_statement(statement: Column, values: dict[str, Column | int]) -> Column:
    return F.coalesce(*(F.when(statement == s, v) for s, v in values.items()))


def statement_spans(found: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, statement, page_num, start, end): first and last page of each statement that starts (doc_id, statement, page_num) name.

    From a page marked (continued) back to one that isn't; from there once more to a titled page
    before it, and on over those that are titled and continued. Then forward, up to the page before
    one that opens the next statement, but no more than FOLLOWING pages. Pages count from 1 without gaps;
    a document's marks travel as one row of a few bits a page. Starts beyond the document give no row.
    """
    line, head = F.lower(F.substring(pages.page_text(F.col("text")), 1, SPAN_HEAD)), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, MARK_HEAD))
    any_of = lambda text, patterns: text.rlike("|".join(patterns))
    marks = F.struct("page_num", line.rlike(CONTINUED).alias("goes_on"), *(any_of(line, SPAN_TITLES[s]).alias(f"titled_{s}") for s in sr.STATEMENTS), *(any_of(head, NEXT_STATEMENT[s]).alias(f"next_{s}") for s in sr.STATEMENTS))
    whole = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(marks)).alias("marks"))
    at = lambda p: F.get(F.col("marks"), p - 1)
    pick = lambda p, kind: _by_statement(F.col("statement"), {s: at(p)[f"{kind}_{s}"] for s in sr.STATEMENTS})
    down = lambda last: F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    n = F.size("marks")
    own = starts.select("doc_id", "statement", F.col("page_num").cast("int").alias("page_num")).join(whole.hint("merge"), "doc_id").where(F.col("page_num").between(1, n))
    first = F.coalesce(F.array_max(F.filter(down(F.col("page_num")), lambda p: ~at(p)["goes_on"])), F.lit(1))
    own = own.withColumn("first", first)
    before = F.col("first") - 1
    gap = F.coalesce(F.array_max(F.filter(down(before), lambda p: ~(pick(p, "titled") & at(p)["goes_on"]))), F.lit(0))
    start = F.when((before >= 1) & pick(before, "titled") & ~at(before)["goes_on"], before).otherwise(gap + 1)
    own = own.withColumn("start", start).withColumn("most", F.least(n, F.col("start") + _by_statement(F.col("statement"), FOLLOWING)))
    ahead = F.when(F.col("most") > F.col("start"), F.sequence(F.col("start") + 1, F.col("most"))).otherwise(F.array().cast("array<int>"))
    end = F.coalesce(F.array_min(F.filter(ahead, lambda p: pick(p, "next"))) - 1, F.col("most"))
    return own.select("doc_id", "statement", "page_num", F.col("start").cast("int").alias("start"), end.cast("int").alias("end"))


def statement_texts(found: DataFrame, starts: DataFrame, walk_back: bool = True) -> DataFrame:
    """(doc_id, statement, start, end, text): the pages of each statement's span, in order, a line break between them.

    Without walk_back (documents that aren't laid out in pages) a span begins where it starts, and
    a statement of cash flows ends with the page that completes its totals.
    """
    spans = statement_spans(found, starts)
    if not walk_back:
        marks = spans.select("doc_id", "statement", "page_num").withColumnsRenamed({"doc_id": "d", "statement": "s", "page_num": "p"})
        heads = found.select("doc_id", F.col("page_num").alias("q"), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, MARK_HEAD)).alias("head"))
        near = marks.join(heads.hint("merge"), (F.col("d") == F.col("doc_id")) & (F.col("q") >= F.col("p")) & (F.col("q") <= F.col("p") + _by_statement(F.col("s"), FOLLOWING)))
        stops = _by_statement(F.col("s"), {s: F.col("head").rlike("|".join(NEXT_STATEMENT[s])) for s in sr.STATEMENTS}) & (F.col("q") > F.col("p"))
        spans = near.groupBy("d", "s", "p").agg(F.coalesce(F.min(F.when(stops, F.col("q"))) - 1, F.max("q")).alias("end")).select(F.col("d").alias("doc_id"), F.col("s").alias("statement"), F.col("p").alias("page_num"), F.col("p").alias("start"), F.col("end").cast("int").alias("end"))
    own = spans.withColumnRenamed("doc_id", "d").drop("page_num").distinct()
    rows = found.join(own.hint("merge"), (F.col("doc_id") == F.col("d")) & F.col("page_num").between(F.col("start"), F.col("end")))
    texts = rows.groupBy("doc_id", "statement", "start", "end").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("t"))
    if not walk_back:
        done = F.array_min(F.filter(F.sequence(F.lit(1), F.size("t")), lambda k: cash_statement_complete(F.array_join(F.slice("t", F.lit(1), k), "\n"))))
        kept = F.when((F.col("statement") == "cashflow") & (F.size("t") > 1), F.coalesce(F.greatest(done, F.lit(2)), F.size("t"))).otherwise(F.size("t"))
        texts = texts.withColumn("t", F.slice("t", F.lit(1), kept)).withColumn("end", F.col("start") + F.size("t") - 1)
    return texts.select("doc_id", "statement", "start", "end", F.array_join("t", "\n").alias("text"))
