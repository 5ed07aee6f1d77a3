"""What makes a page a primary statement, for three markets: titles, cues and rule trees as data.

Texts are a page in one lower-cased line (page), its part from the title on (title) and the part
before it (before).
"""

from __future__ import annotations

from factloom.functions.periods import MONTHS
from factloom.functions.rules import All, Any, Before, Beyond, Cue, Not, Titled

STATEMENTS = ("income", "balance", "cashflow")
MARKETS = ("us", "hk", "eu")

# Titles ------------------------------------------------------------------------

STRICT = {
    "income": (r"consolidated\s+statements?\s+of\s+operations", r"consolidated\s+statements?\s+of\s+earnings", r"consolidated\s+statements?\s+of\s+income"),
    "balance": (r"consolidated\s+balance\s+sheets?", r"consolidated\s+statements?\s+of\s+financial\s+position"),
    "cashflow": (r"consolidated\s+statements?\s+of\s+cash\s+flows?", r"\bcash\s+flows?\s+statements?\b"),
}
PROFIT_OR_LOSS = (
    r"consolidated\s+statements?\s+of\s+profit\s+or\s+loss", r"statement\s+of\s+profit\s+or\s+loss",
)
COMPREHENSIVE = (r"consolidated\s+statements?\s+of\s+comprehensive\s+income", r"consolidated\s+statements?\s+of\s+comprehensive\s+loss", r"statements?\s+of\s+comprehensive\s+income", r"statements?\s+of\s+comprehensive\s+loss")
#: Titles of annual reports.
REPORT = {
    "income": (STRICT["income"][0], *PROFIT_OR_LOSS, *COMPREHENSIVE[:2], r"consolidated\s+income\s+statements?", r"statements?\s+of\s+operations", r"statements?\s+of\s+earnings", r"statements?\s+of\s+income", *COMPREHENSIVE[2:]),
    "balance": (*STRICT["balance"], r"\bbalance\s+sheets?\b", r"statements?\s+of\s+financial\s+position"),
    "cashflow": (STRICT["cashflow"][0], r"statements?\s+of\s+cash\s+flows?", r"consolidated\s+cash\s+flow\s+statements?", r"\bcash\s+flows?\s+statements?\b"),
}
CHINESE = {
    "income": (r"综合(?:收益|损益)(?:表|/(?:亏损))?", r"损益表", r"利润表", r"合并(?:综合)?(?:收益|损益)表"),
    "balance": (r"综合(?:财务)?状况表", r"资产负债表", r"资产(?:负债|及负债)表"),
    "cashflow": (r"合[併并]現金流量表", r"综合现金流量表", r"现金流量表", r"合并现金流量表", r"holdings\s+statement\s+of\s+cash\s+flows?"),
}
HONG_KONG = {
    "income": (r"statements?\s+of\s+profit\s+or\s+loss", PROFIT_OR_LOSS[0], *COMPREHENSIVE[:2], r"consolidated\s+income\s+statements?", r"statement\s+of\s+comprehensive\s+income", r"statement\s+of\s+comprehensive\s+loss", *CHINESE["income"]),
    "balance": (r"statements?\s+of\s+financial\s+position", STRICT["balance"][1], *CHINESE["balance"]),
    "cashflow": (r"statements?\s+of\s+cash\s+flows?", STRICT["cashflow"][0], r"consolidated\s+cash\s+flow\s+statements?", *CHINESE["cashflow"]),
}
FRENCH = {
    "income": (r"compte de r[eé]sultats? consolid[eé]", r"état du r[eé]sultat global consolid[eé]"),
    "balance": (r"bilan consolid[eé]", r"état de la situation financi[eè]re consolid[eé]"),
    "cashflow": (r"tableau des flux de tr[eé]sorerie", r"tableau de variation de la tr[eé]sorerie"),
}
#: Titles that open a statement, looked for near the head of a page.
OPENING = {
    "income": (*STRICT["income"], r"consolidated\s+income\s+statements?", r"\bincome\s+statements?\b", r"statements?\s+of\s+income\b", *PROFIT_OR_LOSS, *COMPREHENSIVE, r"comprehensive\s+income\s+statements?"),
    "balance": REPORT["balance"],
    "cashflow": (STRICT["cashflow"][0], r"statements?\s+of\s+cash\s+flows?", r"consolidated\s+cash\s+flow\s+statements?", r"cash\s+flows?\s+statements?"),
}


def merged(*maps: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    return {k: tuple(dict.fromkeys(p for m in maps for p in m[k])) for k in STATEMENTS}


EUROPE_OPENING = {"income": merged(FRENCH, OPENING)["income"], "balance": merged(FRENCH, STRICT, HONG_KONG)["balance"], "cashflow": merged(FRENCH, OPENING)["cashflow"]}

# Cues --------------------------------------------------------------------------

#: A date or the end of a year, as statements' heads give them.
DATED = rf"years? ended|as of \w+ \d{{1,2}}, \d{{4}}|(?:{'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}"
_UNITS = "(?:millions|thousands)"
#: The unit of a statement's amounts, or an amount of dollars.
PRICED = rf"\(in\s+{_UNITS}|expressed\s+in\s+{_UNITS}|all amounts in thousands|\(rmb\s+millions?\)|rmb[’']?000|人民幣千元|\$\s*[\d,]{{3,}}"
GROUPED = r"\b\d{1,3}(?:,\d{3})+\b"
SPACED = r"\b\d{1,3}(?: \d{3})+\b"
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
#: The same for European reports, where any grouped amount will do.
FIGURED = rf"(?:\(in|expressed\s+in|all amounts are in)\s+(?:eur|usd|gbp)?\s*{_UNITS}|all amounts in thousands|en millions d.?euros|years? ended|(?:{'|'.join((*MONTHS, *FRENCH_MONTHS))})\s+\d{{1,2}},?\s+\d{{4}}|{GROUPED}|{SPACED}"
SUMMARY = r"selected consolidated|financial highlights|five[- ]year|index to the consolidated financial|\bfinancial summary\b|summary consolidated"
CONDENSED, CONDENSED_CASH = r"condensed consolidated statement", r"condensed consolidated statement\s+of\s+cash\s+flow"
_OF_COMPANY = r"statement of financial position of the company"

NO_PRIMARY = (
    Before("notes before any title", r"notes to (?:the )?consolidated financial statements", r"consolidated statement of (?:comprehensive income|profit|financial position|cash flows)", 450, "notes to the consolidated financial statements"),
    Cue("notes", r"notes to consolidated financial statements", 500, example="consolidated statement of profit and notes to consolidated financial statements"),
    All("notes of the company", (Cue("notes mentioned", r"notes to the consolidated financial statements", 500, example="consolidated statement of profit, see notes to the consolidated financial statements 12. other"), Any("company or segment", (
        Cue("position of the company", rf"financial position (?:and .{{0,80}} )?of the company|{_OF_COMPANY}", 900), Cue("numbered note or segments", r"segment reporting|\b\d{1,3}\.\s+[a-z]|summary of significant", 600))))),
    Cue("condensed comprehensive statement", r"\bcondensed\s+statements?\s+of\s+comprehensive", 600, example="condensed statements of comprehensive income"),
    Beyond("condensed statement", CONDENSED, CONDENSED_CASH, 600, "condensed consolidated statement of profit"),
    Cue("company's own statement", _OF_COMPANY, 600, example="statement of financial position of the company"),
    Cue("note number", r"^note\s+\d+", 120, example="note 7"),
    Cue("reconciliation", r"reconciliation of consolidated", 350, example="reconciliation of consolidated results"),
    Cue("analysis", r"following table presents|percentage relationship|results of operations the following|the following table summarizes", 550, example="the following table presents shares"),
    Cue("segments or classification", r"reportable business segments|segment.{0,24}results|consolidated balance sheets.{0,30}analysis|balance sheets analysis|balance sheet classification", 600, example="reportable business segments"),
    Cue("report of the board", r"report of directors|directors.? report|corporate governance report|major customers and suppliers|financial and operating review|\boverview\b.{0,40}\bfinancial statements\b", 500, example="corporate governance report"),
    Cue("numbered section", r"^\d{1,3}\.\s+[a-z]", 200, example="3. accounting policies"),
    Cue("summary", SUMMARY, 500, example="five-year financial highlights"),
    Cue("segment table", r"major vies|eliminations|parent company only|revenue from third parties", 700, example="eliminations"),
)

_PRICED_TITLE = lambda n: (Cue("unit behind title", PRICED, n, at="title"), Cue("date behind title", DATED, n, at="title"))

US_RULES = {
    "income": All("income", (
        *map(Not, NO_PRIMARY),
        Any("titled or plain", (
            All("titled", (
                Titled(),
                Not(All("other comprehensive income alone", (
                    Cue("comprehensive head", r"comprehensive (?:income|loss)", 120), Not(Cue("operations head", r"operations|earnings", 120)),
                    Not(Cue("comprehensive title", r"statements?\s+of\s+comprehensive\s+(?:income|loss)|statement of profit or loss and other comprehensive income", 120, at="title"))))),
                Any("unit, date or revenue", (*_PRICED_TITLE(320), Cue("revenue behind title", r"\b(?:revenue|net sales|interest income|net interest income|net loss|total revenues?)s?\b", 320, at="title"))))),
            All("plain", (
                Not(Titled()), Cue("date", DATED, 280), Cue("revenue", r"\b(?:revenue|net sales)s?\b", 600),
                Cue("statement named", r"consolidated (?:statements?|income statements?)|statement of (?:profit|comprehensive|operations)|\bincome\s+statements?\b", 500),
                Not(Cue("operating activities", r"operating activities", 400)), Not(Cue("other comprehensive income", r"other comprehensive income", 350)), Not(Cue("preferred stock", r"preferred stock balance", 350)))))))),
    "balance": All("balance", (
        *map(Not, NO_PRIMARY),
        Not(Cue("selected balances", r"selected balance sheet|selected metrics|financial highlights|three-year summary", 400, example="selected balance sheet data")),
        Any("titled or plain", (
            All("titled", (
                Titled(),
                Not(Cue("mention before title", r"\b(?:impact of|following table|reflected on|analysis of|discussed in|percentage relationship)\b", 900, at="before")),
                Any("plain words before title", (Cue("header", r"^[\pL\pN_\s&.,'()/-]*$", 900, at="before"), Cue("short", r"(?s)^.{0,20}$", 900, at="before"), Cue("contents", r"^table of contents\b", 900, at="before"))),
                Any("unit, date or balances", (*_PRICED_TITLE(400), Cue("balances behind title", r"\b(?:assets|liabilities|equity)\b", 400, at="title"))))),
            All("plain", (
                Not(Titled()), Any("dated", (Cue("date", DATED, 220), Cue("year end", r"december 31,|september 30,|january 31,|february \d{1,2},", 140))),
                Cue("assets", r"\bassets\b", 280), Cue("cash or totals", r"cash and due from|deposits with banks|cash and cash equivalents|total assets|current assets", 700), Not(Cue("plan assets", r"plan assets at fair value", 400)))))))),
    "cashflow": All("cashflow", (
        *map(Not, NO_PRIMARY),
        Not(Cue("interim", r"half[- ]year report|six months ended|interim financial", 350, example="interim financial report")),
        Not(Cue("company's own", r"company cash flow statement|holdings statement of cash flows", 350, example="company cash flow statement")),
        Any("titled or plain", (
            All("titled", (
                Titled(), Not(Cue("parent company", r"parent company", 450)),
                Any("activities behind title", (Cue("operating activities behind title", r"operating activities|\boperations\b", 400, at="title"), All("profit and adjustments behind title", (Cue("profit behind title", r"profit before tax", 400, at="title"), Cue("adjustments behind title", r"adjustments", 400, at="title"))))),
                Any("unit or date", _PRICED_TITLE(400)))),
            All("plain", (
                Not(Titled()), Any("date or profit with amounts", (Cue("date", DATED, 280), All("profit with amounts", (Cue("profit", r"profit before tax", 500), Cue("amounts", GROUPED, 700, least=6))))),
                Any("activities", (
                    Cue("operating activities", r"operating activities|net cash from operations", 500),
                    All("profit, adjustments, cash", (Cue("profit", r"profit before tax", 500), Cue("adjustments", r"adjustments", 500), Cue("cash from operating", r"net cash from operating", 4000))),
                    All("operations, net income", (Cue("operations", r"\boperations\b", 500), Cue("net income", r"net income", 600))))),
                Not(Cue("parent company", r"parent company", 450)), Not(Cue("changes in equity", r"changes in equity", 350)))))))),
}

HK_SUMMARY = Cue("summary of the year", rf"{SUMMARY}|\bpart i\b|\bpart ii\b|business review|management discussion", 500, example="business review")
HK_CONDENSED = Beyond("condensed statement at the head", CONDENSED, CONDENSED_CASH, 500)
HK_RULES = {k: All(k, (Not(HK_SUMMARY), Not(HK_CONDENSED), v)) for k, v in US_RULES.items()}

_FIGURED_TITLE = lambda n: Cue("figures behind title", FIGURED, n, at="title")
EU_NO_PRIMARY = (
    Cue("company's own statement", r"\bcompany\s+(?:balance\s+sheet|statement\s+of|cash\s+flow)|parent\s+company\s+(?:only\s+)?(?:balance|financial|statement)|comptes? de la soci[eé]t[eé]|bilan social|compte de r[eé]sultat de la soci[eé]t[eé]", 700, example="comptes de la société"),
    HK_SUMMARY, HK_CONDENSED,
    Cue("contents", r"consolidated financial statements\s+consolidated statement of comprehensive income\s+\d+\s+consolidated balance sheet", 900, example="consolidated financial statements consolidated statement of comprehensive income 12 consolidated balance sheet 13"),
    All("french contents", (Cue("french titles in a row", r"bilan consolid[eé].{0,80}compte de r[eé]sultat|compte de r[eé]sultat.{0,80}bilan consolid[eé]|tableau des flux.{0,80}bilan consolid[eé]", 900), Not(Cue("figures below", FIGURED, 1100, 500)))),
    All("year in review", (Cue("boilerplate", r"(?s)^the year in review\b.*\bfinancial statements\b.*\bannual report\s+\d{4}\b", 500), Not(Cue("figures below", FIGURED, 900, 400)))),
    Cue("regulation", r"regulatory capital|own funds|crr/crd|cet1|basic indicator approach|pillar 3", 800, example="regulatory capital"),
)
EU_RULES = {
    "income": All("income", (
        *map(Not, EU_NO_PRIMARY),
        Any("titled or plain", (
            All("titled", (Titled(), _FIGURED_TITLE(420), Cue("income words behind title", r"\b(?:revenue|net revenue|interest income|profit or loss|comprehensive income|cost of goods|operating profit|chiffre d.?affaires|produits|revenus|ventes|r[eé]sultat op[eé]rationnel)\b", 420, at="title"))),
            All("plain", (
                Not(Titled()), Cue("income words", r"\b(?:net revenue|revenue from|interest income|income before income taxes|chiffre d.?affaires|produits|ventes|r[eé]sultat op[eé]rationnel)\b", 700),
                Any("four figures", (Cue("spaced figures", SPACED, 2500, least=4), Cue("grouped figures", GROUPED, 2500, least=4), All("of both", (Cue("two spaced", SPACED, 2500, least=2), Cue("two grouped", GROUPED, 2500, least=2))),
                    All("one and three", (Cue("one spaced", SPACED, 2500), Cue("three grouped", GROUPED, 2500, least=3))), All("three and one", (Cue("three spaced", SPACED, 2500, least=3), Cue("one grouped", GROUPED, 2500))))),
                Not(Cue("cash flows", r"operating activities|company balance sheet|flux de trésorerie", 450)), Not(Cue("comments", r"répartition des ventes|informations trimestrielles|investissements d.?exploitation|commentaires sur", 900)))))))),
    "balance": All("balance", (
        *map(Not, EU_NO_PRIMARY),
        Any("titled or plain", (
            All("titled", (Titled(), _FIGURED_TITLE(420), Cue("balance words behind title", r"\b(?:total assets|intangible assets|cash and cash equivalents|december 31|total actif|immobilisations|décembre)\b", 420, at="title"))),
            All("plain", (
                Not(Titled()), Cue("totals", r"\b(?:total assets|total non-current assets|current assets|actif|immobilisations)\b", 900),
                Cue("assets", r"\b(?:intangible assets|cash and cash equivalents|december 31|immobilisations|tr[eé]sorerie|décembre)\b", 900))))))),
    "cashflow": All("cashflow", (
        *map(Not, EU_NO_PRIMARY),
        Any("titled or plain", (
            All("titled", (
                Titled(),
                Any("activities behind title", (Cue("operating activities behind title", r"operating activities|net cash from operations|activit[eé]s op[eé]rationnelles", 500, at="title"), All("profit and adjustments behind title", (Cue("profit behind title", r"(?:profit|income) before (?:income )?tax(?:es)?", 500, at="title"), Cue("adjustments behind title", r"adjustments", 500, at="title"))))),
                _FIGURED_TITLE(500))),
            All("plain", (
                Not(Titled()), Cue("activities", r"op[eé]rations d.?exploitation|capacit[eé] d.?autofinancement|operating activities|cash flows? from operating", 2500), Cue("figures", FIGURED, 1200),
                Not(Cue("equity", r"capitaux propres consolid", 700)), Not(Cue("comments", r"commentaires sur", 500)))))))),
}
RULES = {"us": US_RULES, "hk": HK_RULES, "eu": EU_RULES}

#: What an untitled statement's page is worth beside its density: (pattern, characters, points).
BONUS = {
    "us": {
        "income": ((r"\brevenue\b", 400, 80), (r"total\s+(?:net\s+)?(?:revenues?|sales)", 900, 120)),
        "balance": ((r"total assets", 900, 80), (r"current assets", 500, 60)),
        "cashflow": ((r"adjustments to reconcile net income|net cash from operating activities", 4000, 80),),
    },
    "eu": {
        "income": ((r"\brevenue\b|chiffre d.?affaires|produits|\bventes\b", 400, 80), (r"total\s+(?:net\s+)?(?:revenues?|sales)|chiffre d.?affaires", 900, 120)),
        "balance": ((r"total assets|total actif|total de l.?actif", 900, 80), (r"current assets|actif courant", 500, 60)),
        "cashflow": ((r"op[eé]rations d.?exploitation|tableau de variation de la tr[eé]sorerie", 700, 100),),
    },
}
#: Two cues of a cash flow statement that are worth 150 points together: (pattern, characters) each.
BOTH = {"us": ((r"profit before tax", 500), (r"net cash from operating activities", 4000)), "eu": ((r"(?:profit|income) before (?:income )?tax(?:es)?", 500), (r"net cash from operating activities|cash flows? from operating", 4000))}
#: What ranks pages of about the same score.
NOTES_HEAD = r"notes to (?:the )?consolidated financial statements"
PRIMARY_HEAD = r"consolidated (?:statements? of (?:comprehensive income|profit|operations)|income statements?)|consolidated statement of financial position|consolidated balance sheet"
REVENUE_BODY = r"\b(?:revenues?|net sales|cost of revenue|gross profit|total operating income)\b"
CONSOLIDATED_HEAD = r"consolidated\s+(?:statement|balance\s+sheet)|consolid[eé]"
EU_WORDS = r"\b(?:revenue|total assets|intangible assets)\b"
