"""Statement rows and exact rows on the shapes that filings have, and cells that span rows."""

import pytest

from factloom.operators import grids, statements

TABLE = "<table>{}</table>"


def tr(*cells, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


def filing(heading, *rows, unit="(in millions)"):
    return f"## {heading}\n{unit}\n<table>" + "".join(rows) + "</table>"


HEAD = tr("Metric", "2025", "2024", tag="th")
CASES = {
    "metric": (filing("Consolidated Statements of Operations", HEAD, tr("Total revenues", "94,827", "97,690"), tr("Net income", "3,855", "7,153"), tr("Net income attributable to common stockholders", "3,794", "7,091")), "Give revenue and net income, then summarize a risk factor", [], {("Total revenues", "2025", "94,827"), ("Net income", "2025", "3,855")}),
    "comparative": (filing("Operations", HEAD, tr("Total automotive revenues", "77,070", "82,419")), "What were total automotive revenues in comparative year 2024?", ["2024"], {("Total automotive revenues", "2024", "82,419")}),
    "header over rows": (
        filing("Balance Sheets", "<thead><tr><th rowspan='2'>(In millions, except percentages and per share amounts)</th><th></th><th></th></tr>" + tr("2025", "2024", tag="th") + "</thead>", tr("Total cash, cash equivalents, and short-term investments", "94,565", "75,543")),
        "What was the combined amount of cash, cash equivalents, and short-term investments in 2025?", [], {("Total cash, cash equivalents, and short-term investments", "2025", "94,565")},
    ),
    "group heading": (
        filing("Segment Results of Operations", HEAD, "<tr><td colspan='3'>Intelligent Cloud</td></tr>", tr("Operating income", "44,589", ""), "<tr><td colspan='3'>Total</td></tr>", tr("Operating income", "128,528", "")),
        "What was Intelligent Cloud operating income in 2025?", [], {("Intelligent Cloud Operating income", "2025", "44,589")},
    ),
    "date in one cell": (filing("Consolidated Balance Sheets", tr("Metric", "December 31, 2025", "December 31, 2024", tag="th"), tr("Total assets", "137,806", "122,070")), "What were total assets in 2025?", [], {("Total assets", "2025", "137,806")}),
    "period row": (filing("Income Statements", HEAD, tr("Year Ended June 30,", "2025", "2024"), tr("Total revenue", "281,724", "245,122")), "What was total revenue for the fiscal year ended June 30, 2025?", [], {("Total revenue", "2025", "281,724")}),
    "specific": (filing("Operations", HEAD, tr("Total revenues", "97,690", "1"), tr("Total automotive revenues", "77,070", "2")), "What were total automotive revenues for the year ended December 31, 2025?", [], {("Total automotive revenues", "2025", "77,070")}),
    "named apart": (filing("Operations", HEAD, tr("Total revenues", "97,690", "1"), tr("Total automotive revenues", "77,070", "2")), "Report both total automotive revenues and total company revenues for 2025.", [], {("Total revenues", "2025", "97,690"), ("Total automotive revenues", "2025", "77,070")}),
    "loss from operations": (filing("Operations", HEAD, tr("Income (loss) from operations", "6,625", "7,076")), "What was operating income in 2025?", [], {("Income (loss) from operations", "2025", "6,625")}),
    "ambiguous": (filing("Operations", HEAD, tr("Goodwill", "$5", "1"), tr("Goodwill", "6", "1")) + filing("More", HEAD, tr("Cash", "$5", "1"), tr("Cash", "5", "1")), "What were goodwill and cash?", [], {("Cash", "2025", "$5")}),
    "no scale": (filing("Operations", HEAD, tr("Goodwill", "5", "1"), unit=""), "What was goodwill?", [], set()),
    "two columns": (filing("Operations", tr("x", "2025", "2025", tag="th"), tr("Goodwill", "5", "1")), "What was goodwill?", [], set()),
    "costs": (filing("Operations", HEAD, "<tr><td colspan='3'>Cost of cloud</td></tr>", tr("Total", "5", "1"), "<tr><td colspan='3'>Cloud</td></tr>", tr("Total", "7", "1")), "What was the cloud total?", [], {("Cloud Total", "2025", "7")}),
    "far": ("## Operations\n" + "x " * 300 + "in millions\n" + TABLE.format(HEAD + tr("Goodwill", "5", "1")), "What was goodwill?", [], set()),
}
TICKERS = {name: f"T{i}" for i, name in enumerate(CASES)}
KEYS = ["ticker", "doc_year", "item", "section", "doc_id"]


@pytest.fixture(scope="module")
def values(spark):
    rows = [(TICKERS[name], "2025", "Item 8", "Item 8. FINANCIAL STATEMENTS AND SUPPLEMENTARY DATA", name, case[0]) for name, case in CASES.items()]
    rows.append(("OTHER", "2025", "Item 1", "Item 1", "other", CASES["metric"][0]))
    texts = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in [*KEYS, "text"]))
    return statements.statement_values(statements.titled_tables(texts, KEYS), KEYS).cache()


def test_statement_rows(spark, values):
    asks = [(name, TICKERS[name], "2025", case[1], case[2]) for name, case in CASES.items()] + [("other", "OTHER", "2025", CASES["metric"][1], []), ("empty", TICKERS["metric"], "2025", "", [])]
    out = statements.statement_rows(values, spark.createDataFrame(asks, "ask_id string, ticker string, doc_year string, question string, years array<string>")).collect()
    got = {name: {(r["label"], r["year"], r["value"]) for r in out if r["ask_id"] == name} for name in [*CASES, "other", "empty"]}
    assert got == {name: case[3] for name, case in CASES.items()} | {"other": set(), "empty": set()}
    assert {r["scale"] for r in out} == {"millions"}


def test_exact_rows(spark):
    """The consolidated total and not the segment, plural labels with a statement's money, dates in headers, no notes."""
    given = {
        "MSFT": filing("INCOME STATEMENTS", tr("Year", "2025", tag="th"), tr("Product", "$63,946"), tr("Total revenue", "281,724")), "TSLA": filing("CASH FLOWS STATEMENTS", tr("Year", "2025", tag="th"), tr("Total revenues", "94,827"), tr("Research (net) and development", "9")),
        "DATE": filing("CONSOLIDATED BALANCE SHEETS", tr("", "December 31, 2025", "December 31, 2024", tag="th"), tr("Short-term investments", "$27,546", "$20,424")), "NOTE": filing("Notes", tr("", "2025", tag="th"), tr("Total revenue", "$1"), tr("Goodwill", "$2")), "PLAIN": filing("Notes", tr("", "2025", tag="th"), tr("Goodwill", "2")),
    }
    rows = [(k, "2025", "Item 8", "Item 8. FINANCIAL STATEMENTS AND SUPPLEMENTARY DATA", k, t) for k, t in given.items()] + [("ELSE", "2025", "Item 7", "Item 7. MD&A", "e", given["MSFT"])]
    found = statements.statement_values(statements.titled_tables(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in [*KEYS, "text"])), KEYS), KEYS)
    asks = [("MSFT", "Revenue"), ("TSLA", "total revenue"), ("TSLA", "research and development expenses"), ("DATE", "short-term investments"), ("NOTE", "revenue"), ("NOTE", "goodwill"), ("PLAIN", "goodwill"), ("ELSE", "revenue")]
    out = statements.exact_rows(found, spark.createDataFrame([(f"{t} {m}", t, m, "2025") for t, m in asks], "ask_id string, ticker string, metric string, year string")).collect()
    assert {(r["ask_id"], r["label"], r["value"]) for r in out} == {("MSFT Revenue", "Total revenue", "281,724"), ("TSLA total revenue", "Total revenues", "94,827"), ("DATE short-term investments", "Short-term investments", "$27,546"), ("NOTE goodwill", "Goodwill", "$2")}


def plain_grid(rows):
    """Cells (text, colspan, rowspan) laid into a matrix one after another."""
    places = {}
    for y, cells in enumerate(rows):
        x = 0
        for text, wide, high in cells:
            while (y, x) in places:
                x += 1
            width = next((n for n in range(1, wide) if (y, x + n) in places), wide)
            for dy in range(min(high, len(rows) - y)):
                for dx in range(width):
                    places[y + dy, x + dx] = text
            x += width
    return {(y, x, t) for (y, x), t in places.items()}


def test_grid(spark):
    import random

    rng = random.Random(4)
    given = {i: [[(f"{y}.{k}", rng.choice((1, 1, 1, 2, 3)), rng.choice((1, 1, 1, 2, 4))) for k in range(rng.randint(0, 4))] for y in range(rng.randint(0, 5))] for i in range(40)}
    html = lambda rows: TABLE.format("".join("<tr>" + "".join(f"<td colspan='{w}' class=a rowspan=\"{h}\"><b>{t}</b></td>" for t, w, h in cells) + "</tr>" for cells in rows))
    out = grids.grid(spark.createDataFrame([(i, html(rows)) for i, rows in given.items()], "id long, html string"), ["id"]).collect()
    for i, rows in given.items():
        assert {(r["row"], r["col"], r["value"]) for r in out if r["id"] == i} == plain_grid(rows)
