"""Questions, replies and answers against literal cases."""

from decimal import Decimal

from factloom.operators import questions as Q

ALIASES = {"MSFT": ("MSFT", "MICROSOFT"), "JPM": ("JPM", "JP MORGAN"), "TSLA": ("TSLA", "TESLA")}


def annotated(spark, *texts):
    rows = Q.annotate(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ALIASES, ("2024", "2025")).orderBy("id").collect()
    return rows


def test_annotations(spark):
    a, b, c, d, e, f = annotated(
        spark, "Compare Microsofts and Tesla's revenue in the 2024 10-K with 2022", "Explain that?", "Show the income statement of JP Morgan for 2025", "Is Apple's stock price today higher?",
        "Show only the average margin in a table", "What did the 2024 and 2025 transcripts say about JPMX",
    )
    assert (a["tickers"], a["years"], a["reference_years"], a["doc_types"], a["topic"], a["comparison"]) == ("MSFT,TSLA", "2024", "2022", "10K", "performance", True)
    assert b["followup"] and b["tickers"] == "" and not b["domain_relevant"]
    assert (c["tickers"], c["wants_table"], c["wants_complete_table"], c["followup"]) == ("JPM", True, True, False)
    assert d["out_of_scope"] and d["unsupported_companies"] == "AAPL"
    assert e["wants_table"] and not e["wants_complete_table"]
    assert (f["tickers"], f["doc_types"], f["years"]) == ("", "TRANSCRIPT", "2025")


def test_clarification(spark):
    pending = spark.createDataFrame([(i, "OLD", "2024", "", ["MSFT"]) for i in range(4)], "id long, tickers string, years string, doc_types string, candidates array<string>")
    texts = ["yes", "no", "the 10-K for 2025", "what are the risks"]
    reply = Q.annotate(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ALIASES, ("2024", "2025"))
    reply = reply.withColumns({"is_yes": Q.plain(reply["text"]).rlike(Q.YES), "is_no": Q.plain(reply["text"]).rlike(Q.NO)})
    out = [tuple(r)[1:] for r in Q.merge_clarification(pending, reply).orderBy("id").collect()]
    assert out == [("MSFT", "2024", "", True), ("", "2024", "", True), ("OLD", "2025", "10K", True), (None, None, None, False)]


def test_table_values(spark):
    values = spark.createDataFrame([("m", "net income", "2024", Decimal("72361")), ("m", "total assets", "2024", Decimal(1)), ("m", "total assets", "2024", Decimal(2))], "scope string, metric string, year string, value decimal(38,6)")
    rows = [
        ("Net income in 2024?", "It was $72,361 million."), ("Net income in 2024?", "About 72.4 billion"), ("Net income in 2024?", "About 72.5 billion"), ("Net income in 2024?", "It rose."), ("Net income in 2023 and 2024?", "1"), ("Combined net income in 2024?", "1"), ("Total assets in 2024?", "5"), ("Net income in 2024?", "(72,361)"),
    ]
    answers = spark.createDataFrame([(i, "m", *r) for i, r in enumerate(rows)], "id long, scope string, question string, answer string")
    out = [(r["passed"], r["reason"]) for r in Q.table_value_check(answers, values).orderBy("id").collect()]
    missing = (False, "value missing from the answer")
    assert out == [(True, "verified"), (True, "verified"), missing, (True, "no numeric claim"), (True, "not applicable"), (True, "composite question"), (True, "inconclusive"), missing]


def test_quotes(spark):
    from factloom.operators.quotes import quote_verify

    body = "Total company revenue grew, driven by demand in all places. Net income rose  because of lower costs at home. Cash may be insufficient for the coming months. <td> 12 </td> because net income rose a lot. Net income will rise because of the outlook."
    quotes = [
        ("Net income was never said to be driven by this.", "net income: reasons"), ("Net income rose because of lower costs at home.", "net income: reasons"), ("Net income will rise because of the outlook.", "net income: reasons"), ("because net income", "what"),
        ("<td> 12 </td> because net income rose a lot.", "net income: drivers"), ("“Cash may be insufficient for the coming months.”", "liquidity"), ("Net income rose because of lower costs at home.", "liquidity"), ("Total company revenue grew, driven by demand in all places.", "revenue: drivers"),
        ("Net income rose because of lower costs at home.", "revenue: drivers"), ("Net income rose because of lower costs at home.", "anything"),
    ]
    choices = spark.createDataFrame([(i, 1, "S1", q, t) for i, (q, t) in enumerate(quotes)] + [(9, 0, "S1", "Cash may be insufficient for the coming months.", "anything")], "ask_id long, choice_no long, source_id string, quote string, task string")
    sources = spark.createDataFrame([(i, "S1", "g", body) for i in range(len(quotes))], "ask_id long, source_id string, grp string, text string")
    assert {(r["ask_id"], r["choice_no"]) for r in quote_verify(choices, sources).collect()} == {(1, 1), (5, 1), (7, 1), (9, 0)}
