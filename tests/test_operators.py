"""Operators on small literal inputs: shapes of the reference's tests, and brute force where there is no SQL."""

import pytest

from factloom.operators import answers, calculations, datasets, documents, joins, retrieval, tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bm25_counts_coverage(spark):
    chunks = spark.createDataFrame([("a", "p1", "The CET1 ratio rose.", "JPM", "10-K"), ("b", "p2", "Nothing here.", "JPM", "10-K"), ("c", "p3", "CET1 elsewhere", "BAC", "10-K")], "child_id string, parent_id string, text string, ticker string, doc_type string")
    q = spark.createDataFrame([(1, "CET1")], "question_id long, text string")
    g = spark.createDataFrame([(1, 0, "JPM", None)], "question_id long, grp_ord int, ticker string, doc_type string")
    assert rows(retrieval.bm25_topk(retrieval.bm25_scores(chunks, q, g), g), "child_id", "coverage", "rank") == [("a", 1.0, 1)]


def test_context_pack_skips_what_does_not_fit(spark):
    b = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 30), (1, 4, 10)], "question_id long, place int, n_chars long")
    assert rows(retrieval.context_pack(b, 100), "place", "source_id") == [(1, "S1"), (3, "S2"), (4, "S3")]


def test_normalize_value(spark):
    given = [
        (1, "$(1,234.5)", None, "thousands", "usd"), (2, "12.5%", None, None, None), (3, "n/a", None, None, None), (4, "$1.2 million", None, None, None), (5, "$1.2 million", None, "thousands", None),
        (6, "EUR 5", None, None, "USD"), (7, "3x", None, None, None), (8, "12 bps", None, None, None), (9, "5 to 6", None, None, None), (10, "$2.50", "per share", "millions", None), (11, "7", "shares", "millions", None), (12, None, None, None, None), (13, "$5%", None, None, None),
    ]
    out = {r["id"]: r for r in answers.normalize_value(spark.createDataFrame(given, "id long, raw_value string, unit string, scale string, currency string")).collect()}
    assert (out[1]["value_type"], out[1]["base_value"], out[1]["currency"]) == ("currency", -1234500.0, "USD")
    assert (out[2]["value_type"], out[2]["base_value"]) == ("percent", 12.5)
    assert [out[i]["reason"] for i in (3, 5, 6, 9, 12, 13)] == ["blank", "scale conflict", "currency conflict", "not one number", "blank", "non-monetary value with a currency"]
    assert out[4]["base_value"] == 1_200_000.0 and out[7]["value_type"] == "ratio" and out[8]["value_type"] == "basis_points"
    assert (out[10]["value_type"], out[10]["base_value"]) == ("per_share", 2.5) and (out[11]["value_type"], out[11]["base_value"]) == ("count", 7_000_000.0)


def test_table_check(spark):
    good = "text\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    given = [(1, good), (2, "****"), (3, "a ` b"), (4, "| a | b |\n| --- | --- |\n| 1 |"), (5, "| a | b |\n| 1 | 2 |\n| 3 | 4 |"), (6, "| a | b |\n| --- | --- |"), (7, "x | y | z"), (8, "|" + " c |" * 9 + "\n|" + " --- |" * 9 + "\n|" + " 1 |" * 9), (9, "| a | b |\n| --- | --- |\n| 1 | 2"), (10, None)]
    out = dict(rows(answers.table_check(spark.createDataFrame(given, "answer_id long, answer string")), "answer_id", "reason"))
    assert out == {1: None, 2: "malformed_empty_bold_marker", 3: "unmatched_markdown_backtick", 4: "inconsistent_table_columns", 5: "invalid_table_separator", 6: "incomplete_markdown_table", 7: "malformed_table_row:1", 8: "wide_markdown_table:9_columns", 9: "malformed_table_row:3", 10: None}


def test_excerpt_support(spark):
    src = "Revenue increased 12% to $45 million in fiscal 2023 because of strong demand"
    given = [(1, "increased 12% to", src), (2, "revenue strong demand increased fiscal 2023", src), (3, "revenue strong demand 99", src), (4, "unrelated words entirely different", src), (5, "", src)]
    assert [s for _, s in rows(answers.excerpt_support(spark.createDataFrame(given, "id long, excerpt string, source string")), "id", "supported")] == [True, True, False, False, False]


def test_table_grid_and_facts(spark):
    html = '<table><tr><th></th><th colspan="2">2022</th><th>2023</th></tr><tr><td>Assets</td></tr><tr><td>Cash</td><td>1</td><td>(2)</td><td>n/a</td></tr></table>'
    t = tables.extract_tables(spark.createDataFrame([(1, f"Balance sheet\n(in millions)\n{html} rest")], "doc_id long, text string"))
    assert rows(t, "table_no", "title") == [(0, "Balance sheet")]
    cells = tables.table_cells(t, ["doc_id", "table_no"])
    assert rows(cells.filter("row = 0"), "col", "value") == [(0, ""), (1, "2022"), (2, "2022"), (3, "2023")]
    assert rows(tables.table_facts(cells, ["doc_id", "table_no"]), "label", "period", "raw_value") == [("Assets - Cash", 2022, "(2)"), ("Assets - Cash", 2022, "1")]


def test_evidence_windows_and_spans(spark):
    p = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([100, 200, 10, 400, 90])], "doc_id long, pos int, text string")
    assert rows(documents.evidence_windows(p, 350, 4, 80, 90), "window", "n_chars") == [(0, 302), (1, 350), (2, 90)]
    s = spark.createDataFrame([(1, 0, 10), (1, 5, 30), (1, 200, 210), (1, 500, 510)], "doc_id long, start long, end long")
    assert rows(documents.merged_spans(s, 200), "start", "end") == [(0, 210), (500, 510)]


def test_mojibake(spark):
    good = "Müller — naïve café"
    broken = good.encode().decode("cp1252", "replace")
    out = documents.repair_mojibake(spark.createDataFrame([(good,), (broken,), ("plain",), (None,)], "text string")).collect()
    assert [r["repaired"] for r in out] == [good, good, "plain", None]


def test_turns(spark):
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Operator: Welcome all.", "Ann Lee", "Chief Executive Officer", "Thank you.", "Q", "Question and Answer", "Bob Roe: Why?", "Revenue: 5"])], "doc_id long, pos long, text string")
    out = rows(documents.transcript_turns(b), "pos", "speaker", "role", "section", "body")
    assert out == [
        (0, "Operator", None, "Prepared Remarks", "Welcome all."), (3, "Ann Lee", "Chief Executive Officer", "Prepared Remarks", "Thank you."),
        (6, "Bob Roe", None, "Question and Answer", "Why?"), (7, "Bob Roe", None, "Question and Answer", "Revenue: 5"),
    ]


def test_balance_and_cap(spark):
    e = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 80 else "c" if i < 95 else "d") for i in range(100)], "id long, kind string")
    counts = {r["kind"]: r["count"] for r in datasets.balance_types(e, "id", "kind").groupBy("kind").count().collect()}
    assert max(counts.values()) <= 0.4 * sum(counts.values()) and counts["b"] == 20
    assert datasets.cap_dataset(e, "id", "kind", 30).count() == 30


def test_near_duplicates_brute(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["z"]), " ".join(base), " ".join(base[:30]), "a b", "a b"]
    grams = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = [(a, b) for a in (0, 1, 3) for b in (0, 1, 3) if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.92]
    pairs, members = joins.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    assert rows(pairs, "a", "b") == want and members.count() == len(texts)


def test_catalog_errors():
    bad = [("x", ("x",), ("ratio", "total_revenue")), ("x", ("x",), ("sum", "no_such"))]
    assert calculations.check_catalog(calculations.FORMULAS) == []
    assert len(calculations.check_catalog(bad)) == 4
    with pytest.raises(ValueError):
        calculations.formula_eval(None, bad)


def test_expansions_and_thresholds(spark):
    hit = "question_id long, grp_ord int, child_id string, parent_id string, rank int, score double, coverage double"
    dense = spark.createDataFrame([(1, 0, "a", "p", 1, 0.9, 0.0)], hit)
    lexical = spark.createDataFrame([(1, 0, "a", "p", 2, 3.0, 0.5), (1, 1, "b", "q", 1, 1.0, 0.1)], hit)
    fused = retrieval.rrf_fuse(dense, lexical)
    assert rows(retrieval.threshold_accept(fused), "child_id", "accepted") == [("a", True), ("b", True)]
    more = spark.createDataFrame([(1, 0, "a", "p", 1, 1.0, 1.0), (1, 0, "c", "r", 2, 1.0, 1.0)], hit)
    assert rows(retrieval.rrf_expansions(fused, more), "child_id") == [("c",)]
