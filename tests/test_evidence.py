"""Checks of answers, facts and records on small inputs with nulls and near misses."""

from factloom.operators import evidence as E


def _by_id(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_reported_amounts(spark):
    answers = spark.createDataFrame([(1, "It was $2.5 billion.", ["S1"]), (2, "It was $7 million.", []), (3, None, ["S1"]), (4, "It was $7 million, and $9 million.", ["S1"]), (5, "It was $7 million.", None)], "answer_id int, answer string, cited array<string>")
    rows = spark.createDataFrame([(1, 0, "a", "$2,510", "millions", "S1"), *[(i, 0, "a", "$7,000", "thousands", "S1") for i in (2, 3, 4, 5)]], "answer_id int, ord int, label string, value string, scale string, source_id string")
    found = _by_id(E.reported_amount_check(answers, rows), "answer_id", "reason")
    assert found == {1: None, 2: "reported_value_source_not_cited:a", 3: "reported_value_missing_or_wrong:a", 4: "unsupported_reported_amount", 5: "reported_value_source_not_cited:a"}


def test_fact_rejects(spark):
    sources = spark.createDataFrame([(1, "A", True, "<td>Net sales</td> <td>$ 1,200</td> in 2021"), (2, "A", None, "x"), (3, None, True, "x"), (4, "A", True, None)], "source_id int, ticker string, in_scope boolean, text string")
    facts = spark.createDataFrame([(1, 1, "A", "$1,200", "net sales", "FY2021", "2021 sales net 1 200"), (2, 2, "A", "x", "x", "", "x"), (3, 3, "A", "x", "x", "", "x"), (4, 4, "A", None, None, None, None), (5, 9, "A", "x", "x", "", "x"), (6, 1, "A", "$1,200", "net sales", "FY2019", "Net sales")], "fact_id int, source_id int, ticker string, raw_value string, label string, period string, excerpt string")
    found = _by_id(E.fact_rejects(facts, sources), "fact_id", "reason")
    assert found == {1: None, 2: "source_outside_permitted_scope", 3: "ticker_source_mismatch", 4: "evidence_excerpt_not_in_source", 5: "unknown_source_id", 6: "period_not_in_source"}


def test_null_questions_and_ids(spark):
    c = spark.createDataFrame([(1, "A", "2021", "10K", None, "1", "1", "1")], "candidate_id int, ticker string, fiscal_year string, doc_type string, question string, claim string, quote string, evidence string")
    assert E.candidate_errors(c).first()["errors"] == "question_missing_company,question_missing_source_fiscal_year,question_missing_10k_source_type"
    g = spark.createDataFrame([(None, "c", "q", "r", ["A"], ["2021"], None)], "id int, category string, question string, reference string, tickers array<string>, years array<string>, doc_types array<string>")
    assert E.gold_schema_check(g).first()["errors"] == "missing id,scope.doc_types is empty"
