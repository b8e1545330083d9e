"""Checks of training examples: a good one, and one for each reason that the query's examples don't have."""

import copy
import hashlib

from factloom.operators import examples


def block(name, text):
    return (name, text, hashlib.sha256(text.encode()).hexdigest())


GOOD = {
    "example_id": 0, "query_type": "calculation", "question": "How did revenue change then?", "years": ["2025"], "evidence": [block("S1", "Revenue was 120, after (100) in 2024."), block("S2", "Other.")], "claims": [("It rose to 120 in 2025.", ["S1", "S2"])], "source_ids": ["S2", "S1"], "answer": "",
    "calculations": [("percentage_change", ["120", "(100)"], 1, "220.0", ["S1"])], "context": "", "usage": "train_candidate", "review_status": "approved", "reviewed_by": "me", "reviewed_at": "2024-01-01T00:00:00+00:00",
}
SCHEMA = (
    "example_id long, query_type string, question string, years array<string>, evidence array<struct<source_id:string,text:string,text_sha256:string>>, claims array<struct<text:string,source_ids:array<string>>>, source_ids array<string>, answer string, "
    "calculations array<struct<operation:string,operands:array<string>,places:int,result:string,source_ids:array<string>>>, context string, usage string, review_status string, reviewed_by string, reviewed_at string"
)


def edited(**changes):
    return copy.deepcopy(GOOD) | changes


CASES = [
    (GOOD, []),
    (edited(calculations=[("ratio", ["1", "0"], 1, "2", ["S1"]), ("sum", ["1", "x"], 0, "1", ["S9"]), ("sum", ["1", "2"], 0, "none", ["S1"]), ("percentage_of", ["1", "8"], 1, "12.4", ["S9"])]), ["calculation_1:not_computable", "calculation_2:not_computable", "calculation_3:not_a_number", "calculation_4:wrong_result:12.4:expected:12.5", "calculation_4:unknown_source_id"]),
    (edited(calculations=[]), ["calculation_query_requires_verified_calculation"]),
    (edited(claims=[], answer=examples.LACKING, source_ids=[]), ["canonical_insufficient_response_requires_matching_query_type"]),
    (edited(claims=[], answer="It was 120 [s1] and [S2].", context="7"), []),
    (edited(claims=[], answer="It was 7 [S1] [S2].", context="7"), []),
    (edited(question="Is it cafÃ© or S3?"), ["question_exposes_internal_source_ids", "mojibake_in_supervised_question_or_target"]),
    (edited(usage="test", reviewed_by="", reviewed_at="never"), []),
    (edited(reviewed_by="", reviewed_at="never"), ["approved_training_example_missing_reviewer", "approved_training_example_invalid_review_timestamp"]),
    ({n: 99 if n == "example_id" else None for n in GOOD}, ["question_too_short"]),
]


def test_reasons(spark):
    rows = [tuple((draft | {"example_id": i})[n] for n in GOOD) for i, (draft, _) in enumerate(CASES)]
    got = {r["example_id"]: r["errors"] for r in examples.example_errors(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, errors) in enumerate(CASES):
        assert got[i] == errors, i
