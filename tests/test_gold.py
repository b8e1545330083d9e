"""Validation of gold drafts: a good one, and one draft for each reason."""

import copy

from factloom.operators import gold

GOOD = {
    "record_id": 0, "question": "How did revenue change in 2025?", "years": ["2025"], "operations": ["difference", "percentage_change"], "requests": [("revenue", "a.md"), ("why", "b.md")], "supported": True, "reference": "Revenue rose by 20 to 120 million, 20%.", "limitations": [],
    "claims": [(["revenue"], ["E1"], ["Revenue was $120 million"]), (["why"], ["E2"], ["demand for the cloud"])], "facts": [("120", "million", ["E1"]), ("0.1", "billion", ["E1"])],
    "calculations": [("difference", ["120", "100"], 0, "20"), ("percentage_change", ["120", "100"], 2, "20.00")],
}
#: The prior year stands in millions only: a tenth of a billion is found as 100.
EVIDENCE = [(0, "E1", "a.md", ["revenue"], "(in millions) Revenue  was $120 million, against 100 in 2024."), (0, "E2", "b.md", ["why"], "It came from Demand for the cloud.")]
DRAFT = (
    "record_id long, question string, years array<string>, operations array<string>, requests array<struct<id:string,source:string>>, supported boolean, reference string, limitations array<string>, claims array<struct<requirement_ids:array<string>,evidence_ids:array<string>,quotes:array<string>>>, "
    "facts array<struct<value:string,unit:string,evidence_ids:array<string>>>, calculations array<struct<operation:string,operands:array<string>,places:int,result:string>>"
)


def edited(**changes):
    return copy.deepcopy(GOOD) | changes


def with_calc(*calcs):
    return edited(calculations=list(calcs), operations=[c[0] for c in calcs])


A, B = GOOD["claims"]
BACKED = GOOD["facts"] + [("100", "", ["E1"])]
CASES = [
    (edited(facts=BACKED), []),
    (edited(facts=GOOD["facts"][:1]), ["calculation_1:operand_2:not_evidence_backed:100", "calculation_2:operand_2:not_evidence_backed:100"]),
    (edited(facts=BACKED, supported=False), ["extractor_marked_unsupported"]),
    (edited(facts=BACKED, reference=" "), ["reference_is_empty"]),
    (edited(facts=BACKED, reference="It rose [e2]."), ["reference_contains_evidence_citation"]),
    (edited(facts=BACKED, limitations=["x"]), ["extractor_reported_limitations"]),
    (edited(facts=BACKED, claims=[]), ["claims_are_empty", "uncovered_requirement:revenue", "uncovered_requirement:why"]),
    (edited(facts=BACKED, claims=[(["revenue", "x"], ["E1"], []), B]), ["claim_1:unknown_requirement:x"]),
    (edited(facts=BACKED, claims=[(["revenue"], ["E1", "E7", "F1"], []), B]), ["claim_1:unknown_evidence:E7", "claim_1:unknown_evidence:F1"]),
    (edited(facts=BACKED, claims=[A, (["why"], ["E1"], [])]), ["claim_2:requirement_not_supported_by_cited_evidence:why", "expected_source_not_cited:b.md"]),
    (edited(facts=BACKED, claims=[A, (["why"], ["E2"], ["too short", "demand for the moon"])]), ["claim_2:quote_1:too_short", "claim_2:quote_2:not_found"]),
    (edited(facts=BACKED, claims=[A]), ["uncovered_requirement:why", "expected_source_not_cited:b.md"]),
    (edited(facts=[*BACKED, ("5", "", ["E9"]), ("none", "", ["E1"]), ("7", "", ["E1"]), ("120.0 million", "", ["E2"])]), ["numeric_fact_4:unknown_evidence", "numeric_fact_5:invalid_value:none", "numeric_fact_6:value_not_found:7", "numeric_fact_7:value_not_found:120.0 million"]),
    (edited(facts=BACKED, operations=["difference", "sum", "sum"]), ["missing_calculation:sum", "unexpected_calculation:percentage_change"]),
    (edited(facts=BACKED, calculations=[("difference", ["120", "100"], 0, "20"), ("percentage_change", ["120", "20"], 0, "500")]), ["percentage_change_operands_must_match_difference_new_and_old"]),
    (with_calc(("sum", ["120", "x"], 0, "120")) | {"facts": BACKED}, ["calculation_1:operand_2:invalid:x", "calculation_1:not_computable", "reference_number_not_supported:20"]),
    (with_calc(("difference", ["120", "100"], 0, "21"), ("ratio", ["21", "100"], 2, "0.21")) | {"facts": BACKED, "reference": ""}, ["reference_is_empty", "calculation_1:wrong_result:21:expected:20", "calculation_2:operand_1:not_evidence_backed:21"]),
    (with_calc(("difference", ["120", "100"], 0, "20"), ("percentage_of", ["20", "120"], 1, "16.7")) | {"facts": BACKED}, []),
    (edited(facts=BACKED, reference="It was 120, and 99 before."), ["reference_number_not_supported:99"]),
]


def test_every_reason(spark):
    names = list(GOOD)
    rows = [tuple(({**draft, "record_id": i})[n] for n in names) for i, (draft, _) in enumerate(CASES)]
    evidence = [(i, *e[1:]) for i in range(len(CASES)) for e in EVIDENCE]
    out = gold.gold_validate(spark.createDataFrame(rows, DRAFT), spark.createDataFrame(evidence, "record_id long, id string, source string, request_ids array<string>, text string")).collect()
    got = {r["record_id"]: (r["passed"], r["errors"]) for r in out}
    for i, (_, errors) in enumerate(CASES):
        assert got[i] == (not errors, errors), i


def test_nulls(spark):
    """Null lists count as empty ones; a draft without evidence supports nothing."""
    row = tuple(7 if n == "record_id" else None for n in GOOD)
    out = gold.gold_validate(spark.createDataFrame([row], DRAFT), spark.createDataFrame([], "record_id long, id string, source string, request_ids array<string>, text string")).collect()
    assert [(r["record_id"], r["errors"]) for r in out] == [(7, ["extractor_marked_unsupported", "reference_is_empty", "claims_are_empty"])]


def test_number_keys(spark):
    from pyspark.sql import functions as F

    given = {"$1,200.50": "1200.5", "007": "7", "0.50": "0.5", "100": "100", "-3.0%": "-3", "(4)": "4", "USD 5": "5", ".5": "0.5", "x": None, "": None, "0": "0", "1.2.3": None}
    out = spark.createDataFrame([(k,) for k in given], "x string").select("x", gold.number_key(F.col("x")).alias("k")).collect()
    assert {r["x"]: r["k"] for r in out} == given
