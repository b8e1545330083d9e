"""Training examples: every check of one example's evidence, claims, sources, numbers, arithmetic and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.answers import table_check
from factloom.operators.documents import mojibake
from factloom.operators.evidence import _O, _orders
from factloom.operators.gold import ERRORS, _said, result_of
from factloom.sources.shared import hinted, written

#: The one answer where evidence is lacking, citations, ids of sources, words of the shortest question.
LACKING = "I cannot find sufficient evidence in the retrieved financial documents to answer this question."
CITED, SOURCE_ID, WORDS = r"(?i)\[(S\d+)\]", r"(?i)\bS[1-9]\d*\b", 4


def _signed(of: Column) -> Column:
    """A number as a plain decimal: brackets make it negative; null where it is none."""
    return F.get(T.number_keys(of), F.lit(0))


def _listed(name: str, values: Column) -> Column:
    """One error that names all values, or none."""
    return F.when(F.size(values) > 0, _said(name, F.array_join(F.array_sort(values), ",")))


def _expected(operation: Column, given: Column, places: Column) -> Column:
    """The key of a calculation's result over plain numbers; a change is measured against the size of the old value."""
    old = F.get(given, F.lit(1))
    change = (F.get(given, F.lit(0)).cast("decimal(18,4)") - old.cast("decimal(18,4)")).cast("string")
    shrunk = (operation == "percentage_change") & old.startswith("-")
    return result_of(F.when(shrunk, "percentage_of").otherwise(operation), F.when(shrunk, F.array(change, F.substring(old, 2, 40))).otherwise(given), places)


def _wrong(calculation: Column, n: Column, known: Column) -> Column:
    """The errors of a calculation: it can't be done, its result is wrong, its sources aren't there."""
    at = lambda *x: _said("calculation_", n, ":", *x)
    both = T.let(F.transform(calculation["operands"], _signed), lambda given: F.struct(_expected(calculation["operation"], given, calculation["places"]).alias("expected"), _signed(calculation["result"]).alias("actual")))

    def errors(x: Column) -> Column:
        wrong = F.when(x["expected"].isNull(), at("not_computable")).when(x["actual"].isNull(), at("not_a_number")).when(x["expected"] != x["actual"], at("wrong_result:", x["actual"], ":expected:", x["expected"]))
        sources = F.when(x["expected"].isNotNull() & (F.size(F.array_except(calculation["source_ids"], known)) > 0), at("unknown_source_id"))
        return F.array_compact(F.array(wrong, sources))

    return T.let(both, errors)


def example_errors(examples: DataFrame) -> DataFrame:
    """example_id, errors: all that is wrong with each example, in the order of the checks, each once.

    examples: example_id (distinct), query_type, question, years, evidence (source_id, text, text_sha256), claims (text, source_ids),
    source_ids, answer, calculations (operation, operands, places, result, source_ids), context, usage, review_status,
    reviewed_by, reviewed_at. Null texts and arrays count as empty ones. Results have at most six places.
    """
    kinds = {f.name: f.dataType.simpleString() for f in examples.schema}
    lists, texts = ("years", "evidence", "claims", "source_ids", "calculations"), ("question", "answer", "context", "query_type", "usage", "review_status", "reviewed_by", "reviewed_at")
    e = examples.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in lists} | {c: F.coalesce(F.col(c), F.lit("")) for c in texts})
    e = written(e, "examples")
    # without a bar, a backtick or an empty bold marker no answer has such a fault
    marked = F.contains("answer", F.lit("|")) | F.contains("answer", F.lit("`")) | F.contains("answer", F.lit("****"))
    tables = table_check(e.filter((F.size("claims") == 0) & marked).select(F.col("example_id").alias("answer_id"), "answer")).filter("reason is not null").select(F.col("answer_id").alias("_tid"), F.concat(F.lit("target_table:"), "reason").alias("_table"))
    tables = written(tables, "tables")
    e = e.join(hinted(tables, tables.count(), 1_000_000), F.col("example_id") == F.col("_tid"), "left")
    with_claims = F.size("claims") > 0
    e = e.withColumns({
        "_known": F.transform("evidence", lambda b: b["source_id"]), "_cited": F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(CITED), 1), F.upper)), "_named": F.array_distinct(F.flatten(F.transform("claims", lambda c: c["source_ids"]))),
        "_said": F.concat_ws("\n", F.array(F.col("answer")), F.transform("claims", lambda c: c["text"])),
        "_numbers": F.flatten(F.array(F.flatten(F.transform("evidence", lambda b: T.number_keys(b["text"]))), T.number_keys(F.col("context")), T.number_keys(F.col("question")), F.col("years"))),
    }).withColumns({"_used": F.when(with_claims, F.col("_named")).otherwise(F.array_distinct("source_ids")), "_loose": F.array_except(T.number_keys(F.col("_said")), F.col("_numbers"))})
    e = written(e, "parts")
    known, cited, named, used, said = (F.col(c) for c in ("_known", "_cited", "_named", "_used", "_said"))
    unlike = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    lacking, plain = F.col("query_type") == "insufficient_evidence", F.trim("answer") == LACKING
    trained = (F.col("usage") == "train_candidate") & (F.col("review_status") == "approved")
    one = lambda c, why: F.when(c, why)
    first = F.array_compact(F.array(one(F.size(F.array_distinct(known)) < F.size(known), "duplicate_evidence_source_id")))
    hashes = F.transform(F.filter("evidence", lambda b: ~F.sha2(b["text"], 256).eqNullSafe(b["text_sha256"])), lambda b: _said("evidence_hash_mismatch:", b["source_id"]))
    middle = F.array_compact(F.array(
        one(with_claims & unlike(F.col("source_ids"), named), "top_level_source_ids_do_not_match_claims"), one(F.exists("claims", lambda c: c["text"].rlike(CITED)), "claim_text_contains_citation_markup"), F.col("_table"), one(~with_claims & unlike(cited, used), "answer_citations_do_not_match_source_ids"),
        _listed("unknown_target_source_ids:", F.array_except(used, known)), one(lacking & ~plain, "insufficient_evidence_target_must_use_canonical_response"), one(lacking & (with_claims | (F.size("source_ids") > 0)), "insufficient_evidence_target_must_not_cite_sources"),
        one(lacking & (F.size("calculations") > 0), "insufficient_evidence_target_must_not_include_calculations"), one(~lacking & plain, "canonical_insufficient_response_requires_matching_query_type"), one((F.col("query_type") == "calculation") & (F.size("calculations") == 0), "calculation_query_requires_verified_calculation"),
        _listed("unsupported_target_numbers:", F.col("_loose")),
    ))
    sums = F.flatten(F.transform("calculations", lambda c, i: _wrong(c, (i + 1).cast("string"), known)))
    last = F.array_compact(F.array(
        one(F.col("question").rlike(SOURCE_ID), "question_exposes_internal_source_ids"), one(F.size(F.regexp_extract_all("question", F.lit(r"(\S+)"), 1)) < WORDS, "question_too_short"), one(mojibake(F.concat_ws("\n", "question", said)), "mojibake_in_supervised_question_or_target"),
        one(trained & (F.trim("reviewed_by") == ""), "approved_training_example_missing_reviewer"), one(trained & T.zoned_timestamp(F.col("reviewed_at")).isNull(), "approved_training_example_invalid_review_timestamp"),
    ))
    return e.select("example_id", F.array_distinct(F.concat(first, hashes, middle, sums, last)).alias("errors"))


# -- queries ----------------------------------------------------------------------------------------


def made_examples(orders: DataFrame) -> DataFrame:
    """An example an order, with faults of every kind by its key."""
    k, lit, price, customer = F.col("o_orderkey"), F.lit, F.col("price").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(lit("The price was $"), price, lit(" and the number "), customer, lit("."))
    block = lambda name, t, h: F.struct(name.alias("source_id"), t.alias("text"), h.alias("text_sha256"))
    evidence = F.array(block(lit("S1"), text, F.when(k % 7 == 0, "none").otherwise(F.sha2(text, 256))), block(F.when(k % 11 == 0, "S1").otherwise("S2"), lit("Nothing."), F.sha2(lit("Nothing."), 256)))
    said = F.concat(lit("It was $"), price, F.when(k % 5 == 0, " or 987654321").otherwise(""), F.when(k % 9 == 0, " [S1]").otherwise(""))
    claims = F.array(F.struct(said.alias("text"), F.array(F.when(k % 13 == 0, "S8").otherwise("S1")).alias("source_ids")))
    whole = k % 3 != 0  # with claims
    lacking = (k % 17 == 0) & ~whole
    answer = F.when(lacking & (k % 2 == 0), f" {LACKING} ").when(whole, "").otherwise(F.concat(lit("It was $"), price, F.when(k % 4 == 0, " [s1]").otherwise(" [S2]"), F.when(k % 8 == 3, "\n| a | b |\n| 1 |").otherwise("")))
    result = (F.col("price") - F.col("o_custkey") + (k % 10 == 0).cast("int")).cast("string")
    calculations = F.array(F.struct(lit("difference").alias("operation"), F.array(price, customer).alias("operands"), lit(0).alias("places"), result.alias("result"), F.array(F.when(k % 14 == 0, "S5").otherwise("S1")).alias("source_ids")))
    kind = F.when(lacking, "insufficient_evidence").when(k % 2 == 0, "calculation").otherwise("direct")
    return orders.select(
        k.alias("example_id"), kind.alias("query_type"), F.when(k % 19 == 0, "Price?").when(k % 23 == 0, "What was the price in S2?").otherwise("What was the price then?").alias("question"), F.array("year").alias("years"), evidence.alias("evidence"),
        F.when(whole, claims).otherwise(F.slice(claims, 1, 0)).alias("claims"), F.when(lacking & (k % 2 == 0), F.array().cast(ERRORS)).otherwise(F.array(lit("S1"))).alias("source_ids"), answer.alias("answer"), F.when(k % 6 == 4, F.slice(calculations, 1, 0)).otherwise(calculations).alias("calculations"), lit("").alias("context"),
        F.when(k % 2 == 0, "train_candidate").otherwise("test").alias("usage"), lit("approved").alias("review_status"), F.when(k % 8 == 0, " ").otherwise("me").alias("reviewed_by"), F.when(k % 16 == 2, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("reviewed_at"),
    )


def q_validate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_errors(made_examples(_orders(spark, sf_dir))).select("example_id", F.array_join("errors", ",").alias("errors"))


QUERIES = {"validate_examples": q_validate_examples}
ORACLES = {
    "validate_examples": _O + """, c AS (SELECT o_orderkey AS k, o_custkey AS c, price AS p, o_orderkey % 3 <> 0 AS w, o_orderkey % 17 = 0 AND o_orderkey % 3 = 0 AS l, o_orderkey % 17 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS r, o_orderkey % 6 <> 4 AS calc FROM o),
e AS (SELECT k, [CASE WHEN k % 11 = 0 THEN 'duplicate_evidence_source_id' END, CASE WHEN k % 7 = 0 THEN 'evidence_hash_mismatch:S1' END, CASE WHEN w AND k % 13 = 0 THEN 'top_level_source_ids_do_not_match_claims' END, CASE WHEN w AND k % 9 = 0 THEN 'claim_text_contains_citation_markup' END,
 CASE WHEN NOT w AND NOT r AND k % 8 = 3 THEN 'target_table:incomplete_markdown_table' END, CASE WHEN NOT w AND NOT r AND k % 4 <> 0 THEN 'answer_citations_do_not_match_source_ids' END, CASE WHEN w AND k % 13 = 0 THEN 'unknown_target_source_ids:S8' END,
 CASE WHEN l AND NOT r THEN 'insufficient_evidence_target_must_use_canonical_response' END, CASE WHEN l AND NOT r THEN 'insufficient_evidence_target_must_not_cite_sources' END, CASE WHEN l AND calc THEN 'insufficient_evidence_target_must_not_include_calculations' END,
 CASE WHEN NOT l AND k % 2 = 0 AND NOT calc THEN 'calculation_query_requires_verified_calculation' END, CASE WHEN w AND k % 5 = 0 THEN 'unsupported_target_numbers:987654321' WHEN NOT w AND NOT r AND k % 8 = 3 THEN CASE WHEN c <> 1 AND p <> 1 THEN 'unsupported_target_numbers:1' END END,
 CASE WHEN calc AND k % 10 = 0 THEN 'calculation_1:wrong_result:' || (p - c + 1) || ':expected:' || (p - c) END, CASE WHEN calc AND k % 14 = 0 THEN 'calculation_1:unknown_source_id' END, CASE WHEN k % 23 = 0 AND k % 19 <> 0 THEN 'question_exposes_internal_source_ids' END, CASE WHEN k % 19 = 0 THEN 'question_too_short' END,
 CASE WHEN k % 8 = 0 THEN 'approved_training_example_missing_reviewer' END, CASE WHEN k % 16 = 2 THEN 'approved_training_example_invalid_review_timestamp' END] AS es FROM c) SELECT k AS example_id, coalesce(array_to_string(es, ','), '') AS errors FROM e""",
}
