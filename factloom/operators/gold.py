"""Gold records: every reason why a drafted answer fails against its evidence, at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.evidence import _O, _orders

#: Numbers with their signs of money and percent, ids of evidence, the shortest quote.
NUMBER = r"(?i)(?<![\p{L}\p{N}_.])(?:USD\s*|\$\s*)?-?\(?\d[\d,]*(?:\.\d+)?\)?%?"
EVIDENCE_ID, QUOTE = r"^E[1-9]\d*$", 12
PERCENT = ("percentage_change", "percentage_of")
AMOUNT = "decimal(18,4)"
#: Places of a result at most.
PLACES = 6
ERRORS = "array<string>"


def number_key(raw: Column) -> Column:
    """One form of a number, without currency, commas, brackets and outer zeros; null where it is none."""
    bare = F.regexp_replace(raw, r"(?i)USD|[$,%\s()]", "")
    short = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(bare, r"\.?0*$", "")).otherwise(bare)
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(short, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), r"^(-?)(?=\.|$)", "$10"))


def number_keys(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), number_key)))


def lone_key(raw: Column) -> Column:
    """The key of a value, or of the only number in it."""
    found = F.regexp_extract_all(raw, F.lit(NUMBER), 0)
    return F.coalesce(number_key(raw), F.when(F.size(found) == 1, number_key(F.get(found, F.lit(0)))))


def _scaled(key: Column, by: str) -> Column:
    return number_key((key.cast("decimal(30,8)") * F.lit(by).cast("decimal(8,4)")).cast("decimal(38,10)").cast("string"))


def _each(of: Column, error) -> Column:
    """The errors of each element (one or null), by the element and its number from 1."""
    return F.array_compact(F.transform(of, lambda x, i: error(x, (i + 1).cast("string"))))


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def result_of(operation: Column, operands: Column, places: Column) -> Column:
    """The key of a calculation's result, half up; null where an operand is none or a divisor is zero."""
    value = lambda i: number_key(F.get(operands, F.lit(i))).cast(AMOUNT)
    a, b = value(0), F.nullif(value(1), F.lit(0).cast(AMOUNT))
    total = F.aggregate(operands, F.lit(0).cast("decimal(24,4)"), lambda t, x: (t + number_key(x).cast(AMOUNT)).cast("decimal(24,4)"))
    wide = lambda c: c.cast("decimal(38,12)")
    made = (
        F.when(operation == "difference", wide(value(0) - value(1))).when(operation == "percentage_change", wide((a - b) / b * 100)).when(operation == "percentage_of", wide(a / b * 100)).when(operation == "ratio", wide(a / b)).when(operation == "sum", wide(total))
    )

    def rounded(value: Column) -> Column:
        out = F.round(value, 0).cast("decimal(38,12)")
        for n in range(1, PLACES + 1):
            out = F.when(places == n, F.round(value, n).cast("decimal(38,12)")).otherwise(out)
        return out

    return T.let(T.let(made, rounded), lambda r: number_key(r.cast("string")))


def _claim_errors(requests: Column, evidence: Column) -> Column:
    known = lambda r: F.exists(requests, lambda q: q["id"] == r)
    item = lambda e: F.get(F.filter(evidence, lambda x: x["id"] == e), F.lit(0))
    fine = lambda e: e.rlike(EVIDENCE_ID) & F.exists(evidence, lambda x: x["id"] == e)

    def of(c: Column, n: Column) -> Column:
        held = F.transform(F.filter(c["evidence_ids"], fine), item)
        at = lambda *x: _said("claim_", n, ":", *x)

        def with_items(items: Column) -> Column:
            said = F.array_join(F.transform(items, lambda x: x["norm"]), " ")
            lacks = lambda r: known(r) & ~F.exists(items, lambda x: F.array_contains(x["request_ids"], r))
            quotes = T.let(said, lambda s: _each(c["quotes"], lambda q, i: F.when(F.length(F.trim(q)) < QUOTE, at("quote_", i, ":too_short")).when(~F.contains(s, T.fold_text(q)), at("quote_", i, ":not_found"))))
            return F.concat(F.transform(F.filter(c["requirement_ids"], lacks), lambda r: at("requirement_not_supported_by_cited_evidence:", r)), quotes)

        return F.concat(
            F.transform(F.filter(c["requirement_ids"], lambda r: ~known(r)), lambda r: at("unknown_requirement:", r)), F.transform(F.filter(c["evidence_ids"], lambda e: ~fine(e)), lambda e: at("unknown_evidence:", e)), T.let(held, with_items),
        )

    return F.flatten(F.transform(F.col("claims"), lambda c, i: of(c, (i + 1).cast("string"))))


def _facts(evidence: Column) -> Column:
    """Of each numeric fact its error, or its key: the value stands in its evidence, or in millions where it is in billions, or the other way."""

    def of(f: Column, n: Column) -> Column:
        items, key, unit = F.filter(evidence, lambda x: F.array_contains(f["evidence_ids"], x["id"])), lone_key(f["value"]), F.lower(F.concat_ws(" ", f["value"], f["unit"]))
        stands = lambda k, scale: F.exists(items, lambda x: F.array_contains(x["keys"], k) & (F.lit(True) if scale is None else F.contains(x["norm"], F.lit(scale))))
        backed = stands(key, None) | F.when(F.contains(unit, F.lit("billion")), F.coalesce(stands(_scaled(key, "1000"), "in millions"), F.lit(False))).when(F.contains(unit, F.lit("million")), F.coalesce(stands(_scaled(key, "0.001"), "in billions"), F.lit(False))).otherwise(False)
        unknown = ~F.forall(f["evidence_ids"], lambda e: F.exists(evidence, lambda x: x["id"] == e))
        error = F.when(unknown, _said("numeric_fact_", n, ":unknown_evidence")).when(key.isNull(), _said("numeric_fact_", n, ":invalid_value:", f["value"])).when(~backed, _said("numeric_fact_", n, ":value_not_found:", f["value"]))
        return F.struct(error.alias("error"), F.when(error.isNull(), key).alias("key"))

    return F.transform(F.col("facts"), lambda f, i: of(f, (i + 1).cast("string")))


def _operations() -> Column:
    """Operations of one multiset that the other has less often; and the pair of a difference and a change of the same two."""
    asked, done = F.col("operations"), F.transform("calculations", lambda c: c["operation"])
    times = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    more = lambda a, b, why: F.transform(F.filter(F.array_distinct(a), lambda x: times(a, x) > times(b, x)), lambda x: _said(why, x))
    pair = (F.array_sort(asked) == F.array(F.lit("difference"), F.lit("percentage_change"))) & (times(done, F.lit("difference")) == 1) & (times(done, F.lit("percentage_change")) == 1)
    operands = lambda op: F.get(F.filter("calculations", lambda c: c["operation"] == op), F.lit(0))["operands"]
    unlike = F.when(pair & (operands("difference") != operands("percentage_change")), F.lit("percentage_change_operands_must_match_difference_new_and_old"))
    return F.concat(more(asked, done, "missing_calculation:"), more(done, asked, "unexpected_calculation:"), F.array_compact(F.array(unlike)))


def _calculations(verified: Column) -> Column:
    """A fold over the calculations: operands are backed by facts or by the right results of earlier ones."""
    start = F.struct(F.array().cast(ERRORS).alias("errors"), verified.alias("backed"), F.lit(1).alias("n"))

    def step(state: Column, c: Column) -> Column:
        at = lambda *x: _said("calculation_", state["n"].cast("string"), ":", *x)
        operands = _each(c["operands"], lambda o, i: F.when(number_key(o).isNull(), at("operand_", i, ":invalid:", o)).when(~F.array_contains(state["backed"], number_key(o)), at("operand_", i, ":not_evidence_backed:", o)))
        both = F.struct(result_of(c["operation"], c["operands"], c["places"]).alias("expected"), number_key(c["result"]).alias("actual"))
        actual = number_key(c["result"])
        wrong = T.let(both, lambda x: F.when(x["expected"].isNull(), at("not_computable")).when(x["actual"].isNull(), at("not_a_number:", c["result"])).when(x["expected"] != x["actual"], at("wrong_result:", x["actual"], ":expected:", x["expected"])))
        return F.struct(F.concat(state["errors"], operands, F.array_compact(F.array(wrong))).alias("errors"), F.when(wrong.isNull(), F.array_append(state["backed"], actual)).otherwise(state["backed"]).alias("backed"), (state["n"] + 1).alias("n"))

    return F.aggregate("calculations", start, step, lambda s: s["errors"])


def gold_validate(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """record_id, passed, errors: all reasons of each draft in the order of the checks, each once.

    drafts: record_id, question, years, operations (arrays), requests (id, source), supported, reference, limitations, claims
    (requirement_ids, evidence_ids, quotes), facts (value, unit, evidence_ids), calculations (operation, operands, places,
    result). evidence: record_id, id, source, request_ids, text; the items of one draft are few. Amounts are DECIMALs of four
    places; results have six at most. Null texts count as empty, null arrays as empty ones.
    """
    lists = [c for c in ("years", "operations", "requests", "limitations", "claims", "facts", "calculations")]
    kinds = {f.name: f.dataType.simpleString() for f in drafts.schema}
    whole = drafts.withColumns({c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in lists} | {c: F.coalesce(F.col(c), F.lit("")) for c in ("question", "reference")})
    item = F.struct("id", "source", "request_ids", T.fold_text(F.col("text")).alias("norm"), number_keys(F.col("text")).alias("keys"))
    held = evidence.withColumn("text", F.coalesce("text", F.lit(""))).groupBy(F.col("record_id").alias("_rid")).agg(F.array_sort(F.collect_list(item)).alias("_held"))
    kind = f"array<{held.schema['_held'].dataType.elementType.simpleString()}>"
    met = whole.join(held.hint("merge"), F.col("record_id") == F.col("_rid"), "left").withColumn("_ev", F.coalesce("_held", F.array().cast(kind)))
    ev, requests = F.col("_ev"), F.col("requests")
    met = met.withColumn("_facts", _facts(ev)).withColumn("_keys", F.array_compact(F.transform("_facts", lambda f: f["key"])))
    ids = F.transform(requests, lambda q: q["id"])
    covered = F.array_distinct(F.flatten(F.transform("claims", lambda c: c["requirement_ids"])))
    supported = F.flatten(F.array(
        number_keys(F.col("question")), F.flatten(F.transform("years", number_keys)), F.flatten(F.transform(ev, lambda x: x["keys"])), F.col("_keys"), F.flatten(F.transform("calculations", lambda c: number_keys(c["result"]))),
        F.when(F.exists("calculations", lambda c: c["operation"].isin(*PERCENT)), F.array(F.lit("100"))).otherwise(F.array().cast(ERRORS)),
    ))
    cited = F.filter(ev, lambda x: x["id"].rlike(EVIDENCE_ID) & F.exists("claims", lambda c: F.array_contains(c["evidence_ids"], x["id"])))
    unheard = F.array_sort(F.array_except(F.transform(requests, lambda q: q["source"]), F.transform(cited, lambda x: x["source"])))
    plain = F.array_compact(F.array(
        F.when(~F.coalesce("supported", F.lit(False)), "extractor_marked_unsupported"), F.when(F.trim("reference") == "", "reference_is_empty"), F.when(F.col("reference").rlike(r"(?i)\[E\d+\]"), "reference_contains_evidence_citation"),
        F.when(F.size("limitations") > 0, "extractor_reported_limitations"), F.when(F.size("claims") == 0, "claims_are_empty"),
    ))
    errors = F.concat(
        plain, _claim_errors(requests, ev), F.transform(F.array_sort(F.array_except(ids, covered)), lambda r: _said("uncovered_requirement:", r)), F.array_compact(F.transform("_facts", lambda f: f["error"])), _operations(), _calculations(F.col("_keys")),
        F.transform(F.array_sort(F.array_except(number_keys(F.col("reference")), supported)), lambda v: _said("reference_number_not_supported:", v)), F.when(F.size(cited) > 0, F.transform(unheard, lambda s: _said("expected_source_not_cited:", s))).otherwise(F.array().cast(ERRORS)),
    )
    return met.select("record_id", F.array_distinct(errors).alias("errors")).select("record_id", (F.size("errors") == 0).alias("passed"), "errors")


# -- queries ----------------------------------------------------------------------------------------


def gold_drafts(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A draft an order, with faults of every kind by its key, and its two pieces of evidence."""
    k, p, c = F.col("o_orderkey"), F.col("price").cast("decimal(18,2)"), F.col("o_custkey").cast("string")
    text, when = lambda *x: _said(*x), lambda n, x, r=0: F.when(k % n == r, x)
    some = lambda *x: F.array_compact(F.array(*x))
    price = p.cast("string")
    first = (p - F.col("o_custkey") + (k % 9 == 0).cast("int")).cast("decimal(18,2)")
    lit = F.lit
    claim = lambda need, ev, quotes: F.struct(need.alias("requirement_ids"), ev.alias("evidence_ids"), quotes.alias("quotes"))
    claims = F.array(
        claim(some(lit("price"), when(7, lit("other"))), some(lit("E1"), when(5, lit("E9"))), some(text("price was $", price, " in  ", F.col("year")), when(6, lit("short")), when(4, lit("this is not in any text")))),
        claim(F.array(lit("ship")), F.array(F.when(k % 3 == 0, "E1").otherwise("E2")), F.array(text("SHIP priority ", c, " units"))),
    )
    fact = lambda v, u, e: F.struct(v.alias("value"), lit(u).alias("unit"), F.array(e).alias("evidence_ids"))
    facts = some(fact(price, "USD", lit("E1")), fact(lit("1.5"), "billion units", lit("E2")), fact(c, "", F.when(k % 5 == 1, "E9").otherwise("E2")), F.when(k % 8 == 0, fact(lit("n/a"), "", lit("E2"))))
    second = F.when(k % 10 == 0, "ratio").otherwise("sum")
    calculations = F.array(
        F.struct(lit("difference").alias("operation"), F.array(price, c).alias("operands"), lit(2).alias("places"), first.cast("string").alias("result")),
        F.struct(second.alias("operation"), F.array(first.cast("string"), lit("1.5")).alias("operands"), lit(2).alias("places"), result_of(second, F.array(first.cast("string"), lit("1.5")), lit(2)).alias("result")),
    )
    reference = F.when(k % 13 == 0, " ").otherwise(text("The price was ", price, "; 1.5 billion units", F.coalesce(when(11, lit(" [E1]")), lit("")), F.coalesce(when(29, lit(" and 77,777 more")), lit("")), "."))
    drafts = orders.select(
        k.alias("record_id"), text("What was the price in ", F.col("year"), "?").alias("question"), F.array("year").alias("years"), F.array(lit("difference"), lit("sum")).alias("operations"),
        F.array(F.struct(lit("price").alias("id"), F.concat(lit("s"), "o_orderstatus").alias("source")), F.struct(lit("ship").alias("id"), lit("x").alias("source"))).alias("requests"), (k % 17 != 0).alias("supported"), reference.alias("reference"),
        F.coalesce(when(19, F.array(lit("no more"))), F.array().cast(ERRORS)).alias("limitations"), F.when(k % 23 == 0, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"), facts.alias("facts"), calculations.alias("calculations"),
    )
    items = F.array(
        F.struct(lit("E1").alias("id"), F.concat(lit("s"), "o_orderstatus").alias("source"), F.array(lit("price")).alias("request_ids"), text("Total price was $", price, " in ", F.col("year"), " overall.").alias("text")),
        F.struct(lit("E2").alias("id"), lit("x").alias("source"), F.array(lit("ship")).alias("request_ids"), text("Ship  priority ", c, " units in\nmillions: 1,500 of them.").alias("text")),
    )
    return drafts, orders.select(k.alias("record_id"), F.explode(items).alias("e")).select("record_id", "e.*")


def q_gold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold_validate(*gold_drafts(_orders(spark, sf_dir)))
    return out.select("record_id", "passed", F.array_join("errors", ",").alias("errors"))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}

_PLAIN = "CASE WHEN contains({0}::VARCHAR, '.') THEN rtrim(rtrim({0}::VARCHAR, '0'), '.') ELSE {0}::VARCHAR END"
ORACLES = {
    "gold_validate": _O + f""", c AS (SELECT o_orderkey AS k, o_custkey AS c, price AS p, o_orderkey % 23 = 0 AS bare, price::DECIMAL(18,2) - o_custkey AS d, price::DECIMAL(18,2) - o_custkey + (o_orderkey % 9 = 0)::INT AS r FROM o),
e AS (SELECT k, [CASE WHEN k % 17 = 0 THEN 'extractor_marked_unsupported' END, CASE WHEN k % 13 = 0 THEN 'reference_is_empty' END, CASE WHEN k % 11 = 0 AND k % 13 <> 0 THEN 'reference_contains_evidence_citation' END, CASE WHEN k % 19 = 0 THEN 'extractor_reported_limitations' END, CASE WHEN bare THEN 'claims_are_empty' END,
 CASE WHEN NOT bare AND k % 7 = 0 THEN 'claim_1:unknown_requirement:other' END, CASE WHEN NOT bare AND k % 5 = 0 THEN 'claim_1:unknown_evidence:E9' END, CASE WHEN NOT bare AND k % 6 = 0 THEN 'claim_1:quote_2:too_short' END, CASE WHEN NOT bare AND k % 4 = 0 THEN CASE WHEN k % 6 = 0 THEN 'claim_1:quote_3:not_found' ELSE 'claim_1:quote_2:not_found' END END,
 CASE WHEN NOT bare AND k % 3 = 0 THEN 'claim_2:requirement_not_supported_by_cited_evidence:ship' END, CASE WHEN NOT bare AND k % 3 = 0 THEN 'claim_2:quote_1:not_found' END, CASE WHEN bare THEN 'uncovered_requirement:price' END, CASE WHEN bare THEN 'uncovered_requirement:ship' END,
 CASE WHEN k % 5 = 1 THEN 'numeric_fact_3:unknown_evidence' END, CASE WHEN k % 8 = 0 THEN 'numeric_fact_4:invalid_value:n/a' END, CASE WHEN k % 10 = 0 THEN 'missing_calculation:sum' END, CASE WHEN k % 10 = 0 THEN 'unexpected_calculation:ratio' END,
 CASE WHEN k % 5 = 1 AND c <> p THEN 'calculation_1:operand_2:not_evidence_backed:' || c END, CASE WHEN k % 9 = 0 THEN 'calculation_1:wrong_result:' || {_PLAIN.format('r')} || ':expected:' || {_PLAIN.format('d')} END, CASE WHEN k % 9 = 0 AND r <> p AND (r <> c OR k % 5 = 1) THEN 'calculation_2:operand_1:not_evidence_backed:' || r END,
 CASE WHEN k % 29 = 0 AND k % 13 <> 0 AND 77777 NOT IN (p, c, r) THEN 'reference_number_not_supported:77777' END, CASE WHEN NOT bare AND k % 3 = 0 THEN 'expected_source_not_cited:x' END] AS es FROM c)
SELECT k AS record_id, len(list_filter(es, lambda x: x IS NOT NULL)) = 0 AS passed, coalesce(array_to_string(es, ','), '') AS errors FROM e""",
}
