"""Facts, quotes and answers against their sources; statements, gold sets, examples from tables, scopes of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources import views as V

#: Words that an excerpt needn't share with its source, and the forms of changes and amounts.
LOOSE = ("a", "an", "and", "as", "at", "for", "fiscal", "in", "million", "millions", "of", "the", "total", "was", "were")
TOKEN = r"([a-z0-9]+(?:\.[0-9]+)?)"
CHANGED = r"\E\s+(?:increased|decreased|grew|declined)\b.{0,80}?\b(\d+(?:\.\d+)?)\s*%"
MONEY = r"(?i)(\$\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:thousand|million|billion)s?\b)?|\d[\d,]*(?:\.\d+)?\s?(?:thousand|million|billion)s?\b)"
SPOKEN = r"\b(?:management|earnings\s+call|transcript|prepared\s+remarks)\b"
STATEMENT, SUPPLEMENT = r"(?i)(?:income statements|statements of operations)", "financial statements and supplementary data"
ITEM = r"^(\d{1,2})([A-C]?)$"


def shown(text: Column) -> Column:
    """Without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))


def folded(text: Column) -> Column:
    return F.lower(shown(text))


# -- facts, quotes and answers ------------------------------------------------------------------------


def fact_rejects(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """fact_id, reason (null: none), the first check that a fact fails.

    facts: fact_id, source_id, ticker, raw_value, label, period, excerpt; sources: source_id, ticker, in_scope, text.
    """
    n = sources.groupBy("source_id").agg(F.count("*").alias("_n"))
    alone = sources.join(n.filter("_n = 1"), "source_id", "left_semi").select("source_id", F.col("ticker").alias("_ticker"), "in_scope", shown(F.col("text")).alias("_t"))
    met = facts.join(n.hint("merge"), "source_id", "left").join(alone.hint("merge"), "source_id", "left").withColumns({"_f": F.lower("_t"), "_e": folded(F.col("excerpt"))})
    met = met.withColumns({"_et": F.regexp_extract_all("_e", F.lit(TOKEN), 1), "_st": F.array_distinct(F.regexp_extract_all("_f", F.lit(TOKEN), 1))})
    compact = lambda c: F.lower(F.regexp_replace(c, r"[\s,$€£¥]", ""))
    here = lambda t: F.array_contains("_st", t)
    words = F.filter("_et", lambda t: ~t.isin(*LOOSE) & ~t.rlike(r"\d"))
    numbers = F.filter("_et", lambda t: t.rlike(r"\d"))
    loose = (F.size("_et") >= 3) & F.forall(numbers, here) & F.when(F.size(words) == 0, F.size(numbers) > 0).otherwise(F.size(F.filter(words, here)) / F.size(words) >= 0.7)
    years = F.regexp_extract_all("period", F.lit(r"((?:19|20)\d{2})"), 1)
    reason = (
        F.when(F.col("_n") > 1, "duplicate_source_id").when(F.col("_n").isNull(), "unknown_source_id").when(~F.coalesce("in_scope", F.lit(False)), "source_outside_permitted_scope").when(~F.col("_ticker").eqNullSafe(F.col("ticker")), "ticker_source_mismatch")
        .when(~F.contains("_f", folded(F.col("raw_value"))) & ~F.contains(compact(F.col("_t")), compact(shown(F.col("raw_value")))), "raw_value_not_in_source").when(~F.contains("_f", folded(F.col("label"))), "metric_or_row_not_in_source")
        .when(~F.forall(years, lambda y: F.contains("_f", y)), "period_not_in_source").when((F.col("_e") == "") | ~(F.contains("_f", F.col("_e")) | loose), "evidence_excerpt_not_in_source")
    )
    return met.select("fact_id", reason.alias("reason"))


def change_check(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, valid, reason: a change stated for the metric must be the only one that the evidence states.

    answers: answer_id, metric, answer; evidence: answer_id, text.
    """
    pattern = F.concat(F.lit(r"(?is)\Q"), "metric", F.lit(CHANGED))
    number = lambda c: c.cast("decimal(18,6)")
    said = evidence.join(answers.select("answer_id", "metric"), "answer_id").select("answer_id", F.explode(F.regexp_extract_all("text", pattern, 1)).alias("p"))
    known = said.groupBy("answer_id").agg(F.min(number(F.col("p"))).alias("_e"), F.max(number(F.col("p"))).alias("_m")).filter("_e = _m")
    met = answers.join(known.hint("merge"), "answer_id", "left").withColumn("_c", F.transform(F.regexp_extract_all("answer", pattern, 1), number))
    wrong = F.exists("_c", lambda c: c != F.col("_e"))
    reason = F.when(F.col("_e").isNull(), "change_inconclusive").when(wrong, F.concat(F.lit("change_mismatch:"), F.col("_e").cast("string"), F.lit("%"))).when(F.size("_c") > 0, "change_verified").otherwise("change_unstated")
    return met.select("answer_id", (~reason.startswith("change_mismatch")).alias("valid"), reason.alias("reason"))


def _amount(raw: Column) -> Column:
    """In millions."""
    n = F.replace(F.regexp_extract(raw, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(",")).cast("decimal(20,4)")
    low = F.lower(raw)
    times = F.when(F.contains(low, F.lit("thousand")), F.lit("0.001")).when(F.contains(low, F.lit("billion")), F.lit("1000")).otherwise(F.lit("1")).cast("decimal(9,3)")
    return (n * times).cast("decimal(24,6)")


def reported_amount_check(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """answer_id, reason (null: fine): every known cell is stated and its source cited, and no other amount is stated.

    answers: answer_id, answer, cited (array); rows: answer_id, ord, label, value, scale, source_id. Amounts
    without a scale are millions; one in billions may differ by half of its last place.
    """
    places = lambda m: F.length(F.regexp_extract(m, r"\d\.(\d+)", 1))
    slack = lambda m: F.when(F.contains(F.lower(m), F.lit("billion")), (F.lit(500.0) / F.pow(F.lit(10.0), places(m))).cast("decimal(24,6)")).otherwise(F.lit(0).cast("decimal(24,6)"))
    claims = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(MONEY), 1), lambda m: F.struct(_amount(m).alias("v"), slack(m).alias("s")))
    told = answers.select("answer_id", claims.alias("_c"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))
    met = rows.withColumn("_v", _amount(F.concat_ws(" ", "value", "scale"))).join(told.hint("merge"), "answer_id")
    fault = F.when(~F.exists("_c", lambda c: F.abs(c["v"] - F.col("_v")) <= c["s"]), F.concat(F.lit("reported_value_missing_or_wrong:"), "label")).when(~F.array_contains("cited", F.col("source_id")), F.concat(F.lit("reported_value_source_not_cited:"), "label"))
    first = met.groupBy("answer_id").agg(F.min(F.when(fault.isNotNull(), F.struct("ord", fault.alias("why")))).alias("f"), F.collect_set("_v").alias("_vs"))
    other = F.exists("_c", lambda c: ~F.exists("_vs", lambda v: F.abs(c["v"] - v) <= c["s"]))
    return told.join(first.hint("merge"), "answer_id").select("answer_id", F.coalesce(F.col("f.why"), F.when(other, "unsupported_reported_amount")).alias("reason"))


def narrative_coverage(sources: DataFrame) -> DataFrame:
    """answer_id, missing: groups (ticker-year-type) with narrative sources of which none is cited, joined in order.

    sources: answer_id, ticker, year, doc_type, narrative, cited.
    """
    group = F.concat_ws("-", "ticker", F.col("year").cast("string"), F.upper(F.replace("doc_type", F.lit("-"))))
    each = sources.filter("narrative").groupBy("answer_id", group.alias("g")).agg(F.max("cited").alias("c"))
    return each.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("c"), F.col("g")))), ",").alias("missing"))


def transcript_citation_check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, missing: the first company, by line and name, whose commentary cites no transcript of its own ("": none).

    answers: answer_id, answer; sources: answer_id, source_id, ticker, doc_type.
    """
    lines = answers.select("answer_id", F.posexplode(F.split("answer", "\n")).alias("n", "line")).filter(F.lower("line").rlike(SPOKEN))
    own = sources.groupBy("answer_id", "ticker").agg(F.collect_set(F.when(F.upper("doc_type") == "TRANSCRIPT", F.upper("source_id"))).alias("own"))
    named = lines.join(own.hint("merge"), "answer_id").filter(F.expr(r"lower(line) rlike concat('\\b\\Q', lower(ticker), '\\E\\b')"))
    cited = F.transform(F.regexp_extract_all("line", F.lit(r"(?i)\[(S\d+)\]"), 1), F.upper)
    bad = named.filter(~F.arrays_overlap(cited, "own")).groupBy("answer_id").agg(F.min(F.struct("n", "ticker")).alias("f"))
    return answers.select("answer_id").join(bad.hint("merge"), "answer_id", "left").select("answer_id", F.coalesce(F.col("f.ticker"), F.lit("")).alias("missing"))


def quote_repair(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, quote (repaired), evidence_id (null: not found): end marks, then a leading speaker, go until some evidence holds the quote.

    claims: claim_id, request_id, quote; evidence: request_id, evidence_id, text, score. A cut quote needs 12 characters.
    """
    cut = F.regexp_replace("quote", r"[ .!?;:,]+$", "")
    bare = F.regexp_replace(cut, r"(?i)^(?:we|management|the company)\s+", "")
    forms = claims.select("claim_id", "request_id", "quote", F.posexplode(F.array(F.col("quote"), cut, bare)).alias("k", "q")).filter((F.col("k") == 0) | (F.length("q") >= 12))
    found = forms.join(evidence.hint("merge"), "request_id").filter(F.contains(T.fold_text(F.col("text")), T.fold_text(F.col("q"))))
    best = found.groupBy("claim_id").agg(F.min(F.struct("k", (-F.col("score")).alias("s"), (-F.col("evidence_id")).alias("e"), "q")).alias("b"))
    return claims.join(best.hint("merge"), "claim_id", "left").select("claim_id", F.coalesce("b.q", "quote").alias("quote"), (-F.col("b.e")).alias("evidence_id"))


def candidate_errors(candidates: DataFrame) -> DataFrame:
    """candidate_id, errors, joined. candidates: candidate_id, ticker, fiscal_year, doc_type (10K or TRANSCRIPT), question, claim, quote, evidence."""
    candidates = candidates.withColumn("question", F.coalesce("question", F.lit("")))
    q = F.lower("question")
    missing = F.array_except(T.number_keys(F.col("claim")), T.number_keys(F.col("quote")))
    errors = F.array_compact(F.array(
        F.when(~F.contains(q, F.lower("ticker")), "question_missing_company"), F.when(~F.contains("question", F.col("fiscal_year").cast("string")), "question_missing_source_fiscal_year"),
        F.when((F.col("doc_type") == "10K") & ~q.rlike("10-?k"), "question_missing_10k_source_type"), F.when((F.col("doc_type") == "TRANSCRIPT") & ~q.rlike("transcript|earnings[ -]call"), "question_missing_transcript_source_type"),
        F.when(~F.contains(T.fold_text(F.col("evidence")), T.fold_text(F.col("quote"))), "quote_not_exact"), F.when(F.size(missing) > 0, F.concat(F.lit("unsupported_numbers:"), F.array_join(F.array_sort(missing), "|"))),
    ))
    return candidates.select("candidate_id", F.array_join(errors, ",").alias("errors"))


# -- documents and statements -------------------------------------------------------------------------


def item_list(sections: DataFrame) -> DataFrame:
    """doc_id, item, title, place: one title an item, in capitals if there is one, then the first by part_no; items by number and letter.

    sections: doc_id, part_no, item, section.
    """
    clean = F.trim(F.regexp_replace("section", r"<[^>]+>", ""))
    s = sections.filter(F.col("item").rlike(ITEM)).withColumn("_s", clean).filter(F.expr(r"lower(_s) rlike concat('^', lower(item), '[.\\s]')"))
    title = F.regexp_replace("_s", r"\s+\d+$", "")
    best = s.withColumn("title", title).groupBy("doc_id", "item").agg(F.min(F.struct((F.col("title") != F.upper("title")).alias("low"), "part_no", "title")).alias("b"))
    order = W.partitionBy("doc_id").orderBy(F.regexp_extract("item", ITEM, 1).cast("int"), F.regexp_extract("item", ITEM, 2))
    return best.select("doc_id", "item", F.col("b.title").alias("title"), F.row_number().over(order).cast("long").alias("place"))


def primary_statement_filter(sources: DataFrame) -> DataFrame:
    """ask_id, source_id: sources with a primary statement in the supplementary data, where there are some; else all.

    sources: ask_id, source_id, section, text.
    """
    primary = F.contains(F.lower("section"), F.lit(SUPPLEMENT)) & F.col("text").rlike(STATEMENT)
    flagged = sources.select("ask_id", "source_id", F.coalesce(primary, F.lit(False)).alias("_p"))
    some = flagged.groupBy("ask_id").agg(F.max("_p").alias("_any"))
    return flagged.join(some.hint("merge"), "ask_id").filter("_p = _any").select("ask_id", "source_id")


def statement_answer(rows: DataFrame) -> DataFrame:
    """ask_id, answer: where each group has exactly one row and all rows one metric; one group gives a line, more a table.

    rows: ask_id, grp, metric, value.
    """
    each = rows.groupBy("ask_id", "grp").agg(F.count("*").alias("n"), F.min("metric").alias("lo"), F.max("metric").alias("hi"), F.min("value").alias("value"))
    one = each.groupBy("ask_id").agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("grp", "value"))).alias("g")).filter("n = 1 and lo = hi")
    table = F.concat(F.lit("| group | "), "lo", F.lit(" |\n| --- | --- |\n"), F.array_join(F.transform("g", lambda x: F.concat(F.lit("| "), x["grp"], F.lit(" | "), x["value"], F.lit(" |"))), "\n"))
    return one.select("ask_id", F.when(F.size("g") == 1, F.concat("lo", F.lit(": "), F.col("g")[0]["value"])).otherwise(table).alias("answer"))


def fact_recovery_tiers(found: DataFrame, first_exact: int = 4) -> DataFrame:
    """need_id, metric, tier, fact_id: facts of the earliest tier; exact tiers (first_exact on) replace those of their metric, the latest of them last."""
    exact = F.col("tier") >= first_exact
    rank = F.dense_rank().over(W.partitionBy("need_id", "metric").orderBy(exact.desc(), F.when(exact, -F.col("tier")).otherwise(F.col("tier"))))
    return found.withColumn("_r", rank).filter("_r = 1").select("need_id", "metric", "tier", "fact_id")


# -- gold sets and examples ---------------------------------------------------------------------------


def gold_schema_check(records: DataFrame) -> DataFrame:
    """id, errors: repeated ids, empty fields, empty scopes and unknown types of each record, joined.

    records: id, category, question, reference, tickers, years, doc_types (arrays).
    """
    n = records.groupBy("id").agg(F.count("*").alias("_n"))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    errors = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "missing id"), F.when(F.col("_n") > 1, "duplicate id"), *[F.when(empty(c), f"missing {c}") for c in ("category", "question", "reference")], *[F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, f"scope.{c} is empty") for c in ("tickers", "years", "doc_types")],
        F.when(F.exists("doc_types", lambda t: ~t.isin("10K", "TRANSCRIPT")), "invalid document types"),
    ))
    return records.join(n.hint("merge"), "id", "left").select("id", F.array_join(errors, ",").alias("errors"))


def gold_export(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """record_id, sources: of records that are approved and passed, the distinct cited (source#section), in order of the evidence's number.

    claims: record_id, evidence_no, source, section; reviews: record_id, status, passed.
    """
    fine = reviews.filter((F.lower(F.trim("status")) == "approved") & F.col("passed")).select("record_id").distinct()
    key = F.concat_ws("#", "source", "section")
    each = claims.join(fine.hint("merge"), "record_id", "left_semi").groupBy("record_id", key.alias("s")).agg(F.min("evidence_no").alias("n"))
    return each.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), ";").alias("sources"))


def seed_examples(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """record_id, split, ids: approved records as rows kept for evaluation, evidence ids E7, E3, ... as S1, S2, ... by first use.

    claims: record_id, pos, evidence_no.
    """
    used = claims.join(reviews.filter("status = 'approved' and passed").select("record_id").distinct(), "record_id", "left_semi").groupBy("record_id", "evidence_no").agg(F.min("pos").alias("p"))
    numbered = used.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("p", "evidence_no"))).alias("u"))
    ids = F.array_join(F.transform("u", lambda x, i: F.concat(F.lit("E"), x["evidence_no"].cast("string"), F.lit("=S"), (i + 1).cast("string"))), ",")
    return numbered.select("record_id", F.lit("evaluation_reserved").alias("split"), ids.alias("ids"))


def _newest(facts: DataFrame) -> DataFrame:
    line = W.partitionBy("ticker", "metric", "unit").orderBy(F.desc("fiscal_year"))
    return facts.withColumns({"older": F.lead("base_value").over(line), "older_year": F.lead("fiscal_year").over(line), "_r": F.row_number().over(line)}).filter("_r = 1 and older is not null")


def gen_targeted_table(facts: DataFrame) -> DataFrame:
    """ticker, metric, answer: the two newest periods as a table of two rows."""
    row = lambda y, v: F.concat(F.lit("| "), F.col(y).cast("string"), F.lit(" | "), F.col(v).cast("decimal(24,2)").cast("string"), F.lit(" |"))
    return _newest(facts).select("ticker", "metric", F.concat(F.lit("| year | "), "metric", F.lit(" |\n| --- | --- |\n"), row("fiscal_year", "base_value"), F.lit("\n"), row("older_year", "older")).alias("answer"))


def gen_calculation(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """ticker, metric, operation, result: of the newest change of each metric, the difference or the percentage in turn; existing ones (ticker, metric) are left out."""
    fresh = _newest(facts).filter("older <> 0").join(existing.hint("merge"), ["ticker", "metric"], "left_anti")
    turn = F.row_number().over(W.partitionBy("ticker").orderBy("metric")) % 2
    diff = (F.col("base_value") - F.col("older")).cast("decimal(24,2)").cast("double")
    ranked = fresh.withColumns({"_turn": turn, "_d": diff})
    return ranked.select("ticker", "metric", F.when(F.col("_turn") == 1, "difference").otherwise("percentage_change").alias("operation"), F.when(F.col("_turn") == 1, F.col("_d")).otherwise(F.round(F.col("_d") / F.abs(F.col("older").cast("double")) * 100, 2)).alias("result"))


# -- scopes of questions ------------------------------------------------------------------------------


def resolve_scope(asked: DataFrame, available: DataFrame) -> DataFrame:
    """question_id, decision, tickers, years, doc_type: the first decision that holds, with the scope that is searched.

    asked: question_id, out_of_scope, unsupported, relevant, followup, performance, q_tickers, q_years, q_types,
    ui_tickers, ui_years (arrays), ui_type, prev_tickers, prev_years, prev_type; available: ticker, year, doc_type.
    """
    some = lambda c: F.size(c) > 0
    differ = lambda a, b: some(a) & some(b) & (F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b)))
    none = F.array().cast("array<string>")

    def chosen(own: str, ui: str, prev: str, other: str) -> Column:
        return F.when(some(own), F.col(own)).when(some(ui), F.col(ui)).when(some(other) & (F.size(prev) > 1), none).when(F.col("followup"), F.col(prev)).otherwise(none)

    kind = F.when(F.size("q_types") == 1, F.get("q_types", F.lit(0))).when(F.size("q_types") > 1, F.lit(None)).when(F.col("ui_type").isNotNull(), F.col("ui_type")).when(F.col("followup"), F.col("prev_type"))
    s = asked.withColumns({"tickers": chosen("q_tickers", "ui_tickers", "prev_tickers", "q_years"), "years": chosen("q_years", "ui_years", "prev_years", "q_tickers"), "doc_type": kind})
    types = F.when(F.size("q_types") > 1, F.col("q_types")).otherwise(F.array(F.coalesce("doc_type", F.lit("*"))))
    wanted = s.select("question_id", F.explode("tickers").alias("ticker"), "years", types.alias("_types")).select("question_id", "ticker", F.explode("years").alias("year"), "_types").select("question_id", "ticker", "year", F.explode("_types").alias("doc_type"))
    loaded = available.distinct()
    any_type = loaded.groupBy("ticker", "year").agg(F.lit("*").alias("doc_type"), F.count("*").alias("kinds"))
    listed = loaded.withColumn("kinds", F.lit(1).cast("long")).unionByName(any_type)
    there = wanted.join(listed.hint("merge"), ["ticker", "year", "doc_type"], "left").groupBy("question_id").agg(F.max(F.col("kinds").isNull()).alias("_lacks"), F.max(F.coalesce("kinds", F.lit(0)) > 1).alias("_both"))
    decision = (
        F.when(F.col("out_of_scope") | F.col("unsupported") | (~F.col("relevant") & ~F.col("followup") & ~some("q_tickers") & ~some("q_years")), "out_of_scope")
        .when(differ("ui_tickers", "q_tickers") | differ("ui_years", "q_years") | (F.col("ui_type").isNotNull() & some("q_types") & (F.col("q_types") != F.array("ui_type"))), "scope_conflict")
        .when(~some("tickers") | ~some("years"), "clarify").when(F.col("_lacks"), "data_unavailable").when(F.col("performance") & ~some("q_types") & F.col("doc_type").isNull() & F.col("_both"), "clarify_basis").otherwise("search")
    )
    return s.join(there.hint("merge"), "question_id", "left").select("question_id", decision.alias("decision"), F.array_join("tickers", ",").alias("tickers"), F.array_join("years", ",").alias("years"), "doc_type")


# -- queries ------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string").alias("year"), F.round("o_totalprice").cast("long").alias("price"))


_O = "WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, year(o_orderdate)::VARCHAR AS year, round(o_totalprice)::BIGINT AS price FROM orders)"


def q_fact_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact a document: its words as value, label and excerpt; some are wrong by their id."""
    i, d = F.col("doc_id"), V.segments(spark, sf_dir).withColumn("w", F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    part = F.slice("w", 3, 8)
    excerpt = F.when(i % 3 == 0, F.array_join(part, " ")).when(i % 3 == 1, F.concat(F.array_join(F.reverse(part), " "), F.lit(" zzz"))).otherwise(F.concat(F.array_join(part, " "), F.lit(" 987654321")))
    facts = d.select(
        i.alias("fact_id"), F.when(i % 17 == 0, i + 1_000_000_000).otherwise(i).alias("source_id"), F.when(i % 13 == 0, "other").otherwise(F.col("ticker")).alias("ticker"), F.when(i % 5 == 0, "987,654").otherwise(F.coalesce(F.get("w", F.lit(2)), F.lit(""))).alias("raw_value"),
        F.when(i % 7 == 0, "no such label").otherwise(F.coalesce(F.get("w", F.lit(0)), F.lit(""))).alias("label"), F.when(i % 11 == 0, "FY2021").otherwise("none").alias("period"), excerpt.alias("excerpt"),
    )
    sources = d.select(i.alias("source_id"), "ticker", (i % 19 != 0).alias("in_scope"), "text")
    return fact_rejects(facts, sources.unionByName(sources.filter("source_id % 23 = 0")))


def q_change_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    said = F.concat(F.lit("Total sales "), F.when(F.col("o_orderkey") % 2 == 0, "increased by ").otherwise("were flat at "), (F.col("o_custkey") % 3 + F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)).cast("string"), F.lit(".5 %"))
    c = F.col("answer_id")
    told = F.when(c % 4 == 0, "Nothing was said.").when(c % 5 == 0, "total sales grew to 9.50%.").otherwise(F.concat(F.lit("TOTAL SALES grew by "), (c % 3).cast("string"), F.lit(".50%.")))
    answers = o.select(F.col("o_custkey").alias("answer_id")).distinct().select("answer_id", F.lit("total sales").alias("metric"), told.alias("answer"))
    return change_check(answers, o.select(F.col("o_custkey").alias("answer_id"), said.alias("text")))


def q_reported_amount_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    rows = o.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("$"), F.col("price").cast("string")).alias("value"), F.lit("thousands").alias("scale"), F.concat(F.lit("S"), (F.col("o_orderkey") % 3).cast("string")).alias("source_id"))
    line = F.concat(F.lit("It was $"), F.col("price").cast("string"), F.when(F.col("o_orderkey") % 80 == 0, " million.").otherwise(" thousand."))
    c = F.col("answer_id")
    answers = o.groupBy(F.col("o_custkey").alias("answer_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda x: x["x"]), " ").alias("a"))
    answers = answers.select("answer_id", F.concat("a", F.when(c % 5 == 0, " In all $1.5 billion.").otherwise("")).alias("answer"), F.when(c % 4 == 0, F.array(F.lit("S0"), F.lit("S1"))).otherwise(F.array(F.lit("S0"), F.lit("S1"), F.lit("S2"))).alias("cited"))
    return reported_amount_check(answers, rows)


def q_narrative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return narrative_coverage(_orders(spark, sf_dir).select(F.col("o_custkey").alias("answer_id"), F.col("o_orderstatus").alias("ticker"), "year", F.when(k % 4 < 2, "10-K").otherwise("transcript").alias("doc_type"), (k % 5 != 0).alias("narrative"), (k % 3 != 0).alias("cited")))


def q_transcript_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    line = F.concat(F.when(k % 3 == 0, "Management of ").otherwise("Sales of "), "o_orderstatus", F.lit(" said so [s"), (k % 7).cast("string"), F.lit("]"))
    answers = o.groupBy(F.col("o_custkey").alias("answer_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda x: x["x"]), "\n").alias("answer"))
    sources = o.select(F.col("o_custkey").alias("answer_id"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("source_id"), F.col("o_orderstatus").alias("ticker"), F.when(k % 2 == 0, "transcript").otherwise("10K").alias("doc_type"))
    return transcript_citation_check(answers, sources)


def q_quote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the documents' first lines, with end marks and speakers that the text lacks."""
    i, first = F.col("doc_id"), F.regexp_extract("text", r"^([^\n]{0,80})", 1)
    quote = F.when(i % 4 == 0, first).when(i % 4 == 1, F.concat(first, F.lit(" ;!"))).when(i % 4 == 2, F.concat(F.lit("We "), first, F.lit("#."))).otherwise(F.concat(F.lit("Management "), first, F.lit(";")))
    d = V.segments(spark, sf_dir)
    near = d.select(i.alias("request_id"), (i * 2).alias("evidence_id"), "text", (i % 5).alias("score")).unionByName(d.select(i.alias("request_id"), (i * 2 + 1).alias("evidence_id"), first.alias("text"), (i % 3).alias("score")))
    return quote_repair(d.select(i.alias("claim_id"), i.alias("request_id"), quote.alias("quote")), near)


def q_candidate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    kind = F.when(k % 2 == 0, "10K").otherwise("TRANSCRIPT")
    question = F.concat(F.lit("In the "), F.when(k % 5 < 3, kind).otherwise("10-k"), F.lit(", what was the price of "), F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise("it"), F.lit(" in "), F.when(k % 3 != 0, F.col("year")).otherwise("the year"), F.lit("?"))
    quote = F.concat(F.lit("The price was "), F.col("price").cast("string"))
    return candidate_errors(o.select(k.alias("candidate_id"), F.col("o_orderpriority").alias("ticker"), F.col("year").alias("fiscal_year"), kind.alias("doc_type"), question.alias("question"), F.concat(F.lit("It was "), (F.col("price") + (k % 11 == 0).cast("int")).cast("string")).alias("claim"), quote.alias("quote"), F.when(k % 13 == 0, "Nothing here").otherwise(F.concat(F.lit("So:  the PRICE was "), F.col("price").cast("string"), F.lit("."))).alias("evidence")))


def q_item_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    item = F.concat((k % 12 + 1).cast("string"), F.when(k % 5 == 0, "A").when(k % 17 == 0, "Z").otherwise(""))
    title = F.concat(F.when(k % 9 == 0, "see ").otherwise(""), F.lit("<b>"), item, F.lit("</b>. "), F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")), F.lit("  "), F.col("price").cast("string"))
    return item_list(o.select((F.col("o_custkey") % 100).alias("doc_id"), k.alias("part_no"), item.alias("item"), title.alias("section")))


def q_primary_statement_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    return primary_statement_filter(o.select(F.col("o_custkey").alias("ask_id"), k.alias("source_id"), F.when(k % 5 == 0, "Item 8. Financial Statements and Supplementary Data").otherwise("Item 7").alias("section"), F.when(k % 2 == 0, "CONSOLIDATED STATEMENTS OF OPERATIONS").otherwise("notes").alias("text")))


def q_statement_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return statement_answer(rows.select(F.col("o_custkey").alias("ask_id"), F.col("year").alias("grp"), F.col("o_orderpriority").alias("metric"), F.col("price").cast("string").alias("value")))


def q_fact_recovery_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return fact_recovery_tiers(_orders(spark, sf_dir).select(F.col("o_custkey").alias("need_id"), F.col("o_orderpriority").alias("metric"), F.when(k % 10 < 8, k % 3 + 1).otherwise(k % 2 + 4).cast("long").alias("tier"), k.alias("fact_id")))


def q_gold_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    o = _orders(spark, sf_dir)
    return gold_schema_check(o.select(F.when(k % 20 == 0, F.lit(0)).otherwise(k).alias("id"), F.col("o_orderpriority").alias("category"), F.when(k % 7 == 0, "  ").otherwise("what?").alias("question"), F.when(k % 6 == 0, F.lit(None)).otherwise("that").alias("reference"), F.array("o_orderstatus").alias("tickers"), F.when(k % 5 == 0, none).otherwise(F.array("year")).alias("years"), F.when(k % 4 == 0, F.array(F.lit("10K"))).when(k % 4 == 1, none).otherwise(F.array(F.lit("TRANSCRIPT"), F.when(k % 8 == 2, "8-K").otherwise("10K"))).alias("doc_types")))


def _claims(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 7 % 11).alias("evidence_no"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("section"))


def _reviews(o: DataFrame) -> DataFrame:
    c = F.col("record_id")
    return o.select(F.col("o_custkey").alias("record_id")).distinct().select("record_id", F.when(c % 3 == 0, "rejected").otherwise("approved").alias("status"), (c % 5 != 0).alias("passed"))


def q_gold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return gold_export(_claims(o), _reviews(o))


def q_seed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return seed_examples(_claims(o), _reviews(o))


def q_gen_targeted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_targeted_table(V.facts(spark, sf_dir))


def q_gen_calculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.facts(spark, sf_dir)
    return gen_calculation(f, f.filter("fiscal_year = 1996 and unit = 'percent'").select("ticker", "metric").distinct())


def q_resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question an order; what is loaded are the customers' groups, years and statuses."""
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    none, lone = F.array().cast("array<string>"), lambda x: F.array(F.lit(x))
    asked = o.select(
        k.alias("question_id"), (k % 29 == 0).alias("out_of_scope"), (k % 31 == 0).alias("unsupported"), (k % 7 != 0).alias("relevant"), (k % 5 < 2).alias("followup"), (k % 4 == 1).alias("performance"),
        F.when(k % 3 == 0, none).otherwise(F.array(F.concat(F.lit("T"), (F.col("o_custkey") * 7 % 45).cast("string")))).alias("q_tickers"), F.when(k % 4 == 0, none).otherwise(F.array("year")).alias("q_years"),
        F.when(k % 10 == 1, F.array(F.lit("F"), F.lit("O"))).when(k % 10 == 3, F.array("o_orderstatus")).otherwise(none).alias("q_types"), F.when(k % 6 == 0, lone("T3")).otherwise(none).alias("ui_tickers"), F.when(k % 8 == 0, lone("1997")).otherwise(none).alias("ui_years"),
        F.when(k % 9 == 0, "F").alias("ui_type"), F.when(k % 11 < 6, lone("T1")).otherwise(F.array(F.lit("T1"), F.lit("T2"))).alias("prev_tickers"), lone("1996").alias("prev_years"), F.when(k % 13 == 0, "O").alias("prev_type"),
    )
    return resolve_scope(asked, o.select(F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), "year", F.col("o_orderstatus").alias("doc_type")))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}


def _fold(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '‘’“”–—' || chr(160), '''''" + '""' + rf"-- ')), '\s+', ' ', 'g'))"


_F = V.with_views("facts")
_NEW = _F + ", n AS (SELECT *, lead(base_value) OVER w AS older, lead(fiscal_year) OVER w AS older_year, row_number() OVER w AS r FROM facts WINDOW w AS (PARTITION BY ticker, metric, unit ORDER BY fiscal_year DESC))"
_CR = ", c AS (SELECT o_custkey AS record_id, o_orderkey AS pos, o_orderkey * 7 % 11 AS evidence_no, o_orderstatus || '#' || o_orderpriority AS s FROM o WHERE o_custkey % 3 <> 0 AND o_custkey % 5 <> 0)"
_CUT = r"regexp_replace(quote, '[ .!?;:,]+$', '')"
ORACLES = {
    "fact_rejects": rf"""WITH w AS (SELECT doc_id AS i, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(\S+)', 1) AS w FROM documents),
f AS (SELECT i, CASE WHEN i % 5 = 0 THEN '987,654' ELSE coalesce(w[3], '') END AS raw, CASE WHEN i % 7 = 0 THEN 'no such label' ELSE coalesce(w[1], '') END AS label, {_fold('text')} AS t,
 {_fold("CASE i % 3 WHEN 0 THEN array_to_string(w[3:10], ' ') WHEN 1 THEN array_to_string(list_reverse(w[3:10]), ' ') || ' zzz' ELSE array_to_string(w[3:10], ' ') || ' 987654321' END")} AS e FROM w),
g AS (SELECT *, {_fold('raw')} AS r, regexp_extract_all(e, '{TOKEN}', 1) AS et, list_distinct(regexp_extract_all(t, '{TOKEN}', 1)) AS st FROM f),
h AS (SELECT *, list_filter(et, lambda x: x NOT IN {LOOSE} AND NOT regexp_matches(x, '\d')) AS ws, list_filter(et, lambda x: regexp_matches(x, '\d')) AS ns FROM g),
m AS (SELECT *, len(et) >= 3 AND len(list_filter(ns, lambda x: NOT list_contains(st, x))) = 0 AND CASE WHEN len(ws) = 0 THEN len(ns) > 0 ELSE len(list_filter(ws, lambda x: list_contains(st, x))) / len(ws) >= 0.7 END AS loose FROM h)
SELECT i AS fact_id, CASE WHEN i % 17 = 0 THEN 'unknown_source_id' WHEN i % 23 = 0 THEN 'duplicate_source_id' WHEN i % 19 = 0 THEN 'source_outside_permitted_scope' WHEN i % 13 = 0 THEN 'ticker_source_mismatch'
 WHEN NOT contains(t, r) AND NOT contains(regexp_replace(t, '[\s,$€£¥]', '', 'g'), regexp_replace(r, '[\s,$€£¥]', '', 'g')) THEN 'raw_value_not_in_source' WHEN NOT contains(t, {_fold('label')}) THEN 'metric_or_row_not_in_source'
 WHEN i % 11 = 0 AND NOT contains(t, '2021') THEN 'period_not_in_source' WHEN e = '' OR NOT (contains(t, e) OR loose) THEN 'evidence_excerpt_not_in_source' END AS reason FROM m""",
    "change_check": _O + """, e AS (SELECT o_custkey AS a, (o_custkey % 3 + CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END + 0.5)::DECIMAL(18,6) AS p FROM o WHERE o_orderkey % 2 = 0), k AS (SELECT a, min(p) AS e FROM e GROUP BY a HAVING min(p) = max(p)),
s AS (SELECT o_custkey AS a, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 9.5 ELSE o_custkey % 3 + 0.5 END::DECIMAL(18,6) AS c FROM (SELECT DISTINCT o_custkey FROM o)),
r AS (SELECT a, CASE WHEN e IS NULL THEN 'change_inconclusive' WHEN c <> e THEN 'change_mismatch:' || e || '%' WHEN c IS NOT NULL THEN 'change_verified' ELSE 'change_unstated' END AS reason FROM s LEFT JOIN k USING (a)) SELECT a AS answer_id, NOT starts_with(reason, 'change_mismatch') AS valid, reason FROM r""",
    "reported_amount_check": _O + """, c AS (SELECT o_custkey AS a, (price * CASE WHEN o_orderkey % 80 = 0 THEN 1 ELSE 0.001 END)::DECIMAL(24,6) AS v, 0.0 AS s FROM o UNION ALL SELECT DISTINCT o_custkey, 1500.0, 50.0 FROM o WHERE o_custkey % 5 = 0),
t AS (SELECT o_custkey AS a, o_orderkey, o_orderpriority AS label, (price * 0.001)::DECIMAL(24,6) AS v, NOT (o_custkey % 4 = 0 AND o_orderkey % 3 = 2) AS cited FROM o),
x AS (SELECT a, o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.a = t.a AND abs(c.v - t.v) <= c.s) THEN 'reported_value_missing_or_wrong:' || label WHEN NOT cited THEN 'reported_value_source_not_cited:' || label END AS why FROM t),
f AS (SELECT a, arg_min(why, o_orderkey) FILTER (WHERE why IS NOT NULL) AS why FROM x GROUP BY a), u AS (SELECT DISTINCT a FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = c.a AND abs(c.v - t.v) <= c.s))
SELECT f.a AS answer_id, CASE WHEN why IS NOT NULL THEN why WHEN u.a IS NOT NULL THEN 'unsupported_reported_amount' END AS reason FROM f LEFT JOIN u ON f.a = u.a""",
    "narrative_coverage": _O + ", g AS (SELECT o_custkey, o_orderstatus || '-' || year || '-' || CASE WHEN o_orderkey % 4 < 2 THEN '10K' ELSE 'TRANSCRIPT' END AS g, bool_or(o_orderkey % 3 <> 0) AS c FROM o WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2) SELECT o_custkey AS answer_id, coalesce(string_agg(g, ',' ORDER BY g) FILTER (WHERE NOT c), '') AS missing FROM g GROUP BY 1",
    "transcript_citation_check": _O + ", t AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderkey % 7 AS s FROM o WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS x FROM o WHERE o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.o_custkey = o.o_custkey AND t.o_orderstatus = o.o_orderstatus AND t.s = o.o_orderkey % 7) GROUP BY o_custkey) SELECT o_custkey AS answer_id, coalesce(x, '') AS missing FROM (SELECT DISTINCT o_custkey FROM o) LEFT JOIN b USING (o_custkey)",
    "quote_repair": rf"""WITH d AS (SELECT doc_id AS i, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^([^\n]{{0,80}})', 1) AS first FROM documents),
q AS (SELECT *, CASE i % 4 WHEN 0 THEN first WHEN 1 THEN first || ' ;!' WHEN 2 THEN 'We ' || first || '#.' ELSE 'Management ' || first || ';' END AS quote FROM d),
v AS (SELECT i, quote, 0 AS k, quote AS q FROM q UNION ALL SELECT i, quote, 1, {_CUT} FROM q UNION ALL SELECT i, quote, 2, regexp_replace({_CUT}, '(?i)^(?:we|management|the company)\s+', '') FROM q),
e AS (SELECT i, i * 2 AS id, text, i % 5 AS score FROM d UNION ALL SELECT i, i * 2 + 1, first, i % 3 FROM d),
b AS (SELECT i, q, id, row_number() OVER (PARTITION BY i ORDER BY k, score DESC, id DESC) AS r FROM v JOIN e USING (i) WHERE (k = 0 OR length(q) >= 12) AND contains({_plain('text')}, {_plain('q')}))
SELECT q.i AS claim_id, coalesce(b.q, quote) AS quote, b.id AS evidence_id FROM q LEFT JOIN b ON q.i = b.i AND b.r = 1""",
    "candidate_errors": _O + """, c AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '10K' ELSE 'TRANSCRIPT' END AS kind FROM o), s AS (SELECT *, CASE WHEN o_orderkey % 5 < 3 THEN lower(kind) ELSE '10-k' END AS said FROM c)
SELECT o_orderkey AS candidate_id, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'question_missing_company' END, CASE WHEN o_orderkey % 3 = 0 THEN 'question_missing_source_fiscal_year' END, CASE WHEN kind = '10K' AND said NOT LIKE '10%' THEN 'question_missing_10k_source_type' END,
 CASE WHEN kind = 'TRANSCRIPT' AND said <> 'transcript' THEN 'question_missing_transcript_source_type' END, CASE WHEN o_orderkey % 13 = 0 THEN 'quote_not_exact' END, CASE WHEN o_orderkey % 11 = 0 THEN 'unsupported_numbers:' || (price + 1) END) AS errors FROM s""",
    "item_list": _O + ", s AS (SELECT o_custkey % 100 AS doc_id, o_orderkey, (o_orderkey % 12 + 1) || CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE '' END AS item, o_orderkey % 2 = 0 AS up, o_orderpriority AS p FROM o WHERE o_orderkey % 9 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 17 <> 0)), t AS (SELECT *, item || '. ' || CASE WHEN up THEN upper(p) ELSE lower(p) END AS title FROM s), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY title <> upper(title), o_orderkey) = 1) SELECT doc_id, item, title, row_number() OVER (PARTITION BY doc_id ORDER BY rtrim(item, 'A')::INT, item) AS place FROM b",
    "primary_statement_filter": _O + ", f AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 = 0 AS p FROM o) SELECT o_custkey AS ask_id, o_orderkey AS source_id FROM f QUALIFY p = bool_or(p) OVER (PARTITION BY o_custkey)",
    "statement_answer": _O + ", g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT year) AS y, count(DISTINCT o_orderpriority) AS m, min(o_orderpriority) AS p, min(price) AS v, string_agg('| ' || year || ' | ' || price || ' |', chr(10) ORDER BY year) AS t FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey) SELECT o_custkey AS ask_id, CASE WHEN n = 1 THEN p || ': ' || v ELSE '| group | ' || p || ' |' || chr(10) || '| --- | --- |' || chr(10) || t END AS answer FROM g WHERE n = y AND m = 1",
    "fact_recovery_tiers": _O + ", f AS (SELECT o_custkey AS need_id, o_orderpriority AS metric, CASE WHEN o_orderkey % 10 < 8 THEN o_orderkey % 3 + 1 ELSE o_orderkey % 2 + 4 END AS tier, o_orderkey AS fact_id FROM o), g AS (SELECT *, max(tier) OVER w AS hi, min(tier) OVER w AS lo FROM f WINDOW w AS (PARTITION BY need_id, metric)) SELECT need_id, metric, tier, fact_id FROM g WHERE tier = CASE WHEN hi >= 4 THEN hi ELSE lo END",
    "gold_schema_check": _O + ", r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE o_orderkey END AS id FROM o) SELECT id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END, CASE WHEN k % 7 = 0 THEN 'missing question' END, CASE WHEN k % 6 = 0 THEN 'missing reference' END, CASE WHEN k % 5 = 0 THEN 'scope.years is empty' END, CASE WHEN k % 4 = 1 THEN 'scope.doc_types is empty' END, CASE WHEN k % 8 = 2 THEN 'invalid document types' END) AS errors FROM r",
    "gold_export": _O + _CR + ", g AS (SELECT record_id, s, min(evidence_no) AS n FROM c GROUP BY record_id, s) SELECT record_id, string_agg(s, ';' ORDER BY n, s) AS sources FROM g GROUP BY record_id",
    "seed_examples": _O + _CR + ", g AS (SELECT record_id, evidence_no, min(pos) AS p FROM c GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p) AS k FROM g) SELECT record_id, 'evaluation_reserved' AS split, string_agg('E' || evidence_no || '=S' || k, ',' ORDER BY k) AS ids FROM n GROUP BY record_id",
    "gen_targeted_table": _NEW + " SELECT ticker, metric, '| year | ' || metric || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || fiscal_year || ' | ' || base_value::DECIMAL(24,2) || ' |' || chr(10) || '| ' || older_year || ' | ' || older::DECIMAL(24,2) || ' |' AS answer FROM n WHERE r = 1 AND older IS NOT NULL",
    "gen_calculation": _NEW + ", x AS (SELECT DISTINCT ticker, metric FROM facts WHERE fiscal_year = 1996 AND unit = 'percent'), c AS (SELECT ticker, metric, (base_value - older)::DECIMAL(24,2)::DOUBLE AS d, abs(older::DOUBLE) AS o, row_number() OVER (PARTITION BY ticker ORDER BY metric) % 2 AS t FROM n ANTI JOIN x USING (ticker, metric) WHERE r = 1 AND older <> 0) SELECT ticker, metric, CASE WHEN t = 1 THEN 'difference' ELSE 'percentage_change' END AS operation, CASE WHEN t = 1 THEN d ELSE round(d / o * 100, 2) END AS result FROM c",
    "resolve_scope": _O + """, a AS (SELECT o_orderkey AS k, k % 5 < 2 AS fu, CASE WHEN k % 3 <> 0 THEN 'T' || (o_custkey * 7 % 45) END AS qt, CASE WHEN k % 4 <> 0 THEN year END AS qy, CASE WHEN k % 10 = 1 THEN 'both' WHEN k % 10 = 3 THEN o_orderstatus END AS qk, CASE WHEN k % 6 = 0 THEN 'T3' END AS ut, CASE WHEN k % 8 = 0 THEN '1997' END AS uy, CASE WHEN k % 9 = 0 THEN 'F' END AS uk, k % 11 < 6 AS lone, CASE WHEN k % 13 = 0 THEN 'O' END AS pk FROM o),
s AS (SELECT *, CASE WHEN qt IS NOT NULL THEN qt WHEN ut IS NOT NULL THEN ut WHEN qy IS NOT NULL AND NOT lone THEN '' WHEN fu THEN CASE WHEN lone THEN 'T1' ELSE 'T1,T2' END ELSE '' END AS tickers, CASE WHEN qy IS NOT NULL THEN qy WHEN uy IS NOT NULL THEN uy WHEN fu THEN '1996' ELSE '' END AS years, CASE WHEN qk = 'both' THEN NULL WHEN qk IS NOT NULL THEN qk WHEN uk IS NOT NULL THEN uk WHEN fu THEN pk END AS kind FROM a),
l AS (SELECT DISTINCT 'T' || (o_custkey % 40) AS t, year AS y, o_orderstatus AS d FROM o), y AS (SELECT t, y, count(*) AS n FROM l GROUP BY t, y),
w AS (SELECT k, unnest(string_split(tickers, ',')) AS t, years AS y, CASE WHEN qk = 'both' THEN ['F', 'O'] ELSE [kind] END AS ds FROM s WHERE tickers <> '' AND years <> ''), e AS (SELECT k, t, y, unnest(ds) AS d FROM w),
z AS (SELECT k, bool_or(CASE WHEN e.d IS NULL THEN y.n IS NULL ELSE l.d IS NULL END) AS lacks, bool_or(e.d IS NULL AND coalesce(y.n, 0) > 1) AS two FROM e LEFT JOIN l ON e.t = l.t AND e.y = l.y AND e.d = l.d LEFT JOIN y ON e.t = y.t AND e.y = y.y GROUP BY k)
SELECT s.k AS question_id, CASE WHEN s.k % 29 = 0 OR s.k % 31 = 0 OR (s.k % 7 = 0 AND NOT fu AND qt IS NULL AND qy IS NULL) THEN 'out_of_scope' WHEN ut <> qt OR uy <> qy OR (uk IS NOT NULL AND qk IS NOT NULL AND uk <> qk) THEN 'scope_conflict' WHEN tickers = '' OR years = '' THEN 'clarify' WHEN lacks THEN 'data_unavailable' WHEN s.k % 4 = 1 AND qk IS NULL AND kind IS NULL AND two THEN 'clarify_basis' ELSE 'search' END AS decision, tickers, years, kind AS doc_type FROM s LEFT JOIN z ON s.k = z.k""",
}
