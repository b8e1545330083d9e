"""Gates on tables of answers, facts and examples: citations, tables, numbers, reviews, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.calculations import SCALES
from factloom.operators.joins import NEAR, _gram_sql, near_duplicates
from factloom.operators.retrieval import _TOKENS
from factloom.sources import views as V
from factloom.sources.shared import written

#: tables' widths and heights, words of cause, change and outlook.
MAX_COLUMNS, MIN_COLUMNS, MIN_ROWS = 8, 2, 3
CHANGE, CAUSE, FUTURE = r"\b(increas|decreas|grew|declin|rose|fell)", r"\b(because|due to|driven by|as a result)\b", r"\b(will|expect|anticipate|may|could|plan)\b"
NULLS = ("", "-", "--", "—", "–", "n/a", "na", "nm", "not meaningful")
SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"))


# -- citations --------------------------------------------------------------------------------------


def normal_citations(answer: Column) -> Column:
    """(S1) and [Source S1] become [S1]."""
    return F.regexp_replace(F.regexp_replace(answer, r"(?i)\((?:source\s+)?S(\d+)\)", "[S$1]"), r"(?i)\[source\s+S(\d+)\]", "[S$1]")


def citation_check(answers: DataFrame) -> DataFrame:
    """answer_id, valid, reason of answers (answer, sources, declared: arrays of ids), the first that holds in this order."""
    clean = F.trim(normal_citations(F.coalesce("answer", F.lit(""))))
    a = answers.withColumn("_t", clean).withColumn("_in", F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(r"\[(S[1-9]\d*)\]"), 1), F.upper)))
    bad_in, bad_declared = F.array_except("_in", "sources"), F.array_except(F.transform("declared", F.upper), "sources")
    reason = (
        F.when(F.col("_t") == "", "empty_answer").when(F.size(bad_in) > 0, F.concat(F.lit("unknown_inline_source_ids:"), F.array_join(bad_in, ",")))
        .when(F.size(bad_declared) > 0, F.concat(F.lit("unknown_declared_source_ids:"), F.array_join(bad_declared, ","))).when(F.size("_in") > 0, "valid_inline_citations")
        .when(F.size("declared") > 0, "valid_structured_ids_appended").otherwise("missing_source_ids")
    )
    return a.select("answer_id", reason.startswith("valid").alias("valid"), reason.alias("reason"))


def citation_expand(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, labels: the label of each cited source once, in order of first use."""
    used = answers.select("answer_id", F.posexplode(F.array_distinct(F.regexp_extract_all(normal_citations(F.col("answer")), F.lit(r"\[(S[1-9]\d*)\]"), 1))).alias("pos", "source_id"))
    met = used.join(sources.hint("merge"), ["answer_id", "source_id"])
    return met.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "; ").alias("labels"))


def table_check(answers: DataFrame) -> DataFrame:
    """answer_id, reason (null: fine): the first fault of the pipe tables of each answer.

    Lines of bars form islands; each row is compared with its island's first.
    """
    text = F.coalesce("answer", F.lit(""))
    whole = F.when(F.contains(text, F.lit("****")), "malformed_empty_bold_marker").when(F.size(F.split(text, "`")) % 2 == 0, "unmatched_markdown_backtick")
    lines = answers.select("answer_id", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    strip = F.trim("line")
    is_row = strip.startswith("|")
    cells = F.when(is_row & strip.endswith("|") & (F.length(strip) > 1), F.size(F.split(F.expr("substring(trim(line), 2, length(trim(line)) - 2)"), r"\|")))
    line = W.partitionBy("answer_id").orderBy("n")
    b = lines.withColumns({"_row": is_row, "_cells": cells, "_bars": F.size(F.split("line", r"\|")) - 1, "_sep": F.regexp_replace(strip, " ", "").rlike(r"^\|(:?-{3,}:?\|)+$")})
    b = b.withColumn("_run", F.sum((~F.col("_row")).cast("int")).over(line))
    broken = b.filter((~F.col("_row") & (F.col("_bars") >= 2)) | (F.col("_row") & F.col("_cells").isNull())).select("answer_id", F.struct(F.lit(0).alias("at"), F.col("n").alias("n"), F.concat(F.lit("malformed_table_row:"), (F.col("n") + 1).cast("string")).alias("why")).alias("f"))
    rows = b.filter("_row and _cells is not null").withColumn("_i", F.row_number().over(W.partitionBy("answer_id", "_run").orderBy("n")))
    head = F.first("_cells").over(W.partitionBy("answer_id", "_run").orderBy("n"))
    rows = rows.withColumns({"_head": head, "_n": F.count("*").over(W.partitionBy("answer_id", "_run"))})
    why = (
        F.when((F.col("_i") == 1) & (F.col("_head") > MAX_COLUMNS), F.concat(F.lit("wide_markdown_table:"), F.col("_head").cast("string"), F.lit("_columns"))).when((F.col("_i") == 1) & (F.col("_head") < MIN_COLUMNS), "malformed_table_header")
        .when((F.col("_i") == 1) & (F.col("_n") < MIN_ROWS), "incomplete_markdown_table").when((F.col("_i") == 2) & (~F.col("_sep") | (F.col("_cells") != F.col("_head"))), "invalid_table_separator").when((F.col("_i") > 2) & (F.col("_cells") != F.col("_head")), "inconsistent_table_columns")
    )
    faults = rows.withColumn("_w", why).filter("_w is not null").select("answer_id", F.struct(F.lit(1).alias("at"), F.col("n").alias("n"), F.col("_w").alias("why")).alias("f"))
    first = broken.unionByName(faults).groupBy("answer_id").agg(F.min("f").alias("f"))
    return answers.select("answer_id", whole.alias("_whole")).join(first.hint("merge"), "answer_id", "left").select("answer_id", F.coalesce("_whole", F.col("f.why")).alias("reason"))


def bullet_check(answers: DataFrame) -> DataFrame:
    """answer_id, uncited: bullets of 70 characters or with a digit, without a citation."""
    lines = answers.select("answer_id", F.explode(F.split(F.coalesce("answer", F.lit("")), "\n")).alias("line"))
    bullet = F.col("line").rlike(r"^\s*[-*•]\s+") & ((F.length("line") >= 70) | F.col("line").rlike(r"\d")) & ~F.col("line").rlike(r"\[S\d+\]")
    return lines.groupBy("answer_id").agg(F.count_if(bullet).alias("uncited"))


def forward_causes(answers: DataFrame) -> DataFrame:
    """answer_id, sentences: those that give an outlook as the cause of a change."""
    low = F.lower("s")
    each = answers.select("answer_id", F.explode(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"([^.!?]+[.!?]?)"), 1)).alias("s"))
    return each.groupBy("answer_id").agg(F.count_if(low.rlike(CHANGE) & low.rlike(CAUSE) & low.rlike(FUTURE)).alias("sentences"))


# -- values and facts -------------------------------------------------------------------------------


def normalize_value(rows: DataFrame) -> DataFrame:
    """id, value_type, currency, scale, numeric_value, base_value, reason from id, raw_value, unit, scale, currency (declared)."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.coalesce("raw_value", F.lit("")), " ", " "), r"<[^>]+>", ""), r"\s+", " "))
    r = rows.select("id", raw.alias("t"), F.lower(F.coalesce("unit", F.lit(""))).alias("unit"), F.lower(F.coalesce("scale", F.lit(""))).alias("declared_scale"), F.upper("currency").alias("declared"))
    low = F.lower("t")

    def named(c: Column) -> Column:
        return F.coalesce(*[F.when(F.lower(c).rlike(rf"\b{n.removesuffix('s')}s?\b"), n) for n in SCALES], F.when(F.lower(c).rlike(r"\bunits?\b"), "ones"))

    shown = F.coalesce(*[F.when(F.contains("t", F.lit(s)), c) for s, c in SYMBOLS], F.nullif(F.upper(F.regexp_extract("t", r"(?i)\b(USD|EUR|GBP|JPY|CAD|AUD)\b", 1)), F.lit("")))
    r = r.withColumns({"shown": shown, "shown_scale": named(F.col("t")), "said_scale": named(F.col("declared_scale"))}).withColumn("cur", F.coalesce("shown", "declared"))
    kind = (
        F.when(F.contains("t", F.lit("%")) | F.contains("unit", F.lit("percent")), "percent").when(F.concat(low, F.lit(" "), F.col("unit")).rlike(r"\b(bps?|basis points?)\b"), "basis_points")
        .when(F.contains("unit", F.lit("per share")) | low.rlike(r"\bper share\b"), "per_share").when(F.contains("unit", F.lit("ratio")) | low.rlike(r"\d\s*x\b"), "ratio")
        .when(F.col("cur").isNotNull(), "currency").when(F.col("unit").rlike("count|shares"), "count").otherwise("number")
    )
    numbers = F.regexp_extract_all(F.replace("t", F.lit(",")), F.lit(r"([-+]?(?:\d+(?:\.\d+)?|\.\d+))"), 1)
    r = r.withColumn("kind", kind).withColumn("nums", numbers)
    flat = F.col("kind").isin("percent", "basis_points", "ratio")
    reason = (
        F.when(low.isin(*NULLS), "blank").when(F.col("declared") != F.col("shown"), "currency conflict").when(F.col("said_scale") != F.col("shown_scale"), "scale conflict")
        .when(flat & F.col("cur").isNotNull(), "non-monetary value with a currency").when(F.size("nums") != 1, "not one number")
    )
    scale = F.when(~flat & (F.col("kind") != "per_share"), F.coalesce("shown_scale", "said_scale", named(F.col("unit"))))
    r = r.withColumns({"reason": reason, "scale": scale})
    number = F.get("nums", F.lit(0)).try_cast("decimal(28,6)")
    signed = F.when(F.contains("t", F.lit("(")) & F.contains("t", F.lit(")")), -F.abs(number)).otherwise(number)
    times = F.element_at(F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, v)]), F.coalesce("scale", F.lit("ones")))
    fine = F.col("reason").isNull()
    return r.select("id", F.when(fine, F.col("kind")).alias("value_type"), F.when(fine, F.col("cur")).alias("currency"), F.when(fine, F.col("scale")).alias("scale"), F.when(fine, signed.cast("double")).alias("numeric_value"), F.when(fine, signed.cast("double") * times).alias("base_value"), "reason")


def excerpt_support(rows: DataFrame) -> DataFrame:
    """id, supported: the excerpt is in the source, or has three tokens, all its numbers and 70 % of its words there."""
    flat = lambda c: T.fold_text(F.col(c))
    r = rows.select("id", flat("excerpt").alias("e"), flat("source").alias("s"))
    r = r.select("id", "e", "s", F.array_distinct(T.tokens(F.col("e"))).alias("et"), F.array_distinct(T.tokens(F.col("s"))).alias("st"))
    missing = F.array_except("et", "st")
    numeric = F.filter(missing, lambda x: x.rlike(r"\d"))
    loose = (F.size("et") >= 3) & (F.size(numeric) == 0) & (F.size("et") - F.size(missing) >= 0.7 * F.size("et"))
    return r.select("id", ((F.col("e") != "") & (F.contains("s", F.col("e")) | loose)).alias("supported"))


def canonical_metric(label: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(label, r"[_\s]+", " ")))
    patterns = (("total_revenue", r"^(total )?(net )?(revenues?|sales)$"), ("net_income", r"^net (income|earnings)( \(loss\))?$"), ("operating_income", r"^(operating income|income from operations)$"), ("gross_profit", r"^gross (profit|margin)$"), ("total_assets", r"^total assets$"),
                ("total_liabilities", r"^total liabilities$"), ("operating_cash_flow", r"^(operating cash flow|net cash provided by operating activities)$"), ("capital_expenditures", r"^(capital expenditures|purchases of property and equipment)$"), ("diluted_eps", r"^diluted (eps|earnings per share)$"))
    return F.coalesce(*[F.when(plain.rlike(p), name) for name, p in patterns])


def fact_dedupe(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row a fact id: F and 16 digits of the hash of the key's fields."""
    return facts.withColumn("fact_id", F.concat(F.lit("F"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256), 1, 16))).dropDuplicates(["fact_id"])


def fact_select(candidates: DataFrame) -> DataFrame:
    """ref_id, chosen, reason: of the candidates (ref_id, fact_id, tier, value, places) of the best tier, any of one value, else the only one of highest precision, else none."""
    best = candidates.withColumn("_t", F.min("tier").over(W.partitionBy("ref_id"))).filter("tier = _t")
    precise = best.withColumn("_p", F.max("places").over(W.partitionBy("ref_id")))
    top = precise.groupBy("ref_id").agg(F.countDistinct("value").alias("values"), F.min("fact_id").alias("any_id"), F.countDistinct(F.when(F.col("places") == F.col("_p"), F.col("value"))).alias("sharp"), F.min(F.when(F.col("places") == F.col("_p"), F.col("fact_id"))).alias("sharp_id"))
    return top.select("ref_id", F.when(F.col("values") == 1, F.col("any_id")).when(F.col("sharp") == 1, F.col("sharp_id")).alias("chosen"), F.when((F.col("values") > 1) & (F.col("sharp") > 1), "ambiguous").alias("reason"))


# -- examples and reviews ---------------------------------------------------------------------------


def validate_questions(examples: DataFrame) -> DataFrame:
    """example_id, errors: all that is wrong with a question, joined."""
    q = F.col("question")
    errors = F.array_compact(F.array(
        F.when(F.trim(q) == "", "empty question"), F.when(F.length(q) > 400, "question too long"), F.when(~q.rlike(r"[.?!]\s*$"), "no end mark"), F.when(q.rlike("[ÂÃ�]"), "mojibake"),
        F.when(q.rlike(r"\d"), "number without evidence"), F.when((F.col("review_status") == "approved") & F.col("benchmark_overlap"), "approved with benchmark overlap"),
    ))
    return examples.select("example_id", F.array_join(errors, ",").alias("errors"))


def validate_dataset(examples: DataFrame, split: Column) -> DataFrame:
    """problem, key, n: repeated ids and questions, groups in more than one split, and near duplicates.

    Near duplicates are different questions at the threshold; key is the class of equal ones, n how many others it
    meets. Two that share a group are an error, two that don't a warning.
    """
    e = examples.withColumns({"fp": T.fingerprint(F.col("question")), "split": split})
    ids = e.groupBy("example_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("problem"), F.col("example_id").cast("string").alias("key"), "n")
    repeated = e.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_question").alias("problem"), F.col("fp").alias("key"), "n")
    leaking = e.filter("split is not null").groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("group_in_splits").alias("problem"), F.col("group_id").alias("key"), "n")
    pairs, members = near_duplicates(examples.select("example_id", "question"), "example_id", "question")
    groups = written(members.join(examples.select("example_id", "group_id").hint("merge"), "example_id").select("class_id", "group_id").distinct(), "groups")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both.join(groups.withColumnRenamed("class_id", "a").hint("merge"), "a").join(groups.select(F.col("class_id").alias("b"), F.col("group_id").alias("_g"), F.lit(1).alias("_x")).hint("merge"), "b").filter("group_id = _g").select("a", "b").distinct().withColumn("same", F.lit(True))
    marked = both.join(sides.hint("merge"), ["a", "b"], "left").select(F.when(F.col("same"), "near_duplicate_in_group").otherwise("near_duplicate_across_groups").alias("problem"), F.col("a").cast("string").alias("key"))
    return ids.unionByName(repeated).unionByName(leaking).unionByName(marked.groupBy("problem", "key").agg(F.count("*").alias("n")))


def review_apply(examples: DataFrame, reviews: DataFrame) -> DataFrame:
    """example_id, status, reason: a known, single review changes the status; approval needs no overlap, a reviewer and a zoned time."""
    n = reviews.groupBy("example_id").agg(F.count("*").alias("n"), F.min("status").alias("new"), F.min("reviewer").alias("reviewer"), F.min("at").alias("at"))
    met = examples.join(n.hint("merge"), "example_id", "left")
    reason = F.when(F.col("n") > 1, "duplicate review").when((F.col("new") == "approved") & F.col("benchmark_overlap"), "overlap").when((F.col("new") == "approved") & F.col("reviewer").isNull(), "no reviewer").when((F.col("new") == "approved") & T.zoned_timestamp(F.col("at")).isNull(), "no zoned time")
    return met.select("example_id", F.when(F.col("n").isNotNull() & reason.isNull(), F.col("new")).otherwise(F.col("review_status")).alias("status"), reason.alias("reason"))


def ai_review_gate(examples: DataFrame, decisions: DataFrame, least: float = 0.90) -> DataFrame:
    """example_id, status: overlap is rejected, checked by rule is approved, a model's decision counts from a confidence of 0.90."""
    met = examples.join(decisions.hint("merge"), "example_id", "left")
    return met.select("example_id", F.when(F.col("benchmark_overlap"), "rejected").when(F.col("deterministic"), "approved").when(F.coalesce("confidence", F.lit(0.0)) < least, "needs_edit").otherwise(F.col("decision")).alias("status"))


def unambiguous(examples: DataFrame, target: str) -> DataFrame:
    """Of questions with one fingerprint: equal targets keep the lowest id, conflicting ones go."""
    fp = T.fingerprint(F.col("question"))
    e = examples.withColumn("fp", fp)
    kept = e.groupBy("fp").agg(F.countDistinct(target).alias("targets"), F.min("example_id").alias("example_id"), F.count("*").alias("rows")).filter("targets <= 1")
    return kept.select("example_id", "rows")


# -- queries ----------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from the documents: the first line, with marks of sources that follow from the number."""
    i = F.col("doc_id")
    mark = F.when(i % 6 == 0, " [S1]").when(i % 6 == 1, " (S2)").when(i % 6 == 2, " [Source S3] [S1]").when(i % 6 == 3, " [S9]").otherwise("")
    declared = F.when(i % 5 == 0, F.array(F.lit("s1"))).when(i % 5 == 1, F.array(F.lit("S7"))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.regexp_extract("text", r"^([^\n]*)", 1), mark)
    return V.segments(spark, sf_dir).select(i.alias("answer_id"), text.alias("answer"), F.transform(F.sequence(F.lit(1), (1 + i % 3).cast("int")), lambda n: F.concat(F.lit("S"), n.cast("string"))).alias("sources"), declared.alias("declared"))


_ANSWERS = r"answers AS (SELECT doc_id AS answer_id, regexp_extract(coalesce(text, ''), '^([^\n]*)', 1) || CASE doc_id % 6 WHEN 0 THEN ' [S1]' WHEN 1 THEN ' (S2)' WHEN 2 THEN ' [Source S3] [S1]' WHEN 3 THEN ' [S9]' ELSE '' END AS answer, list_transform(range(1, 2 + doc_id % 3), lambda n: 'S' || n) AS sources, CASE doc_id % 5 WHEN 0 THEN ['S1'] WHEN 1 THEN ['S7'] ELSE [] END AS declared FROM documents)"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables of orders, one a customer; some are broken."""
    o = V.table(spark, sf_dir, "orders")
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority", F.when(F.col("o_orderkey") % 50 == 0, " | more").otherwise(""), F.when(F.col("o_orderkey") % 60 == 1, "").otherwise(" |"))
    each = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("body"))
    sep = F.when(F.col("o_custkey") % 9 == 0, "| -- | x |").otherwise("| --- | --- |")
    return each.select(F.col("o_custkey").alias("answer_id"), F.concat(F.lit("Orders:\n\n| key | priority |\n"), sep, F.lit("\n"), "body", F.when(F.col("o_custkey") % 7 == 0, "\n`").otherwise("")).alias("answer"))


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as printed in tables, made from the orders: amounts, brackets, percents, scales, conflicts, blanks."""
    i, v = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    forms = [F.concat(F.lit("$"), v), F.concat(F.lit("("), v, F.lit(")")), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(".5%")), F.lit("n/a"), F.concat(F.lit("$1."), (F.col("o_custkey") % 10).cast("string"), F.lit(" million")), F.concat(F.lit("EUR "), v), F.concat((F.col("o_custkey") % 9).cast("string"), F.lit("x")), F.lit("12 bps"), F.concat(v, F.lit(" to "), v), F.lit("£2 billion"), v]
    pick = F.get(F.array(*forms), (i % 11).cast("int"))
    return V.table(spark, sf_dir, "orders").select(i.alias("id"), pick.alias("raw_value"), F.when(i % 13 == 0, "shares").when(i % 17 == 0, "per share").alias("unit"), F.when(i % 4 == 0, "thousands").when(i % 5 == 0, "millions").alias("scale"), F.when(i % 3 == 0, "usd").alias("currency"))


def q_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_check(answers(spark, sf_dir))


def q_citation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    s = a.select("answer_id", F.explode("sources").alias("source_id")).withColumn("label", F.concat_ws(" ", F.lit("Filing"), "source_id", F.col("answer_id").cast("string")))
    return citation_expand(a, s)


def q_markdown_table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_check(tables(spark, sf_dir))


def q_bullet_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents as bullets; every fourth is cited."""
    d = V.segments(spark, sf_dir)
    made = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("- "), x, F.when(i % 4 == 0, " [S1]").otherwise(""))), "\n")
    return bullet_check(d.select(F.col("doc_id").alias("answer_id"), made.alias("answer")))


def q_forward_cause_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.segments(spark, sf_dir)
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Revenue grew because we expect demand. "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Costs rose due to prices. "), "text")).otherwise(F.col("text"))
    return forward_causes(d.select(F.col("doc_id").alias("answer_id"), made.alias("answer")))


def q_normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_value(raw_values(spark, sf_dir))


def q_excerpt_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts: words of the text's middle as they are, with a changed word, and with a number that isn't there."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1), 3, 8)
    e = F.when(F.col("doc_id") % 3 == 0, F.array_join(words, " ")).when(F.col("doc_id") % 3 == 1, F.concat(F.array_join(F.reverse(words), " "), F.lit(" zzz"))).otherwise(F.concat(F.array_join(words, " "), F.lit(" 987654321")))
    return excerpt_support(V.segments(spark, sf_dir).select(F.col("doc_id").alias("id"), e.alias("excerpt"), F.col("text").alias("source")))


def q_canonical_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.facts(spark, sf_dir)
    return f.groupBy("metric").agg(F.count("*").alias("rows")).select("metric", "rows", canonical_metric(F.col("metric")).alias("canonical"))


def q_fact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("c"), "o_orderpriority", F.year("o_orderdate").alias("y"))
    return fact_dedupe(o, ["c", "o_orderpriority", "y"]).select("fact_id")


def q_fact_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference a customer: candidates are the orders, tiers their priorities, precision the places of the discount."""
    o = V.table(spark, sf_dir, "orders")
    return fact_select(o.select(F.col("o_custkey").alias("ref_id"), F.col("o_orderkey").alias("fact_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"), (F.col("o_orderkey") % 3).alias("value"), (F.col("o_orderkey") % 2).alias("places")))


def q_fact_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and years with one distinct status, finished orders first."""
    o = V.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("int").alias("year"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("exact"))
    best = o.withColumn("_x", F.max("exact").over(W.partitionBy("o_custkey", "year"))).filter(F.col("exact") == F.col("_x"))
    return best.groupBy("o_custkey", "year").agg(F.countDistinct("o_orderpriority").alias("v")).filter("v = 1").select("o_custkey", "year")


def q_validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_questions(V.examples(spark, sf_dir))


def q_validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("example_id") % 10 < 8, "train").when(F.col("example_id") % 10 == 8, "validation")
    return validate_dataset(V.examples(spark, sf_dir), split)


def q_review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir)
    i = F.col("example_id")
    r = e.filter(i % 3 != 0).select("example_id", F.when(i % 2 == 0, "approved").otherwise("rejected").alias("status"), F.when(i % 7 != 0, "ann").alias("reviewer"), F.when(i % 5 == 0, "2024-05-01T10:00:00").otherwise("2024-05-01T10:00:00Z").alias("at"))
    return review_apply(e, r.unionByName(r.filter(i % 11 == 0)))


def q_ai_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir).withColumn("deterministic", F.col("example_id") % 4 == 0)
    d = e.filter("example_id % 6 <> 0").select("example_id", F.when(F.col("example_id") % 5 == 0, "rejected").otherwise("approved").alias("decision"), ((F.col("example_id") % 20) / F.lit(20.0)).alias("confidence"))
    return ai_review_gate(e, d)


def q_unambiguous_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unambiguous(V.examples(spark, sf_dir), "review_status")


def q_scope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose years of finished and of open orders are the same set."""
    o = V.table(spark, sf_dir, "orders")
    years = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.year("o_orderdate"))))
    return o.groupBy("o_custkey").agg((years("F") == years("O")).alias("matches"))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}
_E = V.with_views("examples")
_NORM = r"regexp_replace(regexp_replace(answer, '(?i)\((?:source\s+)?S(\d+)\)', '[S\1]', 'g'), '(?i)\[source\s+S(\d+)\]', '[S\1]', 'g')"
_FOLDED = r"trim(regexp_replace(lower(translate(question, '‘’“”–—' || chr(160), '''''" + '""' + r"-- ')), '\s+', ' ', 'g'))"
_FP = rf"sha256(array_to_string(regexp_extract_all({_FOLDED}, '([a-z0-9]+)', 1), ' '))"
_EXCERPT = "CASE id % 3 WHEN 0 THEN array_to_string(w, ' ') WHEN 1 THEN array_to_string(list_reverse(w), ' ') || ' zzz' ELSE array_to_string(w, ' ') || ' 987654321' END"
ORACLES = {
    "excerpt_support": rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(\S+)', 1)[3:10] AS w FROM documents), x AS (SELECT id, {_FOLDED.replace('question', _EXCERPT)} AS e, {_FOLDED.replace('question', 'text')} AS s FROM d),
t AS (SELECT id, e, s, list_distinct({_TOKENS.replace('lower(text)', 'e')}) AS et, {_TOKENS.replace('lower(text)', 's')} AS st FROM x), m AS (SELECT *, list_filter(et, lambda y: NOT list_contains(st, y)) AS ms FROM t)
SELECT id, e <> '' AND (contains(s, e) OR (len(et) >= 3 AND len(list_filter(ms, lambda y: regexp_matches(y, '\d'))) = 0 AND len(et) - len(ms) >= 0.7 * len(et))) AS supported FROM m""",
    "citation_check": rf"WITH {_ANSWERS}, n AS (SELECT *, trim({_NORM}) AS t FROM answers), c AS (SELECT *, list_distinct(regexp_extract_all(t, '\[(S[1-9]\d*)\]', 1)) AS i FROM n), b AS (SELECT *, list_filter(regexp_extract_all(t, '\[(S[1-9]\d*)\]', 1), lambda x: NOT list_contains(sources, x)) AS bi, list_filter(declared, lambda x: NOT list_contains(sources, x)) AS bd FROM c), r AS (SELECT answer_id, CASE WHEN t = '' THEN 'empty_answer' WHEN len(bi) > 0 THEN 'unknown_inline_source_ids:' || array_to_string(bi, ',') WHEN len(bd) > 0 THEN 'unknown_declared_source_ids:' || array_to_string(bd, ',') WHEN len(i) > 0 THEN 'valid_inline_citations' WHEN len(declared) > 0 THEN 'valid_structured_ids_appended' ELSE 'missing_source_ids' END AS reason FROM b) SELECT answer_id, starts_with(reason, 'valid') AS valid, reason FROM r",
    "citation_expand": rf"WITH {_ANSWERS}, u AS (SELECT answer_id, sources, regexp_extract_all({_NORM}, '\[(S[1-9]\d*)\]', 1) AS ids FROM answers), e AS (SELECT answer_id, sources, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM u), f AS (SELECT answer_id, id, min(pos) AS pos FROM e WHERE list_contains(sources, id) GROUP BY answer_id, id) SELECT answer_id, string_agg('Filing ' || id || ' ' || answer_id, '; ' ORDER BY pos) AS labels FROM f GROUP BY answer_id",
    "bullet_citation_check": r"WITH l AS (SELECT doc_id, ls, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)), b AS (SELECT doc_id, '- ' || x || CASE WHEN i % 4 = 0 THEN ' [S1]' ELSE '' END AS line FROM l) SELECT doc_id AS answer_id, count(*) FILTER (WHERE regexp_matches(line, '^\s*[-*•]\s+') AND (length(line) >= 70 OR regexp_matches(line, '\d')) AND NOT regexp_matches(line, '\[S\d+\]')) AS uncited FROM b GROUP BY doc_id",
    "forward_cause_check": rf"WITH a AS (SELECT doc_id AS answer_id, CASE doc_id % 3 WHEN 0 THEN 'Revenue grew because we expect demand. ' || coalesce(text, '') WHEN 1 THEN 'Costs rose due to prices. ' || coalesce(text, '') ELSE coalesce(text, '') END AS answer FROM documents), s AS (SELECT answer_id, lower(unnest(regexp_extract_all(answer, '([^.!?]+[.!?]?)', 1))) AS s FROM a) SELECT answer_id, count(*) FILTER (WHERE regexp_matches(s, '{CHANGE}') AND regexp_matches(s, '{CAUSE}') AND regexp_matches(s, '{FUTURE}')) AS sentences FROM s GROUP BY answer_id",
    "canonical_metric": V.with_views("facts") + " SELECT metric, count(*) AS rows, CASE WHEN metric IN ('total_revenue', 'net_income', 'operating_income', 'total_assets', 'operating_cash_flow', 'capital_expenditures', 'diluted_eps') THEN metric END AS canonical FROM facts GROUP BY metric",
    "fact_dedupe": "SELECT DISTINCT 'F' || left(sha256(concat_ws('|', o_custkey % 200, o_orderpriority, year(o_orderdate))), 16) AS fact_id FROM orders",
    "fact_select": "WITH c AS (SELECT o_custkey AS ref_id, o_orderkey AS fact_id, left(o_orderpriority, 1)::INT AS tier, o_orderkey % 3 AS value, o_orderkey % 2 AS places FROM orders), b AS (SELECT * FROM c QUALIFY tier = min(tier) OVER (PARTITION BY ref_id)), p AS (SELECT *, places = max(places) OVER (PARTITION BY ref_id) AS sharp FROM b), g AS (SELECT ref_id, count(DISTINCT value) AS v, min(fact_id) AS a, count(DISTINCT value) FILTER (WHERE sharp) AS s, min(fact_id) FILTER (WHERE sharp) AS si FROM p GROUP BY ref_id) SELECT ref_id, CASE WHEN v = 1 THEN a WHEN s = 1 THEN si END AS chosen, CASE WHEN v > 1 AND s > 1 THEN 'ambiguous' END AS reason FROM g",
    "fact_completeness": "WITH o AS (SELECT o_custkey, year(o_orderdate)::INT AS year, o_orderpriority, o_orderstatus = 'F' AS exact_ FROM orders), b AS (SELECT * FROM o QUALIFY exact_ = bool_or(exact_) OVER (PARTITION BY o_custkey, year)) SELECT o_custkey, year FROM b GROUP BY o_custkey, year HAVING count(DISTINCT o_orderpriority) = 1",
    "validate_questions": _E + r" SELECT example_id, concat_ws(',', CASE WHEN trim(question) = '' THEN 'empty question' END, CASE WHEN length(question) > 400 THEN 'question too long' END, CASE WHEN NOT regexp_matches(question, '[.?!]\s*$') THEN 'no end mark' END, CASE WHEN regexp_matches(question, '[ÂÃ�]') THEN 'mojibake' END, CASE WHEN regexp_matches(question, '\d') THEN 'number without evidence' END, CASE WHEN review_status = 'approved' AND benchmark_overlap THEN 'approved with benchmark overlap' END) AS errors FROM examples",
    "validate_dataset": _E + f", e AS (SELECT *, {_FP} AS fp, CASE WHEN example_id % 10 < 8 THEN 'train' WHEN example_id % 10 = 8 THEN 'validation' END AS split FROM examples), eq AS (SELECT example_id, question AS text, group_id FROM examples), " + _gram_sql("eq", "example_id", "n") + f""", sig AS (SELECT wn.id, sha256(coalesce(string_agg(g, '|' ORDER BY g), '')) AS s FROM wn LEFT JOIN en USING (id) GROUP BY wn.id), cl AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id FROM sig), er AS (SELECT * FROM en WHERE id IN (SELECT class_id FROM cl)), c AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM er x JOIN er y ON x.g = y.g AND x.id <> y.id GROUP BY ALL), pr AS (SELECT a, b FROM c JOIN nn x ON x.id = a JOIN nn y ON y.id = b WHERE i / (x.n + y.n - i) >= {NEAR}), cg AS (SELECT DISTINCT class_id, group_id FROM cl JOIN eq ON eq.example_id = cl.id), mk AS (SELECT a, CASE WHEN EXISTS (SELECT 1 FROM cg x JOIN cg y USING (group_id) WHERE x.class_id = a AND y.class_id = b) THEN 'near_duplicate_in_group' ELSE 'near_duplicate_across_groups' END AS problem FROM pr) SELECT 'duplicate_id' AS problem, example_id::VARCHAR AS key, count(*) AS n FROM examples GROUP BY example_id HAVING count(*) > 1 UNION ALL SELECT problem, a::VARCHAR, count(*) FROM mk GROUP BY ALL UNION ALL SELECT 'duplicate_question' AS problem, fp AS key, count(*) AS n FROM e GROUP BY fp HAVING count(*) > 1 UNION ALL SELECT 'group_in_splits', group_id, count(DISTINCT split) FROM e WHERE split IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split) > 1""",
    "review_apply": _E + ", r AS (SELECT *, CASE WHEN example_id % 3 = 0 THEN NULL WHEN example_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS new_ FROM examples), w AS (SELECT *, CASE WHEN new_ IS NOT NULL AND example_id % 11 = 0 THEN 'duplicate review' WHEN new_ = 'approved' AND benchmark_overlap THEN 'overlap' WHEN new_ = 'approved' AND example_id % 7 = 0 THEN 'no reviewer' WHEN new_ = 'approved' AND example_id % 5 = 0 THEN 'no zoned time' END AS reason FROM r) SELECT example_id, CASE WHEN new_ IS NOT NULL AND reason IS NULL THEN new_ ELSE review_status END AS status, reason FROM w",
    "ai_review_gate": _E + " SELECT example_id, CASE WHEN benchmark_overlap THEN 'rejected' WHEN example_id % 4 = 0 THEN 'approved' WHEN example_id % 6 = 0 OR (example_id % 20) / 20.0 < 0.9 THEN 'needs_edit' WHEN example_id % 5 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM examples",
    "unambiguous_questions": _E + f" SELECT min(example_id) AS example_id, count(*) AS rows FROM examples GROUP BY {_FP} HAVING count(DISTINCT review_status) <= 1",
    "scope_match": "SELECT o_custkey, list_sort(coalesce(list(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F'), [])) = list_sort(coalesce(list(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus = 'O'), [])) AS matches FROM orders GROUP BY o_custkey",
}
