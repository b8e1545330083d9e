"""Summaries, data-set gates, balanced sampling, splits, set operations and text keys over tables of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources import views as V
from factloom.sources.shared import hinted, written

#: Prices of a million tokens, the priced model, the policy's limits and the split's shares.
PRICE_INPUT, PRICE_CACHED, PRICE_OUTPUT, PRICED = 0.15, 0.075, 0.60, "gpt-4o-mini"
MAX_SHARE, TRAIN, VALIDATION = 0.40, 0.84, 0.92


# -- summaries --------------------------------------------------------------------------------------


def eval_summary(rows: DataFrame, metrics: tuple[str, ...] = V.METRICS) -> DataFrame:
    """One row: counts and rates over all rows, means of the metrics over answered rows without an error."""
    fine = (F.col("decision") == "answered") & F.col("error").isNull()
    value = lambda m: F.when(fine & F.col(m).isNotNull() & ~F.isnan(m), F.col(m))
    rate = lambda c: F.round(F.sum(c.cast("int")) / F.count("*"), 4)
    scored = fine & F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    out = rows.agg(
        F.count("*").alias("questions_evaluated"), F.count_if(F.col("decision") == "answered").alias("answered"), rate(F.col("decision") == "answered").alias("answer_success_rate"), F.count_if(scored).alias("scored_answered_rows"),
        rate(scored).alias("metric_coverage_rate"), rate(F.coalesce("scope_match", F.lit(False))).alias("scope_match_rate"), F.count_if(F.col("error").isNotNull()).alias("rows_with_errors"),
        *[F.round(F.avg(value(m)), 4).alias(f"mean_{m}") for m in metrics], *[F.count(value(m)).alias(f"count_{m}") for m in metrics],
    )
    means = F.filter(F.array(*[F.col(f"mean_{m}") for m in metrics]), lambda x: x.isNotNull())
    final = F.when(F.size(means) > 0, F.round(F.aggregate(means, F.lit(0.0), lambda s, x: s + x) / F.size(means), 4))
    return out.withColumn("final_score", final).withColumn("coverage_adjusted_score", F.round(F.col("final_score") * F.col("answer_success_rate"), 4))


def generation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("questions_generated"), F.count_if(F.col("decision") == "answered").alias("answered"), F.round(F.count_if(F.col("decision") == "answered") / F.count("*"), 4).alias("answer_success_rate"), F.count_if(F.col("error").isNotNull()).alias("rows_with_errors"))


def routing_accuracy(cases: DataFrame) -> DataFrame:
    """expected, total, passed, rate of cases (expected, actual), and of all as expected = null."""
    return cases.rollup("expected").agg(F.count("*").alias("total"), F.count_if(F.col("expected") == F.col("actual")).alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("total"), 4))


def dataset_counts(examples: DataFrame) -> DataFrame:
    """All breakdowns by query type and status in one job: query_type, review_status, level, rows, overlapping."""
    return examples.cube("query_type", "review_status").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("rows"), F.count_if("benchmark_overlap").alias("overlapping"))


def policy_check(examples: DataFrame, group_of: Column, required: tuple[str, ...], minimum: int, least: int, max_share: float = MAX_SHARE) -> DataFrame:
    """check, value, limit, passed: enough rows, no type over its share, each required group with its least number."""
    counts = examples.select(group_of.alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    overall = total.select(F.explode(F.array(
        F.struct(F.lit("minimum").alias("check"), F.col("total").cast("double").alias("value"), F.lit(float(minimum)).alias("limit"), (F.col("total") >= minimum).alias("passed")),
        F.struct(F.lit("largest_share").alias("check"), F.round(F.col("largest") / F.nullif(F.col("total"), F.lit(0)), 6).alias("value"), F.lit(max_share).alias("limit"), (F.col("largest") <= F.col("total") * max_share).alias("passed")),
    )).alias("x")).select("x.*")
    wanted = examples.sparkSession.createDataFrame([(g,) for g in required], "g string")
    each = wanted.join(counts.hint("merge"), "g", "left").select(F.concat(F.lit("group:"), "g").alias("check"), F.coalesce("n", F.lit(0)).cast("double").alias("value"), F.lit(float(least)).alias("limit"), (F.coalesce("n", F.lit(0)) >= least).alias("passed"))
    return overall.unionByName(each)


def usage_cost(calls: DataFrame) -> DataFrame:
    """request_id, calls, tokens, models and cost: null where a call has no usage or its model has no price.

    Costs add up as whole units of 1e-9 dollars times 1000, so sums are exact.
    """
    priced = (F.lower(F.trim("model")) == PRICED) | F.lower(F.trim("model")).startswith(f"{PRICED}-20")
    there = F.col("input").isNotNull() & F.col("output").isNotNull()
    n, c, o = F.when(there, F.greatest("input", F.lit(0))), F.when(there, F.greatest(F.coalesce("cached", F.lit(0)), F.lit(0))), F.when(there, F.greatest("output", F.lit(0)))
    cached = F.least(n, c)
    units = (n - cached) * int(PRICE_INPUT * 1000) + cached * int(PRICE_CACHED * 1000) + o * int(PRICE_OUTPUT * 1000)
    return calls.groupBy("request_id").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum(n), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(cached), F.lit(0)).alias("cached_tokens"), F.coalesce(F.sum(o), F.lit(0)).alias("output_tokens"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.when(F.bool_and(there & priced), F.round(F.sum(units) / 1e9, 8)).alias("cost_usd"),
    )


def availability_counts(chunks: DataFrame) -> DataFrame:
    return chunks.cube("ticker", "doc_type").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("windows"))


def speaker_stats(turns: DataFrame) -> DataFrame:
    """conv_id, speakers (sorted), n_speakers, turns, words."""
    words = F.size(F.regexp_extract_all("content", F.lit(r"(\S+)"), 1))
    out = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("s"), F.count("*").alias("turns"), F.sum(words).alias("words"))
    return out.select("conv_id", F.array_join("s", ",").alias("speakers"), F.size("s").cast("long").alias("n_speakers"), "turns", "words")


def number_support(answers: DataFrame) -> DataFrame:
    """answer_id and unsupported: the numbers of answer that evidence lacks, sorted and joined."""
    return answers.select("answer_id", F.array_join(F.array_sort(F.array_except(T.number_keys(F.col("answer")), T.number_keys(F.col("evidence")))), ",").alias("unsupported"))


def regression_report(cases: DataFrame) -> DataFrame:
    """cases (case_id, expected, actual, cited arrays, limit) with a row of checks: subset, extra, within limit, utilisation in percent, all passed."""
    found = F.size(F.array_except("expected", "actual")) == 0
    within = F.size("actual") <= F.col("limit")
    use = F.when(F.size("actual") > 0, F.round(100 * F.size(F.array_intersect("cited", "actual")) / F.size("actual"), 2))
    return cases.select("case_id", found.alias("expected_found"), F.size(F.array_except("actual", "expected")).cast("long").alias("extra"), within.alias("within_limit"), use.alias("utilisation"), (found & within).alias("passed"))


# -- order, sampling, splits ------------------------------------------------------------------------


def balanced_take(rows: DataFrame, bucket: str, order: str, limit: int) -> DataFrame:
    """Round-robin over buckets, in order within each, to a limit (the feature: a balanced sample). No bucket gives more than the limit, so each part of the table passes on so many rows of it at most."""
    turn = F.row_number().over(W.partitionBy(bucket).orderBy(order))
    return rows.withColumn("turn", turn).filter(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def hash_of(column: str) -> Column:
    return F.sha2(F.col(column).cast("string"), 256)


def ranked_by_hash(rows: DataFrame, id_col: str, type_col: str) -> DataFrame:
    """rows with _r, the place of each in its type by the hash of its id.

    Rows are ranked within a type and the first three digits of the hash, and the counts of the digits before are added, so that
    a common type is 4,096 groups and not one.
    """
    h = rows.withColumn("_h", hash_of(id_col)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy(F.col(type_col).alias("_t"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_t").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("_t", "_c", before.alias("_before")), "offsets")
    near = h.withColumn("_r", F.row_number().over(W.partitionBy(type_col, "_b").orderBy("_h")))
    met = near.join(hinted(offsets, offsets.count(), 200_000), F.col(type_col).eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")))
    return met.select(*rows.columns, (F.col("_r") + F.col("_before")).alias("_r"))


def numbered(rows: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """rows with _r, the place of each in its group by a column without repeats.

    Rows are dealt out by ranges of group and order, numbered within a range, and the counts of the ranges before are added,
    so that a group of any size is as many tasks as it fills.
    """
    dealt = written(rows.repartitionByRange(group_col, order_col).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(F.col(group_col).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("_g", "_p", before.alias("_before")), "offsets")
    near = dealt.withColumn("_r", F.row_number().over(W.partitionBy(group_col, "_part").orderBy(order_col)))
    met = near.join(hinted(offsets, offsets.count(), 200_000), F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_r") + F.col("_before")).alias("_r"))


def cap_dataset(rows: DataFrame, id_col: str, type_col: str, maximum: int) -> DataFrame:
    """At most maximum rows: as if the most common type (ties: first by name) lost its largest hash again and again."""
    rank = F.row_number().over(W.partitionBy(type_col).orderBy(hash_of(id_col)))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= maximum).orderBy(F.col("_r"), F.desc(type_col)).limit(maximum).drop("_r")


def balance_types(rows: DataFrame, id_col: str, type_col: str, max_share: float = MAX_SHARE) -> DataFrame:
    """Rows of the largest type (ties: the first by name, null before all) go, largest hash first, until no type has more than max_share.

    The loop runs over the table of counts alone, one row a type; types are a short list, over 10,000 are an error.
    """
    import math

    listed = rows.groupBy(type_col).count().limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("over 10,000 types")
    counts = {r[0]: r[1] for r in listed}
    while counts:
        total = sum(counts.values())
        kind = min(counts, key=lambda k: (-counts[k], k is not None, k or ""))
        if counts[kind] <= max_share * total or len([k for k in counts if counts[k]]) == 1:
            break
        counts[kind] -= max(1, math.ceil((counts[kind] - max_share * total) / (1 - max_share)))
    keep = F.lit(0)
    for kind, n in counts.items():
        keep = F.when(F.col(type_col).eqNullSafe(F.lit(kind)), F.lit(n)).otherwise(keep)
    return ranked_by_hash(rows, id_col, type_col).filter(F.col("_r") <= keep).drop("_r")


def split_of(group: Column, eligible: Column, reserved: Column) -> Column:
    """train, validation or test by the first 12 hex digits of the group's hash; reserved rows are test; ineligible ones null."""
    share = F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 12), 16, 10).cast("double") / 16.0**12
    return F.when(reserved, "test").when(~eligible, F.lit(None)).when(share < TRAIN, "train").when(share < VALIDATION, "validation").otherwise("test")


def split_quotas(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts with train, validation, test: all train below five, else max(1, round(0.08 n)) each for the others (half to even)."""
    part = F.when(F.col(n) < 5, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col(n) * F.lit("0.08").cast("decimal(3,2)"), 0).cast("int"))).cast("long")
    return counts.withColumns({"validation": part, "test": part}).withColumn("train", F.col(n) - F.col("validation") - F.col("test"))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """side (missing: left alone, unexpected: right alone), and the rows with their numbers."""
    a, b = left.exceptAll(right).withColumn("side", F.lit("missing")), right.exceptAll(left).withColumn("side", F.lit("unexpected"))
    return a.unionByName(b).groupBy("side", *left.columns).agg(F.count("*").alias("n"))


# -- queries ----------------------------------------------------------------------------------------


def q_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_summary(V.eval_rows(spark, sf_dir))


def q_generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation_summary(V.eval_rows(spark, sf_dir))


def q_routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_accuracy(V.eval_rows(spark, sf_dir).select(F.col("decision").alias("expected"), F.when(F.col("scope_match"), "answered").otherwise("refused").alias("actual")))


def q_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_counts(V.examples(spark, sf_dir))


def q_policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_check(V.examples(spark, sf_dir), F.col("query_type"), ("en", "fr", "de", "es", "it"), 100, 50)


def q_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_cost(V.requests(spark, sf_dir))


def q_availability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability_counts(V.chunks(spark, sf_dir))


def q_speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_stats(V.history(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.expr("cast(length(text) div 2 as int)")
    return V.segments(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), F.expr("substring(text, cast(length(text) div 2 as int) + 1)").alias("answer"), F.substring("text", F.lit(1), half).alias("evidence"))


def q_number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_support(_answers(spark, sf_dir))


def q_regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a customer: expected, the priorities of finished orders; actual, of all; cited, of large ones."""
    o = V.table(spark, sf_dir, "orders")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("o_orderpriority"))))
    cases = o.groupBy(F.col("o_custkey").alias("case_id")).agg(pick(F.col("o_orderstatus") == "F").alias("expected"), pick(F.col("o_orderstatus") != "P").alias("actual"), pick(F.col("o_totalprice") > 150000).alias("cited"))
    return regression_report(cases.withColumn("limit", F.lit(4)))


def q_balanced_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_take(V.examples(spark, sf_dir), "group_id", "example_id", 100).select("example_id", "group_id", F.col("turn").cast("long").alias("turn"))


def q_cap_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_dataset(V.examples(spark, sf_dir), "example_id", "query_type", 200).select("example_id", "query_type")


def q_balance_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_types(V.examples(spark, sf_dir), "example_id", "query_type").select("example_id", "query_type")


def q_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir)
    return e.select("example_id", split_of(F.concat_ws("-", "group_id", "query_type"), F.col("review_status") == "approved", F.col("benchmark_overlap")).alias("split"))


def q_split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_quotas(V.examples(spark, sf_dir).groupBy("group_id", "query_type").agg(F.count("*").alias("n")))


def q_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_key(V.examples(spark, sf_dir), "question", "example_id").select("example_id", F.sha2("question", 256).alias("question_sha256"))


def q_top_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.chunks(spark, sf_dir).groupBy("ticker", "parent_id").agg(F.sum(F.length("text")).alias("score"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("score"), "parent_id")).cast("long")).filter("rank <= 3")


def q_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).select("child_id", F.length("text").cast("long").alias("score")).orderBy(F.desc("score"), "child_id").limit(20)


def q_set_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source and language, minus those that hold a document of good quality."""
    d = V.segments(spark, sf_dir)
    have = V.examples(spark, sf_dir).filter("review_status = 'pending'").select(F.col("group_id").alias("ticker"), F.col("query_type").alias("doc_type"))
    return d.select("ticker", "doc_type").distinct().exceptAll(have.distinct())


def q_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that each benchmark item shares with the item after it."""
    q = V.questions(spark, sf_dir).select("question_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    after = q.select((F.col("question_id") - 1).alias("question_id"), F.col("terms").alias("other"))
    return q.join(after.hint("merge"), "question_id").select("question_id", F.size(F.array_intersect("terms", "other")).cast("long").alias("shared"), F.arrays_overlap("terms", "other").alias("any"))


def q_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    pick = lambda s: o.filter(F.col("o_orderstatus") == s).select((F.col("o_custkey") % 50).alias("k"), "o_orderpriority")
    return multiset_diff(pick("F"), pick("O"))


def q_union_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of three tiers; each keeps its best tier."""
    d = V.segments(spark, sf_dir)
    tiers = [(1, "doc_type = 'en' AND doc_id % 3 = 0"), (2, "doc_id % 2 = 0"), (3, "length(text) > 500")]
    rows = [d.filter(c).select("doc_id", F.lit(t).cast("long").alias("tier")) for t, c in tiers]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("doc_id").agg(F.min("tier").alias("tier"), F.count("*").alias("found_by"))


def q_fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("doc_id", F.sha2(T.fold_text(F.col("text")), 256).alias("folded_sha256"))


def q_text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def q_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.segments(spark, sf_dir).select("doc_id", F.array_sort(T.grams(T.words(F.col("text")))).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join("g", "|"), 256).alias("grams_sha256"))


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's trigrams, as 64-bit hashes, against those of the document with the next number."""
    d = V.segments(spark, sf_dir).select("doc_id", F.transform(T.grams(T.words(F.col("text"))), lambda x: F.xxhash64(x)).alias("g"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return d.join(after.hint("merge"), "doc_id").select("doc_id", F.round(T.jaccard(F.col("g"), F.col("h")), 9).alias("jaccard"))


def q_stable_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("doc_id", T.stable_key("ex_", 16, F.col("ticker"), F.col("text")).alias("key"))


def q_number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("doc_id", F.array_join(T.number_keys(F.col("text")), ",").alias("numbers"))


def q_singularize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the texts, without their plural endings, and how many words become each."""
    w = V.segments(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return w.groupBy(T.singular(F.col("word")).alias("term")).agg(F.count("*").alias("words"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("as of "), F.date_format(F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "MMMM d, yyyy"), F.lit(" or so")).alias("t"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("z"))


def q_parse_month_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", F.date_format(T.month_date(F.col("t")), "yyyy-MM-dd").alias("date"))


def q_zoned_timestamp_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", T.zoned_timestamp(F.col("z")).isNotNull().alias("valid"))


def q_json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON, parsed with a schema and written again with a whitelist of fields."""
    p = F.from_json("props", "k long, other string")
    e = V.table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"))).alias("json"))


_TYPES = "examples"
_FOLD = r"trim(regexp_replace(lower(translate(coalesce(text, ''), '‘’“”–—' || chr(160), '''''" + '""' + r"-- ')), '\s+', ' ', 'g'))"
_WORDS = rf"regexp_extract_all({_FOLD}, '([a-z0-9]+)', 1)"
_GRAMS = (
    f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0), "
    "r AS (SELECT doc_id, list_sort(list(DISTINCT array_to_string(w[p : p + 2], ' '))) AS g FROM p GROUP BY doc_id), g AS (SELECT w.doc_id, coalesce(r.g, []) AS g FROM w LEFT JOIN r USING (doc_id))"
)
_KEY = (
    "CASE WHEN (contains(r, '(') AND contains(r, ')') OR contains(r, '-')) THEN '-' ELSE '' END || regexp_replace(CASE WHEN contains(regexp_replace(r, '[^0-9.]', '', 'g'), '.') THEN regexp_replace(regexp_replace(r, '[^0-9.]', '', 'g'), '\\.?0*$', '') ELSE regexp_replace(r, '[^0-9.]', '', 'g') END, '^0+([0-9])', '\\1')"
)


def _keys(col: str) -> str:
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({col}, '(?i)(?:^|[^\p{{L}}\p{{N}}_.])((?:USD\s*|\$\s*)?-?\(?\d[\d,]*(?:\.\d+)?\)?%?)', 1), lambda r: " + _KEY.replace("\\\\", "\\") + ")))"


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}
_M = V.METRICS
_FINE = "decision = 'answered' AND error IS NULL"
ORACLES = {
    "eval_summary": V.with_views("eval_rows") + f", a AS (SELECT count(*) AS questions_evaluated, count(*) FILTER (WHERE decision = 'answered') AS answered, round(count(*) FILTER (WHERE decision = 'answered') / count(*), 4) AS answer_success_rate, count(*) FILTER (WHERE {_FINE} AND coalesce({', '.join(_M)}) IS NOT NULL) AS scored_answered_rows, round(count(*) FILTER (WHERE {_FINE} AND coalesce({', '.join(_M)}) IS NOT NULL) / count(*), 4) AS metric_coverage_rate, round(count(*) FILTER (WHERE scope_match) / count(*), 4) AS scope_match_rate, count(error) AS rows_with_errors, "
    + ", ".join(f"round(avg({m}) FILTER (WHERE {_FINE}), 4) AS mean_{m}, count({m}) FILTER (WHERE {_FINE}) AS count_{m}" for m in _M)
    + f" FROM eval_rows), b AS (SELECT *, round(({' + '.join('mean_' + m for m in _M)}) / 5, 4) AS final_score FROM a) SELECT *, round(final_score * answer_success_rate, 4) AS coverage_adjusted_score FROM b",
    "generation_summary": V.with_views("eval_rows") + " SELECT count(*) AS questions_generated, count(*) FILTER (WHERE decision = 'answered') AS answered, round(count(*) FILTER (WHERE decision = 'answered') / count(*), 4) AS answer_success_rate, count(error) AS rows_with_errors FROM eval_rows",
    "routing_accuracy": V.with_views("eval_rows") + " SELECT decision AS expected, count(*) AS total, count(*) FILTER (WHERE decision = CASE WHEN scope_match THEN 'answered' ELSE 'refused' END) AS passed, round(passed / total, 4) AS rate FROM eval_rows GROUP BY ROLLUP (decision)",
    "dataset_counts": V.with_views("examples") + " SELECT query_type, review_status, grouping(query_type, review_status)::BIGINT AS level, count(*) AS rows, count(*) FILTER (WHERE benchmark_overlap) AS overlapping FROM examples GROUP BY CUBE (query_type, review_status)",
    "policy_check": V.with_views("examples") + ", c AS (SELECT query_type AS g, count(*) AS n FROM examples GROUP BY g), t AS (SELECT sum(n) AS total, max(n) AS largest FROM c) SELECT 'minimum' AS \"check\", total::DOUBLE AS value, 100.0::DOUBLE AS \"limit\", total >= 100 AS passed FROM t UNION ALL SELECT 'largest_share', round(largest / total, 6), 0.4, largest <= total * 0.4 FROM t UNION ALL SELECT 'group:' || w.g, coalesce(n, 0)::DOUBLE, 50.0, coalesce(n, 0) >= 50 FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) w(g) LEFT JOIN c ON w.g = c.g",
    "usage_cost": V.with_views("requests") + ", u AS (SELECT request_id, model, output IS NOT NULL AND input IS NOT NULL AS there, lower(trim(model)) = 'gpt-4o-mini' OR starts_with(lower(trim(model)), 'gpt-4o-mini-20') AS priced, greatest(input, 0) AS n, least(greatest(input, 0), greatest(coalesce(cached, 0), 0)) AS c, greatest(output, 0) AS o FROM requests) SELECT request_id, count(*) AS calls, coalesce(sum(n) FILTER (WHERE there), 0)::BIGINT AS input_tokens, coalesce(sum(c) FILTER (WHERE there), 0)::BIGINT AS cached_tokens, coalesce(sum(o) FILTER (WHERE there), 0)::BIGINT AS output_tokens, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, CASE WHEN bool_and(there AND priced) THEN round(sum((n - c) * 150 + c * 75 + o * 600)::DOUBLE / 1e9, 8) END AS cost_usd FROM u GROUP BY request_id",
    "availability_counts": V.with_views("chunks") + " SELECT ticker, doc_type, grouping(ticker, doc_type)::BIGINT AS level, count(*) AS windows FROM chunks GROUP BY CUBE (ticker, doc_type)",
    "speaker_stats": V.with_views("history") + r" SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS speakers, count(DISTINCT role) AS n_speakers, count(*) AS turns, sum(len(regexp_extract_all(content, '(\S+)', 1)))::BIGINT AS words FROM history GROUP BY conv_id",
    "number_support": "SELECT doc_id AS answer_id, array_to_string(list_sort(list_filter(" + _keys("substr(text, length(text) // 2 + 1)") + ", lambda x: NOT list_contains(" + _keys("substr(text, 1, length(text) // 2)") + ", x))), ',') AS unsupported FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "regression_report": "WITH c AS (SELECT o_custkey AS case_id, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS e, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'P'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_totalprice > 150000), []) AS c FROM orders GROUP BY o_custkey), s AS (SELECT case_id, len(list_filter(e, lambda x: NOT list_contains(a, x))) = 0 AS expected_found, len(list_filter(a, lambda x: NOT list_contains(e, x))) AS extra, len(a) <= 4 AS within_limit, CASE WHEN len(a) > 0 THEN round(100 * len(list_intersect(c, a)) / len(a), 2) END AS utilisation FROM c) SELECT *, expected_found AND within_limit AS passed FROM s",
    "balanced_take": V.with_views("examples") + " SELECT example_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY example_id) AS turn FROM examples ORDER BY turn, group_id LIMIT 100",
    "cap_dataset": V.with_views("examples") + " SELECT example_id, query_type FROM (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY sha256(example_id::VARCHAR)) AS r FROM examples) ORDER BY r, query_type DESC LIMIT 200",
    "split_assign": V.with_views("examples") + " SELECT example_id, CASE WHEN benchmark_overlap THEN 'test' WHEN review_status <> 'approved' THEN NULL WHEN s < 0.84 THEN 'train' WHEN s < 0.92 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, ('0x' || left(sha256(group_id || '-' || query_type), 12))::BIGINT / pow(16.0, 12) AS s FROM examples)",
    "split_quotas": V.with_views("examples") + ", c AS (SELECT group_id, query_type, count(*) AS n FROM examples GROUP BY ALL) SELECT *, CASE WHEN n < 5 THEN 0 ELSE greatest(1, round_even(n * 0.08, 0)) END::BIGINT AS validation, validation AS test, n - 2 * validation AS train FROM c",
    "first_per_key": V.with_views("examples") + " SELECT min(example_id) AS example_id, sha256(question) AS question_sha256 FROM examples GROUP BY question",
    "top_parents": V.with_views("chunks") + " SELECT ticker, parent_id, sum(length(text))::BIGINT AS score, row_number() OVER (PARTITION BY ticker ORDER BY sum(length(text)) DESC, parent_id) AS rank FROM chunks GROUP BY ticker, parent_id QUALIFY rank <= 3",
    "top_hits": V.with_views("chunks") + " SELECT child_id, length(text) AS score FROM chunks ORDER BY score DESC, child_id LIMIT 20",
    "set_missing": V.with_views("segments", "examples") + " SELECT DISTINCT ticker, doc_type FROM segments EXCEPT SELECT group_id, query_type FROM examples WHERE review_status = 'pending'",
    "set_overlap": V.with_views("questions") + rf", q AS (SELECT question_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:[.&''-][\p{{L}}\p{{N}}]+)*', 0), lambda t: t NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}))) AS terms FROM questions) SELECT a.question_id, len(list_intersect(a.terms, b.terms)) AS shared, len(list_intersect(a.terms, b.terms)) > 0 AS \"any\" FROM q a JOIN q b ON a.question_id = b.question_id - 1".replace('\\"', '"'),
    "multiset_diff": "WITH p AS (SELECT o_orderstatus AS s, o_custkey % 50 AS k, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT * FROM p WHERE s = 'F'), o AS (SELECT * FROM p WHERE s = 'O'), d AS (SELECT coalesce(f.k, o.k) AS k, coalesce(f.o_orderpriority, o.o_orderpriority) AS o_orderpriority, coalesce(f.n, 0) - coalesce(o.n, 0) AS d FROM f FULL JOIN o ON f.k = o.k AND f.o_orderpriority = o.o_orderpriority) SELECT CASE WHEN d > 0 THEN 'missing' ELSE 'unexpected' END AS side, k, o_orderpriority, abs(d) AS n FROM d WHERE d <> 0",
    "union_tiers": V.with_views("segments") + ", u AS (SELECT doc_id, 1 AS tier FROM segments WHERE doc_type = 'en' AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM segments WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3 FROM segments WHERE length(text) > 500) SELECT doc_id, min(tier)::BIGINT AS tier, count(*) AS found_by FROM u GROUP BY doc_id",
    "fold_text": f"SELECT doc_id, sha256({_FOLD}) AS folded_sha256 FROM documents",
    "text_fingerprint": f"SELECT doc_id, sha256(array_to_string({_WORDS}, ' ')) AS fingerprint FROM documents",
    "trigrams": f"WITH {_GRAMS} SELECT doc_id, len(g) AS n, sha256(array_to_string(g, '|')) AS grams_sha256 FROM g",
    "jaccard": f"WITH {_GRAMS}, q AS (SELECT a.doc_id, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.doc_id = b.doc_id - 1) SELECT doc_id, CASE WHEN s = 0 THEN 1.0 ELSE round(i / (s - i), 9) END AS jaccard FROM q",
    "stable_key": f"SELECT doc_id, 'ex_' || left(sha256(source || chr(31) || {_FOLD}), 16) AS key FROM documents",
    "number_keys": "SELECT doc_id, array_to_string(" + _keys("coalesce(text, '')") + ", ',') AS numbers FROM documents",
    "singularize": f"WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM documents) SELECT CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'is') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS term, count(*) AS words FROM w GROUP BY term",
    "parse_month_date": "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
    "zoned_timestamp_check": "SELECT o_orderkey, o_orderkey % 2 = 0 AS valid FROM orders",
    "json_project": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract(props, '$.k')::BIGINT || '}' AS json FROM events",
}
