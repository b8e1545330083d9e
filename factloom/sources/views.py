"""Views over the stored tables under the names that the operators use, with the same views in SQL.

Each view is a function (spark, sf_dir) -> DataFrame and an entry of SQL, text for a WITH list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T

#: Words per parent and child window and their overlaps, by kind of document.
FILING, TRANSCRIPT = (3200, 400, 800, 200), (2000, 250, 400, 100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ticker"), F.col("lang").alias("doc_type"), F.coalesce("text", F.lit("")).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"))


def question_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requested groups a question: question_id, grp_ord, ticker, doc_type (null: any)."""
    pick = F.explode(F.array(F.struct(F.lit(0).alias("grp_ord"), F.lit(7).alias("m")), F.struct(F.lit(1).alias("grp_ord"), F.lit(11).alias("m"))))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), pick.alias("g"))
    number = (F.col("question_id") * F.col("g.m") + 3 * F.col("g.grp_ord")) % 20
    kind = F.when(F.col("question_id") % 4 == 0, F.lit("en"))
    return rows.select("question_id", F.col("g.grp_ord").alias("grp_ord"), F.concat(F.lit("src"), number.cast("string")).alias("ticker"), kind.alias("doc_type"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("grp"), "embedding")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples: example_id, group_id, question, query_type, review_status, benchmark_overlap."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("example_id"), F.col("source").alias("group_id"), F.coalesce("text", F.lit("")).alias("question"), F.col("lang").alias("query_type"),
        F.when(F.col("quality") == 1, "approved").otherwise("pending").alias("review_status"), (F.col("doc_id") % 50 == 0).alias("benchmark_overlap"),
    )


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers: id, decision, error, scope_match and five metrics that may be null."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    metric = lambda m, off: F.when((F.col("n_chars") + off) % 7 != 0, ((F.col("n_chars") * m + off) % 101) / F.lit(100.0))
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, "answered").otherwise("refused").alias("decision"), F.when(F.col("doc_id") % 37 == 0, "timeout").alias("error"), (F.col("quality") == 1).alias("scope_match"),
        *[metric(m, i).alias(name) for i, (m, name) in enumerate(zip((3, 5, 7, 11, 13), METRICS, strict=True))],
    )


METRICS = ("faithfulness", "context_precision", "context_recall", "response_relevancy", "factual_correctness")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: request_id, model, input, cached and output tokens (null: no usage), ts."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id"), F.when(F.col("event_type") == "view", "gpt-4o-mini").when(F.col("event_type") == "click", "gpt-4o-mini-2024-07-18").when(F.col("event_type") == "error", "other").otherwise("gpt-4o-mini").alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input"), (k * 7).cast("long").alias("cached"), F.when(F.col("event_id") % 97 != 0, (k * 3).cast("long")).alias("output"), "ts",
    )


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (nation), fiscal_year, metric, base_value DECIMAL(38,10), unit: a fixed stand-in chart of accounts over the orders."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey"), F.col("n_name").alias("ticker"))
    o = t("orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "ticker", F.year("o_orderdate").alias("fiscal_year"), _money(F.col("o_totalprice")).alias("total"), "o_orderstatus", "o_orderpriority")
    o = o.filter(F.col("fiscal_year").between(1995, 2001))
    sum_if = lambda cond, v: F.sum(F.when(cond, v).otherwise(F.lit(0).cast("decimal(18,2)")))
    order_side = o.groupBy("ticker", "fiscal_year").agg(
        F.sum("total").alias("total_assets"), sum_if(F.col("o_orderstatus") != "F", F.col("total")).alias("current_assets"),
        sum_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("total")).alias("current_liabilities"), sum_if(F.col("o_orderstatus") == "P", F.col("total")).alias("cash_and_cash_equivalents"),
        sum_if(F.col("o_orderstatus") == "O", F.col("total")).alias("accounts_receivable"), sum_if(F.col("o_orderpriority") == "3-MEDIUM", F.col("total")).alias("short_term_investments"),
        sum_if(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.col("total")).alias("total_debt"),
    )
    ext, disc, tax = _money(F.col("l_extendedprice")), F.col("l_discount").cast("decimal(5,2)"), F.col("l_tax").cast("decimal(5,2)")
    line = t("lineitem").join(o.select("o_orderkey", "ticker", "fiscal_year"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", _money(F.col("p_retailprice")).alias("retail")), F.col("l_partkey") == F.col("p_partkey"))
    line = line.select("ticker", "fiscal_year", ext.alias("ext"), (ext * (1 - disc)).alias("net"), tax.alias("tax"), (ext * (1 - disc) * tax).alias("taxed"), "retail", _money(F.col("l_quantity")).alias("qty"), "l_linestatus", "l_returnflag")
    line_side = line.groupBy("ticker", "fiscal_year").agg(
        F.sum("net").alias("total_revenue"), F.sum("ext").alias("ext"), F.sum("taxed").alias("taxed"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("net"))).alias("operating_cash_flow"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("retail"))).alias("capex"), F.sum("tax").alias("tax"), F.count("*").alias("n"), F.sum("qty").alias("diluted_weighted_average_shares"),
    )
    wide = order_side.join(line_side, ["ticker", "fiscal_year"])
    d = lambda name: F.col(name).cast("decimal(38,10)")
    dec = lambda c: c.cast("decimal(38,10)")
    revenue, cost = d("total_revenue"), dec(d("ext") * F.lit("0.6").cast("decimal(3,1)"))
    income = dec(revenue - cost)
    earned = dec(income - d("taxed"))
    values = {
        "total_revenue": (revenue, "currency"), "cost_of_revenue": (cost, "currency"), "operating_income": (income, "currency"), "net_income": (earned, "currency"),
        "depreciation_and_amortization": (dec(d("ext") * F.lit("0.05").cast("decimal(3,2)")), "currency"), "operating_cash_flow": (d("operating_cash_flow"), "currency"), "capital_expenditures": (dec(-d("capex")), "currency"),
        "total_assets": (d("total_assets"), "currency"), "current_assets": (d("current_assets"), "currency"), "current_liabilities": (d("current_liabilities"), "currency"), "cash_and_cash_equivalents": (d("cash_and_cash_equivalents"), "currency"),
        "accounts_receivable": (d("accounts_receivable"), "currency"), "short_term_investments": (d("short_term_investments"), "currency"), "total_debt": (d("total_debt"), "currency"), "stockholders_equity": (dec(d("total_assets") - d("total_debt")), "currency"),
        "effective_tax_rate": (F.round(100 * F.col("tax").cast("double") / F.col("n"), 6).cast("decimal(38,10)"), "percent"), "diluted_weighted_average_shares": (d("diluted_weighted_average_shares"), "count"),
        "diluted_eps": (F.round(earned.cast("double") / F.col("diluted_weighted_average_shares").cast("double"), 6).cast("decimal(38,10)"), "per_share"),
    }
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("base_value"), F.lit(u).alias("unit")) for m, (v, u) in values.items()]))
    return wide.select("ticker", "fiscal_year", items.alias("f")).select("ticker", "fiscal_year", "f.*").filter("base_value is not null")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child windows: child_id, parent_id, child_index, ticker, doc_type, text (with its prefix)."""
    from factloom.operators.chunking import chunk_parent_child

    return chunk_parent_child(segments(spark, sf_dir), "doc_id", "text", ["ticker", "doc_type"], kind_col="doc_type", kinds={"en": FILING}, other=TRANSCRIPT)


def _starts(n: str, size: str, over: str) -> str:
    return f"unnest(range(0, CASE WHEN {n} <= {size} THEN 1 ELSE 1 + CAST(ceil(({n} - {size}) / ({size} - {over})) AS BIGINT) END))"


SQL = {
    "segments": "segments AS (SELECT doc_id, source AS ticker, lang AS doc_type, coalesce(text, '') AS text FROM documents)",
    "questions": "questions AS (SELECT item_id AS question_id, coalesce(text, '') AS text FROM benchmark)",
    "question_groups": "question_groups AS (SELECT item_id AS question_id, grp_ord, 'src' || ((item_id * m + 3 * grp_ord) % 20) AS ticker, CASE WHEN item_id % 4 = 0 THEN 'en' END AS doc_type FROM benchmark, (VALUES (0, 7), (1, 11)) v(grp_ord, m))",
    "vectors": "vectors AS (SELECT vec_id, label AS grp, embedding FROM embeddings)",
    "history": "history AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations)",
    "examples": r"examples AS (SELECT doc_id AS example_id, source AS group_id, coalesce(text, '') AS question, lang AS query_type, CASE WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS review_status, doc_id % 50 = 0 AS benchmark_overlap FROM documents JOIN labels USING (doc_id))",
    "eval_rows": "eval_rows AS (SELECT doc_id AS id, CASE WHEN toxic = 0 THEN 'answered' ELSE 'refused' END AS decision, CASE WHEN doc_id % 37 = 0 THEN 'timeout' END AS error, quality = 1 AS scope_match, "
    + ", ".join(f"CASE WHEN (n_chars + {i}) % 7 <> 0 THEN ((n_chars * {m} + {i}) % 101) / 100.0 END::DOUBLE AS {name}" for i, (m, name) in enumerate(zip((3, 5, 7, 11, 13), METRICS, strict=True)))
    + " FROM documents JOIN labels USING (doc_id))",
    "requests": "requests AS (SELECT user_id AS request_id, event_id, CASE event_type WHEN 'view' THEN 'gpt-4o-mini' WHEN 'click' THEN 'gpt-4o-mini-2024-07-18' WHEN 'error' THEN 'other' ELSE 'gpt-4o-mini' END AS model, floor(value * 10)::BIGINT AS input, json_extract(props, '$.k')::BIGINT * 7 AS cached, CASE WHEN event_id % 97 <> 0 THEN json_extract(props, '$.k')::BIGINT * 3 END AS output, ts FROM events)",
    "facts": """order_rows AS (SELECT o_orderkey, n_name AS ticker, year(o_orderdate)::INT AS fiscal_year, o_totalprice::DECIMAL(18,2) AS total, o_orderstatus, o_orderpriority
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) BETWEEN 1995 AND 2001),
order_side AS (SELECT ticker, fiscal_year, sum(total) AS total_assets, sum(CASE WHEN o_orderstatus <> 'F' THEN total ELSE 0 END) AS current_assets, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN total ELSE 0 END) AS current_liabilities,
 sum(CASE WHEN o_orderstatus = 'P' THEN total ELSE 0 END) AS cash_and_cash_equivalents, sum(CASE WHEN o_orderstatus = 'O' THEN total ELSE 0 END) AS accounts_receivable, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN total ELSE 0 END) AS short_term_investments,
 sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN total ELSE 0 END) AS total_debt FROM order_rows GROUP BY ALL),
line_rows AS (SELECT ticker, fiscal_year, l_extendedprice::DECIMAL(18,2) AS ext, l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(5,2)) AS net, l_tax::DECIMAL(5,2) AS tax, p_retailprice::DECIMAL(18,2) AS retail, l_quantity::DECIMAL(18,2) AS qty, l_linestatus, l_returnflag
 FROM lineitem JOIN order_rows ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
line_side AS (SELECT ticker, fiscal_year, sum(net)::DECIMAL(38,10) AS revenue, sum(ext)::DECIMAL(38,10) AS ext, sum(net * tax)::DECIMAL(38,10) AS taxed, sum(CASE WHEN l_linestatus = 'F' THEN net END)::DECIMAL(38,10) AS ocf, sum(CASE WHEN l_returnflag = 'R' THEN retail END)::DECIMAL(38,10) AS capex,
 sum(tax) AS tax, count(*) AS n, sum(qty)::DECIMAL(38,10) AS shares FROM line_rows GROUP BY ALL),
wide AS (SELECT *, (ext::DECIMAL(28,6) * 0.6)::DECIMAL(38,10) AS cost, (ext::DECIMAL(28,6) * 0.05)::DECIMAL(38,10) AS da FROM order_side JOIN line_side USING (ticker, fiscal_year)),
facts AS (SELECT ticker, fiscal_year, f.metric AS metric, f.v AS base_value, f.unit AS unit FROM (SELECT ticker, fiscal_year, unnest([
 {'metric': 'total_revenue', 'v': revenue, 'unit': 'currency'}, {'metric': 'cost_of_revenue', 'v': cost, 'unit': 'currency'}, {'metric': 'operating_income', 'v': revenue - cost, 'unit': 'currency'}, {'metric': 'net_income', 'v': revenue - cost - taxed, 'unit': 'currency'},
 {'metric': 'depreciation_and_amortization', 'v': da, 'unit': 'currency'}, {'metric': 'operating_cash_flow', 'v': ocf, 'unit': 'currency'}, {'metric': 'capital_expenditures', 'v': -capex, 'unit': 'currency'},
 {'metric': 'total_assets', 'v': total_assets::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'current_assets', 'v': current_assets::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'current_liabilities', 'v': current_liabilities::DECIMAL(38,10), 'unit': 'currency'},
 {'metric': 'cash_and_cash_equivalents', 'v': cash_and_cash_equivalents::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'accounts_receivable', 'v': accounts_receivable::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'short_term_investments', 'v': short_term_investments::DECIMAL(38,10), 'unit': 'currency'},
 {'metric': 'total_debt', 'v': total_debt::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'stockholders_equity', 'v': (total_assets - total_debt)::DECIMAL(38,10), 'unit': 'currency'}, {'metric': 'effective_tax_rate', 'v': round(100 * tax::DOUBLE / n, 6)::DECIMAL(38,10), 'unit': 'percent'},
 {'metric': 'diluted_weighted_average_shares', 'v': shares, 'unit': 'count'}, {'metric': 'diluted_eps', 'v': round((revenue - cost - taxed)::DOUBLE / shares::DOUBLE, 6)::DECIMAL(38,10), 'unit': 'per_share'}]) AS f FROM wide) WHERE f.v IS NOT NULL)""",
    "chunks": rf"""seg_words AS (SELECT doc_id, source AS ticker, lang AS doc_type, regexp_extract_all(coalesce(text, ''), '(\S+)', 1) AS w, CASE WHEN lang = 'en' THEN {FILING[0]} ELSE {TRANSCRIPT[0]} END AS ps, CASE WHEN lang = 'en' THEN {FILING[1]} ELSE {TRANSCRIPT[1]} END AS po, CASE WHEN lang = 'en' THEN {FILING[2]} ELSE {TRANSCRIPT[2]} END AS cs, CASE WHEN lang = 'en' THEN {FILING[3]} ELSE {TRANSCRIPT[3]} END AS co FROM documents),
parent_rows AS (SELECT doc_id, ticker, doc_type, w, ps, po, cs, co, {_starts('len(w)', 'ps', 'po')} AS parent_index FROM seg_words WHERE len(w) > 0),
parents AS (SELECT doc_id, ticker, doc_type, cs, co, parent_index, w[parent_index * (ps - po) + 1 : parent_index * (ps - po) + ps] AS pw, sha256(concat_ws('|', 'parent', doc_id, parent_index)) AS parent_id FROM parent_rows),
child_rows AS (SELECT *, {_starts('len(pw)', 'cs', 'co')} AS child_index FROM parents),
chunks AS (SELECT sha256(concat_ws('|', 'child', parent_id, child_index)) AS child_id, parent_id, parent_index, child_index, doc_id, ticker, doc_type, '[' || concat_ws(' | ', ticker, doc_type) || ']' || chr(10) || array_to_string(pw[child_index * (cs - co) + 1 : child_index * (cs - co) + cs], ' ') AS text FROM child_rows)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


