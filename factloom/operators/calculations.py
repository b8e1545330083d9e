"""Requests over fact tables: eleven operations with guards, formula trees, growth, chains of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources import views as V
from factloom.sources.shared import written

#: Scale names and multipliers; operations of two facts and of one.
SCALES = {"ones": 1, "thousands": 1_000, "millions": 1_000_000, "billions": 1_000_000_000}
BINARY = ("absolute_change", "difference", "percentage_change", "percentage_point_change", "basis_point_change", "ratio", "product", "cagr")
UNARY = ("absolute_value", "percent_complement")
TEMPORAL = ("absolute_change", "percentage_change", "percentage_point_change", "basis_point_change", "cagr")
OPERATIONS = ("sum", *BINARY, *UNARY)

#: Formulas by id, their aliases and their trees over metrics.
FORMULAS = [
    ("gross_profit", ("gross profit",), ("difference", "total_revenue", "cost_of_revenue")),
    ("gross_margin", ("gross margin", "gross profit margin"), ("ratio", ("difference", "total_revenue", "cost_of_revenue"), "total_revenue")),
    ("operating_margin", ("operating margin", "operating profit margin"), ("ratio", "operating_income", "total_revenue")),
    ("net_profit_margin", ("net profit margin", "net margin", "net income margin"), ("ratio", "net_income", "total_revenue")),
    ("ebitda", ("ebitda",), ("sum", "operating_income", "depreciation_and_amortization")),
    ("ebitda_margin", ("ebitda margin",), ("ratio", ("sum", "operating_income", "depreciation_and_amortization"), "total_revenue")),
    ("free_cash_flow", ("free cash flow", "fcf"), ("difference", "operating_cash_flow", ("absolute_value", "capital_expenditures"))),
    ("free_cash_flow_margin", ("free cash flow margin", "fcf margin"), ("ratio", ("difference", "operating_cash_flow", ("absolute_value", "capital_expenditures")), "total_revenue")),
    ("current_ratio", ("current ratio",), ("ratio", "current_assets", "current_liabilities")),
    ("quick_ratio", ("quick ratio", "acid test ratio"), ("ratio", ("sum", "cash_and_cash_equivalents", "short_term_investments", "accounts_receivable"), "current_liabilities")),
    ("cash_ratio", ("cash ratio",), ("ratio", ("sum", "cash_and_cash_equivalents", "short_term_investments"), "current_liabilities")),
    ("debt_to_equity", ("debt to equity", "debt equity ratio", "debt-to-equity"), ("ratio", "total_debt", "stockholders_equity")),
    ("debt_to_assets", ("debt to assets", "debt assets ratio", "debt-to-assets"), ("ratio", "total_debt", "total_assets")),
    ("net_debt", ("net debt",), ("difference", "total_debt", "cash_and_cash_equivalents")),
    ("return_on_assets", ("return on assets", "roa"), ("ratio", "net_income", "total_assets")),
    ("return_on_equity", ("return on equity", "roe"), ("ratio", "net_income", "stockholders_equity")),
    ("return_on_invested_capital", ("return on invested capital", "roic"),
     ("ratio", ("product", "operating_income", ("percent_complement", "effective_tax_rate")), ("difference", ("sum", "total_debt", "stockholders_equity"), "cash_and_cash_equivalents"))),
    ("asset_turnover", ("asset turnover",), ("ratio", "total_revenue", "total_assets")),
    ("receivables_turnover", ("receivables turnover", "accounts receivable turnover"), ("ratio", "total_revenue", "accounts_receivable")),
    ("cash_flow_conversion", ("cash flow conversion", "cash conversion ratio"), ("ratio", "operating_cash_flow", "net_income")),
    ("revenue_per_share", ("revenue per share", "sales per share"), ("ratio", "total_revenue", "diluted_weighted_average_shares")),
]
GROWTH = [
    ("revenue_growth", ("revenue growth", "sales growth"), "total_revenue"),
    ("eps_growth", ("eps growth", "earnings per share growth"), "diluted_eps"),
    ("operating_cash_flow_growth", ("operating cash flow growth", "cash flow growth"), "operating_cash_flow"),
]
METRICS = (
    "total_revenue", "cost_of_revenue", "operating_income", "net_income", "depreciation_and_amortization", "operating_cash_flow", "capital_expenditures", "current_assets", "current_liabilities",
    "cash_and_cash_equivalents", "short_term_investments", "accounts_receivable", "total_debt", "stockholders_equity", "total_assets", "effective_tax_rate", "diluted_weighted_average_shares", "diluted_eps",
)


def check_catalog(formulas: list, metrics: tuple[str, ...] = METRICS) -> list[str]:
    """Errors of a catalog of formulas: repeated ids and aliases, unknown metrics, wrong numbers of inputs."""
    errors, ids, names = [], set(), set()

    def walk(name: str, node: object) -> None:
        if isinstance(node, str):
            if node not in metrics:
                errors.append(f"{name}: unknown metric {node}")
            return
        op, *inputs = node
        want = 1 if op in UNARY else 2 if op in BINARY else None
        if op not in OPERATIONS or (want and len(inputs) != want) or not inputs:
            errors.append(f"{name}: {op} of {len(inputs)}")
        for x in inputs:
            walk(name, x)

    for name, aliases, tree in formulas:
        if name in ids:
            errors.append(f"{name}: repeated id")
        ids.add(name)
        for alias in aliases:
            if alias in names:
                errors.append(f"{name}: repeated alias {alias}")
            names.add(alias)
        walk(name, tree)
    return errors


def compile_formula(node: object, percent: frozenset[str] = frozenset({"effective_tax_rate"})) -> Column:
    """A tree over metric columns as one expression; null where an input is missing or a divisor is zero."""
    if isinstance(node, str):
        return F.col(node)
    op, *inputs = node
    args = [compile_formula(x, percent) for x in inputs]
    is_percent = [x in percent if isinstance(x, str) else x[0] == "percent_complement" for x in inputs]
    if op == "sum":
        return sum(args[1:], args[0])
    if op == "difference":
        return args[0] - args[1]
    if op == "ratio":
        return args[0] / F.nullif(args[1], F.lit(0.0))
    if op == "product":
        a, b = (x / 100 if p else x for x, p in zip(args, is_percent, strict=True))
        return a * b
    return F.abs(args[0]) if op == "absolute_value" else 100 - args[0]


def _sql(node: object) -> str:
    if isinstance(node, str):
        return node
    op, *inputs = node
    args = [_sql(x) for x in inputs]
    if op == "product":
        args = [f"({a} / 100)" if x == "effective_tax_rate" or x[0] == "percent_complement" else a for a, x in zip(args, inputs, strict=True)]
    return {"sum": "(" + " + ".join(args) + ")", "difference": f"({' - '.join(args)})", "product": f"({' * '.join(args)})", "absolute_value": f"abs({args[0]})", "percent_complement": f"(100 - {args[0]})"}.get(op) or f"({args[0]} / nullif({args[1]}, 0))"


def wide(facts: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """ticker, fiscal_year and a column for each metric: one aggregation, no pivot pass over the values."""
    return facts.groupBy("ticker", "fiscal_year").agg(*[F.max(F.when(F.col("metric") == m, F.col("base_value").cast("double"))).alias(m) for m in metrics])


def formula_eval(facts: DataFrame, formulas: list = FORMULAS) -> DataFrame:
    """ticker, fiscal_year, formula, value (null: undefined)."""
    errors = check_catalog(formulas)
    if errors:
        raise ValueError("; ".join(errors))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("formula"), F.round(compile_formula(tree), 4).alias("value")) for name, _, tree in formulas]))
    return wide(facts).select("ticker", "fiscal_year", each.alias("x")).select("ticker", "fiscal_year", "x.*")


def formula_temporal(facts: DataFrame, growth: list = GROWTH) -> DataFrame:
    """ticker, formula, first_year, last_year, growth in percent; reason where there is one year or the first value is zero."""
    names = F.create_map(*[F.lit(x) for name, _, metric in growth for x in (metric, name)])
    rows = facts.filter(F.col("metric").isin(*[m for _, _, m in growth])).withColumn("v", F.col("base_value").cast("double"))
    ends = rows.groupBy("ticker", "metric").agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.min_by("v", "fiscal_year").alias("old"), F.max_by("v", "fiscal_year").alias("new"))
    reason = F.when(F.col("first_year") == F.col("last_year"), "needs two years").when(F.col("old") == 0, "old value is zero")
    return ends.select("ticker", F.element_at(names, F.col("metric")).alias("formula"), "first_year", "last_year", F.when(reason.isNull(), F.round((F.col("new") - F.col("old")) / F.abs("old") * 100, 4)).alias("growth"), reason.alias("reason"))


def formula_match(questions: DataFrame, formulas: list = FORMULAS, growth: list = GROWTH) -> DataFrame:
    """questions with formula: the one whose longest alias is a whole phrase of the text; ties by id. Null: none."""
    aliases = sorted({(alias, name) for name, names, _ in [*formulas, *growth] for alias in names}, key=lambda x: (-len(x[0]), x[1]))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " ")), F.lit(" "))
    hits = [F.when(F.contains(plain, F.lit(f" {' '.join(alias.replace('-', ' ').split())} ")), name) for alias, name in aliases]
    return questions.withColumn("formula", F.coalesce(*hits))


# -- calculate -------------------------------------------------------------------------------------


def series(metric: Column) -> Column:
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(metric), "_", " "), r"\s+", " "))
    return F.when(name.rlike("^(total )?revenues?$"), "revenue").when(name.isin("operating income", "income from operations"), "operating income").otherwise(name)


def calculate(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """request_id, operation, result, result_unit, scale, reason (null: computed).

    requests: request_id, operation, inputs (array of fact ids in order), periods. facts: fact_id, ticker,
    metric, base_value (decimal), value_type, currency, scale, basis. One job: inputs meet facts by id,
    and one aggregation a request gives all that the guards and the operations need. A request has a
    handful of inputs.
    """
    multiplier = F.element_at(F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, float(v))]), F.coalesce("scale", F.lit("ones")))
    known = facts.select("fact_id", "ticker", series(F.col("metric")).alias("series"), "base_value", "value_type", "currency", F.coalesce("scale", F.lit("ones")).alias("scale"), F.lower("basis").alias("basis"), multiplier.alias("m"))
    known = known.withColumn("kind", F.concat_ws(":", "value_type", F.when(F.col("value_type").isin("currency", "per_share"), F.col("currency"))))
    given = requests.select("request_id", "operation", "periods", F.size("inputs").alias("n"), (F.size(F.array_distinct("inputs")) < F.size("inputs")).alias("repeated"), F.posexplode_outer("inputs").alias("pos", "fact_id"))
    met = given.join(known.hint("merge"), "fact_id", "left")
    at = lambda i, c: F.max(F.when(F.col("pos") == i, F.col(c)))
    dimensional = F.col("value_type").isin("currency", "count", "per_share", "basis_points")
    one = met.groupBy("request_id", "operation", "periods", "n", "repeated").agg(
        F.count("series").alias("found"), F.sum("base_value").alias("total"), F.countDistinct("kind").alias("kinds"), F.countDistinct("basis").alias("bases"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("series").alias("metrics"),
        F.count(F.when(F.col("value_type") == "percent", 1)).alias("percents"), F.count(F.when(dimensional, 1)).alias("dims"), F.max(F.when(dimensional, F.col("m"))).alias("dim_m"), F.max(F.when(dimensional, F.col("value_type"))).alias("dim_type"), F.max(F.when(dimensional, F.col("scale"))).alias("dim_scale"),
        *[at(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("base_value", "value_type", "m", "scale")],
    )
    op = F.col("operation")
    same = (F.col("kinds") <= 1) & (F.col("bases") <= 1)
    a, b = F.col("base_value0"), F.col("base_value1")
    x, y = a.cast("double"), b.cast("double")
    per_share = (F.col("value_type0") == "currency") & (F.col("value_type1") == "count")
    needs_same = op.isin("sum", "absolute_change", "difference", "percentage_change", "percentage_point_change", "basis_point_change", "cagr")
    reason = (
        F.when(F.col("repeated"), "inputs must be unique")
        .when(op.isin(*BINARY) & (F.col("n") != 2), "two facts are needed")
        .when(op.isin(*UNARY) & (F.col("n") != 1), "one fact is needed")
        .when(F.col("n") < 1, "a fact is needed")
        .when((op == "cagr") & F.coalesce(F.col("periods") <= 0, F.lit(True)), "cagr needs periods")
        .when((op != "cagr") & F.col("periods").isNotNull(), "periods are for cagr alone")
        .when(F.col("found") < F.col("n"), "unknown facts")
        .when(needs_same & ~same, "incompatible units")
        .when(op.isin(*TEMPORAL) & (F.col("tickers") > 1), "different companies")
        .when(op.isin(*TEMPORAL) & (F.col("metrics") > 1), "different metrics")
        .when((op == "absolute_change") & (F.col("percents") > 0), "use percentage_point_change")
        .when(op.isin("percentage_point_change", "basis_point_change") & (F.col("percents") < 2), "percent facts are needed")
        .when((op == "percentage_change") & (a == 0), "old value is zero")
        .when((op == "ratio") & (b == 0), "denominator is zero")
        .when((op == "ratio") & ~same & ~per_share, "incompatible units")
        .when((op == "product") & (F.col("dims") > 1), "more than one dimensional input")
        .when((op == "percent_complement") & (F.col("percents") < 1), "a percent fact is needed")
        .when((op == "cagr") & ((a <= 0) | (b < 0)), "cagr needs a positive start")
    )
    factor = lambda v, t: F.when(F.col(t) == "percent", v / 100).otherwise(v)
    # decimals are rounded (half up) as decimals, before they are divided by a power of ten
    scaled = lambda v, i: (F.when(F.col(f"scale{i}") == "thousands", F.round(v, 1)).when(F.col(f"scale{i}") == "millions", F.round(v, -2)).when(F.col(f"scale{i}") == "billions", F.round(v, -5)).otherwise(F.round(v, 4))).cast("double") / F.col(f"m{i}")
    value = (
        F.when(op == "sum", scaled(F.col("total"), 0))
        .when(op == "absolute_change", scaled(b - a, 1))
        .when(op == "difference", scaled(a - b, 0))
        .when(op == "percentage_change", (y - x) / F.nullif(F.abs(x), F.lit(0.0)) * 100)
        .when(op == "percentage_point_change", F.round(b - a, 4).cast("double"))
        .when(op == "basis_point_change", F.round(b - a, 6).cast("double") * 100)
        .when(op == "ratio", x / F.nullif(y, F.lit(0.0)))
        .when(op == "product", factor(x, "value_type0") * factor(y, "value_type1") / F.coalesce("dim_m", F.lit(1.0)))
        .when(op == "absolute_value", scaled(F.abs(a), 0))
        .when(op == "percent_complement", F.round(100 - a, 4).cast("double"))
        .when(op == "cagr", F.when((x > 0) & (y >= 0) & (F.col("periods") > 0), (F.pow(y / F.nullif(x, F.lit(0.0)), 1 / F.nullif(F.col("periods").cast("double"), F.lit(0.0))) - 1) * 100))
    )
    unit = (
        F.when(op.isin("percentage_change", "percent_complement", "cagr"), "percent").when(op == "percentage_point_change", "percentage_points").when(op == "basis_point_change", "basis_points")
        .when(op == "ratio", F.when(per_share, "per_share").otherwise("ratio")).when(op == "product", F.coalesce("dim_type", F.lit("ratio"))).when(op == "absolute_change", F.col("value_type1")).otherwise(F.col("value_type0"))
    )
    scale = F.when(op == "absolute_change", F.col("scale1")).when(op.isin("sum", "difference", "absolute_value"), F.col("scale0")).when(op == "product", F.col("dim_scale"))
    fine = reason.isNull()
    return one.select("request_id", "operation", F.when(fine, F.round(value, 4)).alias("result"), F.when(fine, unit).alias("result_unit"), F.when(fine, scale).alias("scale"), reason.alias("reason"))


# -- inputs derived from the fact table ------------------------------------------------------------

_SCALE_OF = {"total_revenue": "thousands", "cost_of_revenue": "thousands", "total_assets": "millions", "current_assets": "thousands"}


def catalogued_facts(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """The fact table (facts, if it is there already) with ids, types, currencies and scales."""
    scale = F.when(F.col("metric").isin("total_revenue", "cost_of_revenue", "current_assets"), "thousands").when(F.col("metric") == "total_assets", "millions").otherwise("ones")
    f = V.facts(spark, sf_dir) if facts is None else facts
    return f.select(
        F.concat_ws(":", "ticker", "metric", F.col("fiscal_year").cast("string")).alias("fact_id"), "ticker", "metric", "fiscal_year", "base_value", F.col("unit").alias("value_type"),
        F.when(F.col("unit").isin("currency", "per_share"), "USD").alias("currency"), scale.alias("scale"), F.when(F.col("fiscal_year") == 2001, "GAAP").when(F.col("fiscal_year") == 2000, "non-GAAP").alias("basis"),
    )


def calc_requests(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Requests over the fact table: each operation over consecutive years or over metrics of a year, good and bad."""
    f = (V.facts(spark, sf_dir) if facts is None else facts).select("ticker", "metric", "fiscal_year")
    key = lambda t, m, y: F.concat_ws(":", t, m, y.cast("string"))
    t, m, y = F.col("ticker"), F.col("metric"), F.col("fiscal_year")
    temporal = f.filter("fiscal_year < 2001").select(
        t, F.explode(F.array(*[F.lit(o) for o in TEMPORAL])).alias("operation"), F.array(key(t, m, y), key(t, m, y + 1)).alias("inputs"), F.when(m != "net_income", 1).alias("p"))
    temporal = temporal.select("operation", "inputs", F.when(F.col("operation") == "cagr", F.col("p")).alias("periods"))
    groups = f.select("ticker", "fiscal_year").distinct()
    k = lambda name: key(t, F.lit(name), y)
    rows = [
        ("sum", ("cash_and_cash_equivalents", "short_term_investments", "accounts_receivable")), ("sum", ("total_revenue", "effective_tax_rate")), ("difference", ("total_revenue", "cost_of_revenue")), ("difference", ("total_revenue", "effective_tax_rate")),
        ("ratio", ("operating_income", "total_revenue")), ("ratio", ("total_revenue", "diluted_weighted_average_shares")), ("ratio", ("effective_tax_rate", "total_revenue")), ("ratio", ("total_revenue", "cash_and_cash_equivalents")),
        ("product", ("operating_income", "effective_tax_rate")), ("product", ("operating_income", "total_revenue")), ("absolute_value", ("capital_expenditures",)), ("absolute_value", ("total_revenue", "net_income")),
        ("percent_complement", ("effective_tax_rate",)), ("percent_complement", ("total_revenue",)), ("ratio", ("total_revenue", "total_revenue")), ("sum", ("no_such_metric",)), ("difference", ("total_revenue",)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(op).alias("operation"), F.array(*[k(n) for n in names]).alias("inputs")) for op, names in rows]))
    static = groups.select(each.alias("r")).select("r.operation", "r.inputs", F.lit(None).cast("int").alias("periods"))
    both = temporal.unionByName(static)
    return both.select(F.concat_ws("|", "operation", *[F.get("inputs", F.lit(i)) for i in range(3)]).alias("request_id"), "operation", "inputs", "periods")


_CALC_SQL = (
    V.with_views("facts")
    + """, cf AS (SELECT ticker || ':' || metric || ':' || fiscal_year AS fact_id, ticker, metric, fiscal_year, base_value, unit AS value_type, CASE WHEN unit IN ('currency', 'per_share') THEN 'USD' END AS currency,
 CASE WHEN metric IN ('total_revenue', 'cost_of_revenue', 'current_assets') THEN 'thousands' WHEN metric = 'total_assets' THEN 'millions' ELSE 'ones' END AS scale, CASE fiscal_year WHEN 2001 THEN 'gaap' WHEN 2000 THEN 'non-gaap' END AS basis,
 CASE WHEN metric = 'total_revenue' THEN 'revenue' ELSE replace(metric, '_', ' ') END AS series FROM facts),
cm AS (SELECT *, CASE scale WHEN 'thousands' THEN 1000.0::DOUBLE WHEN 'millions' THEN 1000000.0 ELSE 1.0 END AS m, concat_ws(':', value_type, currency) AS kind FROM cf),
tr AS (SELECT operation, [ticker || ':' || metric || ':' || fiscal_year, ticker || ':' || metric || ':' || (fiscal_year + 1)] AS inputs, CASE WHEN operation = 'cagr' AND metric <> 'net_income' THEN 1 END AS periods FROM facts, (VALUES ('absolute_change'), ('percentage_change'), ('percentage_point_change'), ('basis_point_change'), ('cagr')) o(operation) WHERE fiscal_year < 2001),
sr AS (SELECT operation, list_transform(names, lambda n: ticker || ':' || n || ':' || fiscal_year) AS inputs, NULL::INT AS periods FROM (SELECT DISTINCT ticker, fiscal_year FROM facts), (VALUES
 ('sum', ['cash_and_cash_equivalents', 'short_term_investments', 'accounts_receivable']), ('sum', ['total_revenue', 'effective_tax_rate']), ('difference', ['total_revenue', 'cost_of_revenue']), ('difference', ['total_revenue', 'effective_tax_rate']),
 ('ratio', ['operating_income', 'total_revenue']), ('ratio', ['total_revenue', 'diluted_weighted_average_shares']), ('ratio', ['effective_tax_rate', 'total_revenue']), ('ratio', ['total_revenue', 'cash_and_cash_equivalents']),
 ('product', ['operating_income', 'effective_tax_rate']), ('product', ['operating_income', 'total_revenue']), ('absolute_value', ['capital_expenditures']), ('absolute_value', ['total_revenue', 'net_income']),
 ('percent_complement', ['effective_tax_rate']), ('percent_complement', ['total_revenue']), ('ratio', ['total_revenue', 'total_revenue']), ('sum', ['no_such_metric']), ('difference', ['total_revenue'])) v(operation, names)),
rq AS (SELECT operation || '|' || array_to_string(inputs, '|') AS request_id, operation, inputs, periods FROM (SELECT * FROM tr UNION ALL SELECT * FROM sr)),
ri AS (SELECT request_id, operation, periods, len(inputs) AS n, len(list_distinct(inputs)) < len(inputs) AS repeated, unnest(inputs) AS fact_id, unnest(range(0, len(inputs))) AS pos FROM rq),
one AS (SELECT request_id, operation, periods, n, repeated, count(series) AS found, sum(base_value) AS total, count(DISTINCT kind) <= 1 AND count(DISTINCT basis) <= 1 AS same, count(DISTINCT ticker) AS tickers, count(DISTINCT series) AS metrics,
 count(*) FILTER (WHERE value_type = 'percent') AS percents, count(*) FILTER (WHERE value_type IN ('currency', 'count', 'per_share')) AS dims, max(m) FILTER (WHERE value_type IN ('currency', 'count', 'per_share')) AS dm, max(value_type) FILTER (WHERE value_type IN ('currency', 'count', 'per_share')) AS dt, max(scale) FILTER (WHERE value_type IN ('currency', 'count', 'per_share')) AS ds,
 max(base_value) FILTER (WHERE pos = 0) AS a, max(base_value) FILTER (WHERE pos = 1) AS b, max(value_type) FILTER (WHERE pos = 0) AS ta, max(value_type) FILTER (WHERE pos = 1) AS tb, max(m) FILTER (WHERE pos = 0) AS ma, max(m) FILTER (WHERE pos = 1) AS mb, max(scale) FILTER (WHERE pos = 0) AS sa, max(scale) FILTER (WHERE pos = 1) AS sb
 FROM ri LEFT JOIN cm USING (fact_id) GROUP BY ALL),
rs AS (SELECT *, a::DOUBLE AS x, b::DOUBLE AS y, CASE WHEN repeated THEN 'inputs must be unique' WHEN operation NOT IN ('sum', 'absolute_value', 'percent_complement') AND n <> 2 THEN 'two facts are needed' WHEN operation IN ('absolute_value', 'percent_complement') AND n <> 1 THEN 'one fact is needed'
 WHEN operation = 'cagr' AND periods IS NULL THEN 'cagr needs periods' WHEN found < n THEN 'unknown facts'
 WHEN operation NOT IN ('ratio', 'product', 'absolute_value', 'percent_complement') AND NOT same THEN 'incompatible units'
 WHEN operation = 'absolute_change' AND percents > 0 THEN 'use percentage_point_change' WHEN operation IN ('percentage_point_change', 'basis_point_change') AND percents < 2 THEN 'percent facts are needed'
 WHEN operation = 'percentage_change' AND a = 0 THEN 'old value is zero' WHEN operation = 'ratio' AND b = 0 THEN 'denominator is zero' WHEN operation = 'ratio' AND NOT same AND NOT (ta = 'currency' AND tb = 'count') THEN 'incompatible units'
 WHEN operation = 'product' AND dims > 1 THEN 'more than one dimensional input' WHEN operation = 'percent_complement' AND percents < 1 THEN 'a percent fact is needed' WHEN operation = 'cagr' AND (a <= 0 OR b < 0) THEN 'cagr needs a positive start' END AS reason FROM one),
calc AS (SELECT request_id, operation, round(CASE WHEN reason IS NULL THEN CASE operation WHEN 'sum' THEN (CASE sa WHEN 'thousands' THEN round(total, 1)::DOUBLE WHEN 'millions' THEN round(total, -2)::DOUBLE ELSE round(total, 4)::DOUBLE END / ma) WHEN 'absolute_change' THEN (CASE sb WHEN 'thousands' THEN round((b - a), 1)::DOUBLE WHEN 'millions' THEN round((b - a), -2)::DOUBLE ELSE round((b - a), 4)::DOUBLE END / mb) WHEN 'difference' THEN (CASE sa WHEN 'thousands' THEN round((a - b), 1)::DOUBLE WHEN 'millions' THEN round((a - b), -2)::DOUBLE ELSE round((a - b), 4)::DOUBLE END / ma) WHEN 'percentage_change' THEN (y - x) / abs(x) * 100
 WHEN 'percentage_point_change' THEN round(b - a, 4)::DOUBLE WHEN 'basis_point_change' THEN round(b - a, 6)::DOUBLE * 100 WHEN 'ratio' THEN x / y WHEN 'product' THEN (CASE WHEN ta = 'percent' THEN x / 100 ELSE x END) * (CASE WHEN tb = 'percent' THEN y / 100 ELSE y END) / coalesce(dm, 1.0)
 WHEN 'absolute_value' THEN (CASE sa WHEN 'thousands' THEN round(abs(a), 1)::DOUBLE WHEN 'millions' THEN round(abs(a), -2)::DOUBLE ELSE round(abs(a), 4)::DOUBLE END / ma) WHEN 'percent_complement' THEN round(100 - a, 4)::DOUBLE WHEN 'cagr' THEN (pow(y / x, 1.0::DOUBLE / periods) - 1) * 100 END END, 4) AS result,
 CASE WHEN reason IS NULL THEN CASE WHEN operation IN ('percentage_change', 'percent_complement', 'cagr') THEN 'percent' WHEN operation = 'percentage_point_change' THEN 'percentage_points' WHEN operation = 'basis_point_change' THEN 'basis_points' WHEN operation = 'ratio' THEN CASE WHEN ta = 'currency' AND tb = 'count' THEN 'per_share' ELSE 'ratio' END
 WHEN operation = 'product' THEN coalesce(dt, 'ratio') WHEN operation = 'absolute_change' THEN tb ELSE ta END END AS result_unit,
 CASE WHEN reason IS NULL THEN CASE WHEN operation = 'absolute_change' THEN sb WHEN operation IN ('sum', 'difference', 'absolute_value') THEN sa WHEN operation = 'product' THEN ds END END AS scale, reason FROM rs)
SELECT request_id, operation, result, result_unit, scale, reason FROM calc WHERE """
)


def _calc(where: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = written(V.facts(spark, sf_dir), "facts")  # five tables meet once
        return calculate(calc_requests(spark, sf_dir, facts), catalogued_facts(spark, sf_dir, facts)).filter(where)

    return query


_CALCS = {
    "calc_sum": "operation = 'sum'", "calc_absolute_change": "operation = 'absolute_change'", "calc_difference": "operation = 'difference'", "calc_percentage_change": "operation = 'percentage_change'",
    "calc_pp_change": "operation = 'percentage_point_change'", "calc_bp_change": "operation = 'basis_point_change'", "calc_ratio": "operation = 'ratio'", "calc_product": "operation = 'product'", "calc_abs": "operation = 'absolute_value'",
    "calc_pct_complement": "operation = 'percent_complement'", "calc_cagr": "operation = 'cagr'", "calc_compat_reject": "reason = 'incompatible units'",
    "calc_series_reject": "reason IN ('different companies', 'different metrics', 'use percentage_point_change')", "calc_arity_reject": "reason IN ('inputs must be unique', 'two facts are needed', 'one fact is needed', 'cagr needs periods', 'unknown facts')",
}
_WIDE = "wide_f AS (SELECT ticker, fiscal_year, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN base_value::DOUBLE END) AS {m}" for m in METRICS) + " FROM facts GROUP BY ticker, fiscal_year)"


def q_formula_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula_eval(V.facts(spark, sf_dir))


def q_formula_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula_temporal(V.facts(spark, sf_dir))


def asked_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a formula, made from the items' numbers and words."""
    names = sorted({a for _, names, _ in [*FORMULAS, *GROWTH] for a in names}) + ["the weather", "ebitda margin and ebitda"]
    listed = F.array(*[F.lit(n) for n in names])
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("What was the "), F.get(listed, (F.col("doc_id") % len(names)).cast("int")), F.lit(" of "), "source", F.lit("?")).alias("text"))


def q_formula_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula_match(asked_formulas(spark, sf_dir)).select("question_id", "formula")


def _match_sql() -> str:
    names = sorted({a for _, names, _ in [*FORMULAS, *GROWTH] for a in names}) + ["the weather", "ebitda margin and ebitda"]
    listed = ", ".join(f"'{n}'" for n in names)
    pairs = ", ".join(f"('{' '.join(a.replace('-', ' ').split())}', '{name}', {len(a)})" for name, al, _ in [*FORMULAS, *GROWTH] for a in al)
    return rf"""WITH q AS (SELECT doc_id AS question_id, ' ' || trim(regexp_replace(lower('What was the ' || ([{listed}])[(doc_id % {len(names)})::INT + 1] || ' of ' || source || '?'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), a(alias, name, n) AS (VALUES {pairs}),
h AS (SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, name) AS rn FROM q JOIN a ON contains(t, ' ' || alias || ' ')) SELECT q.question_id, h.name AS formula FROM q LEFT JOIN h ON q.question_id = h.question_id AND rn = 1"""


def calc_chain(facts: DataFrame) -> DataFrame:
    """Steps that use earlier results: profit, then margin, then the change of the margin to the year before.

    Each step is a calculate() over the facts and the results so far, written before the next: as many jobs as the plan is deep.
    """
    base = facts.withColumn("step", F.lit(0))
    key = lambda m, y: F.concat_ws(":", "ticker", F.lit(m), y.cast("string"))
    y = F.col("fiscal_year")

    def step(known: DataFrame, rows: DataFrame, name: str, kind: str, op: str, inputs: Column) -> DataFrame:
        asked = rows.select("ticker", "fiscal_year", key(name, y).alias("request_id"), F.lit(op).alias("operation"), inputs.alias("inputs"), F.lit(None).cast("int").alias("periods"))
        done = calculate(asked, known).join(asked.select("request_id", "ticker", "fiscal_year").hint("merge"), "request_id")
        done = done.select(F.col("request_id").alias("fact_id"), "ticker", F.lit(name).alias("metric"), "fiscal_year", F.col("result").cast("decimal(38,10)").alias("base_value"), F.lit(kind).alias("value_type"), F.when(F.lit(kind) == "currency", "USD").alias("currency"), F.lit("ones").alias("scale"), F.lit(None).cast("string").alias("basis"), F.col("reason"))
        return written(done, name)

    plain = base.drop("step").withColumns({"scale": F.lit("ones"), "basis": F.lit(None).cast("string")})
    plain = written(plain, "facts")
    groups = plain.select("ticker", "fiscal_year").distinct()
    profit = step(plain, groups, "gross_profit", "currency", "difference", F.array(key("total_revenue", y), key("cost_of_revenue", y)))
    known = plain.unionByName(profit.filter("reason is null").drop("reason"))
    margin = step(known, groups, "gross_margin", "ratio", "ratio", F.array(key("gross_profit", y), key("total_revenue", y)))
    known = known.unionByName(margin.filter("reason is null").drop("reason"))
    change = step(known, groups, "margin_change", "ratio", "absolute_change", F.array(key("gross_margin", y - 1), key("gross_margin", y)))
    out = profit.withColumn("step", F.lit(1)).unionByName(margin.withColumn("step", F.lit(2))).unionByName(change.withColumn("step", F.lit(3)))
    return out.select("step", "ticker", "fiscal_year", "metric", F.round(F.col("base_value").cast("double"), 4).alias("result"), "reason")


def q_calc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calc_chain(catalogued_facts(spark, sf_dir))


def q_staged_sum_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cash + short-term investments + receivables) / current liabilities of each group, by one conditional aggregation."""
    f = V.facts(spark, sf_dir)
    top = F.sum(F.when(F.col("metric").isin("cash_and_cash_equivalents", "short_term_investments", "accounts_receivable"), F.col("base_value"))).cast("double")
    low = F.sum(F.when(F.col("metric") == "current_liabilities", F.col("base_value"))).cast("double")
    return f.groupBy("ticker", "fiscal_year").agg(F.round(top / F.nullif(low, F.lit(0.0)), 6).alias("ratio"))


def q_comparison_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each year and formula, the company with the largest value, where two or more have one; ties by name."""
    v = q_formula_eval(spark, sf_dir).filter("value is not null")
    best = v.groupBy("fiscal_year", "formula").agg(F.max("value").alias("value"), F.min(F.struct((-F.col("value")).alias("low"), "ticker")).alias("m"), F.count("*").alias("companies"))
    return best.filter("companies >= 2").select("fiscal_year", "formula", "companies", "value", F.col("m.ticker").alias("winner"))


def record_recalc(records: DataFrame) -> DataFrame:
    """records (record_id, operation, a, b, places, stated) with result (rounded half up) and wrong, or reason."""
    a, b, op = F.col("a").cast("double"), F.col("b").cast("double"), F.col("operation")
    zero = op.isin("percentage_change", "percentage_of", "ratio") & (b == 0)
    safe = F.nullif(b, F.lit(0.0))
    value = F.when(op == "difference", a - b).when(op == "percentage_change", (a - b) / F.abs(safe) * 100).when(op == "percentage_of", a / safe * 100).when(op == "ratio", a / safe).when(op == "sum", a + b)
    shift = F.pow(F.lit(10.0), F.col("places"))
    rounded = F.signum(value) * F.floor(F.abs(value) * shift + 0.5) / shift
    return records.select("record_id", "operation", F.when(~zero, rounded).alias("result"), F.when(~zero, rounded != F.col("stated")).alias("wrong"), F.when(zero, "denominator is zero").alias("reason"))


def q_record_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over order totals and line numbers; every fifth states a wrong result."""
    ops = F.array(*[F.lit(o) for o in ("difference", "percentage_change", "percentage_of", "ratio", "sum")])
    o = V.table(spark, sf_dir, "orders")
    a, b = F.floor("o_totalprice"), F.col("o_custkey") % 40
    r = o.select(F.col("o_orderkey").alias("record_id"), F.get(ops, (F.col("o_orderkey") % 5).cast("int")).alias("operation"), a.alias("a"), b.alias("b"), (F.col("o_orderkey") % 3).cast("int").alias("places"), F.when(F.col("o_orderkey") % 5 == 0, (a - b).cast("double")).otherwise(1.0).alias("stated"))
    return record_recalc(r)


QUERIES = {name: _calc(where) for name, where in _CALCS.items()} | {
    "formula_eval": q_formula_eval, "formula_temporal": q_formula_temporal, "formula_match": q_formula_match, "calc_chain": q_calc_chain, "staged_sum_ratio": q_staged_sum_ratio, "comparison_winner": q_comparison_winner, "record_recalc": q_record_recalc,
}
_EVAL = V.with_views("facts") + ", " + _WIDE + ", ev AS (" + " UNION ALL ".join(f"SELECT ticker, fiscal_year, '{name}' AS formula, round({_sql(tree)}, 4) AS value FROM wide_f" for name, _, tree in FORMULAS) + ")"
ORACLES = {name: _CALC_SQL + where for name, where in _CALCS.items()} | {
    "formula_eval": _EVAL + " SELECT * FROM ev",
    "formula_temporal": V.with_views("facts") + ", e AS (SELECT ticker, metric, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, arg_min(base_value::DOUBLE, fiscal_year) AS o, arg_max(base_value::DOUBLE, fiscal_year) AS n FROM facts WHERE metric IN ('total_revenue', 'diluted_eps', 'operating_cash_flow') GROUP BY ticker, metric), r AS (SELECT *, CASE WHEN first_year = last_year THEN 'needs two years' WHEN o = 0 THEN 'old value is zero' END AS reason FROM e) SELECT ticker, CASE metric WHEN 'total_revenue' THEN 'revenue_growth' WHEN 'diluted_eps' THEN 'eps_growth' ELSE 'operating_cash_flow_growth' END AS formula, first_year, last_year, CASE WHEN reason IS NULL THEN round((n - o) / abs(o) * 100, 4) END AS growth, reason FROM r",
    "formula_match": _match_sql(),
    "calc_chain": V.with_views("facts") + ", " + _WIDE + """, p AS (SELECT ticker, fiscal_year, round((total_revenue - cost_of_revenue), 4) AS profit, total_revenue AS rev FROM wide_f), g AS (SELECT *, round(profit / rev, 4) AS margin FROM p)
SELECT 1 AS step, ticker, fiscal_year, 'gross_profit' AS metric, profit AS result, NULL::VARCHAR AS reason FROM g UNION ALL SELECT 2, ticker, fiscal_year, 'gross_margin', margin, NULL FROM g
UNION ALL SELECT 3, a.ticker, a.fiscal_year, 'margin_change', round(a.margin - b.margin, 4), CASE WHEN b.margin IS NULL THEN 'unknown facts' END FROM g a LEFT JOIN g b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1""",
    "staged_sum_ratio": V.with_views("facts") + " SELECT ticker, fiscal_year, round(sum(CASE WHEN metric IN ('cash_and_cash_equivalents', 'short_term_investments', 'accounts_receivable') THEN base_value END)::DOUBLE / nullif(sum(CASE WHEN metric = 'current_liabilities' THEN base_value END)::DOUBLE, 0), 6) AS ratio FROM facts GROUP BY ticker, fiscal_year",
    "comparison_winner": _EVAL + " SELECT fiscal_year, formula, count(*) AS companies, max(value) AS value, (list(ticker ORDER BY value DESC, ticker))[1] AS winner FROM ev WHERE value IS NOT NULL GROUP BY fiscal_year, formula HAVING count(*) >= 2",
    "record_recalc": """WITH r AS (SELECT o_orderkey AS record_id, (['difference', 'percentage_change', 'percentage_of', 'ratio', 'sum'])[(o_orderkey % 5)::INT + 1] AS operation, floor(o_totalprice)::DOUBLE AS a, (o_custkey % 40)::DOUBLE AS b, pow(10.0, o_orderkey % 3) AS k, CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice) - o_custkey % 40 ELSE 1.0 END AS stated FROM orders),
v AS (SELECT *, CASE operation WHEN 'difference' THEN a - b WHEN 'percentage_change' THEN (a - b) / abs(nullif(b, 0)) * 100 WHEN 'percentage_of' THEN a / nullif(b, 0) * 100 WHEN 'ratio' THEN a / nullif(b, 0) ELSE a + b END AS val FROM r), w AS (SELECT *, sign(val) * floor(abs(val) * k + 0.5) / k AS res FROM v)
SELECT record_id, operation, res AS result, res <> stated AS wrong, CASE WHEN res IS NULL THEN 'denominator is zero' END AS reason FROM w""",
}
