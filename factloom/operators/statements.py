"""Rows of financial statements: headings and scales of tables, values by row label and year, rows that a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import tables
from factloom.operators.evidence import STATEMENT, SUPPLEMENT, fact_recovery_tiers
from factloom.operators.grids import grid
from factloom.sources import views as V
from factloom.sources.shared import written

#: Words that name no metric, words of period rows, scales, unit lines, statements of money, values.
STOP = (
    "a an and all as at by complete data document exact filing financial for from full give in inside into of on presented provide report requested show table the "
    "this to whole with year exactly please me related was follows following could would can you it also"
).split()
PERIODS = "ended ending fiscal quarter quarters month months day days january february march april may june july august september october november december".split()
SCALE, UNIT = r"(?i)\b(millions?|billions?|thousands?)\b", r"(?i)^\(?in\s+(?:millions?|thousands?|billions?)\b"
MONETARY = r"(?i)(?:income statements?|statements? of (?:operations|cash flows?|comprehensive income)|cash flows? statements?|balance sheets?)"
VALUE = r"^\$?\s*\(?-?\d[\d,]*(?:\.\d+)?\)?$"
#: How far a heading may end before its table, and one whose text counts as a statement's; metrics that only a primary statement has, and other labels of metrics.
FAR, NEAR = 500, 350
PRIMARY = ("revenue", "operating income", "research and development")
ALIASES = {"revenue": ("total revenue",), "operating income": ("operating income", "income from operation")}

PART = r"(?ims)<table\b.*?</table>|^[ \t]*#{1,5}[ \t]+[^\n]+$"


def terms(text: Column) -> Column:
    """The terms of a label or question in order: words of three letters or more without stop words, singular, operating as operation."""
    n = F.length
    cut = lambda w, k: F.substring(w, F.lit(1), n(w) - k)
    singular = lambda w: (
        F.when((n(w) > 5) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))).when((n(w) > 4) & w.rlike("(?:sses|xes|ches|shes|zes)$"), cut(w, 2)).when((n(w) > 4) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w)
    )
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), 1), lambda w: ~w.isin(*STOP))
    return F.transform(F.transform(words, singular), lambda w: F.when(w == "operating", "operation").otherwise(w))


def term_set(text: Column) -> Column:
    """Without the loss of an income from operations and the operations of a statement of operations."""
    has = lambda t, w: F.array_contains(t, w)

    def of(t: Column) -> Column:
        loss = F.when(has(t, "income") & has(t, "operation"), F.array_remove(t, "loss")).otherwise(t)
        return F.when(has(t, "statement") & has(t, "operation"), F.array_remove(loss, "operation")).otherwise(loss)

    return T.let(F.array_distinct(terms(text)), of)


def row_label(text: Column) -> Column:
    """A label without brackets, its words singular by one rule."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\s*\([^)]*\)\s*", " ")), F.lit("([a-z0-9]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def titled_tables(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, part, html, title, gap, scale of the tables that stand near a heading and have a scale.

    A heading that only names a unit is none. gap: the characters between the heading and the table; scale: the first
    word for one between the two or in the table.
    """
    cut = texts.select(*keys, F.regexp_extract_all(F.col(text_col), F.lit(PART), 0).alias("_p"), F.split(F.col(text_col), PART, -1).alias("_g"))
    parts = cut.select(*keys, F.posexplode(F.arrays_zip("_p", "_g")).alias("part", "_x")).filter("_x._p is not null").select(*keys, "part", F.col("_x._p").alias("_t"), F.col("_x._g").alias("_g"))
    is_table, title = F.lower(F.substring("_t", 1, 6)) == "<table", F.trim(F.regexp_replace("_t", r"^\s*#{1,5}\s+", ""))
    is_head = ~is_table & ~title.rlike(UNIT)
    line = W.partitionBy(*keys).orderBy("part")
    parts = parts.withColumn("_end", F.sum(F.length("_g") + F.length("_t")).over(line)).withColumn("_h", F.last(F.when(is_head, F.struct("part", title.alias("title"), F.col("_end").alias("end"))), True).over(line))
    word = F.nullif(F.lower(F.regexp_extract(F.concat("_g", F.lit(" "), F.regexp_replace("_t", r"<[^>]+>", " ")), SCALE, 1)), F.lit(""))
    since = W.partitionBy(*keys, "_h.part").orderBy("part")
    parts = parts.withColumn("scale", F.first(F.when(~is_head, word), True).over(since)).withColumn("gap", F.col("_end") - F.length("_t") - F.col("_h.end"))
    return parts.filter(is_table & (F.col("gap") <= FAR) & F.col("scale").isNotNull()).select(*keys, "part", F.col("_t").alias("html"), "_h.title", "gap", "scale")


def statement_values(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, row, label, heading, year, value, title, gap, scale, dollar: the numbers of table rows under the one column of a year.

    A year's column is the one in whose header cells it stands; years of several columns have none. A row with its label
    alone is the heading of those below it. Rows of header cells alone are structure.
    """
    table = [*keys, "part"]
    cells = written(grid(tables, table), "grid")
    years = cells.filter("value rlike '(19|20)[0-9]{2}'").join(cells.filter("head and own").select(*table, "row").distinct().hint("merge"), [*table, "row"])
    years = years.select(*table, "col", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))).alias("year"))
    columns = years.groupBy(*table, "year").agg(F.min("col").alias("col"), F.max("col").alias("_c")).filter("col = _c").drop("_c")
    own = F.col("own") & F.col("first")
    lines = cells.groupBy(*table, "row").agg(
        F.max(F.when(own & (F.col("cell") == 0), F.struct("value", "wide"))).alias("_l"), F.count(F.when(own & (F.col("value") != ""), 1)).alias("_some"), F.max(F.col("own") & ~F.col("head")).alias("_body")
    )
    alone = (F.col("_l.value") != "") & (F.col("_some") == 1)
    named = lines.filter("_body").withColumn("heading", F.last(F.when(alone, F.col("_l.value")), True).over(W.partitionBy(*table).orderBy("row"))).filter(~alone).select(*table, "row", F.col("_l.value").alias("label"), "heading")
    about = tables.select(*table, "title", "gap", "scale", F.contains("html", F.lit("$")).alias("dollar"))
    found = cells.filter(F.col("value").rlike(VALUE)).join(columns.hint("merge"), [*table, "col"]).join(named.hint("merge"), [*table, "row"]).join(about.hint("merge"), table)
    return found.select(*table, "row", "label", "heading", "year", "value", "title", "gap", "scale", "dollar")


def statement_rows(values: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id, label, year, value, scale of the rows that questions name.

    values: ticker, doc_year, item, doc_id, part, row, label, heading, year, value, scale; asked: ask_id, ticker, doc_year,
    question, years (array; empty: doc_year). A row counts if all its terms, with those of its heading that the question has,
    are asked for; rows of costs only where costs are. Rows of equal terms and year with different values are ambiguous and
    count for nothing. A general row goes where a more specific one counts, unless the question names it apart.
    """
    q = asked.select("ask_id", "ticker", "doc_year", "question", F.when(F.size("years") > 0, F.col("years")).otherwise(F.array("doc_year")).alias("_years"), terms(F.col("question")).alias("_said"), F.array_except(term_set(F.col("question")), term_set(F.col("ticker"))).alias("_asked"))
    v = values.filter(F.lower("item").isin("item 7", "item 8")).withColumns({"_t": F.array_remove(term_set(F.col("label")), "total"), "_g": term_set(F.coalesce("heading", F.lit("")))})
    # rows and questions meet at a term of the label, or of the heading where the label has none of its own
    own = F.array_except("_t", F.array(*map(F.lit, PERIODS)))
    met_at = F.when(F.size(own) > 0, F.array(F.array_min(own))).otherwise(F.array_except("_g", F.array(*map(F.lit, PERIODS))))
    met = q.withColumn("_at", F.explode("_asked")).join(v.withColumn("_at", F.explode(met_at)).hint("merge"), ["ticker", "doc_year", "_at"]).filter(F.array_contains("_years", F.col("year")))
    context = F.array_intersect("_g", "_asked")
    met = met.withColumn("_c", context).withColumn("_key", F.array_sort(F.array_except(F.array_union("_t", "_c"), F.array(*map(F.lit, PERIODS)))))
    costs = (F.size("_c") > 0) & F.array_contains("_g", "cost") & ~F.array_contains("_asked", "cost")
    fits = met.filter((F.size("_key") > 0) & (F.size(F.array_except("_key", "_asked")) == 0) & ~costs)
    shown = F.when((F.size(F.array_except("_c", "_t")) > 0) & F.col("heading").isNotNull(), F.concat("heading", F.lit(" "), "label")).otherwise(F.col("label"))
    plain = F.replace("value", F.lit("$"), F.lit(""))
    first = F.min(F.struct("doc_id", "part", "row", shown.alias("label"), "value", "scale")).alias("_first")
    one = fits.groupBy("ask_id", "year", "_key").agg(first, F.min(plain).alias("_lo"), F.max(plain).alias("_hi"), F.first("_said").alias("_said"), F.first("question").alias("question")).filter("_lo = _hi")
    one = written(one, "eligible")
    others = one.groupBy("ask_id", "year").agg(F.collect_list("_key").alias("_keys"))  # the rows of one question and year
    summed = F.col("question").rlike(r"(?i)\b(?:combined|sum|total)\s+(?:amount\s+)?of\b")

    def apart(key: Column, said: Column, other: Column) -> Column:
        """The key's terms stand together in the question, without those that only the other has."""
        width, more = F.size(key) + 2, F.array_except(other, key)
        window = lambda end: F.slice(said, F.greatest(F.lit(1), end - width + 1), F.least(end, width))
        stands = lambda end: F.array_contains(key, F.get(said, end - 1)) & (F.size(F.array_except(key, window(end))) == 0) & ~F.arrays_overlap(more, window(end))
        return F.when(F.size(said) > 0, F.exists(F.sequence(F.lit(1), F.size(said)), stands)).otherwise(False)

    key = F.col("_key")
    less = F.exists("_keys", lambda o: (F.size(o) > F.size(key)) & (F.size(F.array_except(key, o)) == 0) & (summed | ~apart(key, F.col("_said"), o)))
    return one.join(others.hint("merge"), ["ask_id", "year"]).filter(~less).select("ask_id", "_first.label", "year", "_first.value", "_first.scale")


def exact_rows(values: DataFrame, asked: DataFrame) -> DataFrame:
    """ask_id, label, year, value, scale: rows whose label, in normal form, is a metric's or one of its other labels.

    values: as for statement_rows, with section, title, gap and dollar; asked: ask_id, ticker, metric, year. Only tables of the
    financial statements with a sign of money count, and only primary statements for the metrics that these alone report.
    """
    form = row_label(F.regexp_replace("metric", r"(?i)\s+expenses?$", ""))
    labels = F.array(form)
    for metric, others in ALIASES.items():
        labels = F.when(form == metric, F.array(*map(F.lit, others))).otherwise(labels)
    q = asked.select("ask_id", "ticker", "year", form.isin(*PRIMARY).alias("_primary"), F.explode(labels).alias("_form"))
    near = F.col("gap") < NEAR
    v = values.filter(F.contains(F.lower("section"), F.lit(SUPPLEMENT)) & (F.col("dollar") | (near & F.col("title").rlike(MONETARY)))).withColumns({"_form": row_label(F.col("label")), "_is": near & F.col("title").rlike(STATEMENT)})
    return q.join(v.hint("merge"), ["ticker", "year", "_form"]).filter(~F.col("_primary") | F.col("_is")).select("ask_id", "label", "year", "value", "scale").distinct()


def recovered(found: DataFrame, exact: DataFrame, tier: int = 5) -> DataFrame:
    """Facts of the tiers with exact rows as the last: need_id, metric, tier, fact_id. found: the same; exact: need_id, metric, fact_id."""
    return fact_recovery_tiers(found.unionByName(exact.select("need_id", "metric", F.lit(tier).cast("long").alias("tier"), "fact_id")))


# -- queries ----------------------------------------------------------------------------------------

#: What the derived statements report under which label.
REPORTED = ("total_revenue", "cost_of_revenue", "operating_income", "net_income", "total_assets", "total_debt")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.facts(spark, sf_dir).filter(F.col("metric").isin(*REPORTED))
    return written(f.select("ticker", F.col("fiscal_year").cast("string").alias("year"), "metric", F.col("base_value").cast("decimal(24,2)").cast("string").alias("v")), "reported")


def statement_texts(reported: DataFrame) -> DataFrame:
    """A filing a company, for its last year, with an income statement, segments, a balance sheet and a far table; headers span rows."""
    years = reported.groupBy("ticker").agg(F.array_sort(F.collect_set("year")).alias("ys"))
    row = reported.groupBy("ticker", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "v"))), lambda x: x["v"]).alias("vs"))
    wide = row.groupBy("ticker").agg(*[F.max(F.when(F.col("metric") == m, F.col("vs"))).alias(m) for m in REPORTED]).join(years.hint("merge"), "ticker")
    tr = lambda label, vs: F.concat(F.lit(f"<tr><td>{label}</td><td>"), F.array_join(vs, "</td><td>"), F.lit("</td></tr>"))
    n = F.size("ys").cast("string")
    date = F.when(F.length("ticker") % 2 == 0, F.lit("December 31, ")).otherwise("")
    head = F.concat(F.lit('<table><tr><th rowspan="2">(Except per share)</th><th colspan="'), n, F.lit('">Periods</th></tr><tr><th>'), F.array_join(F.transform("ys", lambda y: F.concat(date, y)), "</th><th>"), F.lit("</th></tr>"))
    group = lambda label: F.concat(F.lit('<tr><td colspan="'), (F.size("ys") + 1).cast("string"), F.lit(f'">{label}</td></tr>'))
    income = F.concat(head, tr("Year Ended June 30,", F.col("ys")), tr("Total revenues", F.col("total_revenue")), tr("Total automotive revenues", F.col("cost_of_revenue")), F.lit("</table>"))
    segments = F.concat(head, group("Intelligent Cloud"), tr("Operating income", F.col("operating_income")), group("Total"), tr("Operating income", F.col("net_income")), F.lit("</table>"))
    sheet = F.concat(head, tr("Total assets", F.col("total_assets")), tr("Deferred amount", F.col("total_assets")), tr("Deferred amounts", F.col("total_debt")), F.lit("</table>"))
    text = F.concat(
        F.lit("Intro\n## Consolidated Statements of Operations\n(in thousands)\n"), income, F.lit("\ntext\n# Segment Results of Operations\n(in millions)\n"), segments, F.lit("\n## Balance Sheets\n## In thousands\n"), sheet,
        F.lit("\n## Notes\n" + "far away " * 60 + "in millions\n"), head, tr("Goodwill", F.col("total_debt")), F.lit("</table>\n"),
    )
    return wide.select("ticker", F.element_at("ys", -1).alias("doc_year"), F.lit("Item 8").alias("item"), F.lit("Item 8. FINANCIAL STATEMENTS AND SUPPLEMENTARY DATA").alias("section"), F.col("ticker").alias("doc_id"), text.alias("text"))


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reported = _reported(spark, sf_dir)
    keys = ["ticker", "doc_year", "item", "section", "doc_id"]
    return reported, written(statement_values(written(titled_tables(statement_texts(reported), keys), "tables"), keys), "values")


def q_table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the plain texts, and the income statements with headers over two rows."""
    keys = ["doc_id", "table_no"]
    spanned = tables.extract_tables(statement_texts(_reported(spark, sf_dir))).filter("table_no = 0").withColumn("doc_id", F.concat("doc_id", F.lit("/income")))
    cells = tables.table_cells(tables.extract_tables(tables.table_texts(spark, sf_dir)).unionByName(spanned), keys)
    return cells.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("table_no", "row", "col")], "value")


QUESTIONS = (
    "Report both total automotive revenues and total company revenues for {y}.", "What were total automotive revenues for the year ended December 31, {y}?", "What was Intelligent Cloud operating income in {y}?", "What were total assets and the deferred amount in {y}?", "What was goodwill in {y}?",
)


def q_statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five questions for each company and year."""
    reported, values = _values(spark, sf_dir)
    last = reported.groupBy("ticker").agg(F.max("year").alias("doc_year"))
    asks = reported.select("ticker", "year").distinct().join(last.hint("merge"), "ticker")
    asks = asks.select("ticker", "doc_year", "year", F.posexplode(F.array(*[F.replace(F.lit(q), F.lit("{y}"), F.col("year")) for q in QUESTIONS])).alias("k", "question"))
    asks = asks.select(F.concat_ws("/", "ticker", "year", "k").alias("ask_id"), "ticker", "doc_year", "question", F.array("year").alias("years"))
    return statement_rows(values, written(asks, "asks"))


METRICS = ("Revenue", "operating income", "Total Assets expenses", "cost of revenue", "deferred amount")


def q_recover_exact_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five metrics for each company and year; facts of earlier tiers are there for every third year."""
    reported, values = _values(spark, sf_dir)
    asks = reported.select("ticker", "year").distinct().select("ticker", "year", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    asks = written(asks.select(F.concat_ws("/", "ticker", "year").alias("need_id"), "ticker", "year", "metric"), "asks")
    exact = exact_rows(values, asks.withColumn("ask_id", F.concat_ws("/", "need_id", "metric")))
    exact = exact.select(F.substring_index("ask_id", "/", 2).alias("need_id"), F.substring_index("ask_id", "/", -1).alias("metric"), F.concat_ws(" ", "label", "value", "scale").alias("fact_id"))
    found = asks.filter(F.col("year").cast("int") % 3 == 0).select("need_id", "metric", F.lit(2).cast("long").alias("tier"), F.lit("extracted").alias("fact_id"))
    return recovered(found, exact)


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}

_R = V.with_views("facts") + f", r AS (SELECT ticker, fiscal_year::VARCHAR AS year, metric, base_value::DECIMAL(24,2)::VARCHAR AS v FROM facts WHERE metric IN {REPORTED})"
ORACLES = {
    "table_grid": tables._TT + f""", r AS (SELECT ticker, fiscal_year::VARCHAR AS year, metric, base_value::DECIMAL(24,2)::VARCHAR AS v, row_number() OVER (PARTITION BY ticker, metric ORDER BY fiscal_year) AS col FROM facts WHERE metric IN {REPORTED}),
y AS (SELECT DISTINCT ticker, year, col FROM r), g AS (SELECT ticker, 0 AS row, col, 'Periods' AS value FROM y UNION ALL SELECT ticker, 1, col, CASE WHEN length(ticker) % 2 = 0 THEN 'December 31, ' ELSE '' END || year FROM y UNION ALL SELECT ticker, 2, col, year FROM y
 UNION ALL SELECT ticker, CASE metric WHEN 'total_revenue' THEN 3 ELSE 4 END, col, v FROM r WHERE metric IN ('total_revenue', 'cost_of_revenue')
 UNION ALL SELECT DISTINCT ticker, row, 0, label FROM y, (VALUES (0, '(Except per share)'), (1, '(Except per share)'), (2, 'Year Ended June 30,'), (3, 'Total revenues'), (4, 'Total automotive revenues')) l(row, label))
SELECT doc_id, table_no, row, col, value FROM tgrid UNION ALL SELECT ticker || '/income', 0, row, col, value FROM g""",
    "statement_rows": _R + """, a(m, k, label, scale) AS (VALUES ('total_revenue', 0, 'Total revenues', 'thousands'), ('cost_of_revenue', 0, 'Total automotive revenues', 'thousands'), ('cost_of_revenue', 1, 'Total automotive revenues', 'thousands'),
 ('operating_income', 2, 'Intelligent Cloud Operating income', 'millions'), ('total_assets', 3, 'Total assets', 'thousands')) SELECT ticker || '/' || year || '/' || k AS ask_id, label, year, v AS value, scale FROM r JOIN a ON metric = m""",
    "recover_exact_row": _R + """, a(m, hint, label, scale) AS (VALUES ('total_revenue', 'Revenue', 'Total revenues', 'thousands'), ('total_assets', 'deferred amount', 'Deferred amount', 'thousands'), ('total_debt', 'deferred amount', 'Deferred amounts', 'thousands'), ('total_assets', 'Total Assets expenses', 'Total assets', 'thousands')),
e AS (SELECT ticker || '/' || year AS need_id, hint AS metric, 5 AS tier, label || ' ' || v || ' ' || scale AS fact_id FROM r JOIN a ON metric = m), h(metric) AS (VALUES ('Revenue'), ('operating income'), ('Total Assets expenses'), ('cost of revenue'), ('deferred amount')),
f AS (SELECT DISTINCT ticker || '/' || year AS need_id, h.metric, 2 AS tier, 'extracted' AS fact_id FROM r, h WHERE year::INT % 3 = 0)
SELECT * FROM e UNION ALL SELECT * FROM f ANTI JOIN e USING (need_id, metric)""",
}
