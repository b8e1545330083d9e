"""Tables inside texts: found, laid out as grids, read as facts, written as Markdown; and examples made from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.datasets import _keys, numbered
from factloom.operators.grids import grid
from factloom.sources import views as V

TABLE = r"(?is)(<table\b.*?</table>)"
LABELS = ("total_revenue", "cost_of_revenue", "operating_income", "net_income", "diluted_eps")


def extract_tables(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, table_no, html, title: the last line of text before the table that isn't a tag or a unit line."""
    t = F.col(text_col)
    found = texts.select(id_col, F.split(t, r"(?is)<table\b.*?</table>").alias("_between"), F.posexplode(F.regexp_extract_all(t, F.lit(TABLE), 1)).alias("table_no", "html"))
    lines = F.filter(F.split(F.get("_between", F.col("table_no")), "\n"), lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(r"^\s*\(?in (thousands|millions|billions)"))
    return found.select(id_col, "table_no", "html", F.trim(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))).alias("title"))


def table_cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, value: each cell at its places in the grid; a cell over n columns or rows fills them."""
    return grid(tables, keys).select(*keys, "row", "col", "value")


def table_facts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, period, raw_value: numeric cells under a header with a year, beside a label; a row without numbers is the group of those below it."""
    year = F.regexp_extract("value", r"\b((?:19|20)\d{2})\b", 1)
    header = cells.filter("row = 0 and col > 0").select(*keys, "col", F.nullif(year, F.lit("")).cast("int").alias("period")).filter("period is not null")
    label = cells.filter("row > 0 and col = 0").select(*keys, "row", F.col("value").alias("label"))
    body = cells.filter("row > 0 and col > 0")
    numeric = F.col("value").rlike(r"^[$(]*-?[\d,]*\.?\d+\)?%?$")
    has = body.groupBy(*keys, "row").agg(F.max(numeric).alias("_any"))
    line = W.partitionBy(*keys).orderBy("row")
    named = label.join(has.hint("merge"), [*keys, "row"], "left").withColumn("_g", F.last(F.when(~F.coalesce("_any", F.lit(False)), F.col("label")), True).over(line))
    full = F.when(F.col("_g").isNull(), F.col("label")).otherwise(F.concat("_g", F.lit(" - "), "label"))
    return body.filter(numeric).join(header.hint("merge"), [*keys, "col"]).join(named.filter("_any").select(*keys, "row", full.alias("label")), [*keys, "row"]).filter(F.length("label").between(3, 180)).select(*keys, "label", "period", F.col("value").alias("raw_value"))


def table_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: the grid as a pipe table, bars escaped, short rows padded."""
    width = F.max("col").over(W.partitionBy(*keys)) + 1
    sized = cells.withColumn("_w", width)
    row = sized.groupBy(*keys, "row", "_w").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.replace("value", F.lit("|"), F.lit("\\|")).alias("v")))), lambda x: x["v"]).alias("vs"))
    padded = F.concat("vs", F.array_repeat(F.lit(""), F.col("_w") - F.size("vs")))
    line = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"), F.when(F.col("row") == 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("_w")))).otherwise(""))
    lines = row.select(*keys, "row", line.alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def table_match(tables: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """ask_id and the one table of its document whose title and cells hold all asked terms; a tie at the top gives none.

    tables: keys, doc_id, title, words (array); asked: ask_id, doc_id, terms (array).
    """
    met = asked.join(tables.hint("merge"), "doc_id").filter(F.size(F.array_except("terms", F.array_union("title_terms", "words"))) == 0)
    scored = met.withColumn("score", F.round(F.size(F.array_intersect("terms", "title_terms")) / F.greatest(F.lit(1), F.size("title_terms")), 9))
    best = scored.withColumn("_m", F.max("score").over(W.partitionBy("ask_id"))).filter("score = _m")
    return best.groupBy("ask_id").agg(F.count("*").alias("n"), F.min("table_no").alias("table_no")).filter("n = 1").select("ask_id", "table_no")


# -- examples ---------------------------------------------------------------------------------------


def amount(c: Column) -> Column:
    return c.cast("decimal(24,2)").cast("string")


def gen_direct(facts: DataFrame) -> DataFrame:
    """One question and claim a fact."""
    name = F.replace("metric", F.lit("_"), F.lit(" "))
    q = F.concat(F.lit("What was the "), name, F.lit(" of "), "ticker", F.lit(" in "), F.col("fiscal_year").cast("string"), F.lit("?"))
    a = F.concat("ticker", F.lit(" reported "), name, F.lit(" of "), amount(F.col("base_value")), F.lit(" in "), F.col("fiscal_year").cast("string"), F.lit("."))
    return facts.select(T.stable_key("direct_", 12, F.col("ticker"), F.col("metric"), F.col("fiscal_year")).alias("example_id"), q.alias("question"), a.alias("answer"))


def gen_yoy(facts: DataFrame) -> DataFrame:
    """The two newest periods: the difference, and the change in percent of the rounded difference."""
    line = W.partitionBy("ticker", "metric", "unit").orderBy(F.desc("fiscal_year"))
    p = facts.withColumns({"older": F.lead("base_value").over(line), "older_year": F.lead("fiscal_year").over(line), "_r": F.row_number().over(line)}).filter("_r = 1 and older is not null and older <> 0")
    diff = (F.col("base_value") - F.col("older")).cast("decimal(24,2)")
    return p.select("ticker", "metric", "fiscal_year", "older_year", diff.cast("double").alias("difference"), F.round(diff.cast("double") / F.abs(F.col("older").cast("double")) * 100, 2).alias("percent"))


def gen_comparison(facts: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Of each year and pair of companies, the sentence that names the larger."""
    a, b = (facts.filter(F.col("metric").isin(*metrics)).select("fiscal_year", "metric", "unit", F.col("ticker").alias(f"{s}t"), F.col("base_value").alias(f"{s}v")) for s in ("l", "r"))
    met = a.join(b.hint("merge"), ["fiscal_year", "metric", "unit"]).filter("lt < rt and lv <> rv")
    win = F.when(F.col("lv") > F.col("rv"), F.col("lt")).otherwise(F.col("rt"))
    return met.select("fiscal_year", "metric", "lt", "rt", F.concat(win, F.lit(" had the higher "), F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(".")).alias("answer"))


def scope_prefix(rows: DataFrame) -> DataFrame:
    """id, question: "According to ..." goes before a question that lacks its company or its year."""
    lacks = ~F.contains(F.lower("question"), F.lower("ticker")) | ~F.contains("question", F.col("year").cast("string"))
    return rows.select("id", F.when(lacks, F.concat(F.lit("According to "), "ticker", F.lit(" "), F.col("year").cast("string"), F.lit(", "), "question")).otherwise(F.col("question")).alias("question"))


def candidate_dedupe(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose id, group and question aren't known, the first of each question."""
    fp = T.fingerprint(F.col("question"))
    c, k = candidates.withColumn("fp", fp), known.withColumn("fp", fp)
    for key in ("example_id", "pair", "fp"):
        c = c.join(k.select(key).distinct(), key, "left_anti")
    return c.withColumn("_r", F.row_number().over(W.partitionBy("fp").orderBy("example_id"))).filter("_r = 1").select("example_id")


def sft_records(examples: DataFrame) -> DataFrame:
    """example_id, record: system, user and assistant messages with a JSON target."""
    target = F.to_json(F.struct(F.col("query_type").alias("type"), F.col("review_status").alias("status")))
    messages = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit("Answer from the evidence.")), ("user", F.col("question")), ("assistant", target))])
    return examples.select("example_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def gen_refusals(groups: DataFrame, per_category: int) -> DataFrame:
    """Unanswerable questions of five kinds in equal numbers, one a group, kinds in turn."""
    kinds = F.array(*[F.lit(k) for k in ("missing_year", "missing_company", "future", "opinion", "other_document")])
    kind = (F.conv(F.substring(F.sha2("group_id", 256), 1, 12), 16, 10).cast("long") % 5).cast("int")
    # no kind gives more than per_category: each part of the table passes on so many of it at most
    ranked = groups.withColumn("_k", kind).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("group_id")))
    return ranked.filter(F.col("_r") <= per_category).select("group_id", F.get(kinds, F.col("_k")).alias("category"))


# -- questions --------------------------------------------------------------------------------------

#: Corrections of common slips.
TYPOS = (("reveune", "revenue"), ("revenu ", "revenue "), ("margni", "margin"), ("finacial", "financial"), ("compnay", "company"), ("opearting", "operating"))


def normalize_question(text: Column) -> Column:
    """Glued years apart, "10 k" as 10-K, slips corrected, white space collapsed."""
    t = F.regexp_replace(text, r"([A-Za-z])((?:19|20)\d{2})\b", "$1 $2")
    t = F.regexp_replace(t, r"(?i)\b10\s*-?\s*k\b", "10-K")
    for wrong, right in TYPOS:
        t = F.regexp_replace(t, f"(?i){wrong}", right)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def route_question(text: Column) -> Column:
    """multihop where a question asks twice, calculates or joins parts; else single."""
    return F.when((F.length(text) - F.length(F.replace(text, F.lit("?"))) > 1) | F.lower(text).rlike(r"\b(ratio|growth|change|difference|percent|margin|compare|compared|versus|sum|average)\b") | F.lower(text).rlike(r"\band (what|how|why|which)\b"), "multihop").otherwise("single")


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each after one of six questions in which its source stands."""
    forms = F.array(*[F.lit(x) for x in ("What was the reveune of %s in10 k2020?", "How did   margni change, and why?", "List the items of %s", "What is it? And when?", "Compare %s versus src1 in FY2021", "who audits %s")])
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.concat(F.replace(F.get(forms, (F.col("doc_id") % 6).cast("int")), F.lit("%s"), F.col("source")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


_ASKED = "asked AS (SELECT doc_id AS question_id, replace((['What was the reveune of %s in10 k2020?', 'How did   margni change, and why?', 'List the items of %s', 'What is it? And when?', 'Compare %s versus src1 in FY2021', 'who audits %s'])[(doc_id % 6)::INT + 1], '%s', source) || ' ' || coalesce(text, '') AS text FROM documents)"


# -- queries ----------------------------------------------------------------------------------------


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text a company with the table of five metrics over the years, every third twice; made from the facts."""
    f = V.facts(spark, sf_dir).filter(F.col("metric").isin(*LABELS))
    row = f.groupBy("ticker", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", amount(F.col("base_value")).alias("v")))), lambda x: x["v"]).alias("vs"), F.array_sort(F.collect_list("fiscal_year")).alias("ys"))
    cells = F.concat(F.lit("<tr><td>"), "metric", F.lit("</td><td>"), F.array_join("vs", "</td><td>"), F.lit("</td></tr>"))
    body = row.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", cells.alias("c")))), lambda x: x["c"]), "").alias("b"), F.max("ys").alias("ys"))
    head = F.concat(F.lit("<tr><th></th><th>"), F.array_join(F.col("ys").cast("array<string>"), "</th><th>"), F.lit("</th></tr>"))
    group = F.concat(F.lit('<tr><td colspan="'), (F.size("ys") + 1).cast("string"), F.lit('">Consolidated</td></tr>'))
    table = F.concat(F.lit("<table>"), head, group, "b", F.lit("</table>"))
    text = F.concat(F.lit("Report of "), "ticker", F.lit("\nStatement of "), "ticker", F.lit("\n(in thousands)\n"), table, F.lit("\nNotes follow\n"), F.when(F.length("ticker") % 3 == 0, table).otherwise(""))
    return body.select(F.col("ticker").alias("doc_id"), text.alias("text"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_tables(table_texts(spark, sf_dir))


_KEYS = ["doc_id", "table_no"]


def q_extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", F.col("table_no").cast("long").alias("table_no"), "title", F.sha2("html", 256).alias("html_sha256"))


def q_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_facts(table_cells(_tables(spark, sf_dir), _KEYS), _KEYS).select("doc_id", F.col("table_no").cast("long").alias("table_no"), "label", "period", "raw_value")


def q_table_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = F.row_number().over(W.partitionBy("doc_id", F.sha2("html", 256)).orderBy("table_no"))
    return _tables(spark, sf_dir).withColumn("_r", sig).filter("_r = 1").select("doc_id", F.col("table_no").cast("long").alias("table_no"))


def q_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_markdown(table_cells(_tables(spark, sf_dir), _KEYS), _KEYS).select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.sha2("markdown", 256).alias("markdown_sha256"))


def q_exact_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1), T.singular))
    t = _tables(spark, sf_dir)
    cells = F.regexp_replace("html", r"<[^>]+>", " ")
    found = t.select("doc_id", "table_no", words(F.col("title")).alias("title_terms"), words(cells).alias("words"))
    asked = table_texts(spark, sf_dir).select(F.col("doc_id").alias("ask_id"), "doc_id", words(F.concat(F.lit("statement of "), "doc_id", F.lit(" net income"))).alias("terms"))
    return table_match(found, asked, _KEYS).select("ask_id", F.col("table_no").cast("long").alias("table_no"))


def q_gen_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_direct(V.facts(spark, sf_dir))


def q_gen_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_yoy(V.facts(spark, sf_dir))


def q_gen_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen_comparison(V.facts(spark, sf_dir), ("total_revenue", "net_income"))


def q_gen_complete_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a company and year as one answer."""
    f = V.facts(spark, sf_dir)
    item = F.concat(F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(": "), amount(F.col("base_value")))
    return f.groupBy("ticker", "fiscal_year").agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("answer"))


def q_narrative_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good English documents of 500 characters or more that hold no gold id, dealt over sources to 200."""
    from factloom.operators.datasets import balanced_take

    e = V.examples(spark, sf_dir).filter("query_type = 'en' and review_status = 'approved'").join(V.segments(spark, sf_dir).filter(F.length("text") >= 500).select(F.col("doc_id").alias("example_id")), "example_id", "left_semi")
    gold = V.examples(spark, sf_dir).filter("benchmark_overlap").select("example_id")
    return balanced_take(e.join(gold.hint("merge"), "example_id", "left_anti"), "group_id", "example_id", 200).select("example_id", "group_id")


def q_ensure_scope_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = asked_questions(spark, sf_dir)
    return scope_prefix(a.select(F.col("question_id").alias("id"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("ticker"), (2020 + F.col("question_id") % 2).alias("year")))


def q_candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.examples(spark, sf_dir).withColumn("pair", F.concat_ws("-", "group_id", "query_type", F.expr("example_id div 60").cast("string")))
    return candidate_dedupe(e.filter("example_id % 3 <> 0"), e.filter("example_id % 30 = 0"))


def q_sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_records(V.examples(spark, sf_dir)).select("example_id", F.sha2("record", 256).alias("record_sha256"))


def q_gen_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = V.segments(spark, sf_dir).select(F.concat_ws("-", "ticker", "doc_type").alias("group_id")).distinct()
    return gen_refusals(groups, 8)


def q_normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_questions(spark, sf_dir).select("question_id", normalize_question(F.col("text")).alias("text"))


def q_route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_questions(spark, sf_dir).select("question_id", route_question(F.col("text")).alias("route"))


def q_scope_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested groups that the permitted ones (here: of the sources with a good English document) don't hold."""
    permitted = V.examples(spark, sf_dir).filter("review_status = 'approved' and query_type = 'fr'").select(F.col("group_id").alias("ticker")).distinct()
    return V.question_groups(spark, sf_dir).join(permitted.hint("merge"), "ticker", "left_anti").select("question_id", "grp_ord")


def q_merge_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that are equal without company and year, merged."""
    topic = F.trim(F.regexp_replace(F.regexp_replace(normalize_question(F.col("text")), r"(?i)\bsrc\d+\b|\b(?:19|20)\d{2}\b", ""), r"\s+", " "))
    return asked_questions(spark, sf_dir).groupBy(topic.alias("topic")).agg(F.min("question_id").alias("requirement_id"), F.count("*").alias("merged"))


def q_evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language, good documents that a fact uses, and three others."""
    d = V.examples(spark, sf_dir)
    used = F.col("review_status") == "approved"
    line = F.row_number().over(W.partitionBy("group_id", "query_type").orderBy("example_id"))
    others = d.filter(~used).withColumn("_r", line).filter("_r <= 3")  # a fixed limit: each part of the table passes on its first three alone
    return d.filter(used & (F.col("example_id") % 4 == 0)).select("example_id").unionByName(others.select("example_id"))


def q_strongest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language, the document with the most digits' weight and words; ties by id."""
    score = 4 * F.size(T.number_keys(F.col("text"))) + F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)) / 1000
    d = V.segments(spark, sf_dir).select("ticker", "doc_type", "doc_id", F.round(score, 6).alias("score"))
    return d.withColumn("_r", F.row_number().over(W.partitionBy("ticker", "doc_type").orderBy(F.desc("score"), "doc_id"))).filter("_r = 1").select("ticker", "doc_type", "doc_id", "score")


def q_evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are one source; ids by first appearance in each language."""
    d = V.segments(spark, sf_dir).select("doc_id", "doc_type", F.sha2("text", 256).alias("h"))
    one = d.groupBy("doc_type", "h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("merged"))
    return numbered(one, "doc_type", "first_id").select("doc_type", "first_id", "merged", F.concat(F.lit("S"), F.col("_r").cast("string")).alias("source_id"))


def q_tax_factors_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each company, the five years with the largest change of the tax rate in size."""
    f = V.facts(spark, sf_dir).filter("metric = 'effective_tax_rate'")
    delta = F.round(F.col("base_value").cast("double") - F.lag(F.col("base_value").cast("double")).over(W.partitionBy("ticker").orderBy("fiscal_year")), 6)
    r = f.select("ticker", "fiscal_year", delta.alias("rate")).filter("rate is not null")
    return r.withColumn("rank", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc(F.abs("rate")), "fiscal_year")).cast("long")).filter("rank <= 5")


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}
_F = V.with_views("facts")
_TT = (
    _F
    + f""", tr AS (SELECT ticker, metric, list(base_value::DECIMAL(24,2)::VARCHAR ORDER BY fiscal_year) AS vs, list(fiscal_year ORDER BY fiscal_year) AS ys FROM facts WHERE metric IN {LABELS} GROUP BY ticker, metric),
tb AS (SELECT ticker, string_agg('<tr><td>' || metric || '</td><td>' || array_to_string(vs, '</td><td>') || '</td></tr>', '' ORDER BY metric) AS b, max(ys) AS ys FROM tr GROUP BY ticker),
tt AS (SELECT ticker AS doc_id, '<table><tr><th></th><th>' || array_to_string(ys, '</th><th>') || '</th></tr><tr><td colspan="' || (len(ys) + 1) || '">Consolidated</td></tr>' || b || '</table>' AS html FROM tb),
tn AS (SELECT doc_id, 0 AS table_no, 'Statement of ' || doc_id AS title, html FROM tt UNION ALL SELECT doc_id, 1, 'Notes follow', html FROM tt WHERE length(doc_id) % 3 = 0),"""
    + r"""
trow AS (SELECT doc_id, table_no, unnest(rs) AS r, unnest(range(0, len(rs))) AS row FROM (SELECT *, regexp_extract_all(html, '(?is)<tr\b[^>]*>(.*?)</tr>', 1) AS rs FROM tn)),
tcell AS (SELECT doc_id, table_no, row, unnest(cs) AS c, unnest(range(0, len(cs))) AS i FROM (SELECT *, regexp_extract_all(r, '(?is)(<t[hd]\b[^>]*>.*?</t[hd]>)', 1) AS cs FROM trow)),
tgrid AS (SELECT doc_id, table_no, row, k AS col, trim(regexp_replace(c, '<[^>]+>', '', 'g')) AS value FROM (SELECT *, unnest(range(i, i + CASE WHEN regexp_extract(c, 'colspan="(\d+)', 1) = '' THEN 1 ELSE regexp_extract(c, 'colspan="(\d+)', 1)::INT END)) AS k FROM tcell))"""
)
ORACLES = {
    "extract_tables": _TT + " SELECT doc_id, table_no, title, sha256(html) AS html_sha256 FROM tn",
    "table_facts": _TT + " SELECT t.doc_id, t.table_no, 'Consolidated - ' || l.value AS label, h.value::INT AS period, t.value AS raw_value FROM tgrid t JOIN tgrid l ON t.doc_id = l.doc_id AND t.table_no = l.table_no AND t.row = l.row AND l.col = 0 AND t.col > 0 AND t.row > 1 JOIN tgrid h ON h.doc_id = t.doc_id AND h.table_no = t.table_no AND h.row = 0 AND h.col = t.col",
    "table_dedupe": _TT + " SELECT doc_id, min(table_no) AS table_no FROM tn GROUP BY doc_id, html",
    "table_markdown": _TT + ", l AS (SELECT doc_id, table_no, row, '| ' || string_agg(value, ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat(' --- |', count(*)::INT) ELSE '' END AS line FROM tgrid GROUP BY doc_id, table_no, row) SELECT doc_id, table_no, sha256(string_agg(line, chr(10) ORDER BY row)) AS markdown_sha256 FROM l GROUP BY doc_id, table_no",
    "exact_table_match": _TT + " SELECT doc_id AS ask_id, min(table_no) AS table_no FROM tn WHERE title LIKE 'Statement%' GROUP BY doc_id",
    "gen_direct": _F + " SELECT 'direct_' || left(sha256(lower(ticker) || chr(31) || metric || chr(31) || fiscal_year), 12) AS example_id, 'What was the ' || replace(metric, '_', ' ') || ' of ' || ticker || ' in ' || fiscal_year || '?' AS question, ticker || ' reported ' || replace(metric, '_', ' ') || ' of ' || base_value::DECIMAL(24,2) || ' in ' || fiscal_year || '.' AS answer FROM facts",
    "gen_yoy": _F + ", p AS (SELECT *, lead(base_value) OVER w AS o, lead(fiscal_year) OVER w AS older_year, row_number() OVER w AS r FROM facts WINDOW w AS (PARTITION BY ticker, metric, unit ORDER BY fiscal_year DESC)) SELECT ticker, metric, fiscal_year, older_year, (base_value - o)::DECIMAL(24,2)::DOUBLE AS difference, round((base_value - o)::DECIMAL(24,2)::DOUBLE / abs(o::DOUBLE) * 100, 2) AS percent FROM p WHERE r = 1 AND o <> 0",
    "gen_comparison": _F + " SELECT a.fiscal_year, a.metric, a.ticker AS lt, b.ticker AS rt, CASE WHEN a.base_value > b.base_value THEN a.ticker ELSE b.ticker END || ' had the higher ' || replace(a.metric, '_', ' ') || '.' AS answer FROM facts a JOIN facts b ON a.fiscal_year = b.fiscal_year AND a.metric = b.metric AND a.ticker < b.ticker AND a.base_value <> b.base_value WHERE a.metric IN ('total_revenue', 'net_income')",
    "gen_complete_table": _F + ", i AS (SELECT ticker, fiscal_year, replace(metric, '_', ' ') || ': ' || base_value::DECIMAL(24,2) AS x FROM facts) SELECT ticker, fiscal_year, string_agg(x, '; ' ORDER BY x) AS answer FROM i GROUP BY ticker, fiscal_year",
    "narrative_pool": V.with_views("examples") + ", e AS (SELECT example_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY example_id) AS t FROM examples JOIN documents ON doc_id = example_id WHERE query_type = 'en' AND review_status = 'approved' AND length(text) >= 500 AND NOT benchmark_overlap) SELECT example_id, group_id FROM e ORDER BY t, group_id LIMIT 200",
    "ensure_scope_prefix": f"WITH {_ASKED} SELECT question_id AS id, CASE WHEN NOT contains(lower(text), 'src' || (question_id % 20)) OR NOT contains(text, (2020 + question_id % 2)::VARCHAR) THEN 'According to src' || (question_id % 20) || ' ' || (2020 + question_id % 2) || ', ' || text ELSE text END AS question FROM asked",
    "candidate_dedupe": V.with_views("examples") + ", e AS (SELECT *, group_id || '-' || query_type || '-' || (example_id // 60) AS pair, array_to_string(regexp_extract_all(trim(regexp_replace(lower(translate(question, '‘’“”–—' || chr(160), '''''" + '""' + r"-- ')), '\s+', ' ', 'g')), '([a-z0-9]+)', 1), ' ') AS fp FROM examples), k AS (SELECT * FROM e WHERE example_id % 30 = 0) SELECT min(example_id) AS example_id FROM e WHERE example_id % 3 <> 0 AND pair NOT IN (SELECT pair FROM k) AND fp NOT IN (SELECT fp FROM k) GROUP BY fp",
    "normalize_question": rf"WITH {_ASKED} SELECT question_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])((?:19|20)\d{{2}})\b', '\1 \2', 'g'), '(?i)\b10\s*-?\s*k\b', '10-K', 'g'), '(?i)reveune', 'revenue', 'g'), '(?i)margni', 'margin', 'g'), '\s+', ' ', 'g')) AS text FROM asked",
    "route_question": rf"WITH {_ASKED} SELECT question_id, CASE WHEN length(text) - length(replace(text, '?', '')) > 1 OR regexp_matches(lower(text), '\b(ratio|growth|change|difference|percent|margin|compare|compared|versus|sum|average)\b') OR regexp_matches(lower(text), '\band (what|how|why|which)\b') THEN 'multihop' ELSE 'single' END AS route FROM asked",
    "scope_containment": V.with_views("question_groups", "examples") + " SELECT question_id, grp_ord FROM question_groups WHERE ticker NOT IN (SELECT group_id FROM examples WHERE review_status = 'approved' AND query_type = 'fr')",
    "merge_requirements": rf"WITH {_ASKED}, n AS (SELECT question_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])((?:19|20)\d{{2}})\b', '\1 \2', 'g'), '(?i)\b10\s*-?\s*k\b', '10-K', 'g'), '(?i)reveune', 'revenue', 'g'), '(?i)margni', 'margin', 'g'), '\s+', ' ', 'g'), '(?i)\bsrc\d+\b|\b(?:19|20)\d{{2}}\b', '', 'g')) AS t FROM asked) SELECT trim(regexp_replace(t, '\s+', ' ', 'g')) AS topic, min(question_id) AS requirement_id, count(*) AS merged FROM n GROUP BY 1",
    "evidence_select": V.with_views("examples") + " SELECT example_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, query_type, review_status = 'approved' ORDER BY example_id) AS r FROM examples) WHERE (review_status = 'approved' AND example_id % 4 = 0) OR (review_status <> 'approved' AND r <= 3)",
    "evidence_merge": V.with_views("segments") + " SELECT doc_type, min(doc_id) AS first_id, count(*) AS merged, 'S' || row_number() OVER (PARTITION BY doc_type ORDER BY min(doc_id)) AS source_id FROM segments GROUP BY doc_type, text",
    "tax_factors_top5": _F + ", r AS (SELECT ticker, fiscal_year, round(base_value::DOUBLE - lag(base_value::DOUBLE) OVER (PARTITION BY ticker ORDER BY fiscal_year), 6) AS rate FROM facts WHERE metric = 'effective_tax_rate') SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(rate) DESC, fiscal_year) AS rank FROM r WHERE rate IS NOT NULL QUALIFY rank <= 5",
    "gen_refusals": "WITH g AS (SELECT DISTINCT source || '-' || lang AS group_id FROM documents), k AS (SELECT group_id, ('0x' || substr(sha256(group_id), 1, 12))::BIGINT % 5 AS k FROM g) SELECT group_id, ['missing_year', 'missing_company', 'future', 'opinion', 'other_document'][k + 1] AS category FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY group_id) <= 8",
    "sft_records": V.with_views("examples") + " SELECT example_id, sha256(to_json({'messages': [{'role': 'system', 'content': 'Answer from the evidence.'}, {'role': 'user', 'content': question}, {'role': 'assistant', 'content': to_json({'type': query_type, 'status': review_status})::VARCHAR}]})::VARCHAR) AS record_sha256 FROM examples",
    "strongest_evidence": V.with_views("segments") + ", e AS (SELECT ticker, doc_type, doc_id, round(4 * len(" + _keys("text") + r") + len(regexp_extract_all(text, '(\S+)', 1)) / 1000.0::DOUBLE, 6) AS score FROM segments) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ticker, doc_type ORDER BY score DESC, doc_id) = 1",
}
