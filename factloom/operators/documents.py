"""Cleaning of texts and pages, sections, segments, dates, turns and blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources import views as V

#: Entities that are unescaped (the ampersand last), dropped elements, block elements, headings.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
DROPPED = r"(?is)<(?:style|script|noscript)\b[^>]*>.*?</(?:style|script|noscript)>"
CHROME = r"(?is)<(?:script|style|nav|header|footer|form|button)\b[^>]*>.*?</(?:script|style|nav|header|footer|form|button)>"
BLOCK = r"(?is)<(?:h[1-4]|p|li|blockquote)\b[^>]*>(.*?)</(?:h[1-4]|p|li|blockquote)>"
HEADING = r"(?i)^\s{0,4}(ITEM\s+(?:1[0-6]|1[ABC]?|7A|9[ABC]?|[2-8])|NOTE\s+\d{1,2})\.?\s*(?:[-:]\s*)?([^\n|]{0,160})$"
MOJIBAKE = "[ÂÃâð�]"


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_text(text: Column) -> Column:
    plain = F.translate(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), DROPPED, "")), " ​", " ")
    lines = F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r" +(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def readable_text(text: Column) -> Column:
    """Cells end in bars, rows and paragraphs in line ends; tags go."""
    cells = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)</(?:td|th)>", " | ")
    rows = F.regexp_replace(cells, r"(?i)<br\s*/?>|</(?:p|tr|div|li|h[1-6])>", "\n")
    return F.trim(unescape(F.regexp_replace(rows, r"<[^>]+>", "")))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, pos, block: headings, paragraphs, items and quotes in order, without empty ones and without repeats of the one before."""
    body = F.regexp_replace(F.coalesce(html_col, F.lit("")), CHROME, "")
    raw = pages.select(id_col, F.posexplode(F.regexp_extract_all(body, F.lit(BLOCK), 1)).alias("pos", "b"))
    text = raw.select(id_col, "pos", F.trim(F.regexp_replace(unescape(F.regexp_replace("b", r"<[^>]+>", " ")), r"\s+", " ")).alias("block")).filter("block <> ''")
    before = F.lag("block").over(W.partitionBy(id_col).orderBy("pos"))
    return text.withColumn("_b", before).filter("_b is null or _b <> block").drop("_b")


def sections(lines: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, page_no, frag, section, item, n_chars from lines (doc_id, page_no, line_no, text).

    A heading starts a fragment; what comes before the first one of a page inherits the section. A page
    of four headings or more that says "table of contents" is one fragment and changes nothing.
    Fragments under ``least`` characters go.
    """
    head = F.regexp_extract("text", HEADING, 1) != ""
    page = W.partitionBy("doc_id", "page_no")
    marked = lines.withColumn("_h", head)
    toc = (F.sum(F.col("_h").cast("int")).over(page) >= 4) & F.max(F.contains(F.lower("text"), F.lit("table of contents"))).over(page)
    marked = marked.withColumn("_toc", toc).withColumn("_h", F.col("_h") & ~F.col("_toc"))
    label = F.initcap(F.lower(F.regexp_replace(F.regexp_extract("text", HEADING, 1), r"\s+", " ")))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("text", HEADING, 2), r"\s+", " "), r"^[ *#.:-]+|[ *#.:-]+$", ""))
    name = F.when(F.col("_h"), F.when(title == "", label).otherwise(F.concat(label, F.lit(". "), title)))
    line = W.partitionBy("doc_id").orderBy("page_no", "line_no")
    run = marked.withColumn("_item", F.when(F.col("_h"), label)).withColumn("_name", name)
    run = run.select("doc_id", "page_no", "line_no", "text", "_toc", F.last("_name", True).over(line).alias("_s"), F.last("_item", True).over(line).alias("_i"), F.sum(F.col("_h").cast("int")).over(line).alias("frag"))
    section = F.when(F.col("_toc"), "Table of Contents").otherwise(F.coalesce("_s", F.lit("Document")))
    parts = run.groupBy("doc_id", "page_no", "frag", section.alias("section"), F.when(~F.col("_toc"), F.col("_i")).alias("item")).agg((F.sum(F.length("text") + 1) - 1).alias("n_chars"))
    return parts.filter(F.col("n_chars") >= least)


def segment_runs(fragments: DataFrame) -> DataFrame:
    """doc_id, segment, key, page_start, page_end, n_chars: consecutive fragments of one item (else section)."""
    key = F.coalesce("item", "section")
    line = W.partitionBy("doc_id").orderBy("page_no", "frag")
    marked = fragments.withColumn("key", key).withColumn("_new", (~F.col("key").eqNullSafe(F.lag("key").over(line))).cast("int"))
    return marked.withColumn("segment", F.sum("_new").over(line)).groupBy("doc_id", "segment", "key").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.sum("n_chars").alias("n_chars"))


def first_date(pages: DataFrame, within: int, cue: str | None = None) -> DataFrame:
    """doc_id, date: the first "Month D, YYYY" of the first pages, after a cue where one is given."""
    pattern = T.DATE if cue is None else rf"(?i){cue}\s+((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{{1,2}},\s+20\d{{2}})\b"
    found = F.regexp_extract("text", pattern, 1)
    rows = pages.filter(F.col("page_no") < within).withColumn("f", found).filter("f <> ''")
    return rows.groupBy("doc_id").agg(F.min_by("f", "page_no").alias("f")).select("doc_id", F.date_format(T.month_date(F.col("f")), "yyyy-MM-dd").alias("date"))


def transcript_turns(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, speaker, role, section, body from blocks (doc_id, pos, text).

    "Name: words" is a turn of its own; a name line followed by a role line opens one; section lines
    switch the section; lone Q and A badges go.
    """
    line = W.partitionBy("doc_id").orderBy("pos")
    inline = F.regexp_extract("text", r"^\s*([A-Za-z][A-Za-z .,'&()-]{1,100}?)\s*:\s", 1)
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    b = blocks.filter(~F.upper(F.trim("text")).isin("Q", "A", "Q.", "A."))
    section = F.when((words <= 18) & F.lower("text").rlike(r"\b(question(s)?\s+(and|&)\s+answer|q\s*&\s*a)\b"), "Question and Answer").when((words <= 18) & F.lower("text").rlike(r"\b(management discussion|prepared remarks?)\b"), "Prepared Remarks")
    speaks = (F.lower(inline).isin("operator", "coordinator") | (F.size(F.split(inline, " ")) >= 2)) & ~F.lower(inline).rlike(r"^(revenue|revenues|net income|operating income|gross profit|fiscal year|question|answer)$")
    named = (words <= 8) & F.col("text").rlike(r"^[A-Za-z][A-Za-z .,'&()-]+$") & ~F.col("text").rlike(r"[.?!]$")
    role = F.lower("text").rlike(r"\b(chief|officer|president|chairman|analyst|operator|director|treasurer|controller|executive|founder|partner)\b")
    b = b.withColumns({"_s": section, "_in": F.when(speaks & (inline != ""), inline), "_n": named, "_r": role})
    b = b.withColumn("_name", F.when(F.col("_n") & F.lead("_r").over(line) & F.col("_in").isNull() & F.col("_s").isNull(), F.trim("text"))).withColumn("_used", F.lag("_name").over(line).isNotNull())
    b = b.withColumn("_who", F.coalesce("_in", F.when(F.col("_used"), F.lag("_name").over(line)))).withColumn("_what", F.when(F.col("_used"), F.trim("text")).when(F.col("_in").isNotNull(), F.lit("")))
    b = b.withColumns({"speaker": F.last("_who", True).over(line), "role": F.nullif(F.last("_what", True).over(line), F.lit("")), "section": F.coalesce(F.last("_s", True).over(line), F.lit("Prepared Remarks"))})
    body = F.when(F.col("_in").isNotNull(), F.regexp_replace("text", r"^[^:]*:\s*", "")).otherwise(F.col("text"))
    return b.filter("_s is null and _name is null and not _used").select("doc_id", "pos", "speaker", "role", "section", body.alias("body"))


def turn_metadata(turns: DataFrame) -> DataFrame:
    """doc_id, speakers (in order of first turn), one speaker and role where there is just one, first section."""
    firsts = turns.filter("speaker is not null").groupBy("doc_id", "speaker").agg(F.min("pos").alias("at"), F.min("role").alias("role"))
    listed = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "role"))).alias("s"))
    section = turns.groupBy("doc_id").agg(F.min_by("section", "pos").alias("section"), F.count("*").alias("turns"))
    one = F.size("s") == 1
    return section.join(listed.hint("merge"), "doc_id", "left").select("doc_id", "section", "turns", F.array_join(F.transform("s", lambda x: x["speaker"]), ", ").alias("speakers"), F.when(one, F.get("s", F.lit(0))["speaker"]).alias("speaker"), F.when(one, F.get("s", F.lit(0))["role"]).alias("role"))


def block_split(lines: DataFrame) -> DataFrame:
    """doc_id, block, kind, n_lines, n_chars: runs of pipe lines, and prose up to a blank line; joined again they are the text."""
    line = W.partitionBy("doc_id").orderBy("line_no")
    kind = F.when(F.contains("text", F.lit("|")), "table").otherwise("prose")
    b = lines.withColumn("kind", kind).withColumn("_new", (F.lag("kind").over(line).isNull() | (F.lag("kind").over(line) != F.col("kind")) | (F.lag(F.trim("text")).over(line) == "")).cast("int"))
    return b.withColumn("block", F.sum("_new").over(line)).groupBy("doc_id", "block").agg(F.first("kind").alias("kind"), F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def compress_context(blocks: DataFrame, terms: DataFrame, keep: int = 6) -> DataFrame:
    """doc_id, block, kept: of blocks (doc_id, block, text), the best by shared terms, their neighbours, and blocks with numbers or headings.

    terms: doc_id, terms (array). A document of at most ``keep`` blocks, without terms or without a match is kept whole.
    """
    doc, line = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("block")
    met = blocks.join(terms.hint("merge"), "doc_id", "left").withColumn("_overlap", F.coalesce(F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("text"))), "terms")), F.lit(0)))
    met = met.withColumns({"_n": F.count("*").over(doc), "_best": F.max("_overlap").over(doc), "_rank": F.row_number().over(doc.orderBy(F.desc("_overlap"), "block"))})
    whole = (F.col("_n") <= keep) | F.coalesce(F.size("terms") <= 0, F.lit(True)) | (F.col("_best") <= 0)
    picked = met.withColumn("_whole", whole).withColumn("_pick", ((F.col("_rank") <= keep) & (F.col("_overlap") > 0)).cast("int"))
    near = F.max("_pick").over(line.rowsBetween(-1, 1)) == 1
    return picked.select("doc_id", "block", (F.col("_whole") | near | F.col("text").rlike(r"\d")).alias("kept"))


def evidence_windows(paragraphs: DataFrame, max_chars: int = 12_000, windows: int = 4, shortest: int = 80, least: int = 500) -> DataFrame:
    """doc_id, window, n_chars: paragraphs of 80 characters or more packed in order; a window under 500 goes, as do those past the number asked for.

    The fold runs over the paragraphs of one document, in one expression.
    """
    sized = paragraphs.filter(F.length("text") >= shortest).select("doc_id", "pos", F.least(F.length("text"), F.lit(max_chars)).alias("n"))
    listed = sized.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("ns"))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("now"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["now"] == 0) | (s["now"] + 2 + n <= max_chars)
        grown = F.struct(s["done"].alias("done"), F.when(s["now"] == 0, n).otherwise(s["now"] + 2 + n).alias("now"))
        return F.when(fits, grown).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), n.alias("now")))

    folded = listed.select("doc_id", F.aggregate("ns", start, step, lambda s: F.when(s["now"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])).alias("w"))
    return folded.select("doc_id", F.posexplode(F.slice(F.filter("w", lambda n: n >= least), 1, windows)).alias("window", "n_chars"))


def merged_spans(spans: DataFrame, gap: int = 200) -> DataFrame:
    """doc_id, start, end: spans that overlap or lie within gap, merged."""
    line = W.partitionBy("doc_id").orderBy("start", "end")
    far = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (far.isNull() | (F.col("start") > far + gap)).cast("int"))
    return marked.withColumn("_run", F.sum("_new").over(line)).groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def mojibake(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(MOJIBAKE)


def repair_mojibake(df: DataFrame, text_col: str = "text", out_col: str = "repaired") -> DataFrame:
    """Runs of characters that are UTF-8 read as Windows-1252 (its five free places as controls) are read again; others stay."""

    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        def again(m: re.Match) -> str:
            try:
                return b"".join(bytes([ord(c)]) if "\x80" <= c < "\xa0" else c.encode("cp1252") for c in m.group()).decode("utf-8")
            except UnicodeError:
                return m.group()

        return texts.map(lambda t: t if t is None else re.sub(r"[Â-ôâ][\u0080-¿Œ-™]{1,3}", again, t))

    return df.withColumn(out_col, repaired(text_col))


# -- queries ----------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, four a page; some are headings."""
    raw = V.segments(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    head = F.concat(F.lit("Item "), (1 + F.col("line_no") % 9).cast("string"), F.lit(". "), F.substring("text", 1, 20))
    made = F.when((F.col("doc_id") + F.col("line_no")) % 5 == 0, F.regexp_replace(head, r"\|", "")).when((F.col("doc_id") % 10 == 0) & (F.col("line_no") < 4), F.when(F.col("line_no") == 0, "Table of contents").otherwise(F.concat(F.lit("NOTE "), F.col("line_no").cast("string")))).otherwise(F.col("text"))
    return raw.select("doc_id", F.expr("line_no div 4").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), made.alias("text"))


def _date_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cue = F.when(F.col("o_orderkey") % 3 == 0, "the fiscal year ended ").otherwise("on ")
    return o.select(F.col("o_custkey").alias("doc_id"), page.alias("page_no"), F.concat(cue, F.date_format(F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "MMMM d, yyyy"), F.lit(".")).alias("text"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.history(spark, sf_dir)
    words = F.array_join(F.slice(F.regexp_extract_all("content", F.lit("([A-Za-z]+)"), 1), 1, 6), " ")
    t = F.col("turn")
    line = F.when(t % 5 == 0, F.concat(F.lit("Ann Lee: "), words)).when(t % 5 == 1, F.concat(F.lit("Bob "), F.upper("role"))).when(t % 5 == 2, F.lit("Chief Executive Officer")).when(t % 7 == 3, F.lit("Q")).when(t % 11 == 4, F.lit("Question and Answer Session")).otherwise(F.concat(words, F.lit(".")))
    return c.select(F.col("conv_id").alias("doc_id"), t.alias("pos"), line.alias("text"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pages(spark, sf_dir).select("page_id", F.sha2(clean_text(F.col("html")), 256).alias("clean_sha256"))


def q_readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pages(spark, sf_dir).select("page_id", F.sha2(readable_text(F.col("html")), 256).alias("readable_sha256"))


def q_html_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(V.pages(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), F.sha2("block", 256).alias("block_sha256"))


def q_split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(_lines(spark, sf_dir))


def q_segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_runs(sections(_lines(spark, sf_dir)))


def q_fiscal_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_date(_date_pages(spark, sf_dir), 8, "fiscal year ended")


def q_call_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_date(_date_pages(spark, sf_dir), 80)


def q_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_turns(_blocks(spark, sf_dir))


def q_turn_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_metadata(transcript_turns(_blocks(spark, sf_dir)))


def q_block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.segments(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return block_split(raw)


def q_compress_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks, asked for with the words of the last line."""
    raw = V.segments(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    terms = V.segments(spark, sf_dir).select("doc_id", F.array_distinct(T.tokens(F.element_at(F.split("text", "\n"), -1))).alias("terms"))
    return compress_context(raw, terms).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("kept").alias("kept"))


def q_evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.segments(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return evidence_windows(raw, 3000)


def q_bounded_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 300 characters around the places where a text names "the" followed by a longer word."""
    raw = V.segments(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("end", F.sum(F.length("text") + 1).over(W.partitionBy("doc_id").orderBy("pos")))
    spans = raw.filter(F.lower("text").rlike(r"the [a-z]{9}")).select("doc_id", (F.col("end") - F.length("text") - 100).alias("start"), F.col("end"))
    return merged_spans(spans)


#: The characters of Windows-1252 at the places where ISO-8859-1 has controls.
_C1 = [i for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def q_mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts broken by reading their UTF-8 as Windows-1252, and repaired: the repaired text is the one that was broken."""
    broken = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "".join(map(chr, _C1)), bytes(_C1).decode("cp1252"))
    d = V.segments(spark, sf_dir).select("doc_id", broken.alias("text"))
    return repair_mojibake(d).select("doc_id", F.sha2("repaired", 256).alias("repaired_sha256"))


def q_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}


def _un(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({_un(f'regexp_replace(coalesce(html, {chr(39) * 2}), {chr(39)}{DROPPED}{chr(39)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')}, chr(160) || chr(8203), ' '), '[ \\t]+', ' ', 'g'), ' +(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_READ = "trim(" + _un(r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)</(?:td|th)>', ' | ', 'g'), '(?i)<br\s*/?>|</(?:p|tr|div|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g')") + ")"
_LINES = r"""raw AS (SELECT doc_id, unnest(ls) AS text, unnest(range(0, len(ls))) AS line_no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""
_SECTION_SQL = rf"""WITH {_LINES}, ln AS (SELECT doc_id, line_no // 4 AS page_no, line_no, CASE WHEN (doc_id + line_no) % 5 = 0 THEN replace('Item ' || (1 + line_no % 9) || '. ' || left(text, 20), '|', '') WHEN doc_id % 10 = 0 AND line_no < 4 THEN CASE WHEN line_no = 0 THEN 'Table of contents' ELSE 'NOTE ' || line_no END ELSE text END AS text FROM raw),
m AS (SELECT *, regexp_extract(text, '{HEADING}', 1) AS lab, regexp_extract(text, '{HEADING}', 2) AS tit FROM ln), t AS (SELECT *, count(*) FILTER (WHERE lab <> '') OVER p >= 4 AND bool_or(contains(lower(text), 'table of contents')) OVER p AS toc FROM m WINDOW p AS (PARTITION BY doc_id, page_no)),
h AS (SELECT *, lab <> '' AND NOT toc AS head, upper(left(lab, 1)) || lower(regexp_replace(substr(lab, 2), '\s+', ' ', 'g')) AS label, trim(regexp_replace(regexp_replace(tit, '\s+', ' ', 'g'), '^[ *#.:-]+|[ *#.:-]+$', '', 'g')) AS title FROM t),
r AS (SELECT *, last_value(CASE WHEN head THEN CASE WHEN title = '' THEN label ELSE label || '. ' || title END END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN head THEN label END IGNORE NULLS) OVER w AS i, sum(head::INT) OVER w AS frag FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, line_no)),
sec AS (SELECT doc_id, page_no, frag::BIGINT AS frag, CASE WHEN toc THEN 'Table of Contents' ELSE coalesce(s, 'Document') END AS section, CASE WHEN NOT toc THEN i END AS item, (sum(length(text) + 1) - 1)::BIGINT AS n_chars FROM r GROUP BY ALL HAVING sum(length(text) + 1) - 1 >= 40)"""
_DATES = "pg AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_no, o_orderkey, o_orderdate FROM orders)"
_SEGS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+(?:[.&''-][\p{{L}}\p{{N}}]+)*', 0), lambda t: t NOT IN (" + _STOP + "))"
ORACLES = {
    "evidence_windows": f"""WITH {_LINES}, z AS (SELECT doc_id, list([least(length(text), 3000)] ORDER BY line_no) AS ns FROM raw WHERE length(text) >= 80 GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(list_reduce(ns, lambda acc, x: CASE WHEN acc[-1] + 2 + x[1] <= 3000 THEN list_append(acc[:-2], acc[-1] + 2 + x[1]) ELSE list_concat(acc, x) END), lambda n: n >= 500)[1:4] AS w FROM z)
SELECT doc_id, unnest(range(0, len(w)))::INT AS "window", unnest(w)::INT AS n_chars FROM w""",
    "clean_text": f"SELECT page_id, sha256({_CLEAN}) AS clean_sha256 FROM pages",
    "readable_text": f"SELECT page_id, sha256({_READ}) AS readable_sha256 FROM pages",
    "html_text_blocks": f"WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{CHROME}', '', 'g'), '{BLOCK}', 1) AS bs FROM pages), e AS (SELECT page_id, unnest(bs) AS b, unnest(range(0, len(bs))) AS pos FROM b), t AS (SELECT page_id, pos, trim(regexp_replace({_un(chr(114) + 'egexp_replace(b, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s+', ' ', 'g')) AS block FROM e), f AS (SELECT * FROM t WHERE block <> '') SELECT page_id, pos, sha256(block) AS block_sha256 FROM f QUALIFY lag(block) OVER (PARTITION BY page_id ORDER BY pos) IS DISTINCT FROM block",
    "split_sections": _SECTION_SQL + " SELECT * FROM sec",
    "segment_runs": _SECTION_SQL + ", k AS (SELECT *, coalesce(item, section) AS key FROM sec), c AS (SELECT *, (lag(key) OVER (PARTITION BY doc_id ORDER BY page_no, frag) IS DISTINCT FROM key)::INT AS nw FROM k), g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY page_no, frag)::BIGINT AS segment FROM c) SELECT doc_id, segment, key, min(page_no) AS page_start, max(page_no) AS page_end, sum(n_chars)::BIGINT AS n_chars FROM g GROUP BY ALL",
    "fiscal_end_date": f"WITH {_DATES} SELECT doc_id, strftime(arg_min(o_orderdate, page_no), '%Y-%m-%d') AS date FROM pg WHERE page_no < 8 AND o_orderkey % 3 = 0 AND year(o_orderdate) >= 2000 GROUP BY doc_id",
    "call_date": f"WITH {_DATES} SELECT doc_id, strftime(arg_min(o_orderdate, page_no), '%Y-%m-%d') AS date FROM pg WHERE page_no < 80 AND year(o_orderdate) >= 2000 GROUP BY doc_id",
    "block_split": f"WITH {_LINES}, k AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS kind FROM raw), c AS (SELECT *, (lag(kind) OVER w IS DISTINCT FROM kind OR coalesce(trim(lag(text) OVER w) = '', false))::INT AS nw FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM c) SELECT doc_id, block, min(kind) AS kind, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM g GROUP BY doc_id, block",
    "bounded_excerpt": f"WITH {_LINES}, e AS (SELECT doc_id, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS \"end\" FROM raw), s AS (SELECT doc_id, \"end\" - length(text) - 100 AS start, \"end\" FROM e WHERE regexp_matches(lower(text), 'the [a-z]{{9}}')), m AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s), g AS (SELECT *, sum((far IS NULL OR start > far + 200)::INT) OVER (PARTITION BY doc_id ORDER BY start, \"end\") AS r FROM m) SELECT doc_id, min(start) AS start, max(\"end\") AS \"end\" FROM g GROUP BY doc_id, r",
    "tokenize": V.with_views("segments") + r", t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[.&''-][\p{L}\p{N}]+)*', 0), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")) AS t FROM segments) SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM t",
    "compress_context": V.with_views("segments") + ", raw AS (SELECT doc_id, unnest(ls) AS text, unnest(range(0, len(ls))) AS block, ls[-1] AS last FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM segments)), t AS (SELECT doc_id, block, text, list_distinct(" + _TOKENS.format(t="text") + ") AS a, list_distinct(" + _TOKENS.format(t="last") + r") AS b FROM raw), o AS (SELECT *, len(list_intersect(a, b)) AS overlap FROM t), r AS (SELECT *, count(*) OVER d AS n, max(overlap) OVER d AS best, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, block) AS rank FROM o WINDOW d AS (PARTITION BY doc_id)), p AS (SELECT *, n <= 6 OR len(b) = 0 OR best = 0 AS whole, CASE WHEN rank <= 6 AND overlap > 0 THEN 1 ELSE 0 END AS pick FROM r), k AS (SELECT doc_id, whole OR max(pick) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 OR regexp_matches(text, '\d') AS kept FROM p) SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE kept) AS kept FROM k GROUP BY doc_id",
    "mojibake_repair": "SELECT doc_id, sha256(coalesce(text, '')) AS repaired_sha256 FROM documents",
}
