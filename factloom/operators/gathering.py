"""Evidence for requests: several rankings of parents with weights, merged over the requests of a question; and excerpts around what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import nearest
from factloom.operators.datasets import _keys
from factloom.operators.gold import NUMBER, number_key, number_keys
from factloom.operators.retrieval import _TOKENS, QUERY_ROWS, RRF, _bm25, best_hits
from factloom.sources import views as V
from factloom.sources.shared import hinted, written

#: Hits of a query that count, the weight of numbers, the score of a window around an asked number.
HITS, NUMBERS, EXACT = 36, 4.0, 10.0
#: Characters of an excerpt, of a window and between windows, of a speaker's part, and in which a line end is looked for before and after.
EXCERPT, WINDOW, LEAST, STEP, SPEAKER, BEFORE, AFTER = 6000, 2400, 1000, 700, 500, 300, 500
OMITTED = "[source text omitted]"


def _terms(text: Column) -> Column:
    """Distinct terms, and the numbers as terms of their own kind."""
    return F.array_distinct(F.concat(F.transform(T.tokens(text), lambda t: F.concat(F.lit("t"), t)), F.transform(T.number_keys(text), lambda n: F.concat(F.lit("n"), n))))


def hint_scores(requests: DataFrame, chunks: DataFrame, kept: int) -> DataFrame:
    """spec_id, req_ord, parent_id, score, coverage: of each hint the ``kept`` parents of the source with most of its numbers, then of its terms.

    A parent's terms are those of its chunks, of which only the asked ones travel. Parents without any match can't rank before others, so
    only matches meet. The hints are the query side: they are counted, and up to QUERY_ROWS of their terms go to the tasks (nearest.py).
    """
    asked = requests.select("spec_id", "req_ord", "source", F.col("doc_type").alias("_d"), F.posexplode("hints").alias("hint", "_t")).withColumn("_terms", _terms(F.col("_t")))
    many = lambda kind: F.size(F.filter("_terms", lambda t: t.startswith(kind)))
    asked = written(asked.withColumns({"nt": many("t"), "nn": many("n")}).filter("nt > 0"), "hints")
    rows = asked.agg(F.sum(F.size("_terms"))).first()[0] or 0
    kind = F.col("doc_type").alias("kind")
    wanted = asked.select("source", F.explode("_terms").alias("term")).groupBy("source").agg(F.collect_set("term").alias("_want"))
    have = chunks.select(F.col("ticker").alias("source"), kind, "parent_id", _terms(F.col("text")).alias("_have")).join(hinted(wanted, rows, QUERY_ROWS), "source")
    have = have.select("source", "kind", "parent_id", F.array_intersect("_have", "_want").alias("_have")).filter(F.size("_have") > 0)
    have = written(have.groupBy("source", "kind", "parent_id").agg(F.array_distinct(F.flatten(F.collect_list("_have"))).alias("terms")), "parent_terms")
    if rows <= QUERY_ROWS:
        listed = asked.select("spec_id", "req_ord", "hint", "source", "_d", "_terms").collect()
        sent = chunks.sparkSession.sparkContext.broadcast([(r["source"], r["_d"], r["_terms"]) for r in listed])
        types = dict(asked.dtypes) | dict(chunks.dtypes)
        found = written(have.mapInPandas(nearest.hint_scorer(sent, kept), f"q int, parent_id {types['parent_id']}, numeric double, coverage double"), "matches")
        named = chunks.sparkSession.createDataFrame([(q, r["spec_id"], r["req_ord"], r["hint"]) for q, r in enumerate(listed)], f"q int, spec_id {types['spec_id']}, req_ord {types['req_ord']}, hint int")
        scored = found.join(named.hint("broadcast"), "q")
    else:
        met = have.withColumn("term", F.explode("terms")).drop("terms").join(asked.withColumn("term", F.explode("_terms")).drop("_terms", "_t").hint("merge"), ["source", "term"]).filter(F.col("_d").isNull() | (F.col("_d") == F.col("kind")))
        is_number = F.col("term").startswith("n").cast("int")
        counts = met.groupBy("spec_id", "req_ord", "hint", "parent_id", "nt", "nn").agg(F.sum(1 - is_number).alias("t"), F.sum(is_number).alias("n"))
        scored = counts.withColumns({"coverage": F.col("t") / F.col("nt"), "numeric": F.when(F.col("nn") > 0, F.col("n") / F.col("nn")).otherwise(0.0)})
    rank = F.row_number().over(W.partitionBy("spec_id", "req_ord", "hint").orderBy(F.desc("numeric"), F.desc("coverage"), "parent_id"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= kept).filter("coverage > 0")
    return best.select("spec_id", "req_ord", "parent_id", (1.0 / F.col("rank") + F.col("coverage") + NUMBERS * F.col("numeric")).alias("score"), "coverage")


def query_scores(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """spec_id, req_ord, parent_id, score, coverage of each hit of each distinct hint and of the question, by BM25 in the request's source."""
    each = requests.select("spec_id", "req_ord", F.col("source").alias("ticker"), "doc_type", F.explode(F.array_distinct(F.concat("hints", F.array("question")))).alias("text"))
    each = written(each.withColumn("question_id", F.concat_ws("/", "spec_id", "req_ord", F.md5("text"))), "queries")
    hits = best_hits(chunks, each.select("question_id", "text"), each.select("question_id", F.lit(0).alias("grp_ord"), "ticker", "doc_type", F.lit(HITS).alias("k")))[0]
    hits = hits.join(each.select("question_id", "spec_id", "req_ord").hint("merge"), "question_id")
    return hits.select("spec_id", "req_ord", "parent_id", (1.0 / (RRF + F.col("rank"))).alias("score"), "coverage")


def weighted_evidence(requests: DataFrame, chunks: DataFrame, kept: int = 4) -> DataFrame:
    """spec_id, evidence_id, parent_id, requests, score, coverage: the best parents of each request, once for each question, in the order of its requests.

    requests: spec_id, req_ord, request_id, source, doc_type (null: any), hints (array), question; chunks: child_id, parent_id,
    ticker, doc_type, text. kept: parents of a request, and of each hint's ranking.
    """
    both = hint_scores(requests, chunks, kept).unionByName(query_scores(requests, chunks))
    summed = both.groupBy("spec_id", "req_ord", "parent_id").agg(F.round(F.sum("score"), 9).alias("score"), F.max("coverage").alias("coverage"))
    rank = F.row_number().over(W.partitionBy("spec_id", "req_ord").orderBy(F.desc("score"), "parent_id"))
    best = written(summed.withColumn("_r", rank).filter(F.col("_r") <= kept).drop("_r"), "best")
    named = best.join(requests.select("spec_id", "req_ord", "request_id").hint("merge"), ["spec_id", "req_ord"])
    merged = named.groupBy("spec_id", "parent_id").agg(F.min("req_ord").alias("_first"), F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.transform(F.array_sort(F.collect_list(F.struct("req_ord", "request_id"))), lambda x: x["request_id"]).alias("requests"))
    place = F.row_number().over(W.partitionBy("spec_id").orderBy("_first", F.desc("score"), "parent_id"))
    return merged.select("spec_id", F.concat(F.lit("E"), place.cast("string")).alias("evidence_id"), "parent_id", "requests", "score", "coverage")


def number_places(texts: DataFrame, id_col: str, targets: Column) -> DataFrame:
    """id_col and _at, the starts of the numbers of each text that are among its targets (array of keys); no text travels with them."""
    cut = texts.select(id_col, targets.alias("_want"), F.regexp_extract_all("text", F.lit(NUMBER), 0).alias("_n"), F.transform(F.split("text", NUMBER, -1), F.length).alias("_g")).filter(F.size("_want") > 0)
    each = cut.select(id_col, "_want", F.posexplode(F.arrays_zip("_n", "_g")).alias("_i", "_x")).filter("_x._n is not null")
    end = F.sum(F.col("_x._g") + F.length("_x._n")).over(W.partitionBy(id_col).orderBy("_i"))
    return each.withColumn("_s", end - F.length("_x._n")).filter(F.array_contains("_want", number_key(F.col("_x._n")))).groupBy(id_col).agg(F.collect_list(F.col("_s").cast("int")).alias("_at"))


def focused_excerpts(texts: DataFrame, id_col: str, most: int = EXCERPT) -> DataFrame:
    """id_col, spans (start, end), excerpt: of a text over ``most`` characters the windows that hold most of the queries, without overlaps.

    texts: id_col (distinct), text, queries (array). Windows stand every STEP characters and around each number that is asked
    for (years aside), end at lines where one is near, and are taken by score, then by place, while they fit. A
    speaker's part at the start is kept. Without any hit the start of the text stays.
    """
    given = texts.select(id_col, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("queries", F.array().cast("array<string>")).alias("queries"))
    year = lambda n: n.rlike(r"^\d{1,9}$") & F.coalesce(n.try_cast("int").between(1900, 2100), F.lit(False))
    asked = F.filter(F.array_distinct(F.flatten(F.transform("queries", number_keys))), lambda n: ~year(n))
    long_ = given.filter(F.length("text") > most)
    met = long_.join(number_places(long_, id_col, asked).withColumnRenamed(id_col, "_nid").hint("merge"), F.col(id_col) == F.col("_nid"), "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    speaker = F.substring("text", 1, 1000).rlike(r"(?i)\[SPEAKER:[^\]]+\]")
    met = met.withColumns({"_len": F.length("text"), "_talk": F.when(speaker, SPEAKER).otherwise(0)}).withColumn("_w", F.least(F.lit(WINDOW), F.greatest(F.lit(LEAST), most - F.col("_talk"))))
    text, size, w = F.col("text"), F.col("_len"), F.col("_w")
    met = met.withColumn("_profiles", F.transform("queries", lambda q: F.struct(F.array_distinct(T.tokens(q)).alias("t"), number_keys(q).alias("n"))))
    share = lambda have, want: F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)

    def score(window: Column) -> Column:
        held = F.struct(F.array_distinct(T.tokens(window)).alias("t"), number_keys(window).alias("n"))
        return T.let(held, lambda h: F.coalesce(F.array_max(F.transform("_profiles", lambda p: share(h["t"], p["t"]) + NUMBERS * share(h["n"], p["n"]))), F.lit(0.0)))

    def aligned(points: Column, start: Column, end: Column) -> Column:
        low = F.greatest(F.lit(0), start - BEFORE)
        back = F.locate("\n", F.reverse(F.substring(text, low + 1, start - low)))
        on = F.locate("\n", F.substring(text, end + 1, F.least(F.lit(AFTER), size - end)))
        return F.struct((-points).alias("score"), F.when(back > 0, start - back + 1).otherwise(start).alias("start"), F.when(on > 0, end + on - 1).otherwise(end).alias("end"))

    last = F.when(size <= w, F.lit(0)).otherwise(F.ceil((size - w) / STEP).cast("int") * STEP)
    sliding = F.transform(F.sequence(F.lit(0), last, F.lit(STEP)), lambda s: aligned(score(F.substring(text, s + 1, w)), s, F.least(size, s + w)))

    def around(at: Column) -> Column:
        end = F.least(size, F.greatest(F.lit(0), at - F.floor(w / 2).cast("int")) + w)
        return aligned(F.lit(EXACT), F.greatest(F.lit(0), end - w), end)

    order = F.array_sort(F.concat(F.transform("_at", around), sliding))
    room = F.greatest(F.lit(1), F.floor((most - F.col("_talk")) / w))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    take = lambda s, c: F.when((c["score"] < 0) & (F.size(s) < room) & ~F.exists(s, lambda o: (c["start"] < o["end"]) & (c["end"] > o["start"])), F.array_append(s, F.struct(c["start"].alias("start"), c["end"].alias("end")))).otherwise(s)
    met = met.withColumn("spans", F.aggregate(order, empty, take))
    said = F.regexp_instr(F.substring("text", 1, 1000), F.lit(r"(?i)\[SPEAKER:[^\]]+\]")) - 1
    head = F.when((F.col("_talk") > 0) & ~F.exists("spans", lambda s: (s["start"] <= said) & (said < s["end"])), F.array(F.substring(text, 1, SPEAKER))).otherwise(F.array().cast("array<string>"))
    cut = F.transform("spans", lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    some = F.concat(F.array_join(F.concat(head, cut), f"\n\n{OMITTED}\n\n\n"), F.lit(f"\n\n\n{OMITTED}"))
    bare = F.concat(F.substring(text, 1, most), F.lit("\n\n\n[later text omitted]"))
    out = met.select(id_col, "spans", F.when(F.size("spans") > 0, some).otherwise(bare).alias("excerpt"))
    return given.filter(F.length("text") <= most).select(id_col, empty.alias("spans"), F.col("text").alias("excerpt")).unionByName(out)


# -- queries ----------------------------------------------------------------------------------------


def q_weighted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asks two groups, with its first ten words and the six after them as hints."""
    w = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    hints = F.array(F.array_join(F.slice(w, 1, 10), " "), F.array_join(F.slice(w, 11, 6), " "))
    asks = V.questions(spark, sf_dir).select("question_id", F.col("text").alias("question"), hints.alias("hints")).join(V.question_groups(spark, sf_dir).hint("merge"), "question_id")
    asks = written(asks.select(F.col("question_id").alias("spec_id"), F.col("grp_ord").alias("req_ord"), F.concat(F.lit("r"), F.col("grp_ord").cast("string")).alias("request_id"), F.col("ticker").alias("source"), "doc_type", "hints", "question"), "asks")
    out = weighted_evidence(asks, V.chunks(spark, sf_dir))
    return out.select("spec_id", "evidence_id", "parent_id", F.array_join("requests", ",").alias("requests"), F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def q_focused_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each asked with some of its own words and with a word of the next."""
    w = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    n = F.size(w)
    queries = F.array(F.array_join(F.slice(w, F.greatest(F.lit(1), n - 40), F.lit(6)), " "), F.array_join(F.slice(w, F.greatest(F.lit(1), F.floor(n / 2).cast("int")), F.lit(3)), " "))
    out = focused_excerpts(V.segments(spark, sf_dir).select("doc_id", "text", F.transform(queries, lambda q: F.regexp_replace(q, "[0-9]", "")).alias("queries")), "doc_id")
    return out.select("doc_id", F.size("spans").cast("long").alias("windows"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


QUERIES = {k[2:]: f for k, f in dict(globals()).items() if k.startswith("q_")}

_SHARE = "len(list_intersect(w, {0})) / greatest(len({0}), 1)"
ORACLES = {
    "weighted_evidence": V.with_views("questions", "chunks")
    + ", "
    + V.SQL["question_groups"].replace("question_groups AS", "base_groups AS", 1)
    + r""", qw AS (SELECT question_id, text, regexp_extract_all(text, '(\S+)', 1) AS w FROM questions),
req AS (SELECT question_id AS spec_id, grp_ord AS req_ord, ticker, doc_type, text AS question, [array_to_string(w[1:10], ' '), array_to_string(w[11:16], ' ')] AS hints FROM qw JOIN base_groups USING (question_id)),
wq AS (SELECT concat_ws('/', spec_id, req_ord, md5(text)) AS question_id, * FROM (SELECT spec_id, req_ord, ticker, doc_type, unnest(list_distinct(list_append(hints, question))) AS text FROM req)),
question_groups AS (SELECT question_id, 0 AS grp_ord, ticker, doc_type FROM wq),"""
    + _bm25("wq", "w")
    + rf""",
hits AS (SELECT question_id, parent_id, coverage, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, child_id) AS rank FROM scoredw QUALIFY rank <= {HITS}),
have AS (SELECT DISTINCT ticker, doc_type, parent_id, unnest(list_concat(list_transform({_TOKENS}, lambda t: 't' || t), list_transform({_keys('text')}, lambda n: 'n' || n))) AS term FROM chunks),
ht AS (SELECT spec_id, req_ord, ticker, doc_type, hint, list_distinct(list_concat(list_transform({_TOKENS}, lambda t: 't' || t), list_transform({_keys('text')}, lambda n: 'n' || n))) AS terms FROM (SELECT *, unnest(hints) AS text, unnest([0, 1]) AS hint FROM req)),
hx AS (SELECT *, len(list_filter(terms, lambda t: starts_with(t, 't'))) AS nt, len(list_filter(terms, lambda t: starts_with(t, 'n'))) AS nn, unnest(terms) AS term FROM ht),
hc AS (SELECT spec_id, req_ord, hint, parent_id, count(*) FILTER (WHERE starts_with(hx.term, 't')) / any_value(nt) AS coverage, CASE WHEN any_value(nn) > 0 THEN count(*) FILTER (WHERE starts_with(hx.term, 'n')) / any_value(nn) ELSE 0 END AS numeric_ FROM hx JOIN have ON hx.term = have.term AND hx.ticker = have.ticker AND (hx.doc_type IS NULL OR hx.doc_type = have.doc_type) WHERE nt > 0 GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY spec_id, req_ord, hint ORDER BY numeric_ DESC, coverage DESC, parent_id) AS rank FROM hc QUALIFY rank <= 4),
parts AS (SELECT spec_id, req_ord, parent_id, 1.0::DOUBLE / rank + coverage + {NUMBERS} * numeric_ AS score, coverage FROM hr WHERE coverage > 0 UNION ALL SELECT spec_id, req_ord, parent_id, 1.0::DOUBLE / ({RRF} + rank), coverage FROM hits JOIN wq USING (question_id)),
summed AS (SELECT spec_id, req_ord, parent_id, round(sum(score), 9) AS score, max(coverage) AS coverage FROM parts GROUP BY ALL), best AS (SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY spec_id, req_ord ORDER BY score DESC, parent_id) <= 4),
merged AS (SELECT spec_id, parent_id, min(req_ord) AS f, max(score) AS score, max(coverage) AS coverage, string_agg('r' || req_ord, ',' ORDER BY req_ord) AS requests FROM best GROUP BY ALL)
SELECT spec_id, 'E' || row_number() OVER (PARTITION BY spec_id ORDER BY f, score DESC, parent_id) AS evidence_id, parent_id, requests, round(score, 6) AS score, round(coverage, 6) AS coverage FROM merged""",
    "focused_excerpt": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, regexp_extract_all(coalesce(text, ''), '(\S+)', 1) AS ws FROM documents),
q AS (SELECT doc_id, unnest([0, 1]) AS i, regexp_replace(unnest([array_to_string(ws[greatest(1, len(ws) - 40):greatest(1, len(ws) - 40) + 5], ' '), array_to_string(ws[greatest(1, len(ws) // 2):greatest(1, len(ws) // 2) + 2], ' ')]), '[0-9]', '', 'g') AS text FROM d WHERE n > {EXCERPT}),
p AS (SELECT doc_id, list(list_distinct({_TOKENS}) ORDER BY i) AS ps FROM q GROUP BY doc_id),
s AS (SELECT doc_id, text AS body, n, unnest(range(0, CASE WHEN n <= {WINDOW} THEN 1 ELSE ceil((n - {WINDOW}) / {STEP})::BIGINT * {STEP} + 1 END, {STEP})) AS s FROM d WHERE n > {EXCERPT}),
v AS (SELECT *, least(n, s + {WINDOW}) AS e, substr(body, s + 1, {WINDOW}) AS text FROM s),
t AS (SELECT v.*, list_distinct({_TOKENS.replace('text', 'v.text')}) AS w, ps FROM v JOIN p USING (doc_id)),
c AS (SELECT doc_id, list_max(list_transform(ps, lambda x: len(list_intersect(w, x)) / greatest(len(x), 1))) AS score, CASE WHEN s > 0 AND contains(substr(body, greatest(0, s - {BEFORE}) + 1, s - greatest(0, s - {BEFORE})), chr(10)) THEN s - instr(reverse(substr(body, greatest(0, s - {BEFORE}) + 1, s - greatest(0, s - {BEFORE}))), chr(10)) + 1 ELSE s END AS a,
 CASE WHEN contains(substr(body, e + 1, least({AFTER}, n - e)), chr(10)) THEN e + instr(substr(body, e + 1, least({AFTER}, n - e)), chr(10)) - 1 ELSE e END AS b FROM t),
o AS (SELECT doc_id, list({{'a': a, 'b': b}} ORDER BY score DESC, a, b) FILTER (WHERE score > 0) AS cs FROM c GROUP BY doc_id),
g AS (SELECT doc_id, CASE WHEN cs IS NULL THEN [] ELSE list_reduce(list_transform(cs, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < {EXCERPT // WINDOW} AND len(list_filter(acc, lambda y: x[1].a < y.b AND x[1].b > y.a)) = 0 THEN list_concat(acc, x) ELSE acc END) END AS sel FROM o)
SELECT d.doc_id, CASE WHEN n <= {EXCERPT} THEN 0 ELSE len(sel) END AS windows, sha256(CASE WHEN n <= {EXCERPT} THEN text WHEN len(sel) = 0 THEN substr(text, 1, {EXCERPT}) || repeat(chr(10), 3) || '[later text omitted]'
 ELSE array_to_string(list_transform(sel, lambda x: substr(text, x.a + 1, x.b - x.a)), chr(10) || chr(10) || '{OMITTED}' || repeat(chr(10), 3)) || repeat(chr(10), 3) || '{OMITTED}' END) AS excerpt_sha256 FROM d LEFT JOIN g USING (doc_id)""",
}
