r"""Questions: what they ask for, replies to a clarification, and answers against table values.

Patterns are matched on a normal form of a question: lower-case runs of letters and digits with two spaces
between them and one at each end, so that whole words need no word borders and two matches beside each other
don't share a space. The same tables of words make the columns and the SQL.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import views as V
from factloom.sources.shared import hinted, written

def phrases(*choices: str) -> tuple[str, ...]:
    """All phrases of one choice from each part; the choices of a part stand between bars, and may be empty."""
    return tuple(" ".join(" ".join(x).split()) for x in itertools.product(*[c.split("|") for c in choices]))


#: The words and phrases of each flag; items are those of the form.
FLAGS = {
    "all_tickers": (*phrases("all", "company|companies|ticker|tickers"), *phrases("each|every", "|of", "|the", "three|3", "company|companies|ticker|tickers"), *phrases("across|compare", "|all", "three|3")),
    "all_years": ("all years", "all available years", "2024 and 2025"),
    "compares": ("compare", "comparison", "versus", "vs", "difference", "differ", "higher", "lower", "between"),
    "out_of_scope": (
        "weather", "recipe", "sports score", "football score", "movie review", *phrases("write", "|me", "|a", "poem|story"), "translate this", "medical advice", "diagnose", "diagnosis", *phrases("generate", "python|java|javascript", "code"), "current stock price", "stock price today", "latest news",
        "real time", "live market", "price target", "capital of", "prime minister", "president of", "photosynthesis", "periodic table", *phrases("current|latest|live", "stock|share|market", "price"), *phrases("stock|share|market", "price", "right now|today|currently|now"),
    ),
    "domain": (
        "company", "companies", "business", "strategy", "operation", "operations", "product", "customer", "employee", "financial", "filing", "report", "earnings", "revenue", "income", "profit", "loss", "expense", "cash", "liquidity", "asset", "debt", "capital", "equity", "margin", "growth", "risk",
        "cybersecurity", "legal", "regulatory", "segment", "cloud", "azure", "automotive", "deliveries", "banking", "credit", "loan", "deposit", "guidance", "outlook", "gaap", "tax", "dividend", "repurchase", "shareholder", "stockholder", "executive", "board", "management", "performance", "result",
        "results", "nii", "cet1", "rotce", "eps", "capex", "fsd", "ai",
    ),
    "anaphora": ("that", "those", "it", "its", "they", "their", "them", "the same", "former", "latter"),
    "ten_k": ("10 k", "10 ks", "10k", "10ks", "annual report", "annual reports", "footnote", "footnotes", *(f"item {n}{part}" for n in range(1, 17) for part in ("", "a", "b", "c"))),
    "risk_factors": ("risk factor", "risk factors"),
    "transcript": ("transcript", "transcripts", *phrases("earnings|conference", "call|calls"), *phrases("prepared", "remark|remarks"), "q a", *phrases("question|questions", "and", "answer|answers"), "speaker", "who said", "management said"),
    "both_types": (*phrases("both", "document type|document types|source|sources"), *phrases("10 k|10k|10ks|10 ks", "and", "|the", "transcript|transcripts")),
    "latest_year": phrases("most recent|latest available|newest", "annual report|10 k|10k|filing|earnings call|transcript|year|result|results"),
    "table_words": ("tabular", "table", *phrases("row|rows", "and", "column|columns")),
    "display": ("show", "give", "provide", "display", "present", "list"),
    "statement": (*phrases("balance", "sheet|sheets"), *phrases("statement|statements", "of", "operations|income|cash flow|cash flows|stockholders equity|shareholders equity|equity"), *phrases("income|cash flow", "statement|statements")),
    "whole": ("complete", "full", "entire", "whole", *phrases("all", "rows|columns|entries|data")),
    "projection": ("avg", "average", "mean", "min", "minimum", "max", "maximum", "only", "just"),
}
#: The topics, of which the first that a question has counts.
TOPICS = {
    "risk": ("risk", "risks", "risk factor", "risk factors", "cybersecurity", "litigation", "regulatory"), "liquidity": ("cash", "liquidity", "capital resource", "capital resources", "debt", "borrowing", "borrowings"), "performance": ("revenue", "income", "profit", "loss", "margin", "eps", "growth", "performance"),
    "segments": ("segment", "business line", "division", "automotive", "cloud", "banking"), "guidance": ("guidance", "outlook", "expect", "expects", "expected", "expectation", "forecast"), "governance": ("board", "director", "executive", "governance", "control", "controls", "audit"),
}
#: How a follow-up begins, and replies that are one.
FOLLOWS = r"^ (?:(?:and|also) )?(?:what|how) about |^ (?:why|how|explain|elaborate|continue)(?: (?:that|this|those|it))? $|^ (?:the )?(?:10 ?k|annual report|transcript|both) $"
DOCUMENT = r"10 ?ks?|annual reports?|sec filings?|earnings (?:transcripts?|calls?)|conference calls?|transcripts?"
YES, NO = r"^ (?:yes|yeah|yep|correct|right|confirm|confirmed|sure) ", r"^ (?:no|nope|incorrect|wrong) "
#: Companies that are known and not covered.
UNSUPPORTED = {"AAPL": ("AAPL", "APPLE"), "AMZN": ("AMZN", "AMAZON"), "GOOG": ("GOOG", "GOOGL", "GOOGLE", "ALPHABET"), "META": ("META", "FACEBOOK"), "NVDA": ("NVDA", "NVIDIA")}
#: Metrics of table answers; the first that a question has counts.
METRICS = (
    "total automotive revenues", "intelligent cloud operating income", "cash and cash equivalents", "total current liabilities", "short-term investments", "research and development expense", "energy generation and storage revenue",
    "automotive regulatory credits revenue", "total assets", "total revenue", "net income", "operating income", "gross profit", "gross margin",
)


def _spaced(pattern: str) -> str:
    return pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")


def said(phrase: str) -> str:
    """A phrase as it stands in the normal form."""
    return f" {phrase.replace(' ', '  ')} "


def whole(pattern: str) -> str:
    """The pattern of one of the words in the normal form."""
    return " (?:" + _spaced(pattern) + ") "


def plain(text: Column) -> Column:
    """The normal form."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "  ")), F.lit(" "))


def alias_terms(aliases: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """What the normal form must contain for each company; names of five letters or more may end in s."""
    out = {}
    for ticker, names in aliases.items():
        forms = ["  ".join(n.lower().split()) for n in names]
        out[ticker] = [f" {f} " for f in forms] + [f" {f}s " for f in forms if len(f.replace(" ", "")) >= 5]
    return out


def said_any(terms: list[str]) -> Column:
    """Whether the normal form _q has one of the terms (in it). _known has those of its words that any term has: one word is looked up there, and only a phrase whose first and last word are there is looked for in the text."""
    single, more = [t.strip() for t in terms if len(t.split()) == 1], [t for t in terms if len(t.split()) > 1]
    found = F.arrays_overlap("_known", F.array(*[F.lit(t) for t in single]).cast("array<string>"))
    if not more:
        return found
    parts = F.array(*[F.struct(F.lit(t.split()[0]).alias("first"), F.lit(t.split()[-1]).alias("last"), F.lit(t).alias("term")) for t in more])
    return found | F.exists(parts, lambda x: F.array_contains("_known", x["first"]) & F.array_contains("_known", x["last"]) & F.contains(F.col("_q"), x["term"]))


def annotate(questions: DataFrame, text_col: str, aliases: dict[str, tuple[str, ...]], years: tuple[str, ...]) -> DataFrame:
    """questions with what each asks for: companies, years, types of documents, topic and flags. Lists are joined by commas, in the order of the lists given.

    aliases: the names of each company, a short list; years: those that are covered.
    """
    q = F.col("_q")
    has = lambda words: said_any([said(w) for w in words])
    named = lambda known: F.array_compact(F.array(*[F.when(said_any(terms), F.lit(ticker)) for ticker, terms in alias_terms(known).items()]))
    base = questions.withColumn("_q", plain(F.col(text_col)))
    words = F.split(F.trim(q), "  ")
    terms = [said(w) for group in (*FLAGS.values(), *TOPICS.values()) for w in group] + [t for known in (aliases, UNSUPPORTED) for ts in alias_terms(known).values() for t in ts]
    base = base.withColumn("_known", F.array_intersect(words, F.array(*[F.lit(w) for w in sorted({w for t in terms for w in t.split()})])))
    base = base.withColumn("_mentioned", F.array_distinct(F.filter(words, lambda w: w.rlike(r"^(19|20)\d\d$"))))
    base = base.withColumn("_of_sources", F.array_distinct(F.regexp_extract_all(q, F.lit(rf" ((?:19|20)\d\d)  (?:{_spaced(DOCUMENT)}) "), 1)))
    base = base.withColumn("_tickers", named(aliases)).withColumn("_others", named(UNSUPPORTED))
    base = base.withColumns({f"_{k}": has(v) for k, v in FLAGS.items()})
    topic = F.coalesce(*[F.when(has(p), F.lit(name)) for name, p in TOPICS.items()])
    asked = F.when(F.size("_of_sources") > 0, F.col("_of_sources")).otherwise(F.col("_mentioned"))
    covered = F.array(*[F.lit(y) for y in years])
    inside, outside = F.array_intersect(asked, covered), F.array_except(asked, covered)
    reference = F.when(F.size("_of_sources") > 0, F.array_except("_mentioned", "_of_sources")).otherwise(F.array().cast("array<string>"))
    types = F.when(F.col("_both_types"), F.array(F.lit("10K"), F.lit("TRANSCRIPT"))).otherwise(F.array_compact(F.array(F.when(F.col("_ten_k") | (F.col("_risk_factors") & ~F.col("_transcript")), "10K"), F.when(F.col("_transcript"), "TRANSCRIPT"))))
    shown = F.col("_display") & F.col("_statement")
    table = F.col("_table_words") | shown
    joined = lambda c: F.array_join(c, ",")
    return base.select(
        *[F.col(c) for c in questions.columns], joined(F.col("_tickers")).alias("tickers"), joined(F.col("_others")).alias("unsupported_companies"), joined(inside).alias("years"), joined(outside).alias("unsupported_years"), joined(reference).alias("reference_years"),
        joined(types).alias("doc_types"), topic.alias("topic"), (F.col("_compares") | (F.size("_tickers") > 1) | (F.size(inside) > 1)).alias("comparison"), F.col("_all_tickers").alias("all_tickers"), F.col("_all_years").alias("all_years"),
        F.col("_out_of_scope").alias("out_of_scope"), F.col("_latest_year").alias("latest_year"), table.alias("wants_table"), (table & (F.col("_whole") | (((F.col("_display") & F.col("_table_words")) | shown) & ~F.col("_projection")))).alias("wants_complete_table"),
        (q.rlike(_follows(FOLLOWS)) | ((F.size("_tickers") == 0) & F.col("_anaphora"))).alias("followup"), (F.col("_domain") | topic.isNotNull() | (F.size("_tickers") > 0) | (F.size(inside) > 0) | (F.size(types) > 0)).alias("domain_relevant"),
    )


def _follows(pattern: str) -> str:
    """Anchored patterns: one space at each end, two between words."""
    out = []
    for part in pattern.split("|^"):
        part = part.removeprefix("^")
        end = " $" if part.endswith(" $") else " "
        body = part.removeprefix(" ").removesuffix(end)
        out.append("^ " + _spaced(body) + end)
    return "|".join(out)


def merge_clarification(pending: DataFrame, reply: DataFrame) -> DataFrame:
    """id, tickers, years, doc_types, merged: a short reply (annotated, with is_yes and is_no) fills what is missing of a pending question.

    A reply with a topic, or with no scope and neither yes nor no, is a new question: merged is false. A company in
    the reply replaces the pending ones; yes confirms a single candidate; no drops candidates and companies.
    """
    r = reply.select("id", *[F.col(c).alias(f"r_{c}") for c in ("tickers", "years", "doc_types", "topic")], "is_yes", "is_no")
    met = pending.join(r.hint("merge"), "id")
    said = (F.col("r_tickers") != "") | (F.col("r_years") != "") | (F.col("r_doc_types") != "")
    merged = F.col("r_topic").isNull() & (F.col("is_yes") | F.col("is_no") | said)
    one = (F.size("candidates") == 1) & F.col("is_yes")
    tickers = F.when(F.col("r_tickers") != "", F.col("r_tickers")).when(one, F.array_join("candidates", ",")).when(F.col("is_no") & (F.size("candidates") > 0), "").otherwise(F.col("tickers"))
    years = F.when(F.col("r_years") != "", F.col("r_years")).otherwise(F.col("years"))
    types = F.when(F.col("r_doc_types") != "", F.col("r_doc_types")).otherwise(F.col("doc_types"))
    return met.select("id", F.when(merged, tickers).alias("tickers"), F.when(merged, years).alias("years"), F.when(merged, types).alias("doc_types"), merged.alias("merged"))


def semantic_apply(understood: DataFrame, suggested: DataFrame, supported: list[str]) -> DataFrame:
    """id, tickers, years, reference_years, unsupported, candidates, ambiguous, accepted, followup: only what a question or its past proves is taken from a suggestion.

    understood: id, text, tickers, years, unsupported_companies (lists joined by commas, as annotate() gives them). suggested: id, candidates,
    mentions, period (earlier, later or none), fields, previous_tickers, previous_years. A mention counts where it stands in the question with a
    capital; a candidate where it is the one company of the previous scope; a year where the previous scope has two.
    """
    known = F.array(*[F.lit(x.lower()) for x in supported])
    place = lambda m: F.instr(F.lower("pad"), F.concat(F.lit(" "), F.lower(m), F.lit(" ")))
    said = lambda m: F.substring(F.col("pad"), place(m) + 1, F.length(m))
    met = understood.select("id", "text", "tickers", "years", "unsupported_companies").join(suggested.hint("merge"), "id")
    met = met.withColumn("pad", F.concat(F.lit(" "), F.regexp_replace("text", r"[^\p{L}\p{N}_]+", " "), F.lit(" "))).withColumn("candidates", F.array_intersect("candidates", F.array(*[F.lit(x) for x in supported])))
    found = F.array_distinct(F.transform(F.filter("mentions", lambda m: (place(m) > 0) & ~F.array_contains(known, F.lower(m)) & said(m).rlike("[A-Z]")), said))
    met = met.withColumn("found", found)
    company, year = F.col("tickers") != "", F.col("years") != ""
    inherited = ~company & (F.size("candidates") == 1) & (F.col("candidates") == F.col("previous_tickers"))
    unsure = ~company & (F.size("candidates") > 0) & ~inherited
    ends = F.array_sort(F.array_distinct("previous_years"))
    relative = ~year & (F.col("period") != "none")
    derived = relative & (F.size(ends) == 2)
    target = F.when(F.col("period") == "later", F.get(ends, F.lit(1))).otherwise(F.get(ends, F.lit(0)))
    other = F.when(F.col("period") == "later", F.get(ends, F.lit(0))).otherwise(F.get(ends, F.lit(1)))
    fields = F.filter("fields", lambda f: ~((f == "company") & company) & ~(f.isin("year", "comparison years") & (year | derived)))
    ambiguous = F.array_distinct(F.concat(F.array_compact(F.array(F.when(unsure, "company"), F.when(relative & ~derived, "comparison years"))), fields))
    accepted = F.array_compact(F.array(F.when(F.size("found") > 0, "explicit unsupported company"), F.when(inherited, "company inherited from previous scope"), F.when(derived, "year derived from previous two-year scope")))
    joined = lambda c: F.array_join(c, ",")
    return met.select(
        "id", "tickers", F.when(derived, target).otherwise(F.col("years")).alias("years"), F.when(derived, other).alias("reference_years"), F.concat_ws(",", F.nullif("unsupported_companies", F.lit("")), F.nullif(joined("found"), F.lit(""))).alias("unsupported"),
        joined("candidates").alias("candidates"), joined(ambiguous).alias("ambiguous"), joined(accepted).alias("accepted"), (inherited | derived).alias("followup"),
    )


NUMBER = r"(?:^|[^A-Za-z0-9_.])(-?\(?\$?\s*\d[\d,]*(?:\.\d+)?\)?(?:\s*billion)?)"


def answer_amounts(answer: Column) -> Column:
    """array of (value, tolerance): the amounts of an answer in millions; billions stand for rounded figures, with half a unit of their last place."""

    def of(raw: Column) -> Column:
        billion = raw.endswith("billion")
        digits = F.regexp_replace(raw, r"[^0-9.]", "")
        places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
        minus = F.contains(raw, F.lit("(")) | F.contains(raw, F.lit("-"))
        value = digits.cast("decimal(28,6)") * F.when(minus, -1).otherwise(1) * F.when(billion, 1000).otherwise(1)
        return F.struct(value.cast("decimal(38,6)").alias("value"), F.when(billion, (F.lit(500.0) / F.pow(F.lit(10.0), places)).cast("decimal(38,6)")).otherwise(F.lit(0).cast("decimal(38,6)")).alias("tolerance"))

    wide = F.regexp_replace(F.lower(F.coalesce(answer, F.lit(""))), " ", "  ")
    return F.transform(F.regexp_extract_all(wide, F.lit(NUMBER), 1), of)


def table_value_check(answers: DataFrame, values: DataFrame) -> DataFrame:
    """id, passed, reason: an answer to a question for one metric and one year must hold the unique value that a table has for them.

    answers: id, scope, question, answer; values: scope, metric (as in METRICS), year, value (decimal, millions). Questions for combined amounts, without
    a known metric or with several years, answers without amounts and values that aren't unique are inconclusive and pass.
    """
    q = plain(F.col("question"))
    metric = F.coalesce(*[F.when(F.contains(F.col("_q"), F.lit(" " + "  ".join(m.replace("-", " ").split()) + " ")), F.lit(m)) for m in METRICS])
    asked = answers.withColumn("_q", q).withColumn("_years", F.array_distinct(F.filter(F.split(F.trim("_q"), "  "), lambda w: w.rlike(r"^(19|20)\d\d$"))))
    asked = asked.withColumns({"metric": metric, "year": F.when(F.size("_years") == 1, F.get("_years", F.lit(0))), "amounts": answer_amounts(F.col("answer")), "composite": F.col("_q").rlike(whole("combined|sum of|total of"))})
    unique = written(values.groupBy("scope", "metric", "year").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).filter("n = 1").drop("n"), "values")
    met = asked.join(hinted(unique, unique.count(), 100_000), ["scope", "metric", "year"], "left")
    hit = F.exists("amounts", lambda a: F.abs(a["value"] - F.col("value")) <= a["tolerance"])
    reason = (
        F.when(F.col("composite"), "composite question").when(F.col("metric").isNull() | F.col("year").isNull(), "not applicable").when(F.size("amounts") == 0, "no numeric claim")
        .when(F.col("value").isNull(), "inconclusive").when(hit, "verified").otherwise("value missing from the answer")
    )
    return met.select("id", (reason != "value missing from the answer").alias("passed"), reason.alias("reason"))


# -- queries ----------------------------------------------------------------------------------------

ALIASES = {f"src{i}": (f"SRC{i}", f"SOURCE {i}", f"SOURCECO{chr(65 + i)}") for i in range(20)}
YEARS = ("2024", "2025")
#: Heads of questions by the number of the document, before its whole text.
HEADS = (
    "Compare SRC{a} and SourceCo{c}'s risk factors in the 2024 10-K", "Show the complete income statement of Source {a} for 2023 and 2025", "What about that?", "What did management say in the 2025 earnings call of SRC{a} versus 2024", "Is Apple's stock price today higher", "Give me a table of only the average revenue",
    "the latest available annual report",
)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as questions, each after a head in which a company follows from the source."""
    d = V.table(spark, sf_dir, "documents")
    number = F.regexp_replace("source", "src", "")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRST"), F.try_add(number.cast("int"), F.lit(1)), F.lit(1))
    head = F.get(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS)).cast("int"))
    head = F.replace(F.replace(head, F.lit("{a}"), number), F.lit("{c}"), letter)
    return d.select(F.col("doc_id").alias("id"), F.concat(head, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


def q_annotate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(asked(spark, sf_dir), "text", ALIASES, YEARS).drop("text")


#: Replies by the number of the document.
REPLIES = ("yes, that one", "no", "SRC3 please", "the 10-K for 2025", "both document types", "SRC1 and SRC2 in 2024", "what are the risks of SRC4", "")


def q_clarification_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's source pending with one or two candidates; a reply by its number, and for every ninth its whole text."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("id")
    pending = d.select("id", F.when(i % 3 == 0, F.col("source")).otherwise("").alias("tickers"), F.when(i % 4 == 0, "2024").otherwise("").alias("years"), F.when(i % 5 == 0, "TRANSCRIPT").otherwise("").alias("doc_types"), F.when(i % 2 == 0, F.array(F.concat("source", F.lit("x")))).otherwise(F.array(F.lit("src0"), F.lit("src1"))).alias("candidates"))
    said = F.when(i % 9 == 8, F.col("text")).otherwise(F.get(F.array(*[F.lit(r) for r in REPLIES]), (i % len(REPLIES)).cast("int")))
    reply = annotate(d.select("id", said.alias("text")), "text", ALIASES, YEARS)
    reply = reply.withColumns({"is_yes": plain(F.col("text")).rlike(YES), "is_no": plain(F.col("text")).rlike(NO)})
    return merge_clarification(pending, reply)


def q_table_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question a fact; answers with the value, in billions, with another value, with none, with two years; every tenth value is given twice."""
    name = F.replace("metric", F.lit("_"), F.lit(" "))
    f = written(V.facts(spark, sf_dir).filter(F.col("metric").isin("total_revenue", "net_income", "operating_income", "total_assets", "cash_and_cash_equivalents", "total_debt")).select("ticker", name.alias("metric"), F.col("fiscal_year").cast("string").alias("year"), F.round(F.col("base_value") / 1000, 2).cast("decimal(38,2)").alias("value")), "facts")
    k = F.abs(F.pmod(F.col("value") * 100, F.lit(7))).cast("int")
    again = f.filter((F.pmod(F.col("value") * 100, F.lit(10)) == 0)).withColumn("value", F.col("value") + 1)
    values = f.unionByName(again).select(F.col("ticker").alias("scope"), "metric", "year", F.col("value").cast("decimal(38,6)").alias("value"))
    plain_ = F.col("value").cast("string")
    answer = F.when(k == 0, F.concat(F.lit("It was $"), plain_, F.lit(" million."))).when(k == 1, F.concat(F.lit("About "), F.round(F.col("value") / 1000, 1).cast("decimal(38,1)").cast("string"), F.lit(" billion dollars"))).when(k == 2, F.concat(F.lit("It was "), (F.col("value") + 3).cast("string"))).when(k == 3, "It grew.").otherwise(F.concat(F.lit("Between 5 and "), plain_))
    question = F.concat(F.when(k == 5, "What was the sum of ").otherwise("What was "), "metric", F.lit(" in "), "year", F.when(k == 6, " and 1990").otherwise(""), F.lit("?"))
    rows = f.select(F.concat_ws(":", "ticker", "metric", "year").alias("id"), F.col("ticker").alias("scope"), question.alias("question"), answer.alias("answer"))
    return table_value_check(rows, values)


def q_semantic_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for whole documents as questions: companies, names that some heads have, years by the number of the document."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    i = F.col("id")
    candidates = F.when(i % 3 == 0, F.array("source")).when(i % 3 == 1, F.array(F.lit("src3"), F.lit("nowhere"), F.lit("src4"))).otherwise(F.array().cast("array<string>"))
    mentions = F.array(F.lit("Apple"), F.lit("src1"), F.lit("income statement"), F.lit("Give me"), F.lit("K"))
    period = F.when(i % 4 == 0, "later").when(i % 4 == 1, "earlier").otherwise("none")
    fields = F.when(i % 5 < 2, F.array(F.lit("company"), F.lit("year"))).when(i % 5 == 2, F.array(F.lit("comparison years"), F.lit("document type"))).otherwise(F.array().cast("array<string>"))
    years = F.when(i % 2 == 0, F.array(F.lit("2025"), F.lit("2024"))).otherwise(F.array(F.lit("2024")))
    suggested = d.select("id", candidates.alias("candidates"), mentions.alias("mentions"), period.alias("period"), fields.alias("fields"), F.when(i % 7 < 5, F.array("source")).otherwise(F.array().cast("array<string>")).alias("previous_tickers"), years.alias("previous_years"))
    return semantic_apply(annotate(asked(spark, sf_dir), "text", ALIASES, YEARS), suggested, list(ALIASES))


QUERIES = {"annotate_questions": q_annotate_questions, "clarification_merge": q_clarification_merge, "table_value_check": q_table_value_check, "semantic_apply": q_semantic_apply}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _annotate_sql(source: str) -> str:
    has = lambda words: f"len(list_filter([{', '.join(_sql_text(said(w)) for w in words)}], lambda w: contains(q, w))) > 0"
    named = lambda known: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(q, {_sql_text(t)})" for t in terms) + f" THEN {_sql_text(ticker)} END" for ticker, terms in alias_terms(known).items()) + "], lambda x: x IS NOT NULL)"
    topic = "CASE " + " ".join(f"WHEN {has(p)} THEN {_sql_text(t)}" for t, p in TOPICS.items()) + " END"
    flags = ", ".join(f"{has(p)} AS f_{k}" for k, p in FLAGS.items())
    years = "[" + ", ".join(_sql_text(y) for y in YEARS) + "]"
    keep = lambda a, test: f"list_filter({a}, lambda x: {test})"
    first = lambda a: f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"
    return rf"""n1 AS (SELECT id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', '  ', 'g')) || ' ' AS q FROM {source}),
n2 AS (SELECT id, q, list_filter(string_split(trim(q), '  '), lambda w: regexp_matches(w, '^(19|20)\d\d$')) AS m0, regexp_extract_all(q, {_sql_text(rf' ((?:19|20)\d\d)  (?:{_spaced(DOCUMENT)}) ')}, 1) AS s0, {named(ALIASES)} AS tk, {named(UNSUPPORTED)} AS un, {topic} AS topic, {flags} FROM n1),
n3 AS (SELECT *, {first('m0')} AS m, {first('s0')} AS s FROM n2), n4 AS (SELECT *, CASE WHEN len(s) > 0 THEN s ELSE m END AS a FROM n3), n5 AS (SELECT *, {keep('a', f'list_contains({years}, x)')} AS y, {keep('a', f'NOT list_contains({years}, x)')} AS o,
 CASE WHEN f_both_types THEN ['10K', 'TRANSCRIPT'] ELSE list_filter([CASE WHEN f_ten_k OR (f_risk_factors AND NOT f_transcript) THEN '10K' END, CASE WHEN f_transcript THEN 'TRANSCRIPT' END], lambda x: x IS NOT NULL) END AS dt, f_display AND f_statement AS shown FROM n4),
annotated AS (SELECT id, array_to_string(tk, ',') AS tickers, array_to_string(un, ',') AS unsupported_companies, array_to_string(y, ',') AS years, array_to_string(o, ',') AS unsupported_years, CASE WHEN len(s) > 0 THEN array_to_string({keep('m', 'NOT list_contains(s, x)')}, ',') ELSE '' END AS reference_years, array_to_string(dt, ',') AS doc_types, topic,
 f_compares OR len(tk) > 1 OR len(y) > 1 AS comparison, f_all_tickers AS all_tickers, f_all_years AS all_years, f_out_of_scope AS out_of_scope, f_latest_year AS latest_year, f_table_words OR shown AS wants_table, (f_table_words OR shown) AND (f_whole OR (((f_display AND f_table_words) OR shown) AND NOT f_projection)) AS wants_complete_table,
 regexp_matches(q, {_sql_text(_follows(FOLLOWS))}) OR (len(tk) = 0 AND f_anaphora) AS followup, f_domain OR topic IS NOT NULL OR len(tk) > 0 OR len(y) > 0 OR len(dt) > 0 AS domain_relevant FROM n5)"""


_HEADS = "[" + ", ".join(_sql_text(h) for h in HEADS) + "]"
_REPLIES = "[" + ", ".join(_sql_text(r) for r in REPLIES) + "]"
_PLAIN = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', '  ', 'g')) || ' '"
_AMOUNT = rf"regexp_extract_all(regexp_replace(lower(answer), ' ', '  ', 'g'), '{NUMBER}', 1)"
ORACLES = {
    "annotate_questions": f"WITH asked AS (SELECT doc_id AS id, replace(replace({_HEADS}[(doc_id % {len(HEADS)})::INT + 1], '{{a}}', replace(source, 'src', '')), '{{c}}', substr('ABCDEFGHIJKLMNOPQRST', replace(source, 'src', '')::INT + 1, 1)) || '. ' || coalesce(text, '') AS text FROM documents), " + _annotate_sql("asked") + " SELECT * FROM annotated",
    "clarification_merge": f"WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS tickers, CASE WHEN doc_id % 4 = 0 THEN '2024' ELSE '' END AS years, CASE WHEN doc_id % 5 = 0 THEN 'TRANSCRIPT' ELSE '' END AS doc_types, CASE WHEN doc_id % 2 = 0 THEN [source || 'x'] ELSE ['src0', 'src1'] END AS cand, CASE WHEN doc_id % 9 = 8 THEN coalesce(text, '') ELSE {_REPLIES}[(doc_id % {len(REPLIES)})::INT + 1] END AS text FROM documents), rp AS (SELECT id, text FROM p), "
    + _annotate_sql("rp") + f", m AS (SELECT p.*, a.tickers AS rt, a.years AS ry, a.doc_types AS rd, topic, regexp_matches({_PLAIN}, '{YES}') AS is_yes, regexp_matches({_PLAIN}, '{NO}') AS is_no FROM p JOIN annotated a USING (id)), g AS (SELECT *, topic IS NULL AND (is_yes OR is_no OR rt <> '' OR ry <> '' OR rd <> '') AS merged FROM m) SELECT id, CASE WHEN merged THEN CASE WHEN rt <> '' THEN rt WHEN is_yes AND len(cand) = 1 THEN cand[1] WHEN is_no THEN '' ELSE tickers END END AS tickers, CASE WHEN merged THEN CASE WHEN ry <> '' THEN ry ELSE years END END AS years, CASE WHEN merged THEN CASE WHEN rd <> '' THEN rd ELSE doc_types END END AS doc_types, merged FROM g",
    "table_value_check": V.with_views("facts") + rf""", f AS (SELECT ticker, replace(metric, '_', ' ') AS metric, fiscal_year::VARCHAR AS year, round(base_value / 1000, 2)::DECIMAL(38,2) AS value FROM facts WHERE metric IN ('total_revenue', 'net_income', 'operating_income', 'total_assets', 'cash_and_cash_equivalents', 'total_debt')),
v AS (SELECT ticker, metric, year, min(value) AS value FROM (SELECT * FROM f UNION ALL SELECT ticker, metric, year, value + 1 FROM f WHERE (value * 100)::HUGEINT % 10 = 0) GROUP BY ALL HAVING count(DISTINCT value) = 1),
r AS (SELECT *, (((value * 100)::HUGEINT % 7) + 7) % 7 AS k FROM f), x AS (SELECT *, CASE k WHEN 0 THEN 'It was $' || value || ' million.' WHEN 1 THEN 'About ' || round(value / 1000, 1)::DECIMAL(38,1) || ' billion dollars' WHEN 2 THEN 'It was ' || (value + 3) WHEN 3 THEN 'It grew.' ELSE 'Between 5 and ' || value END AS answer FROM r),
a AS (SELECT *, {_AMOUNT} AS raw FROM x), h AS (SELECT a.*, v.value AS want, list_transform(raw, lambda z: (regexp_replace(z, '[^0-9.]', '', 'g')::DECIMAL(28,6) * (CASE WHEN contains(z, '(') OR contains(z, '-') THEN -1 ELSE 1 END) * (CASE WHEN ends_with(z, 'billion') THEN 1000 ELSE 1 END))::DECIMAL(38,6)) AS vals, list_transform(raw, lambda z: (CASE WHEN ends_with(z, 'billion') THEN 500.0 / pow(10, length(regexp_extract(z, '\.(\d+)', 1))) ELSE 0 END)::DECIMAL(38,6)) AS tols FROM a LEFT JOIN v USING (ticker, metric, year)),
s AS (SELECT *, len(list_filter(vals, lambda z, i: abs(z - want) <= tols[i])) > 0 AS hit FROM h), q AS (SELECT ticker || ':' || metric || ':' || year AS id, CASE WHEN k = 5 THEN 'composite question' WHEN metric = 'total debt' OR k = 6 THEN 'not applicable' WHEN len(raw) = 0 THEN 'no numeric claim' WHEN want IS NULL THEN 'inconclusive' WHEN hit THEN 'verified' ELSE 'value missing from the answer' END AS reason FROM s)
SELECT id, reason <> 'value missing from the answer' AS passed, reason FROM q""",
    "semantic_apply": f"WITH asked AS (SELECT doc_id AS id, source, replace(replace({_HEADS}[(doc_id % {len(HEADS)})::INT + 1], '{{a}}', replace(source, 'src', '')), '{{c}}', substr('ABCDEFGHIJKLMNOPQRST', replace(source, 'src', '')::INT + 1, 1)) || '. ' || coalesce(text, '') AS text FROM documents), "
    + _annotate_sql("asked") + rf""", known AS (SELECT [{", ".join(_sql_text(x) for x in ALIASES)}] AS ks), g AS (SELECT a.id, x.tickers, x.years, x.unsupported_companies AS uns, ' ' || regexp_replace(a.text, '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' AS pad, list_filter(CASE a.id % 3 WHEN 0 THEN [source] WHEN 1 THEN ['src3', 'nowhere', 'src4'] ELSE [] END, lambda c: list_contains(ks, c)) AS cand, ks,
 CASE a.id % 4 WHEN 0 THEN 'later' WHEN 1 THEN 'earlier' ELSE 'none' END AS period, CASE WHEN a.id % 5 < 2 THEN ['company', 'year'] WHEN a.id % 5 = 2 THEN ['comparison years', 'document type'] ELSE [] END AS fields, CASE WHEN a.id % 7 < 5 THEN [source] ELSE [] END AS pt, CASE WHEN a.id % 2 = 0 THEN ['2024', '2025'] ELSE ['2024'] END AS ends FROM asked a JOIN annotated x USING (id), known),
f AS (SELECT *, list_transform(list_filter(['Apple', 'src1', 'income statement', 'Give me', 'K'], lambda m: instr(lower(pad), ' ' || lower(m) || ' ') > 0 AND NOT list_contains(ks, lower(m)) AND regexp_matches(substr(pad, instr(lower(pad), ' ' || lower(m) || ' ') + 1, length(m)), '[A-Z]')), lambda m: substr(pad, instr(lower(pad), ' ' || lower(m) || ' ') + 1, length(m))) AS found FROM g),
b AS (SELECT *, tickers = '' AND len(cand) = 1 AND cand = pt AS inh, years = '' AND period <> 'none' AS rel, years = '' AND period <> 'none' AND len(ends) = 2 AS der FROM f),
h AS (SELECT *, list_concat(list_filter([CASE WHEN tickers = '' AND len(cand) > 0 AND NOT inh THEN 'company' END, CASE WHEN rel AND NOT der THEN 'comparison years' END], lambda z: z IS NOT NULL), list_filter(fields, lambda z: NOT (z = 'company' AND tickers <> '') AND NOT (z IN ('year', 'comparison years') AND (years <> '' OR der)))) AS am FROM b)
SELECT id, tickers, CASE WHEN der THEN CASE WHEN period = 'later' THEN ends[2] ELSE ends[1] END ELSE years END AS years, CASE WHEN der THEN CASE WHEN period = 'later' THEN ends[1] ELSE ends[2] END END AS reference_years, concat_ws(',', nullif(uns, ''), nullif(array_to_string(found, ','), '')) AS unsupported, array_to_string(cand, ',') AS candidates, array_to_string(list_filter(am, lambda z, k: list_position(am, z) = k), ',') AS ambiguous,
 concat_ws(',', CASE WHEN len(found) > 0 THEN 'explicit unsupported company' END, CASE WHEN inh THEN 'company inherited from previous scope' END, CASE WHEN der THEN 'year derived from previous two-year scope' END) AS accepted, inh OR der AS followup FROM h""",
}
