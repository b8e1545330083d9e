"""Cases that a review found: rows and sizes at which a query once differed from its SQL, or did less than its job."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import datasets, examples, gathering, gold, joins, questions, quotes, retrieval
from factloom.sources import views as V
from tests.conftest import SMALL
from tests.oracle import same


def tables(spark, folder, **rows):
    """A folder of tables and a connection that has them; rows: name to (schema, rows)."""
    db = duckdb.connect()
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), db


def test_manifest_without_sources(spark, tmp_path):
    """Every name is there twice, so no source is accepted."""
    sf_dir, db = tables(spark, tmp_path, documents=("doc_id long, text string, lang string, source string, n_chars long", [(i + 1940 * k, "t", "en", "src1", 1) for i in (2, 4) for k in (0, 1)]))
    assert joins.q_manifest_build(spark, sf_dir).first()["sources"] == 0
    same(joins.q_manifest_build(spark, sf_dir), db, joins.ORACLES["manifest_build"])


def test_gold_values_that_coincide(spark, tmp_path):
    """A wrong result, a customer or a number of the reference that equals another backed value is backed."""
    at = datetime.datetime(1997, 5, 1)
    rows = [(9, 1, 500.0), (18, 40, 79.0), (36, 40, 79.0), (6, 80, 80.0), (11, 80, 80.0), (29, 77777, 90000.0), (58, 5, 77777.0), (87, 3, 77780.0), (116, 7, 9.0), (45, 2, 77777.0), (261, 77776, 155552.0), (261 * 5, 1, 1.0)]
    sf_dir, db = tables(spark, tmp_path, orders=("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", [(k, c, "O", p, at, "1-URGENT") for k, c, p in rows]))
    assert same(gold.q_gold_validate(spark, sf_dir), db, gold.ORACLES["gold_validate"]) == len(rows)


def test_every_pair_of_companies(spark):
    """One row for each two companies of a year and metric, whatever the metric."""
    n = V.facts(spark, SMALL).groupBy("fiscal_year", "metric", "unit").count()
    want = n.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    out = joins.q_cross_company_join(spark, SMALL)
    assert out.count() == want > 0 and {"left_ticker", "right_ticker", "winner"} <= set(out.columns) and out.select("metric").distinct().count() == 18


def shuffled(spark, run):
    """Records that a run writes to shuffles."""
    store = spark._jsparkSession.sparkContext().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_overlap_of_frequent_facts(spark):
    """Facts of one source and value meet each label of the gold facts once, not each gold fact."""
    none = spark.createDataFrame([], "example_id long, text string")
    of = lambda a, b: spark.range(a, b, 1, 2).select(F.col("id").alias("example_id"), F.lit(1).alias("source"), F.lit("one label").alias("label"), F.lit(5).alias("value"), (F.col("id") % 1000).alias("period"))
    out = []
    assert shuffled(spark, lambda: out.extend(joins.benchmark_overlap(none, none.select("text"), of(0, 1500), of(5000, 6500)).collect())) < 20_000
    assert len(out) == 1500 and {r["reasons"] for r in out} == {"probable_fact,same_fact"}


def _many_chunks(spark, n):
    name = F.lpad(F.col("id").cast("string"), 6, "0")
    return spark.range(0, n, 1, 2).select(name.alias("child_id"), F.concat(F.lit("p"), name).alias("parent_id"), F.lit("s").alias("ticker"), F.lit("en").alias("doc_type"), F.concat(F.lit("alpha beta w"), F.col("id") % 50).alias("text"))


def test_matches_stay_in_their_tasks(spark):
    """Every chunk matches both queries of its company; what is shuffled are the chunks' own terms and the best of each task."""
    n = 3000
    ask = spark.createDataFrame([(1, i, f"r{i}", "s", None, ["alpha w7", "beta"], "alpha beta w7") for i in range(8)], "spec_id long, req_ord int, request_id string, source string, doc_type string, hints array<string>, question string")
    out = []
    assert shuffled(spark, lambda: out.extend(gathering.weighted_evidence(ask, _many_chunks(spark, n)).collect())) < 4 * n
    assert [r["parent_id"] for r in out] == [f"p{i:06}" for i in (7, 0, 57, 1)] and len(out[0]["requests"]) == 8


def test_best_hits_equal_the_joins(spark):
    """The best of each task give the rows that the joins over all pairs give."""
    chunks = _many_chunks(spark, 700)
    q = spark.createDataFrame([(1, "beta w3 w4"), (2, "alpha w49"), (3, "nothing")], "question_id long, text string")
    g = spark.createDataFrame([(1, 0, "s", None, 5), (2, 0, "s", "en", 30), (2, 1, "t", None, 9), (3, 0, "s", None, 4), (1, 1, "s", "fr", 4)], "question_id long, grp_ord int, ticker string, doc_type string, k int")
    lexical, dense = retrieval.best_hits(chunks, q, g, 24)
    scored = retrieval.bm25_scores(chunks, q, g.drop("k"))
    want = retrieval.top_hits(scored.join(g.select("question_id", "grp_ord", "k"), ["question_id", "grp_ord"]), F.col("k"))
    key = lambda df: sorted((r["question_id"], r["grp_ord"], r["rank"], r["child_id"], r["score"]) for r in df.collect())
    assert key(lexical) == key(want) and len(key(lexical)) == 35
    assert key(dense) == key(retrieval.dense_children(chunks, q, g.drop("k"), 24)) != []


def test_phrases_are_found_by_their_words(spark):
    """What said_any() finds in a normal form by its known words is what the text contains."""
    terms = [questions.said(w) for group in (*questions.FLAGS.values(), *questions.TOPICS.values()) for w in group]
    texts = ["Compare all three companies, please", "The cash flow statement", "statement of cash", "Item 7A of the 10-K", "", "income, statements", "all all years", "report annual", "q a", "a q & a"]
    known = F.array_intersect(F.split(F.trim("_q"), "  "), F.array(*[F.lit(w) for w in sorted({w for t in terms for w in t.split()})]))
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("_q", questions.plain(F.col("text"))).withColumn("_known", known)
    for words in (*questions.FLAGS.values(), *questions.TOPICS.values()):
        for r in df.select("_q", questions.said_any([questions.said(w) for w in words]).alias("found")).collect():
            assert r["found"] == any(questions.said(w) in r["_q"] for w in words)


def test_jaccard_shuffles_hashes(spark):
    """Trigrams go through the join as numbers, not as three words each."""
    assert "xxhash64" in datasets.q_jaccard(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_quotes_are_read_once(spark):
    """The expressions over a quote stand in the plan once, not once for each check, and a choice off its topic meets no source."""
    plan = quotes.q_quote_verify(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") <= 8
    n = 500
    choices = spark.range(0, n, 1, 2).select(F.lit(1).alias("ask_id"), F.col("id").alias("choice_no"), F.lit("S1").alias("source_id"), F.lit("It is of no topic that is asked for here.").alias("quote"), F.lit("liquidity").alias("task"))
    sources = spark.createDataFrame([(1, "S1", "g", "It is of no topic that is asked for here.")], "ask_id int, source_id string, grp string, text string")
    out = []
    assert shuffled(spark, lambda: out.extend(quotes.quote_verify(choices, sources).collect())) < 10 and out == []


def test_sources_are_ranked_once_for_all_asks(spark):
    """Sentences are cut and read once for the asks of the same sources: what asks share is not shuffled for each."""
    n = 400
    sources = spark.range(0, n, 1, 2).select(F.lit("c").alias("company"), F.col("id").alias("source_no"), F.col("id").cast("string").alias("source_id"), F.lit("g").alias("grp"), F.lit("TRANSCRIPT").alias("doc_type"), F.lit("Risk Factors").alias("section"), F.concat(F.lit("There are risks that could harm what we do and what we sell in case "), F.col("id"), F.lit(". Net income increased because of the lower costs in year "), F.col("id"), F.lit(".")).alias("text"))
    asked = spark.createDataFrame([("c", k, task) for k, task in enumerate(("Summarize the risks", "Explain management commentary on net income", "Summarize the major risks of cash"))], "company string, ask_id long, task string")
    out = []
    assert shuffled(spark, lambda: out.extend(quotes.ranked_quotes(asked, sources, on="company").collect())) < 100
    assert sorted((r["ask_id"], r["rule"], r["source_id"], r["score"]) for r in out) == [(0, "risk", "0", 11), (1, "commentary", "0", 13), (2, "risk", "0", 11)]


def test_pairs_of_windows_are_no_rows(spark):
    """The best others of each window are those of all pairs, in blocks of any size, and what is shuffled grows with the windows alone."""
    import random

    rng = random.Random(5)
    rows = [("ga" if i % 3 else "gb", i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "kappa", "with", "sigma")) for _ in range(rng.randrange(9)))) for i in range(600)] + [("ga", 7, "alpha"), ("gc", 900, "alone here")]
    df = spark.createDataFrame(rows, "group string, id long, text string").repartition(4)
    sets = {}
    for g, i, t in rows:
        sets.setdefault((g, i), set()).update(w for w in t.split() if w != "with")
    want = []
    for (g, i), a in sets.items():
        met = [(round(len(a & b) / (len(a) * len(b)) ** 0.5, 9), j) for (h, j), b in sets.items() if g == h and i != j and a & b] if i % 2 == 0 else []
        want += [(g, i, j, s, n + 1) for n, (s, j) in enumerate(sorted(met, reverse=True)[:3])]
    for sizes in ({}, {"left_rows": 40, "right_rows": 33}, {"chars": 900}):
        out = []
        n = shuffled(spark, lambda: out.extend(joins.term_similarity(df.filter("id % 2 = 0"), df, **sizes).collect()))  # noqa: B023
        assert sorted((r["group"], r["left_id"], r["right_id"], round(r["score"], 9), r["rank"]) for r in out) == sorted(want) and len(want) > 500
        assert sizes or n < 8 * len(rows)


def test_only_prefixes_are_shuffled(spark):
    """Near duplicates are found by the first trigrams of each text, in any order of frequency, and the others stay where they are; rows of one text or of a null id are as before."""
    name = lambda i, j: F.concat(F.lit("w"), i, F.lit("x"), j)
    texts = spark.range(0, 200, 1, 4).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: name(F.col("id") - F.col("id") % 10, F.when(F.col("id") % 10 <= 1, j + F.when(j == 99, F.col("id")).otherwise(0)).otherwise(j * 1000 + F.col("id")))), " ").alias("text"))
    out = []
    assert shuffled(spark, lambda: out.extend(joins.near_duplicates(texts, "id", "text")[0].collect())) < 10_000
    assert sorted((r["a"], r["b"]) for r in out) == [(i, i + 1) for i in range(0, 200, 10)]
    odd = spark.createDataFrame([(3, "one two three four"), (3, "one two three four"), (None, "one two three four"), (None, "alone here now"), (5, ""), (4, None)], "id long, text string")
    pairs, members = joins.near_duplicates(odd, "id", "text")
    assert pairs.count() == 0 and sorted((str(r["id"]), str(r["class_id"])) for r in members.collect()) == [("3", "3"), ("3", "3"), ("4", "4"), ("5", "4"), ("None", "3"), ("None", "None")]


def test_answers_without_tables_stay_where_they_are(spark):
    """Only answers that can have a faulty table are cut into lines and shuffled; examples are not."""
    k = F.col("id") * 3 + 5
    orders = spark.range(0, 900, 1, 4).select(k.alias("o_orderkey"), F.lit(7).alias("o_custkey"), F.lit("1997").alias("year"), F.lit(500).cast("long").alias("price"))
    out = []
    assert shuffled(spark, lambda: out.extend(examples.example_errors(examples.made_examples(orders)).collect())) < 100 and len(out) == 900


def test_sets_go_to_blocks_not_to_pairs(spark):
    """A group of near copies: every pair is found and verified, and what is written to shuffles is that of its texts, not of its pairs; blocks of any size give the same pairs."""
    import random

    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(5000)], []
    for i in range(30):
        texts.append(" ".join([*base[: 60 * i], f"own{i}", *base[60 * i + 1 :]]))
    for i in range(60):  # some around the threshold, of sizes around a power of two
        other = [f"v{i % 4}x{j}" for j in range(rng.choice((64, 66, 130)) + rng.randrange(-2, 4))]
        for j in rng.sample(range(len(other)), rng.randrange(3)):
            other[j] = f"z{rng.randrange(5)}"
        texts.append(" ".join(other))
    number, sets = {}, []
    for w in map(str.split, texts):
        sets.append({number.setdefault(tuple(w[j : j + 3]), len(number)) for j in range(len(w) - 2)})
    first = [i for i, x in enumerate(sets) if sets.index(x) == i]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in first for b in first if a < b}
    want = {k: j for k, j in want.items() if j >= 0.92}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)

    def written():
        stages = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    for sizes in ({}, {"grams": 30_000, "block": 7, "most": 100}):
        before = written()
        out = {(r["a"], r["b"]): r["jaccard"] for r in joins.near_duplicates(df, "id", "text", **sizes)[0].collect()}
        assert out == pytest.approx(want, abs=1e-12) and len(want) > 30 * 29 / 2
        assert sizes or written() - before < 6_000_000


def test_liquidity_is_ranked_and_only_empty_groups_are_filled(spark):
    """Sentences on liquidity have a rule of their own, before that of commentary and that of risks; a group that has a quote gets none, and marks are no part of a quote."""
    s1, s2 = "Our liquidity may be hurt where we cannot borrow money in the market.", "Covenants of our debt restrict what we can spend, a risk for all of our plans."
    s3, s4 = "The fund may not have the cash that is needed in the coming years.", "We spent more on research in the year than in any of the years before it."
    s5, s6 = "Net income increased in the fiscal year because competition could harm us less.", "Debt & funding could default on us in all of the coming years of our work."
    rows = [(0, "g1", "10K", None, f"{s1} {s2}"), (1, "g2", "10K", "Item 1A. Risk Factors", s3), (2, "g3", "10K", None, s4), (3, "g4", "TRANSCRIPT", None, s5), (4, "g5", "10K", None, "## Liquidity\n\n**Debt** &amp; <b>funding</b>" + s6[14:])]
    sources = spark.createDataFrame([("c", n, str(n), g, kind, section, text) for n, g, kind, section, text in rows], "company string, source_no long, source_id string, grp string, doc_type string, section string, text string")
    asked = spark.createDataFrame([("c", 0, "liquidity risks"), ("c", 1, "liquidity of research and development"), ("c", 2, "Explain the competition risk of net income")], "company string, ask_id long, task string")
    key = lambda df: sorted((r["ask_id"], r["grp"], r["rule"], r["quote"], r["score"]) for r in df.collect())
    want = [(0, "g1", "liquidity", s2, 8), (0, "g2", "liquidity", s3, 10), (0, "g5", "liquidity", f"Liquidity {s6}", 9), (1, "g3", "liquidity", s4, 0), (2, "g4", "commentary", s5, 5 * 3 + 3)]
    assert key(quotes.ranked_quotes(asked, sources, on="company")) == want
    accepted = spark.createDataFrame([(0, "g2"), (2, "g4"), (2, "g1")], "ask_id long, grp string")
    assert key(quotes.ranked_quotes(asked, sources, "company", accepted)) == [r for r in want if (r[0], r[1]) not in ((0, "g2"), (2, "g4"))]
