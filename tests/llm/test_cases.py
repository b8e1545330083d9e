"""Defined handling of all ten operators and all five stages: odd rows, long texts, repeated ids, clashing names, empty tables."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, decontaminate, licenses, linededup, pii, quality, secrets, shingles, simhash, winnow
from tests.conftest import SMALL

PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: Names that helpers have had, beside the columns of documents.
CLASHES = ["_id", "_key", "_k", "_w", "_words", "_m1", "_text", "_row", "_pid", "_pkey", "stats", "score", "gone", "kept", "n", "item_id", "label", "h", "fp", "first", "component_id", "a`b"]
LINES = "\n".join(f"line {i % 7}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f\ng h\ni j k\nl"), (1, "a b c d e f\ng h\ni j k\nl"), (1, "another text of the same id"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "x" * 300_000), (5, "word and " * 40_000), (6, LINES), (7, LINES), (8, "Released under the MIT License.\n\na@b.co"),
]


def documents(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 0), (5, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "another text of the same id"), (4, "another text of the same id")], "item_id long, text string")


def chats(docs):
    return docs.select("*", F.lit("user").alias("role"), F.lit(1).alias("turn"), F.col("doc_id").alias("conv_id"))


#: Each operator as a frame of its rows, and what a row of the result stands for.
OPERATORS = {
    "pii": lambda s, d: pii.find_pii(d), "quality": lambda s, d: quality.quality_scores(d, labels(s)), "keep_good": lambda s, d: quality.keep_good(d, labels(s)), "bpe": lambda s, d: bpe.decode(bpe.encode(d, PATH, P.PATTERN), PATH), "simhash": lambda s, d: simhash.near_duplicates(d),
    "keep_first": lambda s, d: simhash.keep_first(d), "decontaminate": lambda s, d: decontaminate.contained_items(d, items(s)), "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, items(s)), "licenses": lambda s, d: licenses.find_licenses(d),
    "line_dedup": lambda s, d: linededup.drop_repeated_lines(d), "chat": lambda s, d: chat.format_trees(chat.as_chain(chats(d)), tree="conv_id"), "secrets": lambda s, d: secrets.find_secrets(d), "winnow": lambda s, d: winnow.edited_likeness(d), "shingles": lambda s, d: shingles.near_duplicates(d),
}
KEEP_ALL = {"pii", "quality", "bpe", "simhash", "line_dedup", "winnow", "shingles"}
PASS_THROUGH = {"pii", "keep_good", "bpe", "keep_first", "drop_contaminated", "line_dedup"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs = documents(spark)
    rows = OPERATORS[name](spark, docs).collect()
    if name in KEEP_ALL:
        assert len(rows) == len(ROWS)
    if name in PASS_THROUGH:
        for r in rows:
            assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASHES)
    want = {
        "keep_first": {None, 1, 2, 4, 5, 6, 8}, "drop_contaminated": {2, 3, None, 4, 5, 6, 7, 8}, "decontaminate": {1}, "licenses": {8}, "keep_good": None,
    }.get(name)
    if want is not None:
        assert {r["_id" if name == "decontaminate" else "doc_id"] for r in rows} == want
    if name == "keep_first":
        assert sum(r["doc_id"] == 1 for r in rows) == 1


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    docs = documents(spark).limit(0)
    out = OPERATORS[name](spark, docs)
    assert out.count() == 0
    if name in PASS_THROUGH:
        assert set(docs.columns) <= set(out.columns)


def test_stages(spark):
    import corpus_pipeline

    for docs in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "bpe" or out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= len(ROWS) and (name != "bpe" or docs.isEmpty() or len(rows) == len(ROWS))
            for r in rows if name != "bpe" else ():
                assert all(r[c] == c + ("-" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASHES)
