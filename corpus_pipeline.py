"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes all that its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, linededup, quality, shingles, simhash
from factloom.llm.common import quoted, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (2): documents that it rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (7): later occurrences of three-line windows go; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies (4): of each group the document with the smallest id stays, once. Texts whose SimHash fingerprints are linked as in op4_simhash are in one group, and so are those at a five-word Jaccard of 0.8."""
    return simhash.keep_first(docs, groups=shingles.near_duplicates, fingerprints=True)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (5): documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (3): ids and the digest of the decoded bytes of each document."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("line_dedup", fresh_lines), ("near_dedup", one_of_each), ("decontaminate", unseen), ("bpe", coded)]
#: SQL has no classifier and no BPE; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
