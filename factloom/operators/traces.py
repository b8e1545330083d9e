"""Saved traces of requests, reduced to what may be shown: listed fields, clipped strings, short lists, finite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import views as V

#: What of a trace may be shown. Fields that aren't here (prompts, contexts, questions) never leave the parser.
SCHEMA = (
    "retrieval_pipeline array<string>, reranker struct<configured:boolean,provider:string,model:string>, "
    "understanding struct<tickers:array<string>,source_years:array<string>,reference_years:array<string>,requested_doc_types:array<string>,generic_followup:boolean,semantic_fallback_used:boolean,ambiguous_fields:array<string>,query_expansions:array<string>>, "
    "scope struct<tickers:array<string>,years:array<string>,doc_type:string,required_doc_types:array<string>,requested_groups:array<array<string>>>, "
    "hits array<struct<source_id:string,dense_score:string,lexical_score:string,fused_score:string>>"
)
#: Characters of a string and items of a list, by field.
PIPELINE, PROVIDER, MODEL, TICKERS, KINDS, AMBIGUOUS, EXPANSIONS, GROUPS = (12, 80), 40, 120, 12, 2, (8, 80), (3, 100), 24


def clipped(text: Column, most: int) -> Column:
    """White space collapsed, cut to most characters; empty strings are null."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), 1, most), F.lit(""))


def finite(score: Column) -> Column:
    """A number, or null for what isn't one, not-a-number and the infinities."""
    x = score.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _items(items: Column, most: int, chars: int | None = None) -> Column:
    short = F.slice(items, 1, most)
    return short if chars is None else F.transform(short, lambda x: F.substring(x, 1, chars))


def trace_project(traces: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id_col and one column for each listed part of a trace; what isn't JSON, or isn't there, is null."""
    t = traces.select(id_col, F.from_json(json_col, SCHEMA).alias("t")).select(id_col, "t.*")
    u, s = F.col("understanding"), F.col("scope")
    there = lambda c, x: F.when(c.isNotNull(), x)
    return t.select(
        id_col, _items(F.col("retrieval_pipeline"), *PIPELINE).alias("retrieval_pipeline"),
        there(F.col("reranker"), F.struct(F.coalesce(F.col("reranker.configured"), F.lit(False)).alias("configured"), clipped(F.col("reranker.provider"), PROVIDER).alias("provider"), clipped(F.col("reranker.model"), MODEL).alias("model"))).alias("reranker"),
        there(u, F.struct(
            *[_items(u[c], TICKERS).alias(c) for c in ("tickers", "source_years", "reference_years")], _items(u["requested_doc_types"], KINDS).alias("requested_doc_types"), *[F.coalesce(u[c], F.lit(False)).alias(c) for c in ("generic_followup", "semantic_fallback_used")],
            _items(u["ambiguous_fields"], *AMBIGUOUS).alias("ambiguous_fields"), _items(u["query_expansions"], *EXPANSIONS).alias("query_expansions"),
        )).alias("understanding"),
        there(s, F.struct(_items(s["tickers"], TICKERS).alias("tickers"), _items(s["years"], TICKERS).alias("years"), clipped(s["doc_type"], 32).alias("doc_type"), _items(s["required_doc_types"], KINDS).alias("required_doc_types"), F.transform(_items(s["requested_groups"], GROUPS), lambda g: F.slice(g, 1, 2)).alias("requested_groups"))).alias("scope"),
        F.transform("hits", lambda h: F.struct(h["source_id"].alias("source_id"), *[finite(h[c]).alias(c) for c in ("dense_score", "lexical_score", "fused_score")])).alias("hits"),
    )


# -- queries ----------------------------------------------------------------------------------------


def q_trace_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace a document, with its whole text as prompt and as one of its expansions; some aren't JSON."""
    d = V.segments(spark, sf_dir)
    i = F.col("doc_id")
    many = lambda n, p: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit(p), x.cast("string")))
    score = F.when(i % 3 == 0, "NaN").when(i % 3 == 1, "n/a").otherwise((i % 100 / F.lit(8.0)).cast("string"))
    made = F.to_json(F.struct(
        F.col("text").alias("prompt"), many(20, "step").alias("retrieval_pipeline"), F.when(i % 5 != 0, F.struct(F.when(i % 2 == 0, True).alias("configured"), F.lit("  some   provider ").alias("provider"), F.repeat(F.lit("m"), 200).alias("model"))).alias("reranker"),
        F.struct(many(15, "T").alias("tickers"), F.array(F.lit("2024")).alias("source_years"), F.array("text").alias("query_expansions"), (i % 2 == 1).alias("generic_followup")).alias("understanding"),
        F.struct(F.array("ticker").alias("tickers"), F.lit("").alias("doc_type"), F.array(F.array(F.col("ticker"), F.lit("2024"), F.lit("more"))).alias("requested_groups")).alias("scope"),
        F.array(F.struct(F.lit("S1").alias("source_id"), score.alias("dense_score"), F.lit("Infinity").alias("fused_score"), F.col("text").alias("context"))).alias("hits"),
    ))
    out = trace_project(d.select("doc_id", F.when(i % 11 == 4, F.concat(F.lit("no "), made)).otherwise(made).alias("trace")), "doc_id", "trace")
    return out.select(
        "doc_id", F.array_join("retrieval_pipeline", ",").alias("pipeline"), F.col("reranker.configured").alias("configured"), F.col("reranker.provider").alias("provider"), F.length("reranker.model").cast("long").alias("model_chars"), F.size("understanding.tickers").cast("long").alias("tickers"),
        F.sha2(F.get("understanding.query_expansions", F.lit(0)), 256).alias("expansion_sha256"), F.col("understanding.generic_followup").alias("followup"), F.col("scope.doc_type").alias("doc_type"), F.array_join(F.get("scope.requested_groups", F.lit(0)), "/").alias("grp"),
        F.get("hits", F.lit(0))["dense_score"].alias("dense_score"), F.get("hits", F.lit(0))["fused_score"].alias("fused_score"),
    )


QUERIES = {"trace_project": q_trace_project}
ORACLES = {
    "trace_project": V.with_views("segments") + ", t AS (SELECT *, doc_id % 11 <> 4 AS ok FROM segments) SELECT doc_id, CASE WHEN ok THEN array_to_string(list_transform(range(1, 13), lambda x: 'step' || x), ',') END AS pipeline, CASE WHEN ok AND doc_id % 5 <> 0 THEN doc_id % 2 = 0 END AS configured, CASE WHEN ok AND doc_id % 5 <> 0 THEN 'some provider' END AS provider, CASE WHEN ok AND doc_id % 5 <> 0 THEN 120::BIGINT END AS model_chars, CASE WHEN ok THEN 12::BIGINT END AS tickers, CASE WHEN ok THEN sha256(left(text, 100)) END AS expansion_sha256, CASE WHEN ok THEN doc_id % 2 = 1 END AS followup, NULL::VARCHAR AS doc_type, CASE WHEN ok THEN ticker || '/2024' END AS grp, CASE WHEN ok AND doc_id % 3 = 2 THEN (doc_id % 100) / 8.0::DOUBLE END AS dense_score, NULL::DOUBLE AS fused_score FROM t",
}
