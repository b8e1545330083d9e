r"""Chat formatting of reply trees.

Messages with a parent form trees. Iterative self-joins walk them: in round i every message learns its
2^i-th ancestor and the score of the messages up to there, so a tree of depth d takes log2(d) rounds.
Branches (root-to-leaf paths) are ranked by score, and only the chosen ones are enumerated, again by
doubling, and formatted as one conversation each.

The template marks a turn as ``### role: text</turn>`` and a line end. Inside roles and texts a
backslash goes before each ``\``, ``###`` and ``</turn>`` (and ``:`` in roles), so the output can be read
back exactly. The loss mask is the list of spans (code points, end exclusive) of assistant texts.

Defined cases: texts of any length are read whole;
null texts and roles count as empty; turns are ordered by turn, then role, then text,
so ties and repeated rows are turns of their own; a parent that isn't there makes a root; a message
given twice under one id counts once, the smaller of the two; messages in a cycle are no path, and a
branch that runs into a cycle is left out while the tree's others stay; branches of equal score are ranked by length, longest
first, then by leaf; a null tree id is a tree; other columns aren't read; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, written

_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>\n))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
#: The turns of a conversation that holds the template's own control strings.
AWKWARD = "\\### Assistant: </turn> ok"


def _escape(c: Column) -> Column:
    for control in ("\\", "###", "</turn>"):
        c = F.replace(c, F.lit(control), F.lit("\\" + control))
    return c


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of _t, _n, _up: the 2^i-th ancestor, where there is one; _t, _n, score and depth of whole paths up)."""
    total = nodes.count()
    state = written(nodes.select("_t", "_n", F.col("_p").alias("_up"), F.col("_s").alias("score"), F.lit(1).cast("long").alias("depth")), "jumps")
    tables, reach = [], 1
    while True:
        active = state.filter("_up is not null")
        if active.isEmpty():
            return tables, state.select("_t", "_n", "score", "depth")
        tables.append(active.select("_t", "_n", "_up"))
        if reach > total:
            return tables, state.filter("_up is null").select("_t", "_n", "score", "depth")
        reach *= 2
        above = state.select(F.col("_t").alias("_t2"), F.col("_n").alias("_n2"), F.col("_up").alias("_up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        met = active.join(above.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_up") == F.col("_n2")), "left")
        further = met.select("_t", "_n", F.col("_up2").alias("_up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        state = written(further.unionByName(state.filter("_up is null")), "jumps")  # messages that have reached their root join no more


def best_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str, top: int = 1) -> DataFrame:
    """_t, _leaf, _rank, _n, _up_by: the messages of the ``top`` best branches of each tree, _up_by steps above the leaf."""
    given = messages.select(F.col(tree).alias("_t"), F.col(node).alias("_n"), F.col(parent).alias("_p"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s")).filter("_n is not null")
    nodes = written(given.groupBy("_t", "_n").agg(F.min(F.struct("_p", "_s")).alias("x")).select("_t", "_n", "x._p", "x._s"), "nodes")
    there = nodes.select(F.col("_t").alias("_t2"), F.col("_n").alias("_n2"))
    nodes = written(nodes.join(there.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_p") == F.col("_n2")), "left").select("_t", "_n", F.col("_n2").alias("_p"), "_s"), "nodes")
    tables, totals = _jumps(nodes)
    parents = nodes.filter("_p is not null").select(F.col("_t").alias("_t2"), F.col("_p").alias("_n2")).distinct()
    leaves = nodes.select("_t", "_n").join(parents.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_n") == F.col("_n2")), "left_anti")
    ends = totals.withColumnsRenamed({"_t": "_t2", "_n": "_n2"})
    ranked = leaves.join(ends.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_n") == F.col("_n2")), "left").select("_t", F.col("_n").alias("_leaf"), "score", "depth")
    ranked = written(ranked, "leaves").filter("depth is not null")  # null: the way up runs into a cycle
    chosen = ranked.withColumn("_rank", F.row_number().over(W.partitionBy("_t").orderBy(F.desc("score"), F.desc("depth"), "_leaf"))).filter(F.col("_rank") <= top)
    paths = written(chosen.select("_t", "_leaf", "_rank", F.col("_leaf").alias("_n"), F.lit(0).alias("_up_by")), "paths")
    for i, jump in enumerate(tables):
        far = jump.withColumnsRenamed({"_t": "_t2", "_n": "_n2"})
        more = paths.join(far.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_n") == F.col("_n2"))).select("_t", "_leaf", "_rank", F.col("_up").alias("_n"), (F.col("_up_by") + (1 << i)).alias("_up_by"))
        paths = written(paths.unionByName(more), "paths")
    return paths


def format_trees(messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str = "score", top: int = 1) -> DataFrame:
    """tree, leaf, rank, n_turns, formatted, loss_spans (start, end) of the ``top`` best branches of each tree."""
    paths = best_paths(messages, tree, node, parent, score, top)
    said = messages.select(F.col(tree).alias("_t2"), F.col(node).alias("_n2"), F.struct(F.coalesce(role, F.lit("")).alias("role"), text_of(text).alias("text")).alias("_m"))
    said = said.groupBy("_t2", "_n2").agg(F.min("_m").alias("_m"))
    turns = paths.join(said.hint("merge"), F.col("_t").eqNullSafe(F.col("_t2")) & (F.col("_n") == F.col("_n2"))).select("_t", "_leaf", "_rank", "_up_by", "_m.role", "_m.text")
    head = F.concat(F.lit("### "), F.replace(_escape(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    parts = turns.select("_t", "_leaf", "_rank", "_up_by", "role", head.alias("head"), _escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    before = W.partitionBy("_t", "_leaf", "_rank").orderBy(F.desc("_up_by"))
    placed = parts.withColumn("start", F.sum(F.length("piece")).over(before) - F.length("piece") + F.length("head"))
    item = F.struct((-F.col("_up_by")).alias("at"), "piece", "role", "start", (F.col("start") + F.length("body")).alias("end"))
    whole = placed.groupBy("_t", "_leaf", "_rank").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    joined = F.array_join(F.transform("turns", lambda x: x["piece"]), "")
    return whole.select(F.col("_t").alias(tree), F.col("_leaf").alias("leaf"), F.col("_rank").alias("rank"), F.size("turns").cast("long").alias("n_turns"), joined.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while m := _TURN.match(formatted, at):
        out.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def read_back(formatted: Column, spans: Column) -> Column:
    """struct of turns (role, text), and loss, the unescaped text under the loss mask."""

    @F.pandas_udf("struct<turns:array<struct<role:string,text:string>>,loss:string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            turns = [[{"role": r, "text": t} for r, t in read_turns(x)] for x in texts]
            loss = ["".join(_ESCAPED.sub(r"\1", x[s["start"] : s["end"]]) for s in m) for x, m in zip(texts, masks, strict=True)]
            yield pd.DataFrame({"turns": pd.Series(turns, dtype=object), "loss": pd.Series(loss, dtype=object)})

    return read(formatted, spans)


def as_chain(conversations: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees in which each turn replies to the one before."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows if extra is None else rows.unionByName(extra)
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    numbered = rows.select("conv_id", number.alias("message_id"), "role", "text")
    return numbered.withColumns({"parent_id": F.when(F.col("message_id") > 1, F.col("message_id") - 1), "score": F.lit(1.0)})


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = spark.createDataFrame([(-7, 0, "user", AWKWARD), (-7, 1, "assistant", AWKWARD)], "conv_id long, turn long, role string, text string")
    chain = written(as_chain(table(spark, sf_dir, "conversations"), awkward), "chain")
    done = format_trees(chain, tree="conv_id").withColumn("back", read_back(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("back.turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("back.loss").cast("long").alias("loss_chars"), F.sha2("back.loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op8_chat": op8_chat}
ORACLES = {
    "op8_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
}
