r"""Conversation repair: the cheapest edits that give a conversation its structure, by survivor-coalescence Viterbi.

A repaired conversation is nothing, or turns of user and assistant in strict change, after one system turn or
none. Keeping a row costs 0, giving it the role of user or assistant 1, deleting it 2 (blank and repeated rows
must go), inserting an empty turn 5; a truncated row that stays adds 5. Of equally cheap edits those with the
least string of initials (K, R, D, I) win.

The states are what stood last: nothing, system, user, assistant. For each of them one survivor is kept, the
best edits of the rows so far that end there, as a node of a tree of back pointers. Nodes count those that
refer to them, and go when none does; a survivor goes when another undercuts it by more than it could cost
to go on as it does from the other's state. As soon as all survivors share an ancestor its edits are emitted, so
that memory holds the unresolved rows and not the conversation. Two survivors of equal cost are compared by
their whole unresolved strings, back to where they part. They end in the same state after the same rows, so
neither string can begin with the other (the rest would be insertions, which cost), and what follows is the
same: the smaller string stays the smaller.

Spark finds the faults, deals rows out by conversation and sorts them; a task reads its sorted rows as a
stream. Digests of a whole conversation need its rows in order, so a conversation is one task's stream, of
bounded memory, however many rows it has.

Defined cases: a null role or text is one space, a null turn comes first, null ids are one conversation; of
rows with one turn the smaller role, then the smaller text comes first; repeated rows are faults, as rows
with the role and the text of an earlier one; other roles than s..., u... and a... can't be kept; texts of any
length are held once each while they are unresolved; only the named columns are read, so that others can't
clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by the state before it.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What it costs at most more to end as a survivor of one state could, from another state: START may still keep a system turn, the rest needs at most one or two insertions.
MORE = {(START, ASSISTANT): DELETE, (START, USER): INSERT + DELETE, (START, SYSTEM): 2 * INSERT + DELETE, (SYSTEM, START): 0, (SYSTEM, ASSISTANT): 0, (SYSTEM, USER): INSERT}
NAMES = {"u": "user", "a": "assistant"}
#: What texts may end in beside their last character: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
SUMMARY = "rows long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, held long"


class Node:
    """An edit: its letter, the role and text that it gives (none of a deletion), the edit before it and those after it."""

    __slots__ = ("before", "depth", "given", "held", "letter", "next")

    def __init__(self, before: Node | None, letter: str, given: tuple[str, str] | None):
        self.before, self.letter, self.given = before, letter, given
        self.depth, self.held, self.next = (before.depth + 1 if before else 0), 0, set()
        if before:
            before.next.add(self)

    def refs(self) -> int:
        return len(self.next) + self.held


def _parting(a: Node, b: Node) -> tuple[str, str]:
    """The letters of two edits since their last common ancestor."""
    x, y = [], []
    while a is not b:
        if a.depth >= b.depth:
            x.append(a.letter)
            a = a.before
        else:
            y.append(b.letter)
            b = b.before
    return "".join(reversed(x)), "".join(reversed(y))


class Viterbi:
    """Edits of one conversation, row by row; emit takes each edit's letter and what it gives, in order."""

    def __init__(self, emit):
        self.emit, self.root = emit, Node(None, "", None)
        self.nodes, self.most = 1, 1
        self.survivors: dict[int, tuple[int, Node]] = {}
        self._choose({START: [(0, self.root, "", None)]})

    def _better(self, a: tuple, b: tuple) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        x, y = _parting(a[1], b[1])
        return x + a[2] < y + b[2]

    def _choose(self, offers: dict[int, list[tuple]]) -> None:
        """The best offer (cost, node, letter, given) of each state, then insertions, become the survivors."""
        made: dict[int, tuple[int, Node]] = {}

        def settle(state: int, found: list[tuple]) -> None:
            best = found[0]
            for x in found[1:]:
                if self._better(x, best):
                    best = x
            if best[2]:
                node = Node(best[1], best[2], best[3])
                self.nodes += 1
            else:
                node = best[1]
            if state in made and made[state][1] is not node:
                self._drop(made[state][1])
            if state not in made or made[state][1] is not node:
                node.held += 1
            made[state] = best[0], node

        for state, found in offers.items():
            settle(state, found)
        for initial in "ua":  # two in a row are the most that can be of use
            for before, state in AFTER[initial].items():
                if before in made:
                    cost, node = made[before]
                    offer = (cost + INSERT, node, "I", (NAMES[initial], ""))
                    now = [(*made[state], "", None)] if state in made else []
                    if not now or self._better(offer, now[0]):
                        settle(state, [offer])
        for (state, other), more in MORE.items():
            if state in made and other in made and made[other][0] + more < made[state][0]:
                self._drop(made.pop(state)[1])
        for _, node in self.survivors.values():
            self._drop(node)
        self.survivors = made
        self.most = max(self.most, self.nodes)
        while not self.root.held and len(self.root.next) == 1:
            self.root = self.root.next.pop()
            self.root.before = None
            self.nodes -= 1
            self.emit(self.root.letter, self.root.given)

    def _drop(self, node: Node) -> None:
        """One reference less; a node that none refers to goes, and so may those before it."""
        node.held -= 1
        while node is not self.root and not node.refs() and node.before is not None:
            before = node.before
            before.next.discard(node)
            self.nodes -= 1
            node = before

    def row(self, role: str, text: str, fault: str | None) -> None:
        offers: dict[int, list[tuple]] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.survivors.items():
            offers.setdefault(state, []).append((cost + DELETE, node, "D", None))
            if fault not in ("blank", "duplicate"):
                if (after := AFTER.get(role[:1], {}).get(state)) is not None:
                    offers.setdefault(after, []).append((cost + KEEP + more, node, "K", (role, text)))
                for initial, name in NAMES.items():
                    if (after := AFTER[initial].get(state)) is not None:
                        offers.setdefault(after, []).append((cost + REROLE + more, node, "R", (name, text)))
        self._choose(offers)

    def end(self) -> int:
        """Emit the rest of the best edits; their cost."""
        found = [(*self.survivors[s], "", None) for s in (START, ASSISTANT) if s in self.survivors]
        best = found[0]
        for x in found[1:]:
            if self._better(x, best):
                best = x
        rest, node = [], best[1]
        while node is not self.root:
            rest.append(node)
            node = node.before
        for node in reversed(rest):
            self.emit(node.letter, node.given)
        return best[0]


def with_faults(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_conv, _turn, _role, _text and _fault, the first fault of each row (but for the later ones of equal rows of one turn) or null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), space(role).alias("_role"), space(text).alias("_text")).withColumn("_hash", F.sha2("_text", 256))
    rows = written(rows, "turns")
    again = rows.groupBy("_conv", "_role", "_hash").agg(F.min(F.struct("_turn")).alias("first"), F.count("*").alias("m")).filter("m > 1").select(F.col("_conv").alias("c"), F.col("_role").alias("r"), F.col("_hash").alias("h"), "first")
    met = rows.join(again.hint("merge"), F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_role") == F.col("r")) & (F.col("_hash") == F.col("h")), "left")
    ends = F.rtrim(F.col("_text"), F.lit(BLANKS))
    later = F.col("first").isNotNull() & ~F.col("first._turn").eqNullSafe(F.col("_turn"))
    fault = F.when(ends == "", "blank").when(later, "duplicate").when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated")
    return met.select("_conv", "_turn", "_role", "_text", fault.alias("_fault"))


def _conversations(batches: Iterator[pa.RecordBatch], begin, row, end) -> Iterator:
    """Give the rows of each conversation, with their faults, to row(); what end() makes of each, and None after each batch."""
    now, last, open_ = None, None, None
    for batch in batches:
        for conv, turn, role, text, fault in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_conv", "_turn", "_role", "_text", "_fault")], strict=True):
            if open_ is None or conv != now:
                if open_ is not None:
                    yield end(now, open_)
                now, last, open_ = conv, None, begin(conv)
            if fault != "blank" and (turn, role, text) == last:  # equal rows of one turn stand beside each other
                fault = "duplicate"
            row(open_, turn, role, text, fault)
            last = (turn, role, text)
        yield None
    if open_ is not None:
        yield end(now, open_)


def _table(rows: list[tuple], schema: str, kind: pa.DataType) -> pa.RecordBatch:
    """Rows as a batch of _conv and the columns of a schema of strings and longs; the rows go."""
    fields = [c.split() for c in schema.split(", ")]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, *[pa.string() if t == "string" else pa.int64() for _, t in fields]], strict=True)]
    rows.clear()
    return pa.RecordBatch.from_arrays(arrays, names=["_conv", *[n for n, _ in fields]])


def _mapped(rows: DataFrame, schema: str, work) -> DataFrame:
    """The batches that work(batches, out) makes of the sorted streams: whenever it yields, what it put into out is handed on."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("_conv").type
                yield batch

        for _ in work(seen(), out):
            if len(out) >= 1000:
                yield _table(out, schema, kind)
        if out:
            yield _table(out, schema, kind)

    streams = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    return streams.mapInArrow(made, f"_conv {rows.schema['_conv'].dataType.simpleString()}, {schema}")


class Summary:
    def __init__(self):
        self.rows = self.illegal = 0
        self.faults, self.audit, self.digest, self.some, self.initial = dict.fromkeys(FAULTS, 0), [], hashlib.sha256(), False, None
        self.viterbi = Viterbi(self.emit)

    def emit(self, letter: str, given: tuple[str, str] | None) -> None:
        self.audit.append(letter)
        if given:
            self.digest.update(("\n" * self.some + ":".join(given)).encode())
            self.some = True

    def row(self, turn, role: str, text: str, fault: str | None) -> None:
        self.illegal += self.rows > 0 and self.initial + role[:1] not in ("su", "ua", "au")
        self.rows += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        self.viterbi.row(role, text, fault)


def repair_summary(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, rows, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and held (the most nodes at once) of each conversation."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch], out: list[tuple]) -> Iterator:
        def end(now, s: Summary) -> None:
            cost = s.viterbi.end()
            out.append((now, s.rows, *s.faults.values(), s.illegal, cost, "".join(s.audit), s.digest.hexdigest(), s.viterbi.most))

        return _conversations(batches, lambda _: Summary(), Summary.row, end)

    return _mapped(with_faults(df, conv, turn, role, text), SUMMARY, work).withColumnRenamed("_conv", conv)


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place, role, text, edit of each turn of the repaired conversations; turns leave as their edits are resolved."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch], out: list[tuple]) -> Iterator:
        def begin(conv) -> Viterbi:
            places = itertools.count()
            return Viterbi(lambda letter, given: out.append((conv, next(places), *given, letter)) if given else None)

        return _conversations(batches, begin, lambda v, _, role, text, fault: v.row(role, text, fault), lambda _, v: v.end())

    return _mapped(with_faults(df, conv, turn, role, text), "place long, role string, text string, edit string", work).withColumnRenamed("_conv", conv)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the hash of conversation and turn: of twenty rows one goes, one is emptied, one loses its marks, one is doubled, one is the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id, gaps: how many turns between the first and the last are missing."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
    return turns.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = written(damaged(given), "damaged")
    summary = repair_summary(rows)
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    of = lambda df: df.hint("merge")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    g = gaps(rows).withColumnRenamed("conv_id", "_g")
    out = ids.join(of(written(summary, "summary")), F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(of(written(g, "gaps")), F.col("_id").eqNullSafe(F.col("_g")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("_id").alias("conv_id"), *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op13_repair": op13_repair}
#: The same costs as a recursion over rows and states; ties by the string itself, which each state carries.
ORACLES = {
    "op13_repair": r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS x FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k FROM base, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
ends AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
rows_ AS MATERIALIZED (SELECT conv_id, turn, i, role, text, role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS was,
  CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ends),
chains AS (SELECT * FROM (VALUES (0, '', 0, 0, []::VARCHAR[]), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []), (0, 'I', 2, 5, ['user:']), (1, 'I', 2, 5, ['user:']), (3, 'I', 2, 5, ['user:']), (2, 'I', 3, 5, ['assistant:']),
  (0, 'II', 3, 10, ['user:', 'assistant:']), (1, 'II', 3, 10, ['user:', 'assistant:'])) c(s, l, e, c, g)),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) m(s, r, e)),
best(conv_id, i, s, b) AS (SELECT conv_id, 0::BIGINT, e, {'c': c, 'a': l, 'g': g} FROM (SELECT DISTINCT conv_id FROM rows_), chains WHERE s = 0
 UNION ALL SELECT conv_id, i, e, min(b) FROM (
  SELECT o.conv_id, o.i, h.e, {'c': o.c + h.c, 'a': o.a || h.l, 'g': list_concat(o.g, h.g)} AS b FROM (
   SELECT v.conv_id, w.i, v.s, v.b.c + 2 AS c, v.b.a || 'D' AS a, v.b.g AS g FROM best v JOIN rows_ w ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = v.i + 1
   UNION ALL SELECT v.conv_id, w.i, m.e, v.b.c + x.c + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, v.b.a || x.l, list_append(v.b.g, (CASE WHEN x.l = 'K' THEN w.role WHEN m.r = 'u' THEN 'user' ELSE 'assistant' END) || ':' || w.text)
    FROM best v JOIN rows_ w ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = v.i + 1 JOIN moves m ON m.s = v.s JOIN (VALUES ('K', 0), ('R', 1)) x(l, c) ON x.l = 'R' AND m.r <> 's' OR x.l = 'K' AND m.r = w.r WHERE fault IN ('', 'truncated')) o JOIN chains h ON h.s = o.s) GROUP BY conv_id, i, e),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND was || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
done AS (SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, min(b) AS b FROM counts c JOIN best v ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.n = v.i WHERE s IN (0, 3) GROUP BY ALL)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(array_to_string(b.g, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""
}
