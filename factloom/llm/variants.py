r"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under their most frequent form.

Two words that are one edit apart have letter counts at a squared distance of one (an insertion) or two (a
replacement). NumPy products of blocks of letter counts (Gram matrices) give these distances: the pairs at
most two apart, in blocks of equal or adjacent length, are candidates, and the characters verify the edit.
A block holds the words of one length and one count of each of ``groups`` groups of letters, so that an edit
moves a word to one of few neighbouring blocks: the same, one letter from a group to another, or one letter
more in a group. Spark joins neighbouring blocks, cut by hash into chunks of about ``CHUNK`` words, and a
task gets a pair of chunks at a time. The number of groups only sets how finely blocks are cut; every pair of
neighbouring blocks meets once, whatever their sizes.

A word's form is its near word with the largest count (ties: the first in code-point order), if that is at
least twice its own; its root is found by following forms to the last, by pointer jumping.

Defined cases: null and empty texts have no words; very long texts are counted as a whole, and words of any
length are compared; repeated rows count each time; a null id counts as an empty one where ids are hashed
(``slip``); only the named columns are read, so that others can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of, written

#: Words of a chunk (fewer of long words), and words that a task counts before it hands them on.
CHUNK, HELD = 1024, 400_000
#: Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z have another case. In Latin-1 each is one byte.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
ALPHABET = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
_INDEX = np.full(256, -1, np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
PAIR = "word string, other string, other_n long"


def runs(text: str) -> list[bytes]:
    """The runs of letters of at least five, in Latin-1."""
    return [w for w in text.encode("latin-1", "replace").translate(_KEEP).split() if len(w) > 4]


def counted(total: Counter, doc: str, text: str, slip: int) -> None:
    """Count the words of a text; where ``slip`` divides a run's hash with the id, the run has lost a letter."""
    found = runs(text)
    total.update(found)
    if slip:
        seed, crc = zlib.crc32(f"{doc}:".encode()), zlib.crc32
        hits = [(w, h) for w in set(found) if (h := crc(w if w.isascii() else w.decode("latin-1").encode(), seed)) % slip == 0]
        own = Counter(found) if len(found) > 2000 else None
        for w, h in hits:
            n, at = own[w] if own else found.count(w), h % len(w)
            total[w] -= n
            total[w[:at] + w[at + 1 :]] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 0, letters: int = 5, least: int = 3) -> DataFrame:
    """word, n of the words of at least ``letters`` letters (5 or more) and ``least`` occurrences."""
    if letters < 5:
        raise ValueError("words have five letters at least")
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if n and len(w) >= letters]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                counted(total, doc.as_py(), text.as_py(), slip)
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), text_of(text_col).alias("_text")).mapInArrow(made, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def dealt_letters(words: DataFrame, groups: int) -> list[str]:
    """The letters of the words in groups of about equal counts; there are at most 90."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).filter("c <> ''").collect()
    out, size = [""] * groups, [0] * groups
    for r in sorted(counts, key=lambda r: (-r["n"], r["c"])):
        at = size.index(min(size))
        out[at], size[at] = out[at] + r["c"], size[at] + r["n"]
    return out


def _block(word: Column, groups: list[str]) -> Column:
    """How many letters of each group a word has."""
    return F.array(*[(F.length(word) - F.length(F.translate(word, g, ""))) if g else F.lit(0) for g in groups])


def _moved(block: Column, size: int, less: int | None, more: int) -> Column:
    return F.array(*[block[i] + ((i == more) - (i == less)) for i in range(size)])


def _neighbours(block: Column, size: int) -> Column:
    """The blocks to meet: the same, those with a letter of one group replaced by one of a later group, those with one letter more."""
    kinds = [(0, block)] + [(1, _moved(block, size, i, j)) for i in range(size) for j in range(i + 1, size)] + [(2, _moved(block, size, None, i)) for i in range(size)]
    return F.array(*[F.struct(F.lit(k).cast("byte").alias("kind"), b.alias("to")) for k, b in kinds])


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _letters(codes: np.ndarray) -> np.ndarray:
    """How often each word has each letter; exact as numbers of the type."""
    n, size = len(codes), len(ALPHABET)
    flat = np.bincount((_INDEX[codes] + np.arange(n)[:, None] * size).ravel(), minlength=n * size)
    return flat.reshape(n, size).astype(np.float32 if codes.shape[1] <= 2000 else np.float64)


def near_pairs(a: list[str], b: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the words one edit apart. The words of each have one length, b's the same or one more; alone: b is a, pairs count once."""
    x, y = _codes(a), _codes(b)
    longer = y.shape[1] - x.shape[1]
    p, q = _letters(x), _letters(y)
    apart = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
    i, j = np.nonzero(apart == (1 if longer else 2))
    if alone:
        i, j = i[i < j], j[i < j]
    fine, step, n = [np.zeros(0, bool)], max(1, (8 << 20) // y.shape[1]), x.shape[1]
    for at in range(0, len(i), step):
        u, v = x[i[at : at + step]], y[j[at : at + step]]
        if longer:  # what is equal from the left and from the right covers the shorter word
            left, right = u == v[:, :-1], (u == v[:, 1:])[:, ::-1]
            fine.append(np.where(left.all(1), n, left.argmin(1)) + np.where(right.all(1), n, right.argmin(1)) >= n)
        else:
            fine.append((u != v).sum(1) == 1)
    keep = np.concatenate(fine)
    return i[keep], j[keep]


def chunks(words: DataFrame, groups: list[str], chunk: int = CHUNK) -> DataFrame:
    """block, part, ws, ns: the words of each block in parts of about ``chunk`` words, fewer of words of over 256 letters."""
    rows = written(words.select("word", "n", _block(F.col("word"), groups).alias("block")), "blocks")
    weight = F.greatest(F.lit(1.0), F.length("word") / 256)
    sizes = written(rows.groupBy("block").agg(F.ceil(F.sum(weight) / chunk).alias("parts")), "parts")
    dealt = rows.join(sizes.hint("merge"), "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    parts = dealt.groupBy("block", "part").agg(F.collect_list(F.struct("word", "n")).alias("x"))
    return parts.select("block", "part", F.col("x.word").alias("ws"), F.col("x.n").alias("ns"))


def near_words(words: DataFrame, groups: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """word, other, other_n of all pairs of words one edit apart, in both directions. words: word (distinct), n."""
    if groups is None:  # how finely blocks are cut
        groups = max(2, min(10, round(math.log2(words.count() + 1) / 3)))
    listed = written(chunks(words, dealt_letters(words, groups), chunk), "chunks")
    x = listed.select(F.explode(_neighbours(F.col("block"), groups)).alias("k"), F.col("part").alias("pa"), F.col("ws").alias("wa"), F.col("ns").alias("na")).select("k.kind", "k.to", "pa", "wa", "na")
    y = listed.select(F.col("block").alias("to"), F.col("part").alias("pb"), F.col("ws").alias("wb"), F.col("ns").alias("nb"))
    met = x.join(y.hint("merge"), "to").filter((F.col("kind") > 0) | (F.col("pa") <= F.col("pb")))
    met = met.select(((F.col("kind") == 0) & (F.col("pa") == F.col("pb"))).alias("alone"), "wa", "na", "wb", "nb")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[pa.Array, pa.Array, pa.Array]] = []
            for k in range(batch.num_rows):
                alone, wa, na, wb, nb = [batch.column(c)[k] for c in range(5)]
                i, j = near_pairs(wa.as_py(), wb.as_py(), alone.as_py())
                if len(i):
                    i, j = pa.array(i), pa.array(j)
                    a, b, m, n = wa.values.take(i), wb.values.take(j), na.values.take(i), nb.values.take(j)
                    out += [(a, b, n), (b, a, m)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=["word", "other", "other_n"])

    return met.mapInArrow(paired, PAIR)


def with_roots(words: DataFrame) -> DataFrame:
    """words (word, form, and others) with root, the last word that forms lead to; forms grow in count, so that they end."""
    links = written(words.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(links.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return words.join(links.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, factor: int = 2, groups: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. words: word (distinct), n (long)."""
    words = written(words.select("word", "n"), "words")
    near = near_words(words, groups, chunk).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    fits = -F.col("best.m") >= factor * F.col("n")
    named = words.join(near.hint("merge"), "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    return with_roots(written(named, "forms"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), slip=97)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op11_variants": op11_variants}
#: A crc32 by its table of 256 remainders; near words by the letters that are left when one is taken out.
ORACLES = {
    "op11_variants": r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM found WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM own, crc),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
out_ AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM out_ a JOIN out_ b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
 UNION SELECT o.word, w.word, w.n FROM out_ o JOIN words w ON o.d = w.word UNION SELECT w.word, o.word, o.n FROM out_ o JOIN words w ON o.d = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
steps(word, place) AS (SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.place = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.place AS root FROM steps s JOIN forms f ON s.place = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
}
