r"""Repeated byte strings, by distributed prefix doubling.

Each byte that a string of ``length`` bytes covers which also starts earlier (a smaller id, or the same
document at a smaller place) is removed. Prefix doubling names the strings of a length that start at each
position by ranks, makes the ranks of twice the length from the pairs of ranks at a position and at the
offset, and drops positions as soon as their rank is unique. Two things make it fit a cluster whose disks
hold a few times the input, where one row for each byte wouldn't:

- Ranks are 64-bit Karp-Rabin names, so that a position carries the rank at its offset with it and no
  join has to fetch it: equal strings have equal names, wherever they stand. The last rank is a pair of
  names of independent halves, 128 bits.
- The first rounds rank only sampled positions. The position of the smallest name of ``GRAM`` bytes within
  each string of ``length`` bytes, about one in 39, is its anchor. Equal strings have their anchors at
  equal places, so a string whose anchor has a unique rank is unique. Of anchors with a repeated rank the
  neighbourhoods (all strings that the anchor stands for) are ranked: a neighbourhood that stands earlier
  has only repeated strings. Where one rank has several neighbourhoods, as at the ends of shared passages,
  the first of each is cut into blocks of ``BLOCK`` starts at equal distances from the anchor. These are
  ranked in the same way, by the bytes that all strings of a block share and by the whole block, and all
  positions of the blocks that stay open enter the last doubling: the ranks of a half, whose unique ones
  go, and the pairs of the rank at a position and the rank at the offset.

Every sort and count is Spark's; Python names the strings of a text, in pieces of ``PIECE`` bytes.

Defined cases: null and empty texts, and texts shorter than ``length``, lose nothing; very long texts are
named piece by piece, with the same result; strings overlap freely, also within a text; rows with the same
id and text are one occurrence and stay alike; of rows with one id, or with none, and different texts the
one with the smaller hash comes first; a null id comes first; columns of any name pass through, except that
columns kept, n_bytes, n_removed and n_spans are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_key, hinted, keyed, quoted, row_key, small_batches, table, text_of, written

LENGTH, GRAM, BLOCK = 100, 24, 8
#: Positions of a text that are named at once; the place in a piece fits PLACE bits.
PIECE, PLACE = 1 << 19, 20
_LOW = np.uint64((1 << PLACE) - 1)
#: A row's place: its first start, over the number of its starts and the distance of the first from the anchor.
STARTS, DISTANCE = 20, 10
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@lru_cache(maxsize=2)
def _letters(base: int) -> np.ndarray:
    """A 64-bit number for each byte, by splitmix64."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(base)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2 to the 64, 2 to the ``bits`` of each."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Names:
    """Names of the substrings of some bytes: equal strings have equal names."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        n = len(data)
        powers, self.inverse = _powers(base, max(12, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(base)[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all_of(self, size: int) -> np.ndarray:
        """The names of all strings of a size, by start."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def packed(lo: np.ndarray, n: np.ndarray, d: np.ndarray | int = 0) -> np.ndarray:
    return lo << (STARTS + DISTANCE) | n << DISTANCE | d


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> (STARTS + DISTANCE), place >> DISTANCE & (1 << STARTS) - 1, place & (1 << DISTANCE) - 1


def _with(name: np.ndarray, distance: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return (name ^ (distance << STARTS | starts).astype(np.uint64)) * np.uint64(_BASES[0])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """rank, neighbourhood and place of each anchor of at most PIECE starts; runs of equal ones are two rows."""
    starts, width = len(data) - length + 1, length - gram + 1
    names = Names(data)
    ranks = names.all_of(gram)
    least, span = (ranks & ~_LOW) | np.arange(len(ranks), dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _LOW).astype(np.int64)
    lo = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    hi = np.concatenate((lo[1:], [starts]))
    at = at[lo]
    rank, around = ranks[at], Names(data, _BASES[1]).of(lo, hi - 1 + length)
    around = _with(around, at - lo, hi - lo)
    new = np.ones(len(lo), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (around[1:] != around[:-1])
    first = np.flatnonzero(new)
    end = np.concatenate((first[1:], [len(lo)]))
    again = end - first > 1  # the rest of a run stands after its first
    rows = np.concatenate((first, first[again] + 1))
    until = np.concatenate((hi[first], hi[end[again] - 1]))
    return rank[rows].view(np.int64), around[rows].view(np.int64), packed(lo[rows], until - lo[rows], (at - lo)[rows])


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without a copy."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for a, b in zip(places[:-1], places[1:], strict=True):
        yield whole[a:b]


def _pieces(data: np.ndarray, length: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(data) - length + 1, size):
        yield at, data[at : at + size + length - 1]


def _out(batch: pa.RecordBatch, rows: list[int], counts: list[int], columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.RecordBatch:
    """_id and _key of each row, repeated, beside the columns."""
    index = pa.array(np.repeat(np.array(rows, np.int64), np.array(counts, np.int64)))
    ids = [batch.column(batch.schema.get_field_index(c)).take(index) for c in ("_id", "_key")]
    made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([*ids, *made], names=["_id", "_key", *names])


def _named(df: DataFrame, of, names: tuple[str, ...], length: int, piece_size: int) -> DataFrame:
    """_id, _key and the columns that ``of`` gives for each piece of each text; where places are listed each piece gets its own. df: _id, _key, _text, and places perhaps."""
    listed = "places" in df.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            rows, counts, columns = [], [], [[] for _ in names]
            for i, data in enumerate(_bytes(column("_text"))):
                if listed:
                    lo, n, d = unpacked(column("places")[i].values.to_numpy(zero_copy_only=False))
                for at, piece in _pieces(data, length, piece_size):
                    if listed:
                        mine = (lo >= at) & (lo < at + piece_size)
                        if not mine.any():
                            continue
                        found = of(piece, lo[mine] - at, n[mine], d[mine])
                    else:
                        found = of(piece)
                    rows.append(i)
                    counts.append(len(found[0]))
                    for c, name, v in zip(columns, names, found, strict=True):
                        c.append(v + (at << STARTS + DISTANCE) if name == "place" else v)
            yield _out(batch, rows, counts, columns, names)

    return df.mapInArrow(made, f"_id {df.schema['_id'].dataType.simpleString()}, _key long, " + ", ".join(f"{n} long" for n in names))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 to lo + n - 1 of each."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def blocks(data: np.ndarray, lo: np.ndarray, n: np.ndarray, d: np.ndarray, length: int, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """rank, around and place of the blocks of starts of neighbourhoods, cut by the distance of a start from its anchor.

    The rank names the bytes that all strings of a whole block have, so that equal strings have equal ranks however their blocks are cut.
    """
    many = d // block - (d - n + 1) // block + 1
    j, at = _spread((d - n + 1) // block, many), np.repeat(lo + d, many)
    first, last = np.maximum(at - (j + 1) * block + 1, np.repeat(lo, many)), np.minimum(at - j * block, np.repeat(lo + n - 1, many))
    core = Names(data).of(at - j * block, at - (j + 1) * block + 1 + length)
    whole = Names(data, _BASES[1]).of(first, last + length)
    whole = _with(whole, at - first, last - first + 1)
    return core.view(np.int64), whole.view(np.int64), packed(first, last - first + 1, at - first)


def ranks(data: np.ndarray, lo: np.ndarray, n: np.ndarray, d: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The ranks of the half of the strings at all starts, the ranks at the offset, and the places."""
    p, half = _spread(lo, n), length // 2
    return Names(data).of(p, p + half).view(np.int64), Names(data, _BASES[1]).of(p + half, p + length).view(np.int64), packed(p, np.int64(1))


def _later(rows: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """The first place of each rank and its rows, and the rows of a rank at another place than its first. Ranks are never null, ids may be."""
    place = F.struct("_id", "_key", "place")
    firsts = written(rows.groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("m")), "firsts")
    met = rows.join(firsts.filter("m > 1").drop("m").hint("merge"), list(by)).filter(~place.eqNullSafe(F.col("first")))
    return firsts, met.select("_id", "_key", "place")


def _repeated(rows: DataFrame, rank: str) -> DataFrame:
    """The rows whose rank isn't unique."""
    again = written(rows.groupBy(rank).agg(F.count("*").alias("m")).filter("m > 1").select(rank), "ranks")
    return written(rows.join(again.hint("merge"), rank), "shared")


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Then an id alone tells rows apart."""
    return df.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("c")).filter("c > 1").isEmpty()


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, broadcast_rows: int = 8_000_000, unique: bool = False, piece_size: int = PIECE) -> DataFrame:
    """_pid, _pkey and spans, the starts and ends (exclusive, in turn) of the maximal removed runs of bytes, of each row that has some.

    broadcast_rows: up to so many places, which are counted (a long each), they are broadcast to the texts; beyond that the texts are
    shuffled. unique: ids are, and _pkey is zero. piece_size: positions of a text that are named at once, at most PIECE.
    """
    if not 2 * GRAM <= length < 1 << DISTANCE:
        raise ValueError(f"length must be {2 * GRAM} at least and under {1 << DISTANCE}")
    small_batches(df.sparkSession)
    key = F.lit(0).cast("long") if unique else row_key(id_col, text_col)
    texts = df.select(F.col(id_col).alias("_id"), key.alias("_key"), text_of(text_col).cast("binary").alias("_text")).filter(F.octet_length("_text") >= length)
    of = lambda f: lambda *x: f(*x, length=length)
    # the first rounds: sampled positions, then blocks of positions
    columns = ("rank", "around", "place")
    gone, open_ = _settled(_repeated(_named(texts, of(anchors), columns, length, piece_size), "rank"))
    more, open_ = _settled(written(_named(_met(texts, open_, broadcast_rows), of(blocks), columns, length, piece_size), "blocks"))
    # the last: ranks of a half, then of all
    rows = written(_named(_met(texts, open_, broadcast_rows), of(ranks), ("half", "rest", "place"), length, piece_size), "positions")
    _, twice = _later(_repeated(rows, "half"), "half", "rest")
    return written(merged(gone.unionByName(more).unionByName(twice), length), "spans")


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has only repeated strings, since it stands earlier as a whole, and what stays open: the first of each kind of a rank that has several.

    What has a unique rank has no repeated strings.
    """
    firsts, later = _later(rows, "rank", "around")
    kinds = written(firsts.groupBy("rank").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("rank"), "kinds")
    return later, written(firsts.join(kinds.hint("merge"), "rank").select("first.*"), "open")


def _met(texts: DataFrame, open_: DataFrame, broadcast_rows: int) -> DataFrame:
    """_id, _key, _text and places of the texts with something open, at most one a start."""
    listed = written(open_.groupBy(F.col("_id").alias("_pid"), F.col("_key").alias("_pkey")).agg(F.collect_list("place").alias("places")), "listed")
    return texts.join(hinted(listed, open_.count(), broadcast_rows), at_key()).select("_id", "_key", "_text", "places")


def merged(gone: DataFrame, length: int) -> DataFrame:
    """_pid, _pkey, spans of the runs that the strings at the starts of places cover; at most one a byte of a text."""
    runs = gone.groupBy("_id", "_key").agg(F.collect_list("place").alias("places"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            spans = []
            for i in range(batch.num_rows):
                lo, n, _ = unpacked(of("places")[i].values.to_numpy(zero_copy_only=False))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate((lo + n - 1 + length)[order])
                cut = np.flatnonzero(lo[1:] > end[:-1]) + 1
                spans.append(np.stack((lo[np.concatenate(([0], cut))], end[np.concatenate((cut - 1, [len(lo) - 1]))]), 1).ravel())
            sizes = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(spans) if spans else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([of("_id"), of("_key"), values], names=["_pid", "_pkey", "spans"])

    return runs.mapInArrow(joined, f"_pid {runs.schema['_id'].dataType.simpleString()}, _pkey long, spans array<long>")


def _kept(text: Column, spans: Column) -> Column:
    """The bytes outside the spans; null texts stay null."""

    @F.pandas_udf("binary")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            out.append(None if t is None else b"".join(t[a:b] for a, b in zip([0, *s[1::2]], [*s[::2], len(t)], strict=True)))
        return pd.Series(out, dtype=object)

    return kept(text, spans)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, broadcast_rows: int = 8_000_000, piece_size: int = PIECE) -> DataFrame:
    """df with kept (binary: the bytes that stay, which may end inside a character), n_bytes, n_removed and n_spans (long)."""
    unique = unique_ids(df, id_col)
    spans = repeated_spans(df, id_col, text_col, length, broadcast_rows, unique, piece_size)
    size = spans.agg(F.coalesce(F.sum(F.size("spans") + 8), F.lit(0))).first()[0]
    rows = keyed(df, id_col, text_col)
    if unique:
        rows = rows.withColumn("_key", F.lit(0).cast("long"))
    both = rows.join(hinted(spans, size, broadcast_rows), at_key(), "left").select("_row", F.col("_text").cast("binary").alias("_text"), "spans")
    some = F.col("spans").isNotNull()
    cut = both.withColumn("_cut", _kept(F.when(some, F.col("_text")), F.col("spans"))).withColumn("_kept", F.when(some, F.col("_cut")).otherwise(F.col("_text")))
    out = [F.col(quoted(c, "_row")).alias(c) for c in df.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    n = F.octet_length("_text").cast("long")
    return cut.select(*out, F.col("_kept").alias("kept"), n.alias("n_bytes"), (n - F.octet_length("_kept")).alias("n_removed"), F.when(some, F.size("spans") / 2).otherwise(0).cast("long").alias("n_spans"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
#: All strings of all positions, as SQL; at sf0.01 that is 2.4 million.
ORACLES = {
    "op12_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents), w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1), g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run), k AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS part, h FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(part, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
}
