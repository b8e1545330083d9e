"""Byte-level BPE encoding and decoding with a rank file.

Texts are cut by the tokenizer's pattern; the distinct pieces of a batch become rows of padded numpy
matrices, bucketed by length. In each round every row merges its leftmost pair of minimum rank; pairs
are looked up in a hash table, and finished rows are compacted away.

Defined cases: a null or empty text has no ids; repeated rows give repeated results; other columns
pass through (an existing output column of the same name is replaced); an empty table gives an empty
table. Pieces of more than LONGEST bytes (one run of letters or of spaces without an end) leave the
matrices for a heap with the same ids: a row of n bytes takes up to n rounds of n cells, so that one
piece of 32 KB costs a matrix 4 seconds and the heap 0.2, and one of a megabyte an hour and 12 seconds
(figures in the README).

digests() gets ids and decoded bytes from one worker a task (recode_column), which holds the ranks once.

What a worker keeps between batches are the ids of words and pieces, bounded by the bytes of both
(CACHE); texts are never kept.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

NONE = np.int32(2**31 - 1)
#: Cells of one matrix, bytes kept between batches, the longest word that is kept, characters cut at a time, and the longest row of a matrix.
CELLS, CACHE, KEPT_WORD, CUT, LONGEST = 1 << 16, 24 << 20, 256, 500_000, 2048
#: What an entry of a dict costs besides its characters and ids.
ENTRY = 200
#: A word of letters alone is one piece, and these marks after it are the next piece.
ENDS = tuple(".,;:!?")


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Vocabulary:
    """Ranks of a file, with a hash table from pairs of ids to the rank of their joined bytes."""

    def __init__(self, path: str):
        self.ranks, self.tokens = _ranks(path), token_bytes(path)
        self.packed = [np.int32(i).tobytes() for i in range(len(self.tokens))]
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._fill(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), 0
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slots, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], ranks[put]
            keys, ranks, slots = keys[~put], ranks[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it isn't a token or an id is negative (padding)."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of two or more bytes, each as the bytes of an int32 array."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, starts = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out: list[bytes] = [b""] * len(pieces)
        order, at = np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            small = int(sizes[order[at]])
            if small > LONGEST:
                out[order[at]] = np.array(self.merge_long(pieces[order[at]]), np.int32).tobytes()
                at += 1
                continue
            widest = min(LONGEST, max(4, 1 << (small - 1).bit_length()))
            end = min(int(np.searchsorted(sizes[order], widest, "right")), at + max(1, CELLS // widest))
            rows = order[at:end]
            self._merge(rows, flat, starts[rows], sizes[rows], out)
            at = end
        return out

    def _merge(self, rows: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: list) -> None:
        width, cols = int(sizes.max()), np.arange(int(sizes.max()))
        there = cols < sizes[:, None]
        ids = np.where(there, self.bytes[flat[np.where(there, starts[:, None] + cols, 0)]], np.int32(-1))
        ranks, left = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1), sizes.copy()
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == NONE
            if done.any():  # compaction
                raw, step = ids[done].tobytes(), 4 * ids.shape[1]
                for i, (r, n) in enumerate(zip(rows[done].tolist(), left[done].tolist(), strict=True)):
                    out[r] = raw[i * step : i * step + 4 * n]
                keep = ~done
                rows, ids, ranks, left, at, best = rows[keep], ids[keep], ranks[keep], left[keep], at[keep], best[keep]
                if not len(rows):
                    return
                width = int(left.max())
                ids, ranks, line = ids[:, :width], ranks[:, : max(width - 1, 1)], np.arange(len(rows))
            shift = np.arange(width) > at[:, None]
            ids = np.where(shift, np.concatenate((ids[:, 1:], np.full((len(rows), 1), -1, np.int32)), 1), ids)
            ids[line, at] = best
            ranks = np.where(shift[:, : ranks.shape[1]], np.concatenate((ranks[:, 1:], np.full((len(rows), 1), NONE)), 1), ranks)
            left -= 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
            ranks[after, at[after]] = self.pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """One very long piece: a heap of (rank, position) over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        ranks.append(int(NONE))
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            j = after[i]
            if j >= n:
                return int(NONE)
            key = (ids[i], ids[j])
            if key not in known:
                known[key] = self.ranks.get(self.tokens[key[0]] + self.tokens[key[1]], int(NONE))
            return known[key]

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or ranks[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) != ranks[k]:
                    ranks[k] = new
                    if new != NONE:
                        heapq.heappush(heap, (new, k))
                elif k >= 0 and k == i and ranks[k] != NONE:
                    heapq.heappush(heap, (ranks[k], k))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece, as the bytes of an int32 array."""
        out, rest, raws = {}, [], []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = self.packed[whole]
            else:
                rest.append(piece)
                raws.append(raw)
        if rest:
            out.update(zip(rest, self.merge_rows(raws), strict=True))
        return out


class Cutter:
    """Cuts texts into chunks whose ids don't depend on their neighbours, and keeps the ids of short chunks.

    Where no two white space characters meet, the pattern never matches across a line end or across
    the start of a word's space, so lines and words are the chunks, with keys for "after a space".
    Other texts are cut by the pattern as a whole, and their pieces are the chunks.
    """

    def __init__(self, vocab: Vocabulary, pattern: str):
        import regex

        self.vocab, self.cut, self.pairs = vocab, regex.compile(pattern).findall, re.compile(r"\s\s").search
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.kept = 0

    def _forget(self) -> None:
        """Drop what isn't worth keeping: long chunks at once, all when there is too much."""
        for known in (self.plain, self.spaced, self.pieces):
            for x in self.fresh:
                if len(x) > KEPT_WORD:
                    known.pop(x, None)
        self.kept += sum(ENTRY + 6 * len(x) for x in self.fresh if len(x) <= KEPT_WORD)
        if self.kept > CACHE:
            self.plain, self.spaced, self.pieces, self.kept = {}, {}, {}, 0

    def learn(self, plain: set[str], spaced: set[str], pieces: set[str]) -> None:
        self.fresh: list[str] = []
        for known, new, lead in ((self.plain, plain.difference(self.plain), ""), (self.spaced, spaced.difference(self.spaced), " ")):
            cut = {x: (lead + x,) if x.isalpha() else (lead + x[:-1], x[-1]) if x[-1:] in ENDS and x[:-1].isalpha() else self.cut(lead + x) for x in new}
            self._encode(set(chain.from_iterable(cut.values())))
            get = self.pieces.__getitem__
            known.update((x, b"".join(map(get, y))) for x, y in cut.items())
            self.fresh += new
        self._encode(pieces)

    def _encode(self, pieces: set[str]) -> None:
        new = pieces.difference(self.pieces)
        self.pieces.update(self.vocab.encode_pieces(list(new)))
        self.fresh += new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lined = [[x.split(" ") for x in t.split("\n")] if not self.pairs(t) and "\r" not in t and t[:1] != " " and t[-1:] != " " else None for t in texts]
        whole = {i: self.cut(t) for i, (t, lines) in enumerate(zip(texts, lined, strict=True)) if lines is None}
        plain, spaced = {"", "\n"}, set()
        for lines in lined:
            for words in lines or ():
                plain.add(words[0])
                spaced.update(words[1:])
        self.learn(plain, spaced, set(chain.from_iterable(whole.values())))
        out, get, piece, end = [], self.spaced.__getitem__, self.pieces.__getitem__, self.plain["\n"]
        for i, lines in enumerate(lined):
            raw = b"".join(map(piece, whole[i])) if lines is None else end.join([self.plain[w[0]] + b"".join(map(get, w[1:])) for w in lines])
            out.append(np.frombuffer(raw, np.int32))
        self._forget()
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(cutter: Cutter, texts: pd.Series) -> list[np.ndarray]:
    out, waiting, chars = [], [], 0
    for text in texts:
        waiting.append(text or "")
        chars += len(waiting[-1])
        if chars >= CUT:
            out += cutter.encode(waiting)
            waiting, chars = [], 0
    return out + cutter.encode(waiting)


def _decoded(tokens: list[bytes], lists) -> list[bytes]:
    return [b"" if x is None else b"".join([tokens[i] for i in np.asarray(x).tolist()]) for x in lists]


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int> of the ids of each text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter = Cutter(vocabulary(path), pattern)
        for texts in batches:
            yield pd.Series(_encoded(cutter, texts), dtype=object)

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """The bytes of each list of ids."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = token_bytes(path)
        for lists in batches:
            yield pd.Series(_decoded(tokens, lists), dtype=object)

    return decoded(ids)


def recode_column(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text and the bytes that these stand for, by one worker a task: of two columns each has its own, and its own copy of the ranks."""

    @F.pandas_udf("token_ids array<int>, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        cutter = Cutter(vocab, pattern)
        for texts in batches:
            ids = _encoded(cutter, texts)
            yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "decoded": pd.Series(_decoded(vocab.tokens, ids), dtype=object)})

    return both(text)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """df with the ids of text_col."""
    return df.withColumn(out_col, encode_column(text_of(text_col), path, pattern))


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    return df.withColumn(out_col, decode_column(F.col(ids_col), path))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    small_batches(docs.sparkSession)
    coded = docs.select("doc_id", recode_column(text_of("text"), path, pattern).alias("c")).select("doc_id", "c.*")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
