"""Repeated byte strings against a dictionary of all strings seen before."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import suffix
from tests.conftest import SMALL


def plain(rows, length):
    """kept bytes and spans by (id, text): rows in their order, each string held against all that start before it."""
    seen, out = set(), {}
    for i, t in rows:
        data, gone = t, set()
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone.update(range(p, p + length))
            seen.add(data[p : p + length])
        spans = sum(p - 1 not in gone for p in gone)
        out[i, t] = (bytes(b for p, b in enumerate(data) if p not in gone), len(gone), spans)
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice([rng.choice(passages), " ".join(word() for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(0, 5)))
        if out and rng.random() < 0.4:
            t = rng.choice(out)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t) + 1)
                t = t[:at] + rng.choice(["", "x", "ß", word()]) + t[at + rng.randint(0, 2) :]
        out.append(t)
    return [*out, "ab" * 300, "x" * 1000, "y" + "x" * 400 + "z", "é" * 130, "abcdefg" * 60, "", "x" * 99, "x" * 100]


@pytest.mark.parametrize("seed, piece, broadcast", [(1, 1 << 19, 1_000_000), (2, 150, 0), (3, 37, 1_000_000)])
def test_against_brute_force(spark, seed, piece, broadcast):
    rows = [(i, t) for i, t in enumerate(texts(seed))]
    want = plain([(i, t.encode()) for i, t in rows], suffix.LENGTH)
    out = suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=broadcast, piece_size=piece)
    got = {(r["doc_id"], r["text"].encode()): (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in out.collect()}
    assert got == want and sum(x[1] for x in want.values()) > 5000


def test_names():
    """Equal strings have equal names, and the strings of all sizes of a text of few letters have as many names as there are strings."""
    data = np.frombuffer(bytes(random.Random(4).choices(b"ab", k=3000)), np.uint8)
    for base in suffix._BASES:
        names = suffix.Names(data, base)
        for size in (1, 8, 24, 100):
            strings = [data[i : i + size].tobytes() for i in range(len(data) - size + 1)]
            made = names.all_of(size)
            assert len(set(zip(strings, made.tolist()))) == len(set(strings)) == len(set(made.tolist()))


def test_anchors_cover_all_starts():
    """Without runs, each start has one anchor; equal strings have it at the same place."""
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(2000)), np.uint8)
    lo, n, d = suffix.unpacked(suffix.anchors(data)[2])
    assert [p for a, m in zip(lo, n) for p in range(a, a + m)] == list(range(len(data) - suffix.LENGTH + 1))
    run = suffix.anchors(np.frombuffer(b"x" * 100_000, np.uint8))
    assert len(run[0]) == 2 and sum(suffix.unpacked(run[2])[1]) == 100_000 - suffix.LENGTH + 1


def test_order_of_odd_rows(spark):
    """A null id comes first, rows alike stay alike, one id with two texts has an order of its own."""
    rng = random.Random(6)
    a, b = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (500, 300)]
    rows = [(3, a), (3, a), (None, b), (2, b + a), (7, b), (7, a[:200]), (8, None), (9, "")]
    out = suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("old")).withColumn("_key", F.lit("mine")))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in out.collect())
    assert got == [(-1, 300, 0), (2, 800, 300), (3, 500, 500), (3, 500, 500), (7, 200, 200), (7, 300, 300), (8, 0, 0), (9, 0, 0)]
    assert out.columns == ["doc_id", "text", "_key", "kept", "n_bytes", "n_removed", "n_spans"]


def test_query(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op12_suffix_dedup(spark, SMALL).collect()}
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert got == {i: (len(t), n, s, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, s) in plain(rows, suffix.LENGTH).items()}
