"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import variants


def plain_counts(rows, slip):
    out = Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if slip and h % slip == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [form, n, len(others), words.get(form)]
    for w, r in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        r.append(root)
    return {w: tuple(r) for w, r in out.items()}


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀß÷") for _ in range(rng.randint(3, 9))) for _ in range(25)]
    words = list(base)
    for _ in range(250):
        w = rng.choice(words)
        at = rng.randrange(len(w))
        words.append(w[:at] + rng.choice(["", "x", "ab", "É", w[at]]) + w[at + rng.randint(0, 1) :])
    rows = [(i, "".join(rng.choice(words[: rng.choice((20, 300))]) + rng.choice([" ", "\n", "🙂", "1", "Ā"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    return [*rows, (None, "Longer words, LONGER WORDS"), (7, None), (8, ""), (9, ("m" * 5000 + " ") * 4 + ("m" * 4999 + "n ") * 9), (9, "abcde bcdea " * 5)]


@pytest.mark.parametrize("seed, groups, chunk, slip", [(1, None, 1024, 97), (2, 2, 3, 5), (3, 5, 40, 0)])
def test_against_all_pairs(spark, seed, groups, chunk, slip):
    rows = texts(seed)
    words = plain_counts(rows, slip)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(0))
    counted = variants.word_counts(docs, slip=slip)
    assert {r["word"]: r["n"] for r in counted.collect()} == words
    got = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in variants.variants(counted, groups=groups, chunk=chunk).collect()}
    want = plain(words)
    assert got == want and sum(r[0] is not None for r in want.values()) > 20 and any(want[r[0]][0] for r in want.values() if r[0])


def test_near_pairs():
    """Anagrams, repeated letters and edits at both ends."""
    words = ["aabbc", "abbca", "abcab", "aabbd", "xabbc", "aabb", "abbc", "aabbcc", "aaabbc"]
    for n in (5, 6):
        a, b = [w for w in words if len(w) == n - 1], [w for w in words if len(w) == n]
        for x, y, alone in ((a, b, False), (b, b, True), (b, b, False)):
            i, j = variants.near_pairs(x, y, alone)
            assert sorted(zip(i.tolist(), j.tolist())) == sorted((p, q) for p in range(len(x)) for q in range(len(y)) if near(x[p], y[q]) and (not alone or p < q))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.word_counts(docs)).count() == 0
    assert variants.variants(variants.word_counts(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string"))).count() == 0
