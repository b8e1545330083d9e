"""Near-duplicate groups by exact five-word Jaccard against all pairs, and the stage that uses them."""

import random

import pytest

from factloom.llm import shingles
from factloom.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_llm import AWKWARD, DOCS, groups


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-12 if a or b else True


def expected(rows):
    """id -> smallest id of its group, by all pairs of texts."""
    sets = {i: plain_set(t) for i, t in rows}
    return groups(sets, lambda x, y: near(sets[x], sets[y]))


def planted(n=60, words=120):
    """A chain of near copies, a group of many near copies, a passage that unrelated texts share, and others."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage, out = [word() for _ in range(words)], [word() for _ in range(40)], []
    for _ in range(n):  # one word differs from the base: 115 of 116 shingles less at most 5 are shared
        copy = list(base)
        copy[rng.randrange(words)] = word()
        out.append(" ".join(copy))
    chain = [word() for _ in range(words)]
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(words)] = word()
        chain[rng.randrange(words)] = word()
        out.append(" ".join(chain))
    out += [" ".join(passage + [word() for _ in range(rng.choice([4, 30]))]) for _ in range(n // 2)]
    out += [" ".join(word() for _ in range(words)) for _ in range(20)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("longest", [1, 3, 64])
def test_all_pairs(spark, longest):
    rows = planted()
    found = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), longest=longest).collect()
    want = expected(rows)
    assert 30 < len(rows) - len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_documents(spark):
    docs = table(spark, SMALL, "documents")
    want = expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()])
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()} == want


def test_stage_drops_near_copies(spark):
    """The stage keeps one of two texts at a Jaccard over 0.8, although their 3-word fingerprints are more than two bits apart."""
    import corpus_pipeline
    from factloom.llm.simhash import fingerprint

    rng = random.Random(1)
    a = [f"w{rng.randrange(5000)}" for _ in range(150)]
    b = a[:30] + ["x"] + a[31:70] + ["y"] + a[71:110] + ["z"] + a[111:]
    assert near(plain_set(" ".join(a)), plain_set(" ".join(b)))
    assert ((fingerprint(" ".join(a)) ^ fingerprint(" ".join(b))) & (1 << 64) - 1).bit_count() > 2
    docs = spark.createDataFrame([(2, " ".join(a), "en", "s", 1), (1, " ".join(b), "en", "s", 1), (3, " ".join(a[:75]), "en", "s", 1)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, SMALL).collect()) == [1, 3]


def test_stage_has_the_links_of_simhash(spark):
    """Two texts whose fingerprints op4_simhash links are one group in the stage, although their Jaccard is under 0.8."""
    import corpus_pipeline
    from factloom.llm import simhash

    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(40)]
    a, b = " ".join(words * 30), " ".join(words * 30 + ["x"] + words[:8] + ["y"] + words[20:28] + ["z"])
    assert not near(plain_set(a), plain_set(b))
    docs = spark.createDataFrame([(2, a, "en", "s", 1), (1, b, "en", "s", 1), (3, " ".join(words[::-1]), "en", "s", 1)], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, SMALL).collect()) == [1, 3]


def test_cases(spark):
    import corpus_pipeline

    awkward, empty = spark.createDataFrame(AWKWARD, DOCS), spark.createDataFrame([], DOCS)
    rows = shingles.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[5] == 1 and by[3] == 2 and by[2] == 2
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.one_of_each(spark, awkward, SMALL).collect()) == ["1", "2", "4", "6", "None"]
    assert corpus_pipeline.one_of_each(spark, empty, SMALL).count() == 0
