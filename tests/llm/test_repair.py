"""Conversation repair against all edits of short conversations, and damage against its definition."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import repair

GOOD = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """Every (cost, audit, repaired) of rows (role, text, fault) with at most two insertions beside each other."""

    def walk(i, inserted):
        if i == len(rows):
            yield 0, "", []
        else:
            role, text, fault = rows[i]
            more = 5 * (fault == "truncated")
            for cost, audit, out in walk(i + 1, 0):
                yield cost + 2, "D" + audit, out
                if fault not in ("blank", "duplicate"):
                    yield cost + more, "K" + audit, [(role, text), *out]
                    for name in ("user", "assistant"):
                        yield cost + 1 + more, "R" + audit, [(name, text), *out]
        if inserted < 2:
            for cost, audit, out in walk(i, inserted + 1):
                for name in ("user", "assistant"):
                    yield cost + 5, "I" + audit, [(name, ""), *out]

    return (x for x in walk(0, 0) if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in x[2])))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def solved(rows):
    """audit, cost and repaired turns, by the class alone."""
    audit, out = [], []
    v = repair.Viterbi(lambda letter, given: (audit.append(letter), out.append(given) if given else None))
    for (role, text), fault in zip(rows, faults(rows)):
        v.row(role, text, fault)
    return v.end(), "".join(audit), out


def conversation(rng, most):
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", "u2"])
    return [(role(), rng.choice(["Fine.", "Good!", "cut", "", " ", "so?", "a b."]) if rng.random() < 0.6 else f"{rng.random()}.") for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("seed", range(4))
def test_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = conversation(rng, 3)
        assert solved(rows) == min(all_edits([(*r, f) for r, f in zip(rows, faults(rows))]))


def test_insertions_and_ties():
    u, a, s = [(r, f"{r} says.") for r in ("user", "assistant", "system")]
    assert solved([u])[:2] == (2, "D") and solved([u, a])[:2] == (0, "KK") and solved([])[:2] == (0, "")
    assert solved([u, a, u])[:2] == (2, min(x[:2] for x in all_edits([(*u, None), (*a, None), (*u, None)]))[1])
    assert solved([s, s, u, a])[0] == 2 and solved([a, u])[:2] == (2, "RR")


def test_memory_is_bounded():
    """A long conversation without faults keeps few nodes, and all its turns."""
    out = []
    v = repair.Viterbi(lambda letter, given: out.append(letter))
    for i in range(20_000):
        v.row(("user", "assistant")[i % 2], f"{i}.", None)
    assert v.most < 40 and v.end() == 0 and out == ["K"] * 20_000


def test_long_conversations():
    """Against a forward pass that carries whole strings."""
    rng = random.Random(9)
    for _ in range(30):
        rows = [("user" if rng.random() < 0.6 else "assistant", "cut" if rng.random() < 0.2 else f"{i}.") for i in range(rng.randint(20, 120))]
        best = {0: (0, "")}
        grow = lambda b: {**b, **{t: min([x for x in [b.get(t)] if x] + [(b[s][0] + 5, b[s][1] + "I") for s in fro if s in b]) for t, fro in ((2, (0, 1, 3)),) if any(s in b for s in fro) or t in b}}

        def inserted(b):
            b = grow(b)
            if 2 in b:
                b[3] = min([x for x in [b.get(3)] if x] + [(b[2][0] + 5, b[2][1] + "I")])
            return b

        best = inserted(best)
        for (role, _), fault in zip(rows, faults(rows)):
            new = defaultdict(list)
            for s, (c, x) in best.items():
                new[s].append((c + 2, x + "D"))
                if fault in (None, "truncated"):
                    more = 5 * (fault == "truncated")
                    for r, letter, cost in ((role[0], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                        if s in repair.AFTER[r]:
                            new[repair.AFTER[r][s]].append((c + cost + more, x + letter))
            best = inserted({s: min(v) for s, v in new.items()})
        assert solved(rows)[:2] == min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    """The columns of the query, from the definitions. rows: conv_id, turn, role, text."""
    ids, by = {r[0] for r in rows}, defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c in ids:
        found = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in found if t is not None]
        said = [r[1:] for r in found]
        marks = faults(said)
        cost, audit, kept = solved(said)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(":".join(x) for x in kept).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(f) for f in repair.FAULTS], illegal, cost, audit, digest)
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, t if rng.random() < 0.95 else None, *x) for c in [*range(40), None] for t, x in enumerate(conversation(rng, 12))]
    rows += [(50, t, ("user", "assistant")[t % 2], f"turn {t}." * (1 + 5000 * (t == 7))) for t in range(3000)] + [(51, None, None, None)] + [(52, 1, "user", "x.")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_conv", F.lit("mine")).withColumn("_fault", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", *repair.FAULTS, "illegal", "cost", "audit", "repaired_sha256")) for r in repair.op13_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    held = {r["conv_id"]: r["held"] for r in repair.repair_summary(df).collect()}
    assert held[50] < 60


def test_repaired_turns(spark):
    rng = random.Random(12)
    rows = [(c, t, *x) for c in range(30) for t, x in enumerate(conversation(rng, 9))]
    out = repair.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["place"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, text))
    assert dict(got) == {c: kept for c, said in by.items() if (kept := solved(said)[2])}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_summary(df).count() == 0 and repair.repaired_turns(df).count() == 0
