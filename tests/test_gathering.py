"""Excerpts against a plain reading of their rules, evidence of several rankings, and vectors that find what shares no term."""

import random
import re

from factloom.operators import gathering, retrieval

STOP = set(retrieval.T.STOPWORDS)


def tokens(t):
    return {w for w in re.findall(r"[^\W_]+(?:[.&'-][^\W_]+)*", t.lower()) if w not in STOP}


def keys(t):
    out = {}
    for m in re.finditer(r"(?i)(?<![\w.])(?:USD\s*|\$\s*)?-?\(?\d[\d,]*(?:\.\d+)?\)?%?", t):
        out.setdefault(f"{float(re.sub(r'(?i)USD|[$,%()]|\s', '', m.group())):.6f}", []).append(m.start())
    return out


def plain(t, queries, most=gathering.EXCERPT):
    """Candidates and a greedy choice, one after another."""
    if len(t) <= most:
        return [], t
    talk = 500 if (said := re.search(r"(?i)\[SPEAKER:[^\]]+\]", t[:1000])) else 0
    size = min(2400, max(1000, most - talk))
    found = []

    def add(points, start, end):
        back, on = t.rfind("\n", max(0, start - 300), start), t.find("\n", end, min(len(t), end + 500))
        found.append((-points, back + 1 if back >= 0 else start, on if on >= 0 else end))

    wanted = {k for q in queries for k in keys(q) if not (float(k).is_integer() and 1900 <= float(k) <= 2100)}
    for k, places in keys(t).items():
        for at in places if k in wanted else ():
            end = min(len(t), max(0, at - size // 2) + size)
            add(10.0, max(0, end - size), end)
    for start in range(0, len(t), 700):
        end = min(len(t), start + size)
        have, numbers = tokens(t[start:end]), set(keys(t[start:end]))
        add(max([len(have & tokens(q)) / max(1, len(tokens(q))) + 4 * len(numbers & set(keys(q))) / max(1, len(keys(q))) for q in queries], default=0), start, end)
        if end == len(t):
            break
    spans = []
    for score, start, end in sorted(found):
        if score < 0 and len(spans) < max(1, (most - talk) // size) and not any(start < b and end > a for a, b in spans):
            spans.append((start, end))
    if not spans:
        return [], t[:most] + "\n\n\n[later text omitted]"
    parts = [t[:500]] if said and not any(a <= said.start() < b for a, b in spans) else []
    for a, b in spans:
        parts += ["[source text omitted]\n"] * bool(parts) + [t[a:b]]
    return spans, "\n\n".join([*parts, "\n[source text omitted]"])


def test_excerpts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["1,234", "$5.50", "2024", "the", "12%"]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(words) + rng.choice([" "] * 30 + ["\n"]) for _ in range(rng.choice((0, 300, 1500, 4000))))
        t = "[Speaker: A B] " * (i % 4 == 0) + t
        rows.append((i, t, [" ".join(rng.choice([*words, "nowhere", "88"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 3))]))
    rows += [(100, None, ["w1"]), (101, "x " * 5000, None), (102, "x " * 5000 + "exactly 77,777 here" + " y" * 5000, ["77777"])]
    out = {r["id"]: ([tuple(s) for s in r["spans"]], r["excerpt"]) for r in gathering.focused_excerpts(spark.createDataFrame(rows, "id long, text string, queries array<string>"), "id").collect()}
    want = {i: plain(t or "", q or []) for i, t, q in rows}
    assert out == want and sum(len(s) for s, _ in want.values()) > 30 and "77,777" in out[102][1]


def test_weighted_evidence(spark):
    """Numbers count before words; a parent of two requests comes once, at the first; other sources don't count."""
    chunks = [("c1", "p1", "A", "10K", "revenue was 1,234 in all"), ("c2", "p2", "A", "10K", "revenue revenue growth margin words"), ("c3", "p3", "B", "10K", "revenue was 1,234"), ("c4", "p4", "A", "10K", "nothing of that"), ("c5", "p1", "A", "10K", "margin too")]
    asks = [(1, 0, "growth", "A", None, ["revenue 1234"], "margin"), (1, 1, "why", "A", "10K", ["nothing", ""], "nothing"), (2, 0, "x", "C", None, ["revenue"], "revenue"), (3, 0, "y", "A", "8-K", ["revenue"], "revenue")]
    out = gathering.weighted_evidence(spark.createDataFrame(asks, "spec_id long, req_ord int, request_id string, source string, doc_type string, hints array<string>, question string"), spark.createDataFrame(chunks, "child_id string, parent_id string, ticker string, doc_type string, text string")).collect()
    got = sorted((r["spec_id"], r["evidence_id"], r["parent_id"], tuple(r["requests"])) for r in out)
    assert got == [(1, "E1", "p1", ("growth",)), (1, "E2", "p2", ("growth",)), (1, "E3", "p4", ("why",))]
    first = next(r for r in out if r["parent_id"] == "p1")
    assert first["score"] > 1 + 0.5 + 4 * 0.5 and first["coverage"] == 1.0


def test_vectors_find_without_shared_terms(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"p{i}", "T", "10K", " ".join(f"term{i * 7 + j}" for j in range(5))) for i in range(40)], "child_id string, parent_id string, ticker string, doc_type string, text string")
    q = spark.createDataFrame([(1, "term0 term1 term2 term3 term4"), (2, "the of")], "question_id long, text string")
    g = spark.createDataFrame([(1, 0, "T", None), (1, 1, "U", None), (2, 0, "T", None)], "question_id long, grp_ord int, ticker string, doc_type string")
    out = sorted(retrieval.dense_children(chunks, q, g, 10).collect(), key=lambda r: r["rank"])
    assert len(out) == 10 and (out[0]["child_id"], out[0]["score"]) == ("c0", 1.0) and all(r["score"] < 1 for r in out[1:]) and {r["question_id"] for r in out} == {1}
