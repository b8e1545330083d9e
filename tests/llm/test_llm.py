"""The operators of the llm subpackage against brute force, SQL, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, components, decontaminate, licenses, linededup, pii, quality, queries, secrets, simhash, winnow
from tests.conftest import SMALL
from tests.oracle import connect, same

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, "a b c d\ne f\ng h\ni j", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x", None, "s", 1), (4, "word " * 30_000, "en", "s", 150_000), (5, "a b c d\ne f\ng h\ni j", "en", "s", 3), (5, "a b c d\ne f\ng h\ni j", "en", "s", 3), (6, "é 🙂 \t\r\n\n\n  z", "en", "s", 9)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name])


# -- pii


def plain_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    fine = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d), "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if fine[k](m.group())]


def test_pii_is_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("@@..+-( )0019a5b%é١_:2") for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == plain_spans(t)
        t = rng.choice(["", " ", "-"]).join(rng.choice(["4111", "1111", "0", "25.", "5", ".", "1.2.3", "+1", "(2)", "@", "a.b"]) for _ in range(12))
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE] == plain_spans(t)


@pytest.mark.parametrize("zeros", [4_301, 100_000])
def test_pii_long_runs_of_digits(zeros):
    for t in ("0" * zeros + ".1.1.1", "1.1.1." + "0" * zeros + "9", "9" * zeros + ".1.1.1", "1.1.1.1." + "0" * zeros, "0" * zeros + "255.0.0.0" + "x" + "4111111111111111"):
        parts = re.match(r"[0-9.]*", t).group().split(".")[:4]
        want = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in parts)
        assert [s[:2] for s in pii.find_spans(t) if s[0] == "ip"] == [("ip", 0)] * want
    assert [s[0] for s in pii.find_spans("0" * zeros + "255.0.0.0" + "x" + "4111111111111111")] == ["ip", "card"]


def test_pii_added_kinds_and_redaction(spark):
    text = "account number: 12345678 at 12 Main Street, IBAN GB82 WEST 1234 5698 7654 32. ssn 123-45-6789 see https://a.example.com/x?q=1."
    assert [k for k, _, _ in pii.find_spans(text)] == ["url", "iban", "account", "ssn", "street"]
    out = pii.redact(pii.find_pii(spark.createDataFrame([(text,)], "text string"))).first()
    assert len(out["text"]) == len(text) and "12345678" not in out["text"]


def test_pii_cases(awkward, empty):
    rows = pii.summary(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["spans"] == "" for r in rows)
    assert pii.summary(empty).count() == 0


# -- quality


def test_quality_held_out(spark):
    out = {r["doc_id"]: r for r in quality.op2_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(out[r["doc_id"]]["score"], r["quality"]) for r in labels if out[r["doc_id"]]["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.95


def test_quality_brute(spark):
    """Ridge weights from the closed form, and the calibration, over all labelled rows at once; sums in trees of two."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.STATS)))
    y = (x[:, 0] + x[:, 3] > 0).astype(float)
    rows = [(list(map(float, a)), float(b), i % 3 == 0) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    labelled = spark.createDataFrame(rows, "stats array<double>, label double, calibrate boolean").repartition(7)
    model = quality.fit(labelled, features=32, ridge=1e-3)
    mean, scale = x.mean(0), x.std(0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    z = np.hstack([np.sqrt(2 / 32) * np.cos(np.clip((x - mean) / scale, -6, 6) @ model.turn + model.phase), np.ones((300, 1))])
    fit = np.arange(300) % 3 != 0
    weights = np.linalg.solve(z[fit].T @ z[fit] + 1e-3 * fit.sum() * np.eye(33), z[fit].T @ y[fit])
    assert np.allclose(model.ridge, weights)
    raw = z @ weights
    bins = {}
    for r, t in zip(raw[~fit], y[~fit], strict=True):
        bins.setdefault(int(np.floor(np.clip(r, -1, 2) * 1000)), []).append((r, t))
    points = sorted((np.mean([p[0] for p in v]), np.mean([p[1] for p in v]), len(v)) for v in bins.values())
    best = np.array([p[1] for p in points])
    # isotonic by its min-max form
    w, n = np.array([p[2] for p in points], float), len(points)
    avg = lambda i, j: (best[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    fitted = [max(min(avg(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert np.all(np.diff(model.values) > 0) and {round(v, 9) for v in model.values} == {round(v, 9) for v in fitted}
    assert np.allclose(quality.partition_sums(labelled.select("label"), lambda b: np.array([len(b), b["label"].sum()]), fan=2), [300, y.sum()])
    scores = quality.scored(labelled, model).collect()
    assert np.allclose([r["score"] for r in scores], model.score(np.array([r["stats"] for r in scores])))


def test_quality_cases(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] is not None for r in rows)
    assert {r["score"] for r in quality.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(y) == [0, 0.5, 1] and list(x) == [0, 1.5, 3]


# -- bpe


def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


def test_bpe_is_tiktoken(spark):
    enc, texts = encoder(), [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(5)
    texts += ["", " ", "\n", " a", "a ", "a\r\nb", " " * 5000, "ab" * 3000 + "é" * 2500, "<|endoftext|>", "it's 'll x's\t y\u0085z", "\x00\x01" * 1500]
    texts += ["".join(rng.choice("ab é\n\t'.,1²🙂\u00a0日") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = bpe.Cutter(bpe.vocabulary(PATH), P.PATTERN).encode(texts)
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_bpe_cache_is_bounded(monkeypatch):
    """Texts with blank lines, which aren't cut into words, leave their pieces alone behind; the bytes kept have a bound."""
    monkeypatch.setattr(bpe, "CACHE", 200_000)
    rng, enc = random.Random(9), encoder()
    cutter = bpe.Cutter(bpe.vocabulary(PATH), P.PATTERN)
    for _ in range(40):
        texts = ["\n\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)) + rng.choice(["", "x" * 3000, " " * 400]) for _ in range(5)]
        assert [x.tolist() for x in cutter.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
        kept = [x for known in (cutter.plain, cutter.spaced, cutter.pieces) for x in known]
        assert max(map(len, kept), default=0) <= bpe.KEPT_WORD and sum(bpe.ENTRY + len(x) for x in kept) <= 200_000


def test_bpe_round_trip(awkward, empty):
    for r in bpe.decode(bpe.encode(awkward, PATH, P.PATTERN), PATH).collect():
        assert (r["text"] or "").encode() == bytes(r["decoded"])
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0


def test_bpe_digests_take_one_worker(awkward):
    """Two columns from Python would keep two workers a task, each with the ranks; the digests are those of encode() and decode()."""
    from pyspark.sql import functions as F

    out = bpe.digests(awkward, PATH, P.PATTERN)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    apart = bpe.decode(bpe.encode(awkward, PATH, P.PATTERN), PATH)
    ids = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, apart.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")).collect()))


# -- simhash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in listed}


def test_simhash_fingerprints(spark, awkward):
    for t in [r["text"] or "" for r in awkward.collect()] + ["A B", "Ä b\x0bC\x1cd", "x\u00a0y z w"]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_links(spark, bits):
    """Every link, of groups of near copies and of a list that holds most fingerprints (equal in four bytes)."""
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for s in seeds for _ in range(25)} | {0, 1 << 63, 3 << 62}
    prints |= {seeds[0] ^ sum(1 << rng.choice((0, 1, 2, 9, 17, 18, 30, 31)) for _ in range(4)) for _ in range(200)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    frame, want = spark.createDataFrame([(p,) for p in signed], "fp long"), {(a, b) for a in signed for b in signed if a < b and near(a, b)}
    links = simhash.links(frame, bits)
    for found in (links, simhash.links(frame, bits, longest=3), simhash.links(frame, bits, longest=10_000)):
        rows = [(r["a"], r["b"]) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    found = components.components(links).collect()
    want = groups(signed, near)
    sizes = Counter(want.values())
    assert {r["node"]: r["root"] for r in found} == {v: r for v, r in want.items() if sizes[r] > 1}


def test_simhash_counts_filter(spark):
    """Of the pairs that meet in a list by four equal bytes, the tally rejects those of four or five equal bytes."""
    base = 0x0123456789ABCDEF
    listed = [base, base ^ 0x0101010100000000, base ^ 0x0001010100000000, base ^ 0x0000010100000000, base ^ 0x0300000000000000, base ^ 0x0700000000000000]
    rows = spark.createDataFrame([(0, 7, p) for p in listed], "list int, bytes long, fp long")
    met = rows.alias("x").join(rows.alias("y"), F.col("x.fp") < F.col("y.fp")).select(simhash.shared_bytes(F.col("x.fp"), F.col("y.fp")).alias("n"))
    shares = Counter(r["n"] for r in met.collect())
    enough = lambda a, b: sum((a >> 8 * i & 255) == (b >> 8 * i & 255) for i in range(8)) >= 6
    near = {(a, b) for a in listed for b in listed if a < b and enough(a, b) and (a ^ b).bit_count() <= 2}
    assert shares[4] and shares[5] and {(r["a"], r["b"]) for r in simhash.tallied(rows, 2).collect()} == near


def test_simhash_cases(awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[5] == 1 and by[3] == 2 and by[2] == 2
    kept = simhash.keep_first(awkward).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "4", "6", "None"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(chain).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 203


# -- decontamination


def test_decontaminate_brute(spark, awkward, empty):
    rng = random.Random(2)
    w = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([1, 3, 5, 9, 20, 40])))) for i in range(30)] + [(30, ""), (31, None)]
    docs = []
    for i in range(80):
        t = (items[i % 30][1] or "").split()
        cut = t[rng.randint(0, 2) :]
        docs.append((i, " ".join(w(rng.randint(0, 200)) + cut + w(50)).title()))
    docs.append((80, None))
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    want = set()
    for i, text in items:
        t = (text or "").split()
        n = min(5, len(t))
        for d, other in docs:
            if n and len(grams(t, n) & grams((other or "").lower().split(), n)) >= 0.8 * len(grams(t, n)) - 1e-9:
                want.add((d, i))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["_id"], r["item_id"]) for r in decontaminate.contained_items(d, b).collect()}
    assert got == want and len(want) > 40
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(d, b).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in want}
    assert decontaminate.drop_contaminated(awkward, b).columns == awkward.columns
    assert decontaminate.contained_items(empty, b).count() == 0 and decontaminate.contained_items(d, b.limit(0)).count() == 0


# -- licences, lines


PROSE = " ".join(["river", "stone", "of", "the", "green", "house", "in", "this"] * 60)


def test_licenses(spark, awkward, empty):
    """Licences in a line, over broken lines, in usual paragraphs inside a longer text, inside a sentence, and in full."""
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 300)
    broken = "\n".join(re.findall(r".{1,70}(?: |$)", mit))
    three = mit.replace("The above copyright", "\n\nThe above copyright").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    full = dict(licenses.full_texts())
    rows = [
        (1, "hello there\nReleased under the MIT license\nmore"), (2, f"intro line\n\n{broken}\n\nlast words"), (3, "licensed to nobody"), (4, f"{PROSE}\n\nMIT License\n\nCopyright (c) 2020 A\n\n{three}\n\n{PROSE}\n\n{PROSE}"),
        (5, "This project is licensed under the Apache License, Version 2.0 and welcomes contributions."), (6, PROSE + full["GPL-3.0"] + PROSE), (7, full["Apache-2.0"]), (8, f"{mit}\n{full['MPL-2.0']}"), (9, PROSE * 30 + " Released under the MIT License " + PROSE * 30),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.find_licenses(docs).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "MIT"), (2, "MIT"), (4, "MIT"), (5, "Apache-2.0"), (6, "GPL-3.0"), (7, "Apache-2.0"), (8, "MIT"), (8, "MPL-2.0"), (9, "MIT")]
    assert all(r["dice"] >= 0.8 for r in got)
    assert sorted(map(tuple, licenses.find_licenses(docs.unionByName(docs)).collect())) == sorted(map(tuple, got))
    assert licenses.find_licenses(awkward).count() == 0 and licenses.find_licenses(empty).count() == 0


def test_licenses_brute(spark):
    """Every window of the three lengths, against texts with words changed, and a tie between two licences of one text."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(60)}"
    templates = [("B", " ".join(word() for _ in range(30))), ("C", " ".join(word() for _ in range(6)))]
    templates += [("A", templates[0][1])]
    rows = []
    for i in range(60):
        t = templates[i % 2][1].split()
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 90))] + t + [word() for _ in range(rng.randint(0, 90))])))
    heads, _ = licenses.template_rows(templates, 0.8)
    want = {}
    for i, text in rows:
        w = text.split()
        finds = set()
        for t, name, n, low, step, _, lengths, _ in heads:
            body = templates[t][1].split()
            known = Counter(zip(body, body[1:], strict=False))
            for size in lengths:
                size = min(size, len(w) - 1)
                last = len(w) - 1 - size
                for at in {*range(0, last + 1, step), last} if size >= low else ():
                    part = w[at : at + size + 1]
                    shared = (Counter(zip(part, part[1:], strict=False)) & known).total()
                    if 2 * shared / (size + n) >= 0.8:
                        finds.add((name, at, at + size + 1, shared, 2 * shared / (size + n)))
        def best(found, group, share):
            out = []
            for g in sorted({group(f) for f in found}):
                runs, end = [], None
                for f in sorted((f for f in found if group(f) == g), key=lambda f: (f[1], f[2], f[0])):
                    if end is None or f[1] >= end - share * (f[2] - f[1]):
                        runs.append([])
                    runs[-1].append(f)
                    end = max(end or 0, f[2])
                out += [min(r, key=lambda f: (-f[3], -f[4], f[0], f[1], f[2])) for r in runs]
            return out
        want |= {(i, f[1], f[2], f[0]): f[4] for f in best(best(finds, lambda f: f[0], 0), lambda f: 0, 0.5)}
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["license"]): r["dice"] for r in got} == want and len(want) > 20 and not any(k[3] == "B" for k in want)


def test_line_dedup(spark, awkward, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd \ny"), (3, "b\nc"), (4, "q\nq\nq\nq\nq"), (5, None), (6, "\n\n\n\n")]
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("a\nb\nc\nd", 0), 2: ("x\ny", 3), 3: ("b\nc", 0), 4: ("q", 4), 5: (None, 0), 6: ("\n\n\n\n", 0)}
    shared = [(7, "p\nq\nr\n1"), (7, "p\nq\nr\n2"), (None, "p\nq\nr"), (None, "s\nt\nu\n3"), (None, "s\nt\nu\n4")]  # ids of several texts
    for limit in (0, 1000):
        got = linededup.drop_repeated_lines(spark.createDataFrame(shared, "doc_id long, text string"), broadcast_lines=limit).collect()
        assert sum(r["n_removed"] for r in got) == 9 and len(got) == 5
    long_ = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(100_000))), (2, "\n".join(f"l{i}" for i in range(100_000))), (2, "\n".join(f"l{i % 9}" for i in range(100_000)))], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in linededup.drop_repeated_lines(long_).select("n_removed").collect()) == [0, 100_000, 100_000]
    rows = linededup.drop_repeated_lines(awkward).collect()
    assert len(rows) == len(AWKWARD) and sum(r["text"] == "" and r["n_removed"] == 4 for r in rows) == 2
    assert linededup.drop_repeated_lines(empty).count() == 0


# -- chat


def test_chat_tree(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "\\###</turn>\n", 1.0), (1, 3, 1, "assistant", "better", 5.0), (1, 4, 3, "user", None, 0.0), (1, 5, 99, "system:x", "alone", 0.5), (None, 1, None, "user", "z", None)]
    m = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    out = {(r["tree_id"], r["rank"]): r for r in chat.format_trees(m, top=3).collect()}
    assert chat.read_turns(out[1, 1]["formatted"]) == [("user", "hi"), ("assistant", "better"), ("user", "")]
    assert chat.read_turns(out[1, 2]["formatted"]) == [("user", "hi"), ("assistant", "\\###</turn>\n")]
    assert chat.read_turns(out[1, 3]["formatted"]) == [("system:x", "alone")] and out[None, 1]["n_turns"] == 1
    ring = spark.createDataFrame([(1, 1, 2, "u", "", 0.0), (1, 2, 1, "u", "", 0.0), (1, 3, 1, "u", "", 0.0), (1, 4, None, "u", "ok", 0.0), (2, 1, None, "u", "fine", 0.0)], m.schema)
    assert sorted((r["tree_id"], r["formatted"]) for r in chat.format_trees(ring, top=9).collect()) == [(1, "### u: ok</turn>\n"), (2, "### u: fine</turn>\n")]
    assert chat.format_trees(m.limit(0)).count() == 0


def test_chat_template_round_trip(spark):
    rng = random.Random(1)
    bits = ["\\", "###", "#", "</turn>", "<", "\n", ": ", "### user: ", "é", "ok"]
    rows = [(i, t, rng.choice(["user", "assistant", "a:b\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(60) for t in range(rng.randint(1, 6))]
    done = chat.format_trees(chat.as_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), tree="conv_id")
    for r in done.withColumn("back", chat.read_back(F.col("formatted"), F.col("loss_spans"))).collect():
        said = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["back"]["turns"]] == said
        assert r["back"]["loss"] == "".join(t for role, t in said if role == "assistant")


# -- secrets


def plain_features(value, before, after, path, kind, words):
    """By character and word, from their definitions."""
    n = max(1, len(value))
    kind_of = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m"
    steps = [(kind_of(value[i]), kind_of(value[i + 1])) for i in range(len(value) - 1)]
    low, covered, i = value.lower(), 0, 0
    while i < len(low):
        fit = [x for x in words if len(x) > 2 and low.startswith(x, i)]
        covered += max(map(len, fit), default=0)
        i += max(map(len, fit), default=1)
    beside = [w.lower() for w in re.findall("[A-Za-z]+[0-9]*", before)[-5:] + re.findall("[A-Za-z]+[0-9]*", after)[:3]]
    shares = [value.count(c) / n for c in set(value)]
    return [
        n, *[sum(kind_of(c) == k for c in value) / n for k in "dulm"], sum(a != b for a, b in steps) / n, sum(sorted(s) == ["l", "u"] for s in steps) / n, -sum(p * np.log2(p) for p in shares), re.fullmatch("[0-9a-fA-F]*", value) is not None,
        sum(c in "aeiou" for c in low) / n, covered / max(1, len(value)), sum(any(c in w for c in secrets.CUES) for w in beside), sum(any(c in w for c in secrets.NOT_CUES) for w in beside), bool(re.search(r"[=:][ \"']*$", before)),
        before[-1:] in ("'", '"') and before[-1:] == after[:1], any(c in path.lower() for c in secrets.PATH_CUES), sum(value.count(c) for c in "./-") / n, max(map(value.count, value), default=0) / n, kind == "private_key",
    ]


WORDS = frozenset(["the", "house", "river", "green", "stone", "table", "understandability"])


def test_secrets_brute(spark):
    """Features from their definitions, and the forest's probabilities as the mean of its trees' votes."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = secrets.example_findings(spark, WORDS, 400).collect()
    given = [(r["value"], r["before"], r["after"], r["path"], "long") for r in rows] + [("", "", "", "", "long"), ("understandability1", "a", "", "", "long"), ("a" * 5000, "key=", "", "test", "long"), ("-----BEGIN PRIVATE KEY-----", "'", "'", "", "private_key")]
    made = [secrets.features(*x, WORDS) for x in given]
    for x, f in zip(given, made, strict=True):
        assert np.allclose(f, np.array(plain_features(*x, WORDS), float)), x
    forest = secrets.train(spark.createDataFrame(rows), WORDS, trees=7)
    judged = forest.transform(spark.createDataFrame([(f,) for f in made], "f array<double>").withColumn("vector", array_to_vector("f"))).select("vector", vector_to_array("probability").alias("p")).collect()
    for r in judged:
        votes = np.array([t.predictRaw(r["vector"]).toArray() for t in forest.trees])
        assert np.allclose(r["p"], (votes / votes.sum(1, keepdims=True)).mean(0))


def other_findings(n=400):
    """Labelled by another rule than example_findings: fixed sentences around values from hashes, names and dates."""
    out = []
    for i in range(n):
        h = hashlib.sha512(str(i).encode()).hexdigest()
        out += [(h[:40], "curl -H 'Authorization: Bearer ", "' https", "", 1), (h[:32].upper(), 'db_password = "', '" # prod', "settings.py", 1), ("tok-" + h[3:35], "SERVICE_TOKEN=", "\n", ".env", 1)]
        out += [(h[:40], "fixed in commit ", " last week", "CHANGES", 0), (h[:64], "its sha256 checksum is ", ".", "", 0), (f"release-{i}-candidate-{i % 7}", "we tagged ", " today", "", 0), (f"green{i}.stone.table.org", "see ", " for more", "", 0)]
    return out


def test_secrets_precision_and_recall(spark):
    from pyspark.ml.functions import array_to_vector

    forest = secrets.train(secrets.example_findings(spark, WORDS), WORDS)
    feats = [(secrets.features(v, b, a, p, "long", WORDS), y) for v, b, a, p, y in other_findings()]
    judged = forest.transform(spark.createDataFrame(feats, "f array<double>, label int").withColumn("vector", array_to_vector("f"))).collect()
    hit = sum(r["prediction"] == 1 and r["label"] == 1 for r in judged)
    families = [f"{sum(r['prediction'] == r['label'] for r in judged[i::7])} of {len(judged[i::7])}" for i in range(7)]
    print("right by family (bearer, password, token; commit, checksum, release, host):", families)
    assert hit / sum(r["label"] == 1 for r in judged) > 0.9 and hit / sum(r["prediction"] == 1 for r in judged) > 0.9


def test_secrets_in_documents(spark):
    """The planted tokens (a cue, an equals sign and 40 hex digits) are kept, the names of hosts are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.find_secrets(docs).collect()
    planted = [x for r in docs.collect() for x in re.findall(r"token = \"?([0-9a-f]{40})", r["text"] or "")]
    kept = [r["value"] for r in got if r["secret"]]
    assert planted and sorted(kept) == sorted(planted) and any("example.com" in r["value"] for r in got)


def test_secrets_found(spark, awkward, empty):
    key = hashlib.sha1(b"x").hexdigest()
    docs = spark.createDataFrame([(1, f'say token = "{key}" now', "s"), (2, f"see commit {key} there", "s"), (3, "mail.server1.example.com is up", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs).filter("secret").collect()}
    assert 1 in got and got[1]["value"] == key and 3 not in got
    assert secrets.find_secrets(awkward).count() == 0 and secrets.find_secrets(empty).count() == 0
    labelled = spark.createDataFrame([(key, "token = ", "", None, None)], "value string, before string, after string, path string, label int")
    assert {(r["secret"], r["probability"]) for r in secrets.find_secrets(docs, findings=labelled.limit(0)).collect()} == {(True, 0.5)}
    assert {r["secret"] for r in secrets.find_secrets(docs, findings=labelled).collect()} == {True}
    assert {r["secret"] for r in secrets.find_secrets(docs, findings=labelled.withColumn("label", F.lit(0))).collect()} == {False}


def test_key_blocks(spark):
    """A block up to its END line, one that never ends by its first line, two beside each other, and one past the bound."""
    body = "\n".join("MIIEabc+/0123456789" * 3 for _ in range(20))
    one = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    for text, want in (
        (f"see {one} there", [one]), (f"{one}\n{one}", [one, one]), ("a line -----BEGIN PRIVATE KEY----- and no more", ["-----BEGIN PRIVATE KEY-----"]),
        ("-----BEGIN PRIVATE KEY-----\n" + one, ["-----BEGIN PRIVATE KEY-----", one]), ("-----BEGIN PRIVATE KEY-----" + " " * (secrets.KEY + 1) + "-----END PRIVATE KEY-----", ["-----BEGIN PRIVATE KEY-----"]),
    ):
        assert [text[s:e] for k, s, e in secrets.candidates(text) if k == "private_key"] == want
        assert all(k == "private_key" for k, s, e in secrets.candidates(text))
    docs = spark.createDataFrame([(1, f"my key\n{one}\n", "s"), (2, "The line -----BEGIN PRIVATE KEY----- starts a key.", "s")], "doc_id long, text string, source string")
    got = secrets.find_secrets(docs).collect()
    assert {(r["doc_id"], r["value"], r["secret"]) for r in got} == {(1, one, True), (2, "-----BEGIN PRIVATE KEY-----", False)}


def test_dictionary(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "ab", "Five"]) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    counts = Counter(w for t in texts for w in set(t.lower().split()) if len(w) >= 3)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for size in (0, 1, 4, 7, 100):
        assert secrets.dictionary(docs, size=size) == frozenset(sorted(counts, key=lambda w: (-counts[w], w))[:size])


# -- winnowing


def plain_winnow(text, k, w, hash_of):
    words = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    h = [hash_of(words[i : i + k]) for i in range(len(words) - k + 1)] or ([hash_of(words)] if words else [])
    out = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        if part:
            low = min(part)
            at = i + max(j for j, x in enumerate(part) if x == low)
            if (at, low) not in out:
                out.append((at, low))
    return out


def word_hashes(spark, texts):
    known = spark.createDataFrame([(w,) for w in {w for t in texts for w in re.split(r"[\W_]+", t.lower()) if w} | {"a"}], "w string").withColumn("h", F.xxhash64("w")).collect()
    return {r["w"]: r["h"] % (1 << 64) for r in known}


def plain_run(words, hashes):
    """A cyclic polynomial, word by word: what is there turns by one bit, the next word's hash is added without carry."""
    out = 0
    for w in words:
        out = ((out << 1 | out >> 63) & (1 << 64) - 1) ^ hashes[w]
    return out >> 25


def test_winnowing_brute(spark):
    rng = random.Random(4)
    texts = ["", "one", "one two", "a b c", "z " * 40] + [" ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    table = word_hashes(spark, texts)
    given = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i long, text string, _h string")
    got = winnow.with_fingerprint(given).select("i", "_h", F.transform("fingerprint", winnow.position_of).alias("p"), F.transform("fingerprint", winnow.hash_of).alias("h")).collect()
    for r in got:
        assert list(zip(r["p"], r["h"], strict=True)) == plain_winnow(texts[r["i"]], 3, 8, lambda g: plain_run(g, table)) and r["_h"] == "kept"


@pytest.mark.parametrize("ids", [range(0, 60), [1, 2, 3, 10**15, 10**15 + 1, -5], ["b", "a", "k", "ab", "z", "é"]])
def test_winnowing_edits(spark, ids, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 2)
    monkeypatch.setattr(winnow, "BUCKETS", 3)
    rows = [(i, f"text é{n} " * (n % 12 + 1) + "and so on with the same words each time " * (n % 3)) for n, i in enumerate(ids)]
    got = {r["doc_id"]: r for r in winnow.edited_likeness(spark.createDataFrame(rows, f"doc_id {'string' if isinstance(ids[0], str) else 'long'}, text string")).collect()}
    line = sorted(rows)
    edited = {i: t[: len(t) - len(t) // 2] + line[(n + 1) % len(line)][1][: len(t) // 2] for n, (i, t) in enumerate(line)}
    table = word_hashes(spark, [t for _, t in line] + list(edited.values()))
    prints = lambda t: plain_winnow(t, 3, 8, lambda g: plain_run(g, table))
    for n, (i, t) in enumerate(line):  # likeness: Jaccard of the sets of hashes
        own, cut, after = ({h for _, h in prints(x)} for x in (t, edited[i], line[(n + 1) % len(line)][1]))
        assert abs(got[i]["near_edited"] - len(own & cut) / len(own | cut)) < 1e-12 and abs(got[i]["near_next"] - len(own & after) / len(own | after)) < 1e-12
        assert got[i]["fingerprint"] == ",".join(f"{p}:{h:x}" for p, h in prints(t)) and got[i]["edited_fingerprint"] == ",".join(f"{p}:{h:x}" for p, h in prints(edited[i]))
    for n, (i, t) in enumerate(line):
        after, half = line[(n + 1) % len(line)][1], len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)


def test_winnowing_cases(awkward, empty):
    rows = winnow.edited_likeness(awkward).collect()
    assert len(rows) == len(AWKWARD) and winnow.edited_likeness(empty).count() == 0
    same_ = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 5)}
    assert len(same_) == 1


# -- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        sizes.append(docs.count())
        assert name == "bpe" or docs.columns == columns
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    assert corpus_pipeline.run(spark, SMALL).count() == sizes[-1]
