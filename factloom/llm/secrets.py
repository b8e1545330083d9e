r"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of letters, digits and the marks of encoded values (16 characters or more,
with a letter and a digit), values assigned to words such as token or password, and private key
blocks up to their END lines. The forest sees a candidate's length, its character classes and transitions between them, its
coverage by a dictionary, its path and the words beside it (the last five of the 60 characters before
it, the first three of the 40 after it). It is trained, on Spark, from labelled findings: a table of
value, before, after, path and label. Without one, ``example_findings`` makes a labelled table by rule, of
a fixed number of rows. It deals a family of values and a family of places independently, so that no pair
of the two is fixed, and labels them by both: a value of a key's form is a secret unless its words say
that it is a checksum, a version, an identifier or an example; a value of another form never is. A third of
the places use words that no feature counts. Whole key blocks are secrets, their first lines in prose are not.

The dictionary is the corpus's own: the ``dictionary_words`` words (of 3 to 64 letters; longer runs are no words) in
most rows, counted over all texts.

Defined cases: texts of any length are read whole;
null and empty texts have no candidates; repeated rows give repeated findings; a null
path counts as empty; only the named columns are read, so others can't clash; an empty table gives an
empty table; labelled findings of one class keep all candidates of that class's judgement; without any
labelled findings all candidates are kept, with a probability of 0.5; null labels are left out; words that
are in equally many rows are ordered by the word.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of, written

#: Words that a secret is assigned to, and words beside look-alikes.
CUES = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "access", "private")
NOT_CUES = ("example", "sample", "test", "dummy", "commit", "sha", "sha256", "checksum", "version", "uuid", "hash", "placeholder", "md5", "etag", "build", "file", "host", "image")
PATH_CUES = ("test", "example", "sample", "doc", "mock", "fixture")
_LONG = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9=+/_-](?![A-Za-z0-9])"
_ASSIGNED = r"(?:key|token|secret|passw(?:or)?d|pwd|credential)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[^\s\"'<>]{6,})"
#: A key block ends at its END line, within KEY characters and before another begins; without one it is its first line.
KEY = 20_000
_BLOCK = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S]){{0,{KEY}}}?-----END [A-Z ]*PRIVATE KEY-----)?"
_FIND = re.compile(f"(?P<block>{_BLOCK})|(?i:{_ASSIGNED})|(?P<long>{_LONG})")
_WORD = re.compile(r"[A-Za-z]+[0-9]*")
KINDS = {"block": "private_key", "value": "assigned", "long": "long"}
FEATURES = ("length", "digits", "upper", "lower", "marks", "changes", "case_changes", "entropy", "hex", "vowels", "coverage", "cues", "not_cues", "assigned", "quoted", "path", "dots", "repeats", "block")
#: Characters before and after a candidate in which the words beside it are looked for.
BEFORE, AFTER = 60, 40
FINDING = "array<struct<kind:string,start:int,end:int,value:string,features:array<double>>>"


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        value = m.group(kind)
        if kind != "long" or (any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value)):
            out.append((KINDS[kind], *m.span(kind)))
    return out


def _coverage(value: str, words: frozenset[str], lengths: list[int]) -> float:
    """The share of characters that the longest dictionary words cover, from the left."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        for n in lengths:
            if low[i : i + n] in words:
                n = min(n, len(low) - i)
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(low))


@lru_cache(maxsize=4)
def _lengths(words: frozenset[str]) -> list[int]:
    """The lengths that words have, longest first."""
    return sorted({len(w) for w in words}, reverse=True)


def features(value: str, before: str, after: str, path: str, kind: str, words: frozenset[str]) -> list[float]:
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    counts = Counter(value)
    near = [w.lower() for w in _WORD.findall(before)[-5:] + _WORD.findall(after)[:3]]
    hit = lambda cues: float(sum(any(c in w for c in cues) for w in near))
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("m") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum({a, b} == {"u", "l"} for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        0.0 - sum(c / n * math.log2(c / n) for c in counts.values()), float(all(c in "0123456789abcdefABCDEF" for c in value)),
        sum(c in "aeiouAEIOU" for c in value) / n, _coverage(value, words, _lengths(words)), hit(CUES), hit(NOT_CUES),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ('"', "'") and before[-1:] == after[:1]), float(any(c in path.lower() for c in PATH_CUES)),
        (value.count(".") + value.count("/") + value.count("-")) / n, max(counts.values(), default=0) / n, float(kind == "private_key"),
    ]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 2000) -> frozenset[str]:
    """The ``size`` lower-case words (3 to 64 letters) that most texts hold; ties by the word.

    The counts are written; a histogram of them, of at most 64 x 8 rows, tells which count is enough, so
    that few words but those asked for are ordered.
    """
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+"))).alias("w")).filter(F.length("w").between(3, 64))
    counts = written(words.groupBy("w").agg(F.count("*").alias("n")), "counts")
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    have, least = 0, 1
    for r in steps:
        have, least = have + r["words"], r["n"]
        if have >= size:
            break
    top = written(counts.filter(F.col("n") >= least), "top").orderBy(F.desc("n"), "w").limit(size)
    return frozenset(r["w"] for r in top.collect())  # at most ``size`` words


#: The words by which the labelled examples are made. A family of places by what it says of a value.
ASSIGNED = ("token", "secret", "api_key", "password", "auth_token", "client_secret", "private_key", "access_key", "credential")
#: The same outside the words that features count, so that the forest must also judge by a value's form and marks.
ASSIGNED_ELSE = ("login", "signing", "webhook", "vault", "session", "deploy", "service", "cookie")
NAMED_ELSE = ("revision", "digest", "snapshot", "ticket", "release", "document", "trace", "fingerprint")
NAMED = ("commit", "sha256", "md5 checksum", "uuid", "etag", "build", "version", "image", "example", "sample", "test", "placeholder", "host", "file")


def _example(i: int, words: list[str]) -> tuple[str, str, str, str, int]:
    rng = random.Random(f"finding {i}")
    w = lambda: rng.choice(words)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    keyed_ = {
        "hex": lambda: some("0123456789abcdef", rng.choice((32, 40, 48, 64))), "base64": lambda: some(lower + lower.upper() + digits + "+/", rng.randint(24, 60)) + rng.choice(("", "=", "==")),
        "prefixed": lambda: some(lower, rng.randint(2, 4)) + "_" + some(lower + lower.upper() + digits, rng.randint(24, 40)), "capitals": lambda: some(lower.upper(), 4) + some(lower.upper() + digits, 16),
        "password": lambda: w()[:5] + some(lower + lower.upper() + digits + "!#$%", rng.randint(8, 14)),
    }
    plain = {
        "name": lambda: "_".join(w() for _ in range(3)) + str(rng.randrange(100)), "camel": lambda: "".join(w().title() for _ in range(3)) + str(rng.randrange(10)), "path": lambda: f"{w()}/{w()}/{w()}-{rng.randrange(99)}.{rng.choice(('txt', 'py', 'png'))}",
        "host": lambda: f"{w()}{rng.randrange(99)}.{w()}.{rng.choice(('internal', 'org', 'net', 'example'))}", "time": lambda: f"20{rng.randint(10, 40)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T00-00-0{rng.randint(0, 9)}Z",
        "version": lambda: f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}-{w()}-{w()}", "repeat": lambda: rng.choice("x*0a") * rng.randint(14, 20) + "1", "words": lambda: w() + w() + w() + str(rng.randrange(10)),
    }
    if rng.random() < 0.1:  # key blocks, and their first lines in prose
        kind, whole = rng.choice(("", "RSA ", "EC ", "OPENSSH ")), rng.random() < 0.6
        lines = "\n".join(some(lower + lower.upper() + digits + "+/", 64) for _ in range(rng.randint(3, 26)))
        head = f"-----BEGIN {kind}PRIVATE KEY-----"
        return (f"{head}\n{lines}\n-----END {kind}PRIVATE KEY-----", f"{w()} {w()}\n", "\n", "", 1) if whole else (head, f"{w()} line ", f" {w()} {w()}", "", 0)
    named = rng.random() < 0.4
    real = rng.random() < 0.65
    elsewhere = rng.random() < 0.3
    value = rng.choice(list((keyed_ if real else plain).values()))()
    lead = " ".join(w() for _ in range(3))
    if named:
        before, after = f"{lead} {rng.choice(NAMED_ELSE if elsewhere else NAMED)}{rng.choice((' ', ':', ': ', ' is '))}", rng.choice((" ", ", ", "")) + w()
    else:
        cue, quote = rng.choice(ASSIGNED_ELSE if elsewhere else ASSIGNED), rng.choice(('"', "'", ""))
        before = rng.choice((f"{lead} {cue} = {quote}", f"{lead} {cue}: {quote}", f"{lead} {cue.upper()}={quote}", f"{lead} bearer {quote}"))
        after = quote + " " + w()
    if not named and not real and rng.random() < 0.5:  # names of things beside no cue at all
        before, after = f"{lead} ", " " + w()
    path = rng.choice(("tests/test_app.py", "docs/example.md") if named and rng.random() < 0.5 else ("src/app.py", "config/prod.env", ""))
    return value, before, after, path, int(real and not named)


def example_findings(spark: SparkSession, words: frozenset[str], rows: int = 6000) -> DataFrame:
    """Labelled findings by rule: value, before, after, path, label."""
    listed = sorted(words) or ["alpha", "beta", "gamma"]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_example(int(i), listed) for i in batch["id"]], columns=["value", "before", "after", "path", "label"])

    return spark.range(0, rows, 1, 4).mapInPandas(made, "value string, before string, after string, path string, label int")


def train(findings: DataFrame, words: frozenset[str], trees: int = 30, depth: int = 8):
    """A forest fitted on labelled findings; None without any."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    @F.pandas_udf("array<double>")
    def seen(value: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([features(v or "", b or "", a or "", p or "", "private_key" if (v or "").startswith("-----BEGIN") else "long", words) for v, b, a, p in zip(value, before, after, path, strict=True)], dtype=object)

    rows = written(findings.filter("label is not null").select(seen("value", "before", "after", "path").alias("f"), F.col("label").cast("double").alias("label")), "findings")
    if rows.isEmpty():
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=11).fit(rows.select(array_to_vector("f").alias("vector"), "label"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: DataFrame | None = None, threshold: float = 0.5, dictionary_words: int = 2000) -> DataFrame:
    """id_col, kind, start, end, value, probability, secret of every candidate; secret is false for those that the forest rejects."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    small_batches(docs.sparkSession)
    words = dictionary(docs, text_col, dictionary_words)
    forest = train(example_findings(docs.sparkSession, words) if findings is None else findings, words)

    @F.pandas_udf(FINDING)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            yield pd.Series([
                [{"kind": k, "start": s, "end": e, "value": t[s:e], "features": features(t[s:e], t[max(0, s - BEFORE) : s], t[e : e + AFTER], p, k, words)} for k, s, e in candidates(t)]
                for t, p in zip(texts, paths, strict=True)
            ], dtype=object)

    path = text_of(path_col) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(found(text_of(text_col), path)).alias("c")).select("_id", "c.*")
    if forest is None:
        judged = rows.withColumn("sure", F.lit(0.5))
    else:
        judged = forest.transform(rows.withColumn("vector", array_to_vector("features")))
        judged = judged.withColumn("sure", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return judged.select(F.col("_id").alias(id_col), "kind", "start", "end", "value", F.col("sure").alias("probability"), (F.col("sure") >= threshold).alias("secret"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents")).filter("secret")
    return out.select("doc_id", "kind", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability")


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
