r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, URL schemes and identifier cues in one
pass over a text. Deterministic local parsers then expand each anchor to the boundaries of an email,
address or account and validate it. The base kinds are

- email: a local part, an at-sign and at least two dotted labels;
- ip: four dotted runs of digits, each at most 255;
- card: 16 to 19 digits with single spaces or hyphens between, passing Luhn;
- phone: a plus sign and 8 to 15 digits with spaces, dots, brackets or hyphens;

leftmost, without overlaps within a kind, and failing matches aren't tried again. Added kinds, which
never remove a base span: url, iban (after its cue), account (a number after its cue), ssn (after its
cue) and street (a house number before a street cue).

Defined cases: texts of any length are read whole;
null and empty texts have no spans; repeated rows give repeated results; input columns
pass through (an existing output column of that name is replaced); an empty table gives an empty
table; spans count code points, the end is exclusive; equal starts are ordered by end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

SPANS = "array<struct<kind:string,start:int,end:int>>"
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "ssn", "street")
KINDS = BASE + ADDED
#: Cues of the added kinds, found in lower case, capitalised and in capitals.
CUES = {
    "url": ("http://", "https://", "ftp://", "sftp://", "ssh://", "ws://", "wss://"),
    "iban": ("iban",),
    "account": ("account", "acct", "account no", "account number", "routing"),
    "ssn": ("ssn", "social security"),
    "street": (" street", " avenue", " road", " boulevard", " lane", " drive"),
}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"[0-9][\x20().0-9-]+")
_URL = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z0-9-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_IBAN = re.compile(r"[\s:#.-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\s*(?:no|number|num|id))?[\s.:#=-]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SSN = re.compile(r"[^0-9]{1,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w.'-]*){1,4}\Z")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                anchors.add_word(form, kind)
    anchors.add_word("@", "email")
    anchors.add_word("+", "phone")
    for digit in "0123456789":
        anchors.add_word(digit, "digit")
    anchors.make_automaton()
    return anchors


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of one text, by kind as in KINDS and then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = phone_end = run_end = dots_end = chain_end = 0
    for last, kind in automaton().iter(text):
        at = last + 1  # the first character after the anchor
        if kind == "digit":
            start = last
            if start >= run_end:
                run_end = _DIGITS.match(text, start).end()
                if start >= dots_end:  # dotted runs: four at a time
                    parts, stop = [(start, run_end)], run_end
                    while text[stop : stop + 1] == "." and (more := _DIGITS.match(text, stop + 1)):
                        stop = more.end()
                        parts.append(more.span())
                    dots_end = stop
                    for i in range(0, len(parts) - 3, 4):
                        if all(len(x := text[s:e].lstrip("0")) < 4 and int(x or "0") <= 255 for s, e in parts[i : i + 4]):
                            found["ip"].append((parts[i][0], parts[i + 3][1]))
                if start >= chain_end:
                    chain_end = _CHAIN.match(text, start).end()
                    if 16 <= chain_end - start <= 37:
                        digits = text[start:chain_end].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append((start, chain_end))
        elif kind == "email":
            left = _left(text, last, mail_end)
            if left < last and (domain := _DOMAIN.match(text, at)):
                mail_end = domain.end()
                found["email"].append((left, mail_end))
        elif kind == "phone":
            if last >= phone_end and (run := _PHONE.match(text, at)):
                end = run.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end - at > 2:
                    phone_end = end
                    if 8 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                        found["phone"].append((last, end))
        elif kind == "url":
            if m := _URL.match(text, at):
                scheme = last
                while scheme > 0 and text[scheme - 1].isascii() and (text[scheme - 1].isalpha() or text[scheme - 1] in ":/"):
                    scheme -= 1
                end = at + len(m.group().rstrip(".,;:!?)]}"))
                if not found["url"] or found["url"][-1][1] <= scheme:
                    found["url"].append((scheme, end))
        elif kind == "iban":
            if m := _IBAN.match(text, at):
                for n in range(len(m.group(1)), 14, -1):
                    packed = m.group(1)[:n].replace(" ", "")
                    if m.group(1)[n - 1] != " " and 15 <= len(packed) <= 34 and _mod97(packed):
                        found["iban"].append((m.start(1), m.start(1) + n))
                        break
        elif kind == "account":
            if m := _ACCOUNT.match(text, at):
                found["account"].append(m.span(1))
        elif kind == "ssn":
            if m := _SSN.match(text, at):
                found["ssn"].append(m.span(1))
        elif m := _HOUSE.search(text, max(0, last + 1 - 80), last + 1):
            found["street"].append((m.start(), at))
    return [(k, s, e) for k in KINDS for s, e in sorted(set(found[k]))]


def _left(text: str, at: int, floor: int) -> int:
    """Where the run of local-part characters before an at-sign begins."""
    start = at
    while start > floor and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
        start -= 1
    return start


def spans_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] if t else [] for t in texts], dtype=object)

    return spans(text)


def find_pii(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """df with the spans of text_col: kind, start, end."""
    return df.withColumn(out_col, spans_column(text_of(text_col)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """df with each span's characters replaced by stars; lengths and positions stay."""
    starred = F.aggregate(
        F.col(spans_col),
        text_of(text_col),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit("*"), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t))),
    )
    return df.withColumn(text_col, starred)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of each row."""
    small_batches(docs.sparkSession)
    found = find_pii(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
