"""Column expressions over text: folding, tokens, fingerprints, shingles, number keys, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the lexical index leaves out.
STOPWORDS = (
    "a", "about", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i",
    "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "what", "when", "which", "who", "why", "with",
)
TOKEN = r"[\p{L}\p{N}]+(?:[.&'-][\p{L}\p{N}]+)*"


def tokens(text: Column) -> Column:
    """Lower-case terms without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0), lambda t: ~t.isin(*STOPWORDS))


def fold_text(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces become plain; lower case; white space collapses."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—\u00a0", "''\"\"-- ")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold_text(text), F.lit("([a-z0-9]+)"), 1)


def fingerprint(text: Column) -> Column:
    return F.sha2(F.array_join(words(text), " "), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens_: Column, width: int = 3) -> Column:
    """The set of runs of width words; fewer words give one gram, none give none."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(width)]))
        return F.when(F.size(t) >= width, F.array_distinct(runs)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens_, of)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def stable_key(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[fold_text(p.cast("string")) for p in parts]), 256), 1, n))


NUMBER = r"(?i)(?:^|[^\p{L}\p{N}_.])((?:USD\s*|\$\s*)?-?\(?\d[\d,]*(?:\.\d+)?\)?%?)"


def number_keys(text: Column) -> Column:
    """The sorted set of numbers of a text: currency, commas and percent signs go, brackets make it negative, outer zeros go."""

    def key(raw: Column) -> Column:
        minus = F.contains(raw, F.lit("(")) & F.contains(raw, F.lit(")")) | F.contains(raw, F.lit("-"))
        digits = F.regexp_replace(raw, r"[^0-9.]", "")
        short = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)
        return F.concat(F.when(minus, "-").otherwise(""), F.regexp_replace(short, r"^0+([0-9])", "$1"))

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 1), key)))


def singular(term: Column) -> Column:
    """Three suffix rules: -ies to -y, -sses to -ss, -s (not -ss, -us, -is) away."""
    n = F.length(term)
    return (
        F.when(term.endswith("ies") & (n > 4), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when(term.endswith("sses"), F.substring(term, F.lit(1), n - 2))
        .when(term.endswith("s") & ~term.endswith("ss") & ~term.endswith("us") & ~term.endswith("is") & (n > 3), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


DATE = r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+20\d{2})\b"


def month_date(text: Column) -> Column:
    """The first "Month D, YYYY" of a text as a date, else null."""
    found = F.regexp_replace(F.regexp_extract(text, DATE, 1), r"\s+", " ")
    return F.to_date(F.try_to_timestamp(F.when(found != "", F.initcap(F.lower(found))), F.lit("MMMM d, yyyy")))


def zoned_timestamp(text: Column) -> Column:
    """An ISO-8601 time with a zone, else null."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(shape, text))
