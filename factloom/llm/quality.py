"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over about twenty statistics of a text. Each partition
adds up its share of the normal equations; the sums, of fixed size, are added up in a tree, at most
32 at a time, and solved on the driver. Scores are calibrated by isotonic regression over raw scores of
other rows, in bins of a width of 1/1000 (a resolution: raw scores outside -1 to 2 are in the outer bins).

Defined cases: texts of any length are read whole;
null and empty texts have all statistics zero and get a score as any other; labels of
a repeated doc_id are averaged, null labels are ignored; without labels every score is the prior (0.5);
equal raw scores are one bin, and repeated rows have equal scores; keep_good() passes columns of any name
through, the others read the named ones alone; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, small_batches, table, text_of, written

MARKS = "#$%&*|~^@=<>{}[]\\_/+"
STATS = ("chars", "words", "word_size", "long_words", "short_words", "letters", "upper", "digits", "space", "stops", "marks", "bangs", "other", "distinct", "repeats", "top_word", "lines", "line_repeats", "line_size", "mark_words")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each UTF-16 unit: 0 lower or other letter, 1 upper, 2 digit, 3 space, 4 stop, 5 mark, 6 bang, 7 other."""
    out = np.full(65536, 7, np.uint8)
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = 1 if kind == "Lu" else 0 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if c.isspace() else 5 if c in MARKS else 6 if c in "!?" else 4 if c in ".,;:'\"()-" else 7
    return out


def statistics(text: str) -> list[float]:
    if not text:
        return [0.0] * len(STATS)
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    kinds = np.bincount(_classes()[units], minlength=8)
    n, letters = len(units), max(1, int(kinds[0] + kinds[1]))
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.mean()) if len(words) else 0.0, float((sizes > 14).mean()) if len(words) else 0.0, float((sizes <= 3).mean()) if len(words) else 0.0,
        letters / n, float(kinds[1]) / letters, float(kinds[2]) / n, float(kinds[3]) / n, float(kinds[4]) / n, float(kinds[5]) / n, float(kinds[6]) / n, float(kinds[7]) / n,
        len(counts) / w, sum(map(eq, words, words[1:])) / w, max(counts.values(), default=0) / w, float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(kinds[5]) / w,
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t or "") for t in texts], dtype=object)

    return stats(text)


def partition_sums(df: DataFrame, add: Callable[[pd.DataFrame], np.ndarray], fan: int = 32) -> np.ndarray | None:
    """The sum of add() over all batches of df: added up in each partition, then ``fan`` sums at a time until one group is left."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if len(batch):
                part = add(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() // fan], "sums": [total.astype(np.float64).tobytes()]})

    def joined(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": batch["g"][:1] // fan, "sums": [sum(np.frombuffer(x) for x in batch["sums"]).tobytes()]})

    sums, left = df.mapInPandas(each, "g int, sums binary"), df.rdd.getNumPartitions()
    while left > 1:
        sums, left = sums.groupBy("g").applyInPandas(joined, "g int, sums binary"), -(-left // fan)
    rows = sums.collect()  # one
    return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None


@dataclass
class Model:
    """mean and scale of the statistics; weights and phases of the features; ridge weights; the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.turn + self.phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by x: the mean x and value of each block."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a1, b1, w1 = blocks.pop()
            a0, b0, w0 = blocks[-1]
            blocks[-1] = [(a0 * w0 + a1 * w1) / (w0 + w1), (b0 * w0 + b1 * w1) / (w0 + w1), w0 + w1]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(labelled: DataFrame, features: int = 256, ridge: float = 1e-4, seed: int = 7, bins: int = 3000) -> Model:
    """A model from stats, label (0 to 1) and calibrate (boolean: rows for the calibration alone)."""
    size = len(STATS)
    stacked = lambda b: np.stack(b["stats"].to_numpy())
    sums = partition_sums(labelled.select("stats"), lambda b: np.concatenate(([len(b)], (x := stacked(b)).sum(0), (x * x).sum(0))))
    if sums is None:
        return Model(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.full(1, 0.5))
    mean = sums[1 : size + 1] / sums[0]
    spread = np.sqrt(np.maximum(sums[size + 1 :] / sums[0] - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(size, features)) / np.sqrt(size), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def normal(b: pd.DataFrame) -> np.ndarray:
        z, y = model.features(stacked(b)), b["label"].to_numpy(np.float64)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    fitting = labelled.filter(~F.col("calibrate"))
    eqs = partition_sums(fitting.select("stats", "label"), normal)
    if eqs is None:
        eqs = partition_sums(labelled.select("stats", "label"), normal)
    d = features + 1
    gram, target = eqs[: d * d].reshape(d, d), eqs[d * d :]
    model.ridge = np.linalg.solve(gram + ridge * max(gram[-1, -1], 1.0) * np.eye(d), target)

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.stack(stats.to_numpy())) if len(stats) else np.zeros(0))

    held = labelled.filter("calibrate").select("label", raw("stats").alias("raw"))
    binned = held.groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * (bins / 3)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w"))
    points = sorted(tuple(r) for r in binned.select("x", "y", "w").collect())  # at most one a bin
    x, y, w = (np.array(v, float) for v in zip(*points, strict=True)) if points else (np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.ones(2))
    model.knots, model.values = isotonic(x, y, w)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """stats with a score."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column.to_numpy())) if len(column) else np.zeros(0))

    return stats.withColumn("score", score("stats"))


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the rows that may be learnt from: a quarter is held out, a quarter calibrates. stats: _id, stats."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    usable = stats.select(F.col("_id").alias("doc_id"), "stats").join(known.filter(fold() != 2).hint("merge"), "doc_id")
    return written(usable.select("stats", "label", (fold() == 3).alias("calibrate")), "labelled")


def _judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (_id, _text and others; written with the statistics in _text's place) with a score."""
    small_batches(rows.sparkSession)
    known = written(rows.withColumn("stats", statistics_column(F.col("_text"))).drop("_text"), "stats")
    return scored(known, fit(labelled_stats(known, labels)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    out = _judged(docs.select(F.col("doc_id").alias("_id"), text_of().alias("_text")), labels)
    return out.select(F.col("_id").alias("doc_id"), F.coalesce(fold("_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least the threshold, with their columns.

    The rows are written once with their statistics, so that no text is looked at twice or shuffled.
    """
    return _judged(keyed(docs, "doc_id", "text").select("_id", "_text", "_row"), labels).filter(F.col("score") >= threshold).select("_row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
