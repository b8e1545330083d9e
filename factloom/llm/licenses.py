r"""Licence scan: Dice coefficient of word bigrams between windows of a text and licence templates.

Texts and templates become lower-case words of letters, marks and digits; copyright lines go from the
templates. Templates are notices, short licences and, from the folder ``license_texts``, full ones. Dice
over bigrams, repeats counted, is ``2 * shared / (n_window + n_template)``; a window of n bigrams can only
reach the threshold t with templates of ``n * t / (2 - t)`` to ``n * (2 - t) / t`` bigrams. So a template of
n bigrams is compared with windows of three lengths within those bounds (about 4/5 n, n and 5/4 n), that
begin at every eighth of n and at the text's end; a shorter text within the bounds is one window. Where a
licence stands, in a line, over broken lines, in paragraphs or inside a longer text, one of them holds it.

Candidates come first: a window that reaches t shares ``n * t / (2 - t)`` bigrams at least, so it has some of
any choice of more than the others. Of each template the bigrams without common words are chosen, they
meet those of the texts in one map-side join, and are tallied by template and stretch of the text. Only
stretches with enough of them have their windows made and compared. The templates are a fixed list of a
bounded size (about 25,000 bigrams) and are broadcast.

Windows of one licence that overlap are one find: the one that shares most bigrams, then the best
coefficient, the first, the shortest. Finds that cover each other by half or more are one as well, by the
same order and then by name. So a notice inside its licence is part of the licence.

Defined cases: texts of any length are read whole;
null and empty texts and texts of one word have no bigrams and match nothing; repeated rows
give their finds once; a null doc_id is kept; only the named columns are read, so others can't clash; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at_key, hinted, row_key, table, text_of, written

THRESHOLD = 0.8
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
#: Licence, template text. Notices and short licences in full.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full texts by file name; the names of the licences they are.
FULL = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
#: Bigrams with one of these are chosen last.
COMMON = frozenset("the of a to and or in for this that any by is be as with not you your it on are an may shall from which such".split())
#: Rows of candidates up to which they are broadcast; counted before the join.
CANDIDATE_ROWS = 100_000
TEXT_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def full_texts() -> list[tuple[str, str]]:
    folder = Path(__file__).parent / "license_texts"
    return [(name, (folder / f"{file}.txt").read_text(encoding="utf-8")) for file, name in FULL.items()]


def words(text: str) -> list[str]:
    kept = "\n".join(x for x in text.split("\n") if not re.match(r"\s*copyright\b.*\d{4}", x, re.I))
    return re.findall(r"[^\W_]+", kept.lower())


def shape(n: int, threshold: float) -> tuple[int, int, int, int, list[int]]:
    """low, high, step, block, lengths of the windows for a template of n bigrams. A block is as long as the longest unit within the bounds."""
    low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
    return max(1, low), high, max(1, n // 8), high + 1, sorted({max(1, low, n - n // 5), n, min(high, n + n // 4)})


def template_rows(templates: list[tuple[str, str]], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """(template, license, n, low, step, block, lengths, need of each template; template, a, b, n, seed of each of its bigrams)."""
    heads, bigrams = [], []
    for i, (name, text) in enumerate(templates):
        w = words(text)
        counts = Counter(zip(w, w[1:], strict=False))
        n = len(w) - 1
        low, _, step, block, lengths = shape(n, threshold)
        misses, chosen, have = n - low, set(), 0
        for pair, m in sorted(counts.items(), key=lambda x: (x[0][0] in COMMON or x[0][1] in COMMON, -len(x[0][0]) - len(x[0][1]), x[0])):
            if have < misses + -(-n // 6):
                chosen.add(pair)
                have += m
        heads.append((i, name, n, low, step, block, lengths, have - misses))
        bigrams += [(i, a, b, m, (a, b) in chosen) for (a, b), m in sorted(counts.items())]
    return heads, bigrams


def _cut(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TEXT_WORDS), lambda x: x != "")


def _pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, _i, a, b: the bigrams of the words _w."""
    placed = rows.filter(F.size("_w") > 1).select(*keep, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 2)).alias("_i"))
    return placed.select(*keep, "_i", F.get("_w", "_i").alias("a"), F.get("_w", F.col("_i") + 1).alias("b"))


def candidates(cut: DataFrame, heads: DataFrame, seeds: DataFrame) -> DataFrame:
    """_pid, _pkey, template, block_no: the stretches of two blocks with enough chosen bigrams. cut: _id, _key, _w."""
    blocks = F.floor(F.col("_i") / F.col("block")).cast("int")
    met = _pairs(cut, "_id", "_key").join(seeds.hint("broadcast"), ["a", "b"]).select("_id", "_key", "template", "need", F.explode(F.array(blocks, blocks - 1)).alias("block_no"))
    tallied = met.groupBy("_id", "_key", "template", "block_no").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    return tallied.filter("n >= need").select(F.col("_id").alias("_pid"), F.col("_key").alias("_pkey"), "template", F.greatest("block_no", F.lit(0)).alias("block_no")).distinct()


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id_col, start, end (words, end exclusive), license, dice of each find."""
    spark = docs.sparkSession
    heads, bigrams = template_rows(TEMPLATES + full_texts() if templates is None else templates, threshold)
    head = spark.createDataFrame(heads, "template int, license string, n_template int, low int, step int, block int, lengths array<int>, need int")
    known = written(spark.createDataFrame(bigrams, "template int, a string, b string, n int, seed boolean").coalesce(1), "templates")
    base = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), text_of(text_col).alias("_text"))
    seeds = known.filter("seed").select("template", "a", "b").join(head.select("template", "block", "need").hint("broadcast"), "template")
    found = written(candidates(base.select("_id", "_key", _cut(F.col("_text")).alias("_w")), head, seeds), "candidates")
    places = written(found.select("_pid", "_pkey").distinct(), "places")
    texts = base.join(hinted(places, places.count(), CANDIDATE_ROWS), at_key(), "left_semi").groupBy("_id", "_key").agg(F.first("_text").alias("_text"))
    texts = written(texts.select("_id", "_key", _cut(F.col("_text")).alias("_w")), "texts")  # repeated rows once
    some = texts.join(hinted(found, found.count(), CANDIDATE_ROWS), at_key()).join(head.drop("need").hint("broadcast"), "template")
    # from here on rows hold the words of their two blocks, not those of the text
    region = F.slice("_w", F.col("block_no") * F.col("block") + 1, 2 * F.col("block") + 1)
    some = some.select("_id", "_key", *[c for c in head.columns if c != "need"], "block_no", F.size("_w").alias("_words"), region.alias("_w")).withColumn("_l", F.explode("lengths"))
    some = some.withColumn("n_window", F.least("_l", F.col("_words") - 1)).filter("n_window >= low").withColumn("_last", F.col("_words") - 1 - F.col("n_window"))
    first = (F.ceil(F.col("block_no") * F.col("block") / F.col("step")) * F.col("step")).cast("int")
    stop = F.least((F.col("block_no") + 1) * F.col("block") - 1, F.col("_last"))
    grid = F.when(first <= stop, F.sequence(first, F.greatest(first, stop), F.col("step"))).otherwise(F.array().cast("array<int>"))
    tail = F.when(F.floor(F.col("_last") / F.col("block")) == F.col("block_no"), F.array("_last")).otherwise(F.array().cast("array<int>"))
    windows = some.select("_id", "_key", "template", "license", "n_template", "n_window", "_w", (F.col("block_no") * F.col("block")).alias("_from"), F.explode(F.array_distinct(F.concat(grid, tail))).alias("start"))
    key = ["_id", "_key", "template", "license", "n_template", "n_window", "start"]
    # a capped length may be one of the others: the place in the window tells repeats apart
    pairs = _pairs(windows.select(*key, F.slice("_w", F.col("start") - F.col("_from") + 1, F.col("n_window") + 1).alias("_w")), *key)
    met = pairs.join(known.select("template", "a", "b", "n").hint("broadcast"), ["template", "a", "b"])
    each = met.groupBy(*key, "a", "b").agg(F.count_distinct("_i").alias("m"), F.min("n").alias("n"))
    shared = each.groupBy(*key).agg(F.sum(F.least("m", F.col("n"))).alias("shared"))
    scored = shared.withColumn("dice", 2 * F.col("shared") / (F.col("n_window") + F.col("n_template"))).filter(F.col("dice") >= threshold)
    scored = scored.select("_id", "_key", "license", "start", (F.col("start") + F.col("n_window") + 1).alias("end"), "shared", "dice")
    peaks = _best(scored, ["_id", "_key", "license"], F.lit(0.0))
    return _best(peaks, ["_id", "_key"], F.lit(0.5)).select(F.col("_id").alias(id_col), "start", "end", "license", "dice")


def _best(finds: DataFrame, group: list[str], share: Column) -> DataFrame:
    """The best find of each run of finds; one that overlaps those before it by no more than a share of its length begins a run."""
    line = W.partitionBy(*group).orderBy("start", "end", "license")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before - share * (F.col("end") - F.col("start"))), 1).otherwise(0)
    runs = finds.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    best = W.partitionBy(*group, "_run").orderBy(F.desc("shared"), F.desc("dice"), "license", "start", "end")
    return runs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_new", "_run", "_r")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """All windows with a shared bigram, without candidates."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    heads, _ = template_rows(TEMPLATES + full_texts(), THRESHOLD)
    texts = [" ".join(words(t)) for _, t in TEMPLATES + full_texts()]
    values = ", ".join(f"({i}, {quoted(name)}, {n}, {low}, {step}, {lengths}, {quoted(texts[i])})" for i, name, n, low, step, _, lengths, _ in heads)
    runs = lambda source, group, share: (
        f"SELECT * EXCLUDE (new_, run_) FROM (SELECT *, sum(new_) OVER (PARTITION BY {group} ORDER BY start, \"end\", license ROWS UNBOUNDED PRECEDING) AS run_ FROM (SELECT *, CASE WHEN b IS NULL OR start >= b - {share} * (\"end\" - start) THEN 1 ELSE 0 END AS new_ FROM "
        f"(SELECT * EXCLUDE b, max(\"end\") OVER (PARTITION BY {group} ORDER BY start, \"end\", license ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {source}))) QUALIFY row_number() OVER (PARTITION BY {group}, run_ ORDER BY shared DESC, dice DESC, license, start, \"end\") = 1"
    )
    return rf"""
WITH t(template, license, n_template, low, step, lengths, body) AS (VALUES {values}),
tw AS (SELECT template, string_split(body, ' ') AS w FROM t),
tb AS (SELECT template, a, b, count(*) AS n FROM (SELECT template, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM tw) GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS words, unnest(range(0, len(w) - 1)) AS i, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1),
m AS (SELECT doc_id, words, i, a, b, template, n FROM p JOIN tb USING (a, b)),
l AS (SELECT DISTINCT doc_id, words, i, a, b, m.template, n, license, n_template, step, least(len_, words - 1) AS n_window FROM m JOIN (SELECT template, license, n_template, low, step, unnest(lengths) AS len_ FROM t) x ON x.template = m.template AND words - 1 >= low),
s AS (SELECT *, unnest(list_distinct(list_concat(list_transform(range(greatest(0, i - n_window + 1 + step - 1) // step, least(i, words - 1 - n_window) // step + 1), lambda k: k * step), CASE WHEN i >= words - 1 - n_window THEN [words - 1 - n_window] ELSE [] END))) AS start FROM l),
e AS (SELECT doc_id, template, license, n_template, n_window, start, a, b, least(count(*), any_value(n)) AS both_ FROM s GROUP BY ALL),
g AS (SELECT doc_id, license, start, start + n_window + 1 AS "end", sum(both_) AS shared, 2 * sum(both_) / (n_window + n_template) AS dice, NULL::BIGINT AS b FROM e GROUP BY doc_id, template, license, n_template, n_window, start HAVING 2 * sum(both_) / (n_window + n_template) >= {THRESHOLD}),
k AS ({runs('g', 'doc_id, license', '0.0')})
SELECT doc_id, start::INT AS start, "end"::INT AS "end", license, dice::DOUBLE AS dice FROM ({runs('k', 'doc_id', '0.5')})"""


QUERIES = {"op6_licenses": op6_licenses}
ORACLES = {"op6_licenses": _oracle()}
