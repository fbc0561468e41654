"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled into columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.llm.batches import whole_text_batches
from tracelark.llm.storage import Scratch, written
from tracelark.llm.words import word_hashes

#: Statistics of a text, all computed over its whole length; text never leaves the scan.
STATISTICS = (
    "n_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "exclaim_per_word",
    "bar_per_word",
    "stop_per_word",
    "distinct_word_share",
    "repeat_word_share",
    "lines_per_word",
    "top_byte_share",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>={}[]\\_+", np.uint8)


class Rule(NamedTuple):
    """A conjunction of bounds, each (statistic, ``<=`` or ``>``, value), and its weight."""

    bounds: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(s) <= v if op == "<=" else F.col(s) > v for s, op, v in self.bounds))


class RuleEnsemble(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The logistic score as a column over the statistics."""
        parts = [F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))


def statistics_of(text: str | None) -> list[float]:
    """The values of STATISTICS, in order; all 0 for a null or empty text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = word_hashes(raw)
    n, size = max(1, len(words)), len(raw)
    visible = max(1, size - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    return [
        float(len(words)),
        visible / n,
        counts[65:91].sum() / visible,
        counts[48:58].sum() / visible,
        counts[_SYMBOLS].sum() / visible,
        counts[33] / n,
        counts[124] / n,
        counts[46] / n,
        len(np.unique(words)) / n,
        float((words[1:] == words[:-1]).sum()) / n,
        counts[10] / n,
        counts[33:128].max(initial=0) / visible,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, print (xxhash64 of the text) and STATISTICS of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics_of(text.as_py()) for text in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in rows.T)], ["doc_id", "print", *STATISTICS])

    schema = ", ".join(["doc_id long, print long", *(f"{s} double" for s in STATISTICS)])
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print")).mapInArrow(run, schema)


def held_out() -> Column:
    """Whether crc32 of the doc_id's text leaves 0 by 5; such rows, and those without an id, are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def tree_rules(tree: str) -> list[Rule]:
    """Every path from the root of one printed decision tree, as a rule."""
    path: list[tuple[str, str, float]] = []
    found = []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            del path[len(m[1]) - 2 :]
            path.append((STATISTICS[int(m[2])], m[3], float(m[4])))
            found.append(Rule(tuple(path)))
    return found


def fit_rules(train: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """Rules from a forest's paths over ``train`` (STATISTICS and label 0.0 or 1.0), weighted by lasso logistic regression."""
    share = train.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
    if not share["n"]:
        return RuleEnsemble(0.0, ())
    if share["p"] in (0.0, 1.0):
        return RuleEnsemble(4.0 if share["p"] else -4.0, ())
    vectors = train.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString)))
    if not rules:
        return RuleEnsemble(float(np.log(share["p"] / (1 - share["p"]))), ())
    fired = vectors.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    kept = tuple(Rule(r.bounds, float(w)) for r, w in zip(rules, weights, strict=True) if w)
    return RuleEnsemble(float(lasso.intercept), kept)


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 50_000) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) as ``labels`` (doc_id, quality) marks quality.

    Learns from labelled documents that are not held out, at most about ``train_rows`` of them, chosen by a hash
    of the id; the fit runs on Spark. Scoring covers all rows and uses text statistics alone.

    Null and empty texts have all statistics 0 and get the score of that point. Rows labelled twice count by
    their mean label, null labels not at all; a repeated document gets the same score each time. Without labels
    every score is 0.5, with one class only 0.98 or 0.02. Texts of any length are counted whole, one batch at a time.
    Other columns are ignored; an empty table gives an empty result.

    Returns doc_id, held_out, score (0 to 1), print (xxhash64 of the text), predicted (1 if score >= 0.3).
    """
    whole_text_batches(docs.sparkSession)
    stats = written(with_statistics(docs), "quality-statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    usable = stats.where(~held_out()).join(marks, "doc_id").withColumn("label", (F.col("label") >= 0.5).cast("double"))
    total = usable.count()
    if total > train_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))
    scratch = Scratch(docs.sparkSession)
    model = fit_rules(scratch.written(usable.select("label", *STATISTICS), "quality-train"))
    scratch.drop()
    score = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"), "print")
    return score.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every document, scored by rules learnt from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")).drop("print")
