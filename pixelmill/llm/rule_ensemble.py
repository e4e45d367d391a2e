"""Operator 1: a quality classifier as a sparse ensemble of rules.

Statistics of whole texts are the inputs. A forest of shallow trees is grown on labelled documents; every path from a
root is a rule, a conjunction of bounds on statistics; a logistic regression with an L1 penalty weighs the rules and
sets most weights to zero; the rest compile into one Spark column expression that scores documents.

The fit takes at most SAMPLE_ROWS labelled documents, the first by hash of doc_id, and of rows that share a doc_id one,
that of the smallest statistics; the forest and the regression are Spark ML's.

Defined results: null and empty texts have statistics of zero and get a score like any other; rows are scored one by
one, repeated or not; several labels of a document count as their mean, from 0.5 up as good; without labels of both
classes the score is the smoothed share of good labels; a null doc_id isn't held out; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, written

SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.002
SEED = 7
STATS = (
    "log_words", "word_bytes", "symbols", "bars", "exclamations", "capitals", "digits", "stops", "distinct", "stutter", "lines", "repeated_lines", "unended_lines", "wide_bytes",
)
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
WIDE = bytes(range(0x80, 0x100))


@dataclass(frozen=True)
class Rule:
    """Bounds low < statistic <= high, all of which have to hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = [F.col(k) > low for k, low, _ in self.bounds if low > -math.inf] + [F.col(k) <= high for k, _, high in self.bounds if high < math.inf]
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...] = ()

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(), w).otherwise(0.0) for w, r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def text_stats(data: bytes) -> tuple[float, ...]:
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [x.strip() for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    letters = max(1, count(LETTERS))
    return (
        math.log(n), sum(map(len, words)) / n, count(b"#*$%&<>") / n, data.count(b"|") / n, data.count(b"!") / n, count(UPPER) / letters, count(b"0123456789") / letters, count(b".,;:?") / n,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), sum(x[-1] not in b".!?:;\"')" for x in lines) / len(lines), count(WIDE) / len(data),
    )


def with_stats(docs: DataFrame, keep: str) -> DataFrame:
    """The columns named in keep ("name type, ...") and the statistics of text."""
    names = [x.split()[0] for x in keep.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [text_stats(x or b"") for x in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b[c] for c in names] + [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(STATS))], names + list(STATS))

    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(measure, keep + "".join(f", {c} double" for c in STATS))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def paths(tree: str) -> list[Rule]:
    """The rules of a tree's nodes, read from its debug string."""
    found, stack = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth, k, sign, at = len(m[1]), STATS[int(m[2])], m[3], float(m[4])
            stack = [x for x in stack if x[0] < depth] + [(depth, k, sign, at)]
            bounds: dict[str, list[float]] = {}
            for _, name, s, x in stack:
                low, high = bounds.setdefault(name, [-math.inf, math.inf])
                bounds[name] = [max(low, x), high] if s == ">" else [low, min(high, x)]
            found.append(Rule(tuple(sorted((k, *v) for k, v in bounds.items()))))
    return found


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """rows: the statistics and good (boolean)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    if good in (0, n):
        return Ensemble(math.log((good + 1) / (n - good + 1)))
    data = rows.withColumn("label", F.col("good").cast("double"))
    data = VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(data)
    forest = RandomForestClassifier(featuresCol="stats", numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, min(10, n // 50)), seed=SEED).fit(data)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree.toDebugString)))
    if not rules:
        return Ensemble(math.log((good + 1) / (n - good + 1)))
    data = data.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("rules"))
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=80).fit(data)
    return Ensemble(float(lasso.intercept), tuple((float(w), r) for w, r in zip(lasso.coefficients, rules, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fits to labels.quality of at most sample_rows documents that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # one row for each sampled id, gathered by many tasks; of these, one partition in a fixed order makes the fit repeatable
    stats = with_stats(texts, "doc_id long, good boolean").groupBy("doc_id").agg(F.min(F.struct(*STATS, "good")).alias("r")).select("doc_id", "r.*")
    return fit(written(written(stats, "stats").coalesce(1).sortWithinPartitions("doc_id"), "sample"))


def classify(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = with_stats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id long")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
