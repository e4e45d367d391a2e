"""Operator 11: what filters take away from each other, in every order, as a relational pipeline over words.

1. The rows are written once with a number, and with what a text alone says: capitals, symbols, SHA-256.
2. Words are exploded and grouped by (row, word), then by row, for totals and distinct words. Texts are dealt out by row
   before that, so both groupings stay where the words are; words themselves are never shuffled.
3. The other flags are outer-joined: by row, and by SHA-256 the smallest doc_id of equal texts (groups of over a
   ten-thousandth of all rows by broadcast). Rows of one document, part and set of failures are counted before labels
   are joined, so no id is too frequent.
4. 32 conditional counts for each part, one for each set of failed filters, and as many for good and toxic documents,
   say all about every order: orders are evaluated on them.

Filters (words: maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive), a document failing by: A, few words; B, few distinct
words; C, many of `[A-Z]`; D, one of `[#$%&*|]`; E, a text that is equal to one of a smaller doc_id.

Defined results: a null text is empty, with no words (it fails A, not B or C); empty texts are equal. A row without
doc_id fails E never and has no label; rows that share id and text fail E if a smaller id has the text. A null source is
the part of the empty string. Of repeated labels of a document one of 1 suffices. An empty table has no parts and gives
no rows. Texts are read whole; repeated rows count each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import heavy_and_light, written

LETTERS = "ABCDE"
SETS = 1 << len(LETTERS)
ORDERS = ["".join(x) for x in permutations(LETTERS)]
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    min_words: int = 200
    min_distinct_percent: int = 50
    max_capitals_percent: int = 2


def word_counts(rows: DataFrame) -> DataFrame:
    """(row, words, distinct_words) of (row, text), of the rows that have a word."""
    words = rows.select("row", "text").repartition("row").select("row", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return words.groupBy("row", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("row").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document: doc_id, part, and fails, whose bit k is set if it fails the filter LETTERS[k]."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        (100 * capitals > limits.max_capitals_percent * F.length(text)).alias("c"), text.rlike(r"[#$%&*|]").alias("d"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"),
    )
    rows = written(rows, "rows")
    flags = rows.drop("text")
    copies = written(flags.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    flags = heavy_and_light(flags, copies, "sha", F.col("n"), flags.count())
    both = flags.join(word_counts(rows), "row", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    failed = [words < limits.min_words, 100 * distinct < limits.min_distinct_percent * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))]
    return both.select("doc_id", "part", sum((x.cast("int") * (1 << k) for k, x in enumerate(failed)), F.lit(0)).alias("fails"))


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part: arrays of SETS counts of documents (every), of good ones and of toxic ones, by set of failures."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    few = failed.groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    numbered, others = few.where("doc_id is not null"), few.where("doc_id is null")
    marked = numbered.join(marks, "doc_id", "left").select("part", "fails", "n", "good", "toxic").unionByName(others.select("part", "fails", "n"), allowMissingColumns=True)
    counted = {"every": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    sums = [F.coalesce(F.sum(F.when(F.col("fails") == k, F.col("n") * of)), F.lit(0)).alias(f"{name}{k}") for name, of in counted.items() for k in range(SETS)]
    return marked.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{name}{k}") for k in range(SETS)]).alias(name) for name in counted])


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, of set_counts()."""
    bit_of = lambda letter: F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(LETTERS) for x in (c, 1 << k)]), letter)
    each = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(LETTERS))])))
    each = each.withColumn("bit", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x)))
    sets = F.array(*[F.lit(k) for k in range(SETS)])

    def total(name: str, take: Column | None = None, times: Column | None = None) -> Column:
        """The sum of the counts of the sets (k) for which take holds."""
        zipped = F.zip_with(F.col(name), sets, lambda n, k: F.when(take(k), n * (times(k) if times else 1)).otherwise(0).cast("long"))
        return F.aggregate(zipped, F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda k: k.bitwiseAND(F.col("bit")) != 0
    open_ = lambda k: k.bitwiseAND(F.col("before")) == 0
    here = lambda k: has(k) & open_(k)
    return each.select(
        "part", "filter_order", "step", total("every", lambda k: open_(k) & ~has(k)).alias("kept"), total("every", here).alias("removed"), total("every", lambda k: has(k) & ~open_(k)).alias("redundant"),
        total("every", lambda k: k == F.col("bit")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders
        total("every", has, lambda k: F.lit(len(ORDERS)) / F.bit_count(k)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audited(set_counts(failures(docs, limits), labels))
