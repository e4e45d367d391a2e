"""Operator 10: near-duplicate documents by a join of MinHash signature coordinates.

Documents with equal shingle sets collapse first. Each distinct set has a key for every pair of its coordinates' values,
and is posted under its keys, rarest first: sets that share at least SHARED of the keys must meet in all but the last
SHARED - 1 of that order, so only that prefix is posted and the frequent rest is skipped. A set with fewer keys that
others have isn't posted at all. Sets that meet have their collisions counted over the whole signatures, and those with
MATCHES or more are confirmed on the full sets. linking.py compares what meets without emitting all pairs of a group;
components follow by union-find.

Keys of one coordinate won't do: texts with nothing in common but a frequent shingle share them, the more so the more
texts there are, so that what meets grows faster than the input.

Of two sets with a similarity of exactly 0.8, fewer than 25 of 48 coordinates agree with probability 3.3e-6 and fewer
than 5 of 24 pairs with 2.7e-6, so at most 6e-6 of the links may be lost at the threshold itself, and practically none
above it.

Defined results: documents without a word or text have n_shingles 0, are linked with nothing and kept; those of fewer
words than a shingle have one shingle, all their words; rows that share a doc_id count as one document, linked where
any of its texts is; a null doc_id stays unlinked and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import free_names, heavy_and_light, slices, small, written
from pixelmill.llm.linking import linked

COORDINATES = 48
#: Of the coordinates and of their pairs, as many as sets of the least similarity have in common.
MATCHES, SHARED = 25, 5
CACHED_WORDS = 300_000
SEED = 20240229


class WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_shingles(data: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit fingerprints of the n-word shingles; A-Z are lower-cased."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signatures(sets: list[np.ndarray], count: int, seed: int = SEED) -> np.ndarray:
    """A row of 32-bit minima for each set; the sets are not empty."""
    a, b = permutations(count, seed)
    out = np.empty((len(sets), count), np.uint32)
    if sets:
        starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        for k in range(count):
            out[:, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    return out


def sketched(docs: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """(doc_id, n, fp, sig) of every row; fp identifies the whole set, sig is null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            sets = [word_shingles(x, shingle, hashes) for x in b["text"].cast(pa.binary()).to_pylist()]
            rows = iter(signatures([x for x in sets if len(x)], coordinates).view(np.int32))
            sig = [next(rows) if len(x) else None for x in sets]
            fp = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) for x in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id long, n long, fp binary, sig array<int>")


def prefixes(sets: DataFrame, coordinates: int, shared: int) -> DataFrame:
    """(key, v, n, w): each set's rarest keys, as many as sets need that share `shared` of them, if others have them.

    A key is the values of two neighbouring coordinates. w grows with the number of other sets that share any of a set's
    keys.
    """
    pairs = [F.xxhash64(F.lit(k), *(F.col("sig")[i] for i in range(k, min(k + 2, coordinates)))) for k in range(0, coordinates, 2)]
    posted = sets.select("v", "n", F.explode(F.array(*pairs)).alias("key"))
    df = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = posted.join(df, "key").groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"), F.sum(F.log2("df")).alias("w"))
    # keys that no other set has come before these in the order, so the last ones are left out
    room = F.size("keys") - (shared - 1)
    return each.where(room > 0).select(F.explode(F.slice(F.col("keys.key"), F.lit(1), room)).alias("key"), "v", "n", "w")


def word_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(v, s): the whole shingle sets of the documents in a (written) table of v."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            found = [word_shingles(x, shingle, hashes).tobytes() for x in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["v"], pa.array(found, pa.binary())], ["v", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("v"), F.col("text").cast("string").alias("text"))
    return texts.join(small(ids), "v", "left_semi").mapInArrow(full, "v long, s binary")


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide often enough and whose full sets reach the similarity."""
    sig = sets.select("v", "sig")
    met = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    met = met.where(F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)) >= matches)
    met = written(met.select("a", "b"), "candidates")
    words = written(word_sets(docs, written(met.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "wanted"), shingle), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for x, y in zip(b["wa"].to_pylist(), b["wb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and 100 * same >= percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = met.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, shared: int = SHARED) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = written(sketched(docs, shingle, coordinates), "rows")
    sets = written(rows.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("v"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("times")), "sets")
    postings = written(prefixes(sets, coordinates, shared), "postings")
    confirm = lambda pairs: confirmed(pairs, docs, sets, shingle, matches, percent)
    linked_sets = written(linked(postings, confirm, lambda ids: word_sets(docs, ids, shingle), percent), "linked")
    comps = written(sets.select("fp", "v", "times").join(linked_sets, "v", "left").select("fp", F.coalesce("comp", "v").alias("comp"), "times"), "components")
    # a large group of equal sets is one fingerprint; documents without a word have none
    found = heavy_and_light(rows.select("doc_id", "n", "fp"), comps, "fp", F.col("times"), rows.count())
    component = F.coalesce("comp", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a number of its own for each, written, in order of doc_id (nulls last) and text hash."""
    (at,) = free_names(docs, "at")
    order = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    # equal rows go by their places, so that they needn't be sorted in one task
    rows = docs.withColumn(at, F.monotonically_increasing_id()).orderBy(*order, at).drop(at)
    return written(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, the first by doc_id (nulls last) and text hash; rows without a word all stay.

    Rows are told apart one by one, whatever their doc_id. Where the ids do that, they are taken; where any is null
    or repeated, rows are written with a number of their own. Further columns are carried, whatever their names; an
    empty table gives no rows.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    row, gone = free_names(docs, "row", "gone")
    rows = docs.withColumn(row, F.col("doc_id").cast("long")) if ids.where("doc_id is null or count > 1").isEmpty() else numbered(docs, row)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle, percent)
    given_up = small(written(found.where("not kept").select(F.col("doc_id").alias(gone)), "gone"))
    return rows.join(given_up, F.col(row) == F.col(gone), "left_anti").select(docs.columns)
