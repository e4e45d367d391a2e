"""Operator 13: maximal periodic stretches of words (runs), found by Lyndon arrays in the manner of Ellert and Fischer.

A run of period p holds Lyndon roots: places whose longest Lyndon word, in one of the two orders of the alphabet, has
length p. The Lyndon array is built from left to right over the stack of previous smaller suffixes. Two suffixes are
compared word by word only from the furthest place that has been looked at: up to there the later one lies in a copy
of earlier text, and what was found in the original (how far the same two places match) is found again; outside the
copy the match follows from the two matches that it is made of. Every comparison moves that place on or ends a match,
so an array takes linear time on any ordered alphabet. No suffix structures and no hashes of stretches are used. A
run's right end is the match of its root; its left end is walked back from the leftmost root, less than a period.

A run of at least `times` periods holds each of its words that often, so words that are rarer (in the text, then in
the part that is left) part a text, and only the parts between them are searched. This drops no run.

Words are maximal `[^\\x20\\x09-\\x0D]+`, compared as bytes. Each text is read whole, by the task that holds its row;
nothing is shuffled.

Defined results: null and empty texts have no words and no runs; texts of any length are one row's work, in time and
memory that grow with them; rows are judged one by one, so repeated rows and null ids are too; an empty table gives no
rows; further columns are ignored or, in collapsed(), carried along.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices

#: A run that counts has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rounds in which rare words part a text; more would only save work.
ROUNDS = 4
RUN_SCHEMA = "doc_id long, start long, length long, period long"
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """The next smaller suffix of each place (the length of s if there is none), and how far the two suffixes match.

    A suffix that is another's prefix is the smaller one.
    """
    n = len(s)
    after, after_match = [n] * n, [0] * n
    before, before_match = [-1] * n, [0] * n
    first, second, reach = 0, 0, 0  # s[first:] and s[second:] match up to reach, the furthest place looked at
    for r in range(1, n):
        at, popped, match = r - 1, -1, 0
        while at >= 0:
            look = True
            if at >= second and second < r < reach:  # both places lie in the copy, as their originals were compared
                x, y = at - second + first, r - second + first
                match = after_match[x] if after[x] == y else before_match[y]
                if r + match < reach:
                    look = False
                else:
                    match = reach - r
            elif popped >= 0 and before_match[popped] != match:
                match, look = min(before_match[popped], match), False
            if look:
                while r + match < n and s[at + match] == s[r + match]:
                    match += 1
            if r + match >= reach:
                first, second, reach = at, r, r + match
            if r + match < n and s[at + match] < s[r + match]:
                before[r], before_match[r] = at, match
                break
            after[at], after_match[at] = r, match
            popped, at = at, before[at]
    return after, after_match


def runs_of_part(s: list[int], least: int, times: int) -> list[Run]:
    found: dict[tuple[int, int], Run | None] = {}
    for turned in (s, [-x for x in s]):
        for i, (j, match) in enumerate(zip(*lyndon(turned), strict=True)):
            p = j - i
            # the leftmost root starts less than a period after its run
            if match > (times - 2) * p and (p, j + match) not in found:
                start = i
                while start and s[start - 1] == s[start - 1 + p]:
                    start -= 1
                length = j + match - start
                found[p, j + match] = (start, length, p) if length >= max(least, times * p) else None
    return [r for r in found.values() if r]


def parts(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """The stretches (from, to) of words that may lie in a run of so many words and periods."""
    keep = np.bincount(ids)[ids] >= times
    for _ in range(ROUNDS):
        if not keep.any():
            return []
        part = np.cumsum(~keep)
        keep &= np.bincount(part[keep], minlength=int(part[-1]) + 1)[part] >= least
        where = np.flatnonzero(keep)
        _, key, count = np.unique(part[where] * (int(ids.max()) + 1) + ids[where], return_inverse=True, return_counts=True)
        rare = count[key] < times
        keep[where[rare]] = False
        if not rare.any():
            break
    edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if b - a >= least]


def runs(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of every run, by start, then period. times is 2 at least."""
    if len(words) < least:
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    found = []
    for a, b in parts(ids, least, times) if len(seen) < len(words) else ():
        found += [(a + start, length, p) for start, length, p in runs_of_part(ids[a:b].tolist(), least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def highest(found: list[Run]) -> Run | None:
    """The run of the greatest exact exponent; ties: the smallest start, then period."""
    best = None
    for r in found:  # they come by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def without_runs(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, p in found:
        marks[start + p] += 1
        marks[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _each(docs: DataFrame, work: Callable[[int | None, list[bytes]], list[tuple]], schema: str, rewrite: Rewrite | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in schema.split(", ")]
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                out += work(doc_id, rewrite(doc_id, words) if rewrite else words)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return _texts(docs).mapInArrow(run, schema)


def find(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, rewrite: Rewrite | None = None) -> DataFrame:
    """A row for each run of each document: doc_id, start (number of the word), length, period."""
    return _each(docs, lambda doc_id, words: [(doc_id, *r) for r in runs(words, least, times)], RUN_SCHEMA, rewrite)


def measure(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, rewrite: Rewrite | None = None) -> DataFrame:
    """One row for each document: its number of runs, the one of the highest exponent, and digests of runs and of kept words."""

    def work(doc_id: int | None, words: list[bytes]) -> list[tuple]:
        found = runs(words, least, times)
        best = highest(found)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        kept = hashlib.sha256(b" ".join(without_runs(words, found))).hexdigest()
        return [(doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), kept)]

    return _each(docs, work, SCHEMA, rewrite)


def collapsed(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """All rows and columns; a text with runs keeps their first periods, its words joined by single spaces."""

    @F.arrow_udf("string")
    def once(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            text = x.as_py()
            words = (text or "").encode().split()
            found = runs(words, least, times)
            out.append(b" ".join(without_runs(words, found)).decode() if found else text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", once(F.col("text").cast("string")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: those of every tenth document, by a hash of its number, repeat from a place on.

    A document without a number is left as it is.
    """
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]
