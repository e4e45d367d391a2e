"""Operator 9: quality rules with line sequence labelling.

Counting rules give the base verdict. The method's verdict reads a document's lines as a sequence: a linear-chain
conditional random field over line features labels each line content or boilerplate (Viterbi decoding), and the
share of words in content lines decides whether the document stays.

The field is trained here. Only documents are labelled, so its line labels are those of a good document (all
content) and, for a bad one, the labels that the current field decodes; from hand-set starting weights a few rounds
alternate between decoding and fitting. Documents for training are a bounded sample, see Training.

Defined results: null and empty texts have no words, so the base fails them; ties and repeated rows are judged row by
row; an empty table gives no rows; without usable labels the starting weights stand; further columns are ignored or,
in keep_documents, carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: White space and UTF-8 continuation bytes: what is left of a text has one byte for each code point in a word.
NOT_WORD_STARTS = SPACE + bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".!?:;\"')"
FEATURES = ("bias", "symbols", "bars", "exclamations", "capitals", "digits", "repeated", "unended", "stutter")
#: Starting weights: how much a feature speaks for content.
START = (3.0, -8.0, -8.0, -6.0, -6.0, -3.0, -0.5, -0.5, -8.0)
#: Starting score of staying in a label, against changing it.
STAY = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and the fit.

    The sample is the first documents by hash of doc_id, one for each id. Of a document of more lines than
    document_lines, a stretch of so many is taken, wherever a hash of the document puts it.
    """

    documents: int = 1000
    document_lines: int = 2000
    rounds: int = 2
    steps: int = 30
    rate: float = 0.5
    pull: float = 0.02


@dataclass(frozen=True)
class Field:
    """Weights for content, against boilerplate, and the score of staying in a label."""

    weights: tuple[float, ...] = START
    stay: float = STAY
    fitted_on: int = field(default=0, compare=False)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window found twice or more; windows are compared exactly, by ranks of their parts."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key, size = ids[:n], len(seen)
    for k in range(1, window):
        if size * len(seen) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * len(seen) + ids[k : k + n], size * len(seen)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def read_lines(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature rows and word counts of the lines that have a word, and how many repeat an earlier line."""
    rows, counts, seen, again = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        repeated = line in seen
        again += repeated
        seen.add(line)
        letters = size - len(line.translate(None, LETTERS))
        rows.append((
            size - len(line.translate(None, SYMBOLS)), 2 * line.count(b"|"), line.count(b"!"), size - len(line.translate(None, UPPER)), letters, size - len(line.translate(None, DIGITS)), repeated, words[-1][-1] not in STOPS, sum(map(eq, words, words[1:])) if n > 3 else 0,
        ))
        counts.append(n)
    raw, n = np.array(rows, np.float64).reshape(len(rows), 9), np.array(counts, np.float64)
    out = np.ones((len(rows), len(FEATURES)))
    if len(rows):
        out[:, 1:4] = np.minimum(1, raw[:, :3] / n[:, None])
        out[:, 4] = np.where(raw[:, 3] > 3, np.maximum(0, raw[:, 3] / np.maximum(1, raw[:, 4]) - 0.3) / 0.7, 0)
        out[:, 5] = np.minimum(1, raw[:, 5] / np.maximum(1, raw[:, 4] + raw[:, 5]))
        out[:, 6:8] = raw[:, 6:8]
        out[:, 8] = raw[:, 8] / n
    return out, n, again


def viterbi(scores: np.ndarray, stay: float) -> np.ndarray:
    """Labels (True: content) of the best sequence; scores: content against boilerplate for each line; ties: content."""
    n, lead, back = len(scores), 0.0, []
    for s in scores.tolist():  # lead: how much better the best path to content is than that to boilerplate
        back.append((lead + stay >= 0, lead - stay >= 0))  # came from content: to content, to boilerplate
        lead = s + max(lead + stay, 0.0) - max(lead, stay) if len(back) > 1 else s
    out, now = np.empty(n, bool), lead >= 0
    for k in range(n - 1, -1, -1):
        out[k] = now
        now = back[k][0] if now else back[k][1]
    return out


def content_share(features: np.ndarray, counts: np.ndarray, model: Field) -> float:
    if not len(counts):
        return 0.0
    content = viterbi(features @ np.array(model.weights), model.stay)
    return float(counts[content].sum() / counts.sum())


def gradient(docs: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, stay: float) -> tuple[np.ndarray, float]:
    """Of the mean log-likelihood of the labelled sequences, over weights and stay (forward-backward, all documents at once)."""
    most, k = max(len(y) for _, y in docs), len(docs)
    s, real, gold = np.zeros((k, most)), np.zeros((k, most), bool), np.zeros((k, most), bool)
    for i, (x, y) in enumerate(docs):
        s[i, : len(y)], real[i, : len(y)], gold[i, : len(y)] = x @ w, True, y
    forward, backward = np.zeros((k, most, 2)), np.zeros((k, most, 2))  # log sums; label 1 is content
    forward[:, 0, 1] = s[:, 0]
    for t in range(1, most):
        a, b = forward[:, t - 1, 0], forward[:, t - 1, 1]
        forward[:, t, 0] = np.where(real[:, t], np.logaddexp(a + stay, b), a)
        forward[:, t, 1] = np.where(real[:, t], np.logaddexp(a, b + stay) + s[:, t], b)
    for t in range(most - 2, -1, -1):
        a, b = backward[:, t + 1, 0], backward[:, t + 1, 1] + s[:, t + 1]
        backward[:, t, 0] = np.where(real[:, t + 1], np.logaddexp(a + stay, b), 0)
        backward[:, t, 1] = np.where(real[:, t + 1], np.logaddexp(a, b + stay), 0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    one = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None])
    g = sum(x.T @ (y - one[i, : len(y)]) for i, (x, y) in enumerate(docs))
    both = real[:, 1:]
    zero_zero = forward[:, :-1, 0] + stay + backward[:, 1:, 0]
    one_one = forward[:, :-1, 1] + stay + s[:, 1:] + backward[:, 1:, 1]
    expected = np.exp(np.where(both, zero_zero - z[:, None], -np.inf)) + np.exp(np.where(both, one_one - z[:, None], -np.inf))
    lines = max(1, int(real.sum()))
    return g / lines, float(((gold[:, 1:] == gold[:, :-1]) & both).sum() - expected.sum()) / lines


def fit(sample: list[tuple[np.ndarray, bool]], how: Training = Training()) -> Field:
    """sample: the feature rows of a document and whether it is good."""
    w, stay = np.array(START), STAY
    sample = [(x, good) for x, good in sample if len(x)]
    used: list = []
    for _ in range(how.rounds):
        used = []
        for x, good in sample:
            y = np.ones(len(x), bool) if good else viterbi(x @ w, stay)
            if good or not y.all():  # a bad document without a boilerplate line says nothing about lines
                used.append((x, y))
        if not used:
            return Field()
        used.sort(key=lambda d: len(d[1]))
        lines = sum(len(y) for _, y in used)
        for _ in range(how.steps):
            parts = [(sum(len(y) for _, y in part), *gradient(part, w, stay)) for part in batched(used, 64)]  # of like lengths, so little is padded
            g, g_stay = sum(n * x for n, x, _ in parts) / lines, sum(n * x for n, _, x in parts) / lines
            w = w + how.rate * (g - how.pull * (w - np.array(START)) / len(FEATURES))
            stay = stay + how.rate * (g_stay - how.pull * (stay - STAY) / len(FEATURES))
    return Field(tuple(map(float, w)), float(stay), len(used))


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Field:
    """Fits on at most how.documents labelled documents, the first by hash of doc_id."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.documents)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [stretch(read_lines(x or b"")[0].astype("<f4"), how.document_lines).tobytes() for x in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["good"], pa.array(rows, pa.binary())], ["doc_id", "good", "rows"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text").mapInArrow(features, "doc_id long, good boolean, rows binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("rows", "good")).alias("r")).select("r.*").collect()  # at most how.documents rows of document_lines lines
    found = sorted(((bytes(r["rows"]), r["good"]) for r in found))
    return fit([(np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(np.float64), good) for x, good in found], how)


def stretch(rows: np.ndarray, most: int) -> np.ndarray:
    """So many neighbouring rows, from a place that the rows themselves decide."""
    return rows[(at := zlib.crc32(rows.tobytes()) % (len(rows) - most + 1)) : at + most] if len(rows) > most else rows


def judge(docs: DataFrame, model: Field, min_words: int = 10, max_repeat_percent: int = 20, min_share: float = 0.5) -> DataFrame:
    """One row for each document: the counts, the base verdict, the share of content and the final verdict."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for data in b["text"].cast(pa.binary()).to_pylist():
                data = data or b""
                words = data.split()
                features, counts, again = read_lines(data)
                repeats = repeat_words(words)
                failed = len(words) < min_words or 100 * repeats > max_repeat_percent * len(words)
                share = content_share(features, counts, model)
                out.append((len(words), len(data.translate(None, NOT_WORD_STARTS)), len(data) - len(data.translate(None, SYMBOLS)), again, repeats, failed, share, not failed and share >= min_share))
            columns = [b["doc_id"]] + [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, SCHEMA)


def keep_documents(docs: DataFrame, model: Field, min_words: int = 10, max_repeat_percent: int = 20, min_share: float = 0.5) -> DataFrame:
    """The rows that judge() keeps, with all their columns; no row leaves its partition."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()):
            data = text.as_py() or b""
            words = data.split()
            good = len(words) >= min_words and 100 * repeat_words(words) <= max_repeat_percent * len(words)
            out.append(good and content_share(*read_lines(data)[:2], model) >= min_share)
        return pa.array(out, pa.bool_())

    return docs.where(kept(F.col("text").cast("string")))
