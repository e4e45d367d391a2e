"""Operator 6: secret scans, native: patterns, and character Markov models of random strings and identifiers.

Base spans come from three patterns. The method looks at every other long run of key characters: two first-order
Markov models, one of random strings and one of ordinary identifiers and words, give its log-likelihood ratio, and a
run whose ratio passes the threshold is a span of kind `markov`. Both models are transition counts over labelled
samples, smoothed towards a uniform alphabet. All of it is DataFrame expressions; the driver holds a table of
transitions, whose size is that of the alphabet squared.

Samples are labelled by the patterns: values that match are random strings, the other words of the same documents are
ordinary. They come from at most SAMPLE_DOCS documents, the first by hash of doc_id; of rows that share an id, one.

Defined results: a null text counts as empty; empty texts and those without a finding have no spans (base_sha256 is
that of the empty string); repeated rows and ties are judged row by row; a null doc_id stays null; an empty table
gives no rows and uniform models; further columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base patterns, in the order of the kinds.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_CHARS = 12
#: A shorter run can't hold a longer one, so the least lengths are part of these patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
#: A run is a secret if its log-likelihood ratio, in nats, is above this and above this share of its transitions.
THRESHOLD, PER_TRANSITION = 12.0, 0.5
SAMPLE_DOCS = 8000
SMOOTHING = 0.5
#: Weight of the uniform alphabet in the model of random strings: the patterns only find some kinds of them.
UNIFORM = 0.5


NO_SPANS = "array<struct<s:int,k:int,e:int>>"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scan_in_order(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """What step(state, item) gives out (its second; nulls are left out) over an array in order.

    Lists that grow one by one are copied at each step, so items are taken in chunks of about the square root of their
    number: a chunk's list is short, and whole lists are only put together by chunks.
    """
    start = lambda state: F.struct(state.alias("state"), F.array().cast(out_type).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.when(out.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(out))).alias("out"))

    def chunk(done: Column, items: Column) -> Column:
        return F.concat(done, F.array(F.aggregate(items, start(F.element_at(done, -1)["state"]), one)))

    def whole(items: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(1), F.size(items), width), lambda i: F.slice(items, i, width))
        return F.when(F.size(items) > 0, F.flatten(F.transform(F.aggregate(chunks, F.array(start(state)), chunk), lambda x: x["out"])))

    return F.coalesce(bound(items, whole), F.array().cast(out_type))


def found(text: Column, pattern: str, kind: int, ok: Column | None = None) -> Column:
    """The matches of a pattern as an array of (start, kind, end), in order; ok: an array that says which count.

    Positions follow from the lengths of the matches and of the pieces between them.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = F.transform(matches, lambda _: F.lit(True)) if ok is None else ok
    lengths = F.zip_with(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))), ok, lambda x, good: F.struct(x["p"].alias("p"), x["m"].alias("m"), good.alias("ok")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["p"]
        end = start + F.coalesce(x["m"], F.lit(0))
        return end, F.when(x["m"].isNotNull() & x["ok"], F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e")))

    return F.when(text.rlike(pattern), scan_in_order(lengths, F.lit(0), step, NO_SPANS)).otherwise(F.array().cast(NO_SPANS))


def clear_of(base: Column, runs: Column) -> Column:
    """The runs that overlap none of the base spans: one pass over both in order of their starts.

    A run is held back until the next span shows that none begins before its end.
    """
    last = F.array(F.struct(F.lit(2**31 - 1).alias("s"), F.lit(len(KINDS)).alias("k"), F.lit(2**31 - 1).alias("e")))
    state = F.struct(F.lit(0).alias("upto"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        run = x["k"] == KINDS.index("markov")
        hold = run & (at["upto"] <= x["s"])
        keep = (at["e"] >= 0) & (run | (x["s"] >= at["e"]))
        upto = F.when(run, at["upto"]).otherwise(F.greatest(at["upto"], x["e"]))
        new = F.struct(upto.alias("upto"), F.when(hold, x["s"]).otherwise(-1).alias("s"), F.when(hold, x["e"]).otherwise(-1).alias("e"))
        return new, F.when(keep, F.struct(at["s"].alias("s"), F.lit(KINDS.index("markov")).alias("k"), at["e"].alias("e")))

    return F.when(F.size(runs) > 0, scan_in_order(F.concat(F.array_sort(F.concat(base, runs)), last), state, step, NO_SPANS)).otherwise(runs)


def base_spans(text: Column) -> list[Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return [found(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= ASSIGN_CHARS)), found(text, ACCESS, 1), found(text, HEX, 2)]


def codes(run: Column) -> Column:
    """Places of a run's characters in the alphabet, from 0."""
    place = {ord(c): i for i, c in enumerate(ALPHABET)}
    table = F.split(F.lit(",".join(str(place.get(x, 0)) for x in range(128))), ",").cast("array<int>")
    return F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(table, F.ascii(c)))


def transitions(run: Column) -> Column:
    """The numbers of a run's transitions: place times size of the alphabet plus next place."""
    c, n = codes(run), F.length(run) - 1
    return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: a * len(ALPHABET) + b)


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random) labelled by the base patterns, from at most sample_docs documents."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row for each id
    secret = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_CHARS), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("value")).distinct().select("value", F.lit(False).alias("random"))
    return texts.select(F.explode(F.array_distinct(secret)).alias("value"), F.lit(True).alias("random")).distinct().unionAll(words)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios by transition, random against ordinary."""
    size = len(ALPHABET)
    clean = labelled.where(F.length("value") > 1).select("random", F.explode(transitions(F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", ""))).alias("t"))
    counts = {(r["random"], r["t"]): r["count"] for r in clean.groupBy("random", "t").count().collect()}  # two alphabets squared at most
    logs = {}
    for label in (True, False):
        for a in range(size):
            row = [counts.get((label, a * size + b), 0) + SMOOTHING for b in range(size)]
            even = UNIFORM if label else 0.0
            logs |= {(label, a * size + b): math.log((1 - even) * x / sum(row) + even / size) for b, x in enumerate(row)}
    return [logs[True, t] - logs[False, t] for t in range(size * size)]


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, per_transition: float = PER_TRANSITION) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    text = F.col("_text")
    score = lambda run: F.aggregate(transitions(run), F.lit(0.0), lambda s, t: s + F.get(table, t))
    secret = lambda run: score(run) > F.greatest(F.lit(threshold), (F.length(run) - 1) * per_transition)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    base = base.select("doc_id", "_text", *[c.alias(k) for k, c in zip(KINDS, base_spans(text), strict=False)])
    spans = base.select("doc_id", "_text", *KINDS[:3], F.array_sort(F.concat(*KINDS[:3])).alias("base"))
    verdicts = spans.withColumn("_ok", F.when(text.rlike(RUN), F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), secret)).otherwise(F.array().cast("array<boolean>")))
    runs = F.when(F.exists("_ok", lambda ok: ok), found(text, RUN, 3, F.col("_ok"))).otherwise(F.array().cast(NO_SPANS))
    more = verdicts.withColumn("_runs", runs).withColumn("_runs", clear_of(F.col("base"), F.col("_runs")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return more.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "_runs"))).alias("spans"), F.size("_runs").cast("long").alias("n_markov"))
