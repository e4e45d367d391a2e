import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import periodic_runs
from pixelmill.llm.common import table
from pixelmill.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(s, least=6, times=4):
    """Every maximal stretch of every period, that have no shorter one."""
    n, out = len(s), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i >= p:
                out.setdefault((i, j + p - i), p)  # the smallest comes first
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in out.items() if n >= max(least, times * p)), key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    n = len(s)
    match = lambda i, j: next((k for k in range(n - j) if s[i + k] != s[j + k]), n - j)
    after = [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) for i in range(n)]
    return after, [match(i, j) for i, j in enumerate(after)]


@given(st.lists(st.integers(0, 2), max_size=40))
@settings(max_examples=400, deadline=None)
def test_lyndon_arrays(s):
    assert periodic_runs.lyndon(s) == plain_lyndon(s)


def test_lyndon_arrays_of_all_short_strings():
    for n in range(13):
        for s in itertools.product((0, 1), repeat=n):
            assert periodic_runs.lyndon(list(s)) == plain_lyndon(list(s))


@pytest.mark.parametrize("times", [2, 4])
def test_runs_of_all_short_strings(times):
    for n in range(15):
        for s in itertools.product((0, 1), repeat=n):
            words = [b"%d" % x for x in s]
            assert periodic_runs.runs(words, 2, times) == plain_runs(words, 2, times)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_repetitive_strings(seed):
    rng = random.Random(seed)
    s = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
    while len(s) < 250:  # repeats of repeats
        a = rng.randrange(len(s))
        s += s[a : a + rng.randint(1, 30)] * rng.randint(1, 5) + [rng.randrange(4)] * rng.randrange(2)
    words = [b"w%d" % x for x in s]
    for times in (2, 3, 4):
        assert periodic_runs.runs(words, 6, times) == plain_runs(words, 6, times)


class Counted(int):
    looks = 0

    def __eq__(self, other):
        Counted.looks += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["one", "fibonacci", "thue", "blocks", "squares", "random"])
def test_comparisons_grow_linearly(kind):
    def text(n):
        rng = random.Random(1)
        if kind == "one":
            return [0] * n
        if kind == "random":
            return [rng.randrange(2) for _ in range(n)]
        if kind == "thue":
            return [bin(i).count("1") % 2 for i in range(n)]
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, {"fibonacci": b + a, "blocks": b * 4 + [1], "squares": b * 2 + a}[kind]
        return b[:n]

    for turn in (1, -1):
        Counted.looks = 0
        s = [Counted(turn * x) for x in text(4000)]
        periodic_runs.lyndon(s)
        assert Counted.looks <= 3 * len(s)


def test_a_long_text_takes_seconds():
    words = [b"a", b"b", b"a", b"c"] * 250_000
    assert periodic_runs.runs(words) == [(0, 1_000_000, 4)]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, k, p in found for i in range(a + p, a + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept))


def test_query_against_plain_version(spark):
    docs = [r for r in table(spark, SF, "documents").collect() if len((r["text"] or "").split()) <= 3000]
    rows = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    assert len(rows) == table(spark, SF, "documents").count()
    assert sum(r[1] > 0 for r in rows.values()) >= 5
    for r in docs:
        assert rows[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs.measure(odd_docs, rewrite=periodic_runs.planted)
    short = [r for r in odd_docs.collect() if len(r["text"] or "") < 20_000]
    got = sorted(map(tuple, rows.collect()), key=str)
    assert len(got) == odd_docs.count()
    for r in short:
        assert plain_row(r["doc_id"], r["text"]) in got
    assert periodic_runs.measure(no_docs).count() == periodic_runs.find(no_docs).count() == periodic_runs.collapsed(no_docs).count() == 0


def test_collapsed_texts(spark):
    texts = ["buy now " * 40 + "end", "a b c", None, "", "x\nx x  x x x", "no run, kept \n as  it is"]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, start int")
    assert [r["text"] for r in periodic_runs.collapsed(docs).orderBy("doc_id").collect()] == ["buy now end", "a b c", None, "", "x", "no run, kept \n as  it is"]
    assert periodic_runs.collapsed(docs).columns == docs.columns
    assert [tuple(r) for r in periodic_runs.find(docs).orderBy("doc_id").collect()] == [(0, 0, 80, 2), (4, 0, 6, 1)]
