import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.llm import common, exact_dedup
from pixelmill.llm.common import table
from pixelmill.llm.queries import op12_exact_dedup

SF = "/root/testdata/sf0.001"


@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=200), st.integers(0, 36))
@settings(max_examples=300, deadline=None)
def test_code_round_trip(values, shift):
    values = np.array(sorted({x >> shift for x in values}), np.int64)
    assert (exact_dedup.decode(exact_dedup.encode(values), len(values)) == values).all()


def test_code_is_short():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000))
    assert 8 * len(exact_dedup.encode(values)) / len(values) < 40 - np.log2(len(values)) + 2.2


def test_messages_and_bitmaps():
    rng = np.random.default_rng(2)
    fragments = [rng.integers(0, 8000, 700) for _ in range(3)]
    sent = [exact_dedup.messages(x, 3, 13) for x in fragments]
    flagged = [s[3].copy() for s in sent]
    for owner in range(8):
        held = [(i, n, code) for i, s in enumerate(sent) for o, n, code in s[0] if o == owner]
        for (i, n, _), bitmap in zip(held, exact_dedup.duplicate_bitmaps([(n, code) for _, n, code in held]), strict=True):
            if bitmap:
                bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[:n].astype(bool)
                mine = sent[i][1] == owner
                flagged[i][mine] |= bits[sent[i][2][mine]]
    every = np.concatenate(fragments)
    values, counts = np.unique(every, return_counts=True)
    often = set(values[counts > 1].tolist())
    assert [f.tolist() for f in flagged] == [[x in often for x in f.tolist()] for f in fragments]


def plain(rows):
    """rows (doc_id, text) to sorted digests."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        best, stays = max((i for i in ids if i is not None), default=None), True
        for i in ids:
            out.append((i, best, len(ids), stays and i == best, hashlib.sha256(t.encode()).hexdigest()))
            stays = stays and i != best
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_query_against_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert got(op12_exact_dedup(spark, SF)) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(exact_dedup.exact_groups(odd_docs)) == plain(rows)
    assert exact_dedup.exact_groups(no_docs).count() == exact_dedup.without_copies(no_docs).count() == 0
    kept = exact_dedup.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"] or "") for r in kept.collect()))) == sorted(str((i, t)) for i, t, k in ((r[0], {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}[r[4]], r[3]) for r in plain(rows)) if k)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(5)
    rows = [(i, "one text that most rows have") for i in range(900)] + [(i, f"text {rng.randrange(400)}") for i in range(900, 1500)] + [(None, "no id")] * 40 + [(7, "one id, one text")] * 60
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("small", [False, True])
def test_hot_groups_with_and_without_broadcasts(spark, hot, monkeypatch, small):
    rows, docs = hot
    if not small:
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(exact_dedup, "FRAGMENT_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(exact_dedup.exact_groups(docs)) == plain(rows)
        kept = exact_dedup.without_copies(docs).collect()
        assert sorted(str(tuple(r)) for r in kept) == sorted(str((i, next(t for j, t in rows if j == i and hashlib.sha256(t.encode()).hexdigest() == s))) for i, _, _, k, s in plain(rows) if k)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_can_be_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "doc_id long, text string")
    assert [r[:4] for r in got(exact_dedup.exact_groups(docs, normal=lambda t: F.regexp_replace(F.lower(t), r"\s+", " ")))] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_heavy_and_light(spark):
    rows = spark.createDataFrame([("a", i) for i in range(90)] + [("b", 90), (None, 91), ("z", 92)], "k string, i long")
    groups = spark.createDataFrame([("a", 90), ("b", 1), ("c", 1)], "k string, n long")
    found = {r["i"]: r["n"] for r in common.heavy_and_light(rows, groups, "k", F.col("n"), 93, parts=10).collect()}
    assert found == {**dict.fromkeys(range(90), 90), 90: 1, 91: None, 92: None}
