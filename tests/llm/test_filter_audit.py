import itertools
import random
import re
from collections import defaultdict

import pytest

from pixelmill.llm import filter_audit
from pixelmill.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_failures(rows):
    """rows (doc_id, text, source) to the set of filters that each fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        out.append({k for k, x in bad.items() if x})
    return out


def plain_audit(rows, good, toxic):
    """Applies the filters one after the other, in every order."""
    failed, out = plain_failures(rows), {}
    parts = defaultdict(list)
    for k, r in enumerate(rows):
        parts[r[2] or ""].append(k)
    for part, members in parts.items():
        at_step, shapley = {}, defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(members)
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if letter in failed[k]]
                redundant = [k for k in members if letter in failed[k] and k not in left]
                left = [k for k in left if letter not in failed[k]]
                shapley[letter] += len(gone)
                at_step[order, step] = (len(left), len(gone), len(redundant), sum(failed[k] == {letter} for k in members), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone))
        for (order, step), x in at_step.items():
            out[part, order, step] = (*x, shapley[order[step - 1]])
    return out


def check(docs, labels):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    marks = labels.collect()
    good, toxic = {r["doc_id"] for r in marks if r["quality"] == 1} - {None}, {r["doc_id"] for r in marks if r["toxic"] == 1} - {None}
    found = filter_audit.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == plain_audit(rows, good, toxic)


def test_against_plain_version(spark):
    check(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_odd_rows(spark, odd_docs, no_docs, labels):
    check(odd_docs, labels)
    assert filter_audit.audit(no_docs, labels).count() == 0
    check(odd_docs, labels.limit(0))


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_hot_text_source_and_id(spark, broadcast):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmn") * rng.randint(1, 3) for _ in range(rng.choice([5, 220]))) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for _ in range(30)]
    rows = [(i, texts[0], "hot") for i in range(300)] + [(77, texts[1], "hot")] * 50 + [(i, rng.choice(texts), rng.choice(["hot", "s", None])) for i in range(300, 400)] + [(None, texts[2], "")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        check(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_are_not_shuffled(spark):
    """Texts are dealt out by row; both groupings of words follow without another exchange."""
    rows = table(spark, SF, "documents").selectExpr("doc_id as row", "text")
    plan = filter_audit.word_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
