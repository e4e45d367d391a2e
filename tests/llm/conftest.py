import random

import pytest

EXTRA = ", v long, n string, key string, score string, kept string, component_id string, grp string, rank string, labelled boolean"
#: More names: of working columns, and of what an operator adds.
CLASHES = ("_gone", "_nth", "_text", "_rank", "_start", "_mix_source", "_mix_slot", "gone", "new_text", "row", "_row", "block", "leader")
EXTRA += "".join(f", {x} string" for x in CLASHES)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns with names the operators use."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base = text(60)
    texts = [None, "", " \t\n\x0b ", "x", "one two", base, base, base.upper(), base + " tail", text(20_000), "y" * 200_000, "\n".join(text(8) + "." for _ in range(40)), "| a | b | c |\n*** $$$ ###", "héé ñandú 世界 \U0001f600 " * 30]
    rows = [(i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "a text without a number, and some words more to it", "en", "s1", 10), rows[5], rows[5]]
    return spark.createDataFrame([(*r, None, *["clash"] * 7, None, *CLASHES) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + EXTRA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 3 and 1, 0) for i in range(14)] + [(None, 1, 0), (3, None, 0), (5, 1, None), (5, 1, None), (999, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
