import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pixelmill.llm import mixing, packing
from pixelmill.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_every_sequence(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 4096, 4097, 9000, rng.randint(1, 3000)]) for _ in range(rng.randint(1, 80))]
    seqs: dict[int, list] = {}
    seen = {i: [] for i in range(len(lengths))}
    for item, start, n, seq, offset in packing.plan(lengths):
        seqs.setdefault(seq, []).append((offset, n))
        seen[item].append((start, n))
    for i, n in enumerate(lengths):
        assert [x for start, k in sorted(seen[i]) for x in range(start, start + k)] == list(range(n))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert sum(packing.capacities(12345, 4096)) == 12345


def test_costs_are_balanced():
    rng = random.Random(1)
    cost: dict[int, float] = {}
    for _, _, n, seq, _ in packing.plan([rng.randint(50, 2000) for _ in range(2000)]):
        cost[seq] = cost.get(seq, 0) + n + n * n / 4096
    full = [c for c in cost.values() if c > 4096]
    assert max(full) < 1.25 * (sum(full) / len(full))


def test_words_equal_the_tokenizer(tokenizer):
    words = packing.WordIds(tokenizer_path())
    assert words.short_way
    texts = ["It's DON'T we'll x'sy", "ÉTÉ ÿÿ ŸŸ ſecret İstanbul ΣΑΣ", "áb é x́", "12,34 ½ ① ２", "<|endoftext|>ab c<|startoftext|>", "\x1ca\x1db \x85z \xa0q　w", "a\x00b", "ﬁ ﬂ ŉ don''t''s ×÷ª º µ", "日本語 テスト 한국어", "a.,b ..., !!! $$$*** |x| ß ẞ", "", " \n\t"]
    for text in texts:
        assert np.frombuffer(words.text(text.encode(), 2), words.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_words_are_forgotten_by_age(tokenizer, monkeypatch):
    """Memory is bounded at twice the setting, hot words stay, and nothing of it shows in the ids."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 8)
    words, asked = packing.WordIds(tokenizer_path()), []
    words.words.find = lambda w, find=words.words.find: asked.append(w) or find(w)
    texts = [f"the w{k}x the {'y' * 70}{k} Name{k}, THE" for k in range(50)]
    for text in texts:
        assert np.frombuffer(words.text(text.encode(), 2), words.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert all(len(m) <= 8 and len(m.old) <= 8 for m in (words.words, words.letters, words.marks))
    assert asked.count(b"the") == 1 and len(asked) == 2 + 3 * len(texts)
    words.forget()
    assert not words.words and not words.words.old and words.text(b"the", 2)


def test_batches_ask_for_each_word_once(tokenizer, monkeypatch):
    """However few words are remembered, a batch's letters go to the model once, and nothing of it shows in the ids."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 4)
    words, asked = packing.WordIds(tokenizer_path()), []
    words.letters.find = lambda w, find=words.letters.find: asked.append(w) or find(w)
    many = [f"Word{'abcdefghij'[k]} {'klmnopqrst'[k]}et, ÉTÉ!" for k in range(10)]
    texts = [None, "", " \n\t", *many, *many, " ".join(many) + " ", "\x1ca\x1db \x85z \xa0q\u3000w", "It's x\u0301 a\x0bb 12,34 <|endoftext|> ß ẞ", *many]
    for way in (True, False):
        words.short_way, asked[:] = way, []
        for x, ids in zip(texts, words.texts(pa.array(texts), 2), strict=True):
            assert ids.tolist() == [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2]
        assert len(asked) == len(set(asked))
    assert words.texts(pa.array([], pa.string()), 2) == [] and [x.tolist() for x in words.texts(pa.array([None, ""], pa.string()), 2)] == [[2], [2]]


def test_pack_round_trip(spark, odd_docs, no_docs, tokenizer):
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    want: dict = {}
    for d in odd_docs.collect():
        want.setdefault(d["doc_id"], []).append([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2])
    for k, copies in want.items():
        ids, own = copies[0], [r for r in rows if r["doc_id"] == k]
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        for r in own:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_groups_are_neighbours_of_bounded_size(spark, tmp_path):
    """Null and repeated ids too: no key gathers rows."""
    for of in ("id", "cast(null as long)", "7L"):
        docs = spark.range(0, 5000, 1, 2).selectExpr(f"{of} as doc_id", "repeat('some words here ', 20) as text", "id as row")
        rows = packing.pack(docs, tokenizer_path(), group_bytes=1 << 16).toPandas()
        pieces = rows.groupby("sequence_id").agg(at=("offset", "min"), n=("length", "sum"), docs=("doc_id", "nunique"))
        assert (pieces["at"] == 0).all() and ((pieces.n == 4096) | (pieces.n & (pieces.n - 1) == 0)).all()
        ends = rows.sort_values(["sequence_id", "offset"])
        assert (ends.groupby("sequence_id").offset.shift(-1).fillna(-1).where(lambda x: x >= 0, ends.offset + ends.length) == ends.offset + ends.length).all()
        assert rows.length.sum() == 5000 * rows.doc_tokens.iloc[0]
        if of == "id":
            spread = rows.groupby("sequence_id").doc_id.agg(lambda x: x.max() - x.min())
            assert spread.max() <= (1 << 16) / 320 + 1 and len(spread) > 20


@pytest.mark.parametrize("seed", range(30))
def test_schedule_stays_within_a_block(seed):
    rng = random.Random(seed)
    blocks = {str(i): rng.randint(1, 300) for i in range(rng.randint(1, 9))}
    weights = {k: rng.random() + 0.01 for k in blocks}
    rows, at = mixing.plan(blocks, weights, rng.choice([16, 64, 1024])), {}
    for source, first, end, slot, share, period, slots in rows:
        for b in range(first, end):
            x = slot + (b - first) // share * period + slots[(b - first) % share]
            assert x not in at
            at[x] = (source, b)
    assert sorted(at) == list(range(sum(blocks.values())))
    starts = sorted({r[3] for r in rows}) + [len(at)]
    for a, z in zip(starts, starts[1:], strict=False):
        share = {r[0]: r[4] / r[5] for r in rows if r[3] == a}
        got = dict.fromkeys(share, 0)
        for t in range(a, z):
            got[at[t][0]] += 1
            assert all(abs(got[s] - share[s] * (t - a + 1)) < 1 + 1e-9 for s in share)


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, out.collect())) == sorted(map(key, odd_docs.collect()))
    assert mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(odd_docs, {"s1": 1.0, None: 0.0, "gone": 2.0}).count() == odd_docs.count()


def test_mix_places(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'t' as text", "if(id % 10 < 7, 'big', 'small') as source")
    rows = mixing.mix_order(docs, {"big": 0.5, "small": 0.5}, block_docs=10, period=4).toPandas().sort_values(["_mix_slot", "_mix_in_block"])
    assert rows.duplicated(["_mix_slot", "_mix_in_block"]).sum() == 0 and (rows.groupby("_mix_slot").source.nunique() == 1).all()
    head = rows[rows._mix_slot < 40].groupby("source").size()
    assert abs(head["big"] - head["small"]) <= 20


def test_schedule_follows_the_given_weights():
    for n, first in ((20, 1 / 3), (100, 0.5), (256, 1 / 3)):
        weights = {str(i): first if i == 0 else (1 - first) / (n - 1) for i in range(n)}
        blocks = {k: 1 + int(10_000 * w) for k, w in weights.items()}
        of = {}
        for source, start, end, slot, share, period, slots in mixing.plan(blocks, weights):
            for b in range(start, end):
                of[slot + (b - start) // share * period + slots[(b - start) % share]] = source
        assert sorted(of) == list(range(sum(blocks.values())))
        got, total = dict.fromkeys(weights, 0), sum(weights.values())
        for t in range(len(of)):
            got[of[t]] += 1
            assert all(abs(got[k] - weights[k] / total * (t + 1)) < 1 + 1e-9 for k in weights)
            if got[of[t]] == blocks[of[t]]:
                break
        assert t > 5000


def test_mix_over_many_stretches(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'t' as text", "if(id % 10 < 7, 'big', if(id % 10 < 9, 'small', null)) as source")
    rows = mixing.mix_order(docs, {"big": 0.6, "small": 0.3, None: 0.1}, block_docs=2, period=16).toPandas()
    assert sorted(rows._mix_slot.unique()) == list(range(1500)) and len(rows) == 3000
    places = rows.groupby(rows.source.fillna("-"))[["_mix_block", "_mix_slot"]].apply(lambda x: x.sort_values("_mix_block")._mix_slot.is_monotonic_increasing)
    assert places.all()


def plain_schedule(blocks, weights):
    """Slots of the blocks (source, number): at each slot, of the released next blocks that of the earliest deadline."""
    out, done, at = [], dict.fromkeys(blocks, 0), 0
    while left := [k for k in blocks if done[k] < blocks[k]]:
        total = sum(Fraction(weights[k]) for k in left)
        share, begun, t = {k: Fraction(weights[k]) / total for k in left}, dict(done), 0
        while all(done[k] < blocks[k] for k in left):
            j = {k: done[k] - begun[k] + 1 for k in left}
            ready = [k for k in left if math.floor((j[k] - 1) / share[k]) <= t]
            k = min(ready, key=lambda k: (math.ceil(j[k] / share[k]), str(k), k is None))
            out.append((k, done[k]))
            done[k], t = done[k] + 1, t + 1
        at += t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix_positions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 7]), f"text {rng.randrange(400)}", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 0.2, "b": 0.5, "c": 0.25, None: 0.05}
    out = mixing.mix_order(docs, weights, block_docs=4, period=16).selectExpr("*", "xxhash64(doc_id, text) as h").collect()
    sizes = {k: sum(r["source"] == k for r in out) for k in weights}
    slots = {x: t for t, x in enumerate(plain_schedule({k: -(-n // 4) for k, n in sizes.items() if n}, weights))}
    for k in sizes:
        own = sorted((r for r in out if r["source"] == k), key=lambda r: (r["_mix_block"], r["_mix_in_block"]))
        assert [(r["_mix_block"], r["_mix_in_block"]) for r in own] == [(i // 4, i % 4) for i in range(len(own))]
        assert [r["h"] for r in own] == sorted(r["h"] for r in own)
        assert all(r["_mix_slot"] == slots[k, r["_mix_block"]] for r in own)


def test_schedule_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'t' as text", "if(id % 10 < 7, 'big', 'small') as source")
    rows = mixing.mix_order(docs, block_docs=1, most_blocks=50).toPandas()
    assert rows._mix_slot.nunique() <= 52 and rows.groupby("_mix_slot").size().max() == 100
    assert rows.duplicated(["_mix_slot", "_mix_in_block"]).sum() == 0


def test_texts_are_dealt_out_once_for_their_places(spark, tmp_path):
    """Ranks need one shuffle of whole rows; hash ranges' starts come to them, however small Spark takes tables to be."""
    spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 3 = 0, null, 's') as source").write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mixing.mix_order(spark.read.parquet(f"{tmp_path}/docs"), block_docs=10)
        plan = rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
        got = [r["doc_id"] for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert sorted(got) == list(range(3000))
