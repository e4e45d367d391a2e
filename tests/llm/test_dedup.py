import math
import random
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute

from conftest import CLASHES

from pixelmill.llm import common, components, line_dedup, linking, minhash, mixing

SF = "/root/testdata/sf0.001"


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def near_texts(seed=1):
    """Families of near copies around the threshold, exact copies, and a passage that many share."""
    rng, out = random.Random(seed), {}
    vocabulary = [f"t{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(90)]
        for k in range(12):
            out[len(out)] = " ".join(edited(rng, base, k // 2))
    for _ in range(30):
        out[len(out)] = " ".join(passage + [rng.choice(vocabulary) for _ in range(40)])
    out |= {len(out) + i: out[3].title() for i in range(3)}
    return out


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    groups = brute.Sets({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    want = {x: groups.find(x) for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["v"]: r["comp"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    for n in (2, 5):
        want = brute.document_components(texts, n)
        rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), shingle=n).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, shingle=2).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert all(by[k]["n_shingles"] == 0 and by[k]["kept"] for k in (0, 1, 2))
    assert {by[k]["component_id"] for k in (5, 6, 7, 8)} == {5} and by[3]["n_shingles"] == 1
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.without_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(5) == 1 and not {6, 7, 8} & set(ids) and {0, 1, 2, 3, 4, 9, None} <= set(ids)
    assert minhash.without_near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = minhash.signatures([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.05


def test_line_components_equal_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(40)) for _ in range(rng.randint(3, 14))) for _ in range(60)]
    texts = {k: "\n".join(" ".join(edited(rng, line.split(), rng.choice([0, 0, 1]))) for line in rng.sample(lines, 12)) for k in range(40)}
    texts |= {100: texts[3], 101: None, 102: ""}
    want = brute.line_places(texts)
    rows = line_dedup.line_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in rows}
    assert got.keys() == want.keys()
    assert sum(got[p] != want[p] for p in want) <= len(want) // 100  # banding has a recall above 0.99 at the threshold
    assert all(r["kept"] == (got[r["doc_id"], r["line_no"]] == (r["doc_id"], r["line_no"])) for r in rows)


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert ids.count(5) == 3 and 6 not in ids and {None, 0, 1, 2, 3, 4, 9, 10, 11} <= set(ids)  # identical rows are one document
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] and r["doc_id"] is not None)
    assert line_dedup.without_repeats(no_docs).count() == 0 and line_dedup.line_components(no_docs).count() == 0


def test_repeated_lines_go_once(spark):
    a, b, c = "the first line of five words", "another line, of quite other words", "short one"
    docs = spark.createDataFrame([(1, f"{a}\n{c}", 0), (2, f"{b}\n{a}\n{c}", 0), (3, f"  {a.upper()} ", 0)], "doc_id long, text string, n_chars int")
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.without_repeats(docs).collect()} == {(1, f"{a}\n{c}", len(a) + 10), (2, f"{b}\n{c}", len(b) + 10)}


def test_query_and_pipeline_link_near_copies_of_short_lines(spark, tmp_path):
    import corpus_pipeline
    from pixelmill.llm import queries

    rng = random.Random(5)
    letters = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 8)))
    lines = [" ".join(letters() for _ in range(9)) for _ in range(40)]  # 50 to 80 bytes
    near = [x[:25] + "#" + x[26:] for x in lines]
    texts = {k: "\n".join(part) for k, part in enumerate([lines[:20], near[:10] + lines[20:], near[10:]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute.line_places(texts, min_words=1, chars=5)
    assert sum(want[p] != p for p in want) > 30
    rows = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert sum((r["kept_doc_id"], r["kept_line_no"]) != want[r["doc_id"], r["line_no"]] for r in rows) <= len(want) // 50 and len(rows) == len(want)
    left = corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()
    assert sum(len(r["text"].split("\n")) for r in left) <= sum(want[p] == p for p in want) + len(want) // 50


def test_query_and_pipeline_take_lines_of_few_words(spark, tmp_path):
    import corpus_pipeline
    from pixelmill.llm import queries

    long = "没有空格的一行文字也是会重复出现的样板内容需要去掉"
    texts = {1: f"All rights reserved.\n{long}\n\nx", 2: f"all  rights reserved.\nown\n\n{long}", 3: f"x\n{long}!\nlast"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in rows} == brute.line_places(texts, min_words=1, chars=5)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: texts[1], 2: "own\n", 3: "last"}


def test_stage_decides_by_row_not_by_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, lone = (text() for _ in range(6))
    rows = [(1, b), (5, a), (5, b + " tail"), (7, c), (7, d), (7, lone), (7, lone), (9, d), *[(None, c)] * 20, *[(None, e)] * 20, *[(2, "")] * 2, (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = minhash.without_near_duplicates(docs).collect()
    want = [(1, b), (5, a), (7, c), (7, d), (7, lone), (None, e), (2, ""), (2, ""), (None, None)]
    assert sorted(map(repr, (tuple(r) for r in left))) == sorted(map(repr, want))


def test_stages_carry_clashing_columns(spark, odd_docs):
    for stage in (minhash.without_near_duplicates, line_dedup.without_repeats, mixing.mixed):
        out = stage(odd_docs)
        assert out.columns == odd_docs.columns
        assert all(r[x] == x for r in out.collect() for x in CLASHES)


def test_strays_of_a_large_group_equal_brute_force(spark):
    """A key of several hundred vertices in many components: near copies of one text at all distances, and what only shares a passage with it."""
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = {i: " ".join(edited(rng, base, i % 14)) for i in range(150)}
    texts |= {200 + i: " ".join([rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + base[:50]) for i in range(60)}
    texts |= {300 + i: " ".join(base[: 80 - i % 40] if i % 2 else base[i % 40 :]) for i in range(60)}
    sets = {k: np.unique([hash(x) & (2**63 - 1) for x in brute.shingles(t, 2)]).astype(np.uint64) for k, t in texts.items()}
    table = spark.createDataFrame([(k, bytes(x.tobytes())) for k, x in sets.items()], "v long, s binary")
    postings = spark.createDataFrame([(key, k, len(x), 1.0) for k, x in sets.items() for key in (1, 2 + k % 3)], "key long, v long, n long, w double")

    def confirm(pairs):
        like = lambda a, b: (both := len(np.intersect1d(sets[a], sets[b]))) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        return spark.createDataFrame([tuple(r) for r in pairs.select("a", "b").collect() if like(*r)], "a long, b long")

    want = {k: comp for k, (_, comp) in brute.document_components(texts, 2).items()}
    found = linking.linked(postings, confirm, lambda ids: table.join(ids, "v", "left_semi"), 80)
    got = {r["v"]: r["comp"] for r in found.collect()}
    assert {k: got.get(k, k) for k in texts} == want and len(set(want.values())) > 60
    members = spark.createDataFrame([(0, 0, k, k) for k in sets if k], "leader long, leader_comp long, v long, comp long")
    for block_bytes in (1 << 12, 1 << 20):  # many blocks, or one
        links = linking.apart(members, lambda ids: table.join(ids, "v", "left_semi"), 80, block_bytes).collect()
        groups = brute.Sets(texts)
        for a, b in links:
            groups.join(a, b)
        alone = brute.document_components({k: t for k, t in texts.items() if k}, 2)
        assert {k: groups.find(k) for k in texts if k} == {k: comp for k, (_, comp) in alone.items()}


def test_linked_without_postings(spark):
    none = spark.createDataFrame([], "key long, v long, n long, w double")
    pairs, sets = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "v long, s binary")
    assert linking.linked(none, lambda _: pairs, lambda _: sets, 80).count() == 0


def test_shared_keys(spark):
    """Counts of keys over buckets and tasks, with a key that stands in most lists."""
    rng = random.Random(5)
    lists = [[rng.randrange(-(2**63), 2**63) if rng.random() < 0.5 else rng.randrange(-(10**3), 10**3), 7, None] for _ in range(3000)] + [None, [], [7, 7]]
    want = {}
    for x in (x for some in lists for x in some or [] if x is not None):
        want[x] = want.get(x, 0) + 1
    rows = spark.createDataFrame([(x,) for x in lists], "keys array<long>").repartition(7)
    for held in (100, 1 << 20):
        assert {r["key"]: r["df"] for r in linking.shared_keys(rows, "keys", held).collect()} == {x: n for x, n in want.items() if n > 1}
    assert linking.shared_keys(rows.where("false"), "keys").count() == 0


def test_blocks_of_lines_are_cut_where_they_are_compared(spark):
    """Fifty lines of one group as strays of one leader, their shingles unpacked in the blocks."""
    text = "the quick brown fox jumps over the lazy dog and then sleeps for a very long while "
    lines = [(v, f"{text}{text}{v:03d}".encode()) for v in range(50)] + [(50, b"x")]
    table = spark.createDataFrame(lines, "v long, s binary")
    members = spark.createDataFrame([(0, 0, v, v) for v in range(51)], "leader long, leader_comp long, v long, comp long")
    for block_bytes in (1 << 20, 1 << 13):
        links = linking.apart(members, lambda ids: table.join(ids, "v", "left_semi"), 80, block_bytes, lambda s: line_dedup.char_shingles(s, 5), 8).collect()
        seen, todo = set(), {0}
        while todo:
            seen |= todo
            todo = {y for r in links for x, y in ((r["a"], r["b"]), (r["b"], r["a"])) if x in seen} - seen
        assert seen == set(range(50))


def test_a_million_repeated_lines_are_taken_out_in_one_pass(spark):
    """Time grows with the lines of a document, not with their square."""
    text = "one line that stands again and again\n" * 1_000_000 + "another one, at the end of it all"
    docs = spark.createDataFrame([(1, text), (2, "one line that stands again and again")], "doc_id long, text string")
    began = time.monotonic()
    assert [tuple(r) for r in line_dedup.without_repeats(docs, **line_dedup.FINE).collect()] == [(1, "one line that stands again and again\nanother one, at the end of it all")]
    assert time.monotonic() - began < 120


def test_equal_sets_beyond_the_broadcasts(spark, monkeypatch):
    """Nine tenths of the rows have one set; no side of a join is broadcast but that of the largest groups."""
    rng = random.Random(9)
    texts = ["the same words in every one of these rows"] * 270 + [" ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) for _ in range(20)] + [None] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, shingle=2).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == brute.document_components(dict(enumerate(texts)), 2)


def test_normal_forms_of_lines():
    """As by words line by line; a text without odd white space isn't split into words at all."""
    for text in (None, b"", b"\n", b"One two\nthree\n\nFour", b" a b", b"a b ", b"a\n b", b"a \nb", b"a  b\nc", b"a\tb\nc\r\nd\x0be\x0cf", b"a\x1cb \xc3\x89"):
        for least in (0, 1, 2, 5):
            want = [(no, b" ".join(x.lower().split())) for no, x in enumerate((text or b"").split(b"\n")) if len(x.split()) >= least]
            assert list(line_dedup.eligible(text, least)) == want
    asked = []

    class Text(bytes):
        def lower(self):
            return Text(bytes.lower(self))

        def split(self, by=None):
            asked.append(by)
            return [Text(x) for x in bytes.split(self, by)]

    assert list(line_dedup.eligible(Text(b"A plain line\nand one more"), 1)) == [(0, b"a plain line"), (1, b"and one more")]
    assert asked == [b"\n"]


def test_windows_are_told_apart():
    for chars in (1, 5, 8):
        x = line_dedup.windows(b"abcabcab\xff\x00bcab", chars)
        texts = [b"abcabcab\xff\x00bcab"[i : i + chars] for i in range(14 - chars + 1)]
        assert [[a == b for b in texts] for a in texts] == [[bool(a == b) for b in x] for a in x]
        assert len(line_dedup.windows(b"ab"[: chars - 1], chars)) == 0


def test_lines_are_taken_out_in_one_pass(spark):
    """The function that takes lines out is called once a text, for the filter and the result together."""
    docs = spark.createDataFrame([(1, "one line\nanother"), (2, "one line"), (3, "one line\nmore")], "doc_id long, text string")
    out = line_dedup.without_repeats(docs, **line_dedup.FINE)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "one line\nanother"), (3, "more")]


def test_keys_of_lines_are_carried_as_one_value(spark, monkeypatch):
    """Packed keys are counted and posted as lists of them are, nulls and slices too."""
    docs = spark.createDataFrame([(1, "one line\nanother of them"), (2, "one line\n\nOne  line"), (None, None)], "doc_id long, text string")
    rows = line_dedup.sketches(docs, 1, 5, 18, 6)
    assert dict(rows.dtypes)["keys"] == "binary" and {len(r["keys"]) for r in rows.collect()} == {8 * 18}
    rng = random.Random(8)
    lists = [[rng.randrange(-50, 50) for _ in range(3)] for _ in range(400)]
    values = linking.packed(np.array(lists, np.int64))
    assert linking.unpacked_all(values.slice(7, 90)).view(np.int64).tolist() == [x for some in lists[7:97] for x in some]
    assert len(linking.unpacked_all(values.slice(0, 0))) == 0
    table = spark.createDataFrame([(v, x) for v, x in enumerate([bytearray(x) for x in values.to_pylist()] + [None])], "v long, keys binary").repartition(3)
    want = {}
    for x in (x for some in lists for x in some):
        want[x] = want.get(x, 0) + 1
    for total in (None, 1200):
        found = linking.shared_keys(table, "keys", 100, total)
        assert {r["key"]: r["df"] for r in found.collect()} == {x: n for x, n in want.items() if n > 1}
    for most in (line_dedup.BROADCAST_ROWS, 0):  # with a map of the keys or without
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
        posted = line_dedup.shared(table.where("keys is not null"), found).collect()
        assert sorted((r["v"], r["key"]) for r in posted) == sorted((v, x) for v, some in enumerate(lists) for x in some if want[x] > 1)


def test_wanted_lines_are_read_where_they_stand(spark, monkeypatch):
    """By doc_id, version and number, null ids and repeated rows too, joined by broadcast or shuffle; never another line."""
    rows = [(None, "x\nA  b\tC "), (None, "x\nA  b\tC "), (None, "other\nlines"), (1, "first\nsecond\nthird"), (1, "another first"), (2, "not wanted"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = line_dedup.places(docs, 1).distinct().selectExpr("doc_id", "version", "line_no", "line_id", "monotonically_increasing_id() as v")
    wanted = common.written(places.where("line_no = 1 or doc_id = 1"), "wanted")
    number = {(r["doc_id"], r["version"], r["line_no"]): r["v"] for r in wanted.collect()}
    named = {(r["doc_id"], r["text"]): r["version"] for r in line_dedup.sources(docs).collect()}
    want = {number[i, named[i, text], no]: line for i, text, no, line in [(None, rows[0][1], 1, b"a b c"), (None, rows[2][1], 1, b"lines"), (1, rows[3][1], 0, b"first"), (1, rows[3][1], 1, b"second"), (1, rows[3][1], 2, b"third"), (1, rows[4][1], 0, b"another first")]}
    for most in (line_dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
        got = line_dedup.line_texts(docs, wanted).collect()
        assert {r["v"]: bytes(r["line"]) for r in got} == want and len(got) == len(want)
    far = wanted.withColumn("line_no", wanted["line_no"] + 5)  # as if two texts had one version
    assert line_dedup.line_texts(docs, far).count() == 0


def test_keys_that_stand_once_stay_where_they_are(spark):
    """What no other line has isn't made a row: the function gives the join a few rows of two thousand."""
    rows = np.random.default_rng(3).integers(-(2**63), 2**63, (500, 4))
    rows[1, 2] = rows[7, 0]
    table = spark.createDataFrame([(v, bytearray(x)) for v, x in enumerate(linking.packed(rows).to_pylist())], "v long, keys binary").repartition(3)
    found = common.written(linking.shared_keys(table, "keys"), "shared")
    out = line_dedup.shared(table, found)
    assert sorted((r["v"], r["key"], r["df"]) for r in out.collect()) == [(1, int(rows[7, 0]), 2), (7, int(rows[7, 0]), 2)]
    given = []

    class Lines:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            given.extend(f(iter(table.toArrow().to_batches())))
            return out

    line_dedup.shared(Lines(), found)
    assert 2 <= sum(b.num_rows for b in given) < 20


def test_an_order_of_hashes_gives_four_rows_of_a_signature(monkeypatch):
    """The query's 108 rows are of 27 orders, those of a band of six different ones; lines at the threshold still meet."""
    asked = []
    orders = line_dedup.permutations
    monkeypatch.setattr(line_dedup, "permutations", lambda count: asked.append(count) or orders(count))
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 1500:
        x = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(60, 300)))
        y = bytearray(x)
        for at in rng.sample(range(len(x)), max(1, len(x) // 55)):
            y[at] = ord("#")
        a, b = (set(line_dedup.char_shingles(s, 5).tolist()) for s in (x, bytes(y)))
        if len(a & b) * 180 >= 80 * (len(a) + len(b)):  # a similarity of 0.8 or more
            pairs.append((x, bytes(y)))
    lines = [x for pair in pairs for x in pair]
    keys = line_dedup.band_keys(lines, 5, 18, 6)
    assert asked == [27] and keys.shape == (len(lines), 18)
    assert (keys[::2] == keys[1::2]).any(1).mean() > 0.99
    assert not (keys[::2][1:] == keys[1::2][:-1]).any()  # of lines that have next to nothing in common


def test_signatures_are_of_sets_of_shingles():
    """Neither what stands beside a line nor the part it falls into counts, nor how often a shingle stands in it."""
    lines = [b"a", b"abcab", b"abcabcab", b"abcabcabcabcab", b"hello there, this is a line", b"\xff" * 40, b"\xff" * 9, b"x" * 300]
    for chars, bands, rows in ((5, 18, 6), (8, 10, 4), (1, 2, 6)):
        keys = line_dedup.band_keys(lines, chars, bands, rows)
        assert all((line_dedup.band_keys([x], chars, bands, rows)[0] == k).all() for x, k in zip(lines, keys, strict=True))
        assert (line_dedup.line_signatures(lines, 40, chars, 1) == line_dedup.line_signatures(lines, 40, chars)).all()
        sets = [tuple(line_dedup.char_shingles(x, chars).tolist()) for x in lines]
        assert [[(a == b).all() for b in keys] for a in keys] == [[a == b for b in sets] for a in sets]
        assert line_dedup.band_keys([], chars, bands, rows).shape == (0, bands)


def test_strays_lie_beside_the_members_of_their_block():
    """One row of a block, so that the only block of a leader is compared where it lies and not shuffled."""
    sets = [np.array(x, np.uint64).tobytes() for x in ([1, 2, 3], [1, 2, 4], [5, 6, 7])]
    rows = pa.table({"s": sets, "v": [0, 1, 2], "comp": pa.array([None, 1, 2], pa.int64()), "stray": [False, False, True]})
    key = tuple(pa.scalar(x, pa.int64()) for x in (0, 0, 1))
    (row,) = linking.pack(key, rows, linking.unpacked).to_pylist()
    assert [np.frombuffer(row[c], np.int64).tolist() for c in ("vs", "q_vs")] == [[1, 2], [2]]
    (row,) = linking.pack(key, rows.slice(0, 2), linking.unpacked).to_pylist()
    assert row["vs"] and row["q_vs"] is None
    assert linking.pack(key, rows.slice(0, 1), linking.unpacked).num_rows == 0


def test_texts_that_share_frequent_shingles_are_not_posted(spark, monkeypatch):
    """What meets has several pairs of coordinates in common; phrases that other texts have, each another one, don't do that."""
    rng = random.Random(12)
    phrases = [" ".join(f"p{i}w{k}" for k in range(5)) for i in range(4000)]
    texts = {i: " ".join(rng.sample(phrases, 50)) for i in range(400)}
    near = {1000 + i: texts[i] + " and one word more" for i in range(40)}
    texts |= near
    asked = []
    linked = minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda postings, *more: asked.append(postings) or linked(postings, *more))
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), shingle=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.document_components(texts, 2)
    posted = [r["v"] for r in asked[0].collect()]
    alone = [v for v in posted if v not in near and v + 1000 not in near]
    assert set(posted) >= set(near) and len(set(alone)) < 36  # of 360 texts


def test_sets_that_share_enough_keys_meet(spark):
    """However frequent those keys are, and in whichever order; one key fewer needn't do."""
    rng = random.Random(13)
    meet = lambda found, a, b: bool(found.get(a, set()) & found.get(b, set()))
    for shared in (1, 2, minhash.SHARED):
        kinds = [rng.randrange(1, 4) for _ in range(24)]  # the first ones of a pair are in all sets
        pairs = [[(rng.randrange(kinds[k]) - 2**31, k) for k in range(24)] for _ in range(60)]
        pairs[7] = pairs[3][:shared] + [(5, -k) for k in range(shared, 24)]
        sets = spark.createDataFrame([(v, 10, [y for x in some for y in x]) for v, some in enumerate(pairs)], "v long, n long, sig array<int>")
        found = {}
        for r in minhash.prefixes(sets, 48, shared).collect():
            found.setdefault(r["v"], set()).add(r["key"])
        same = lambda a, b: sum(x == y for x, y in zip(pairs[a], pairs[b], strict=True))  # noqa: B023, E731
        assert same(3, 7) == shared and meet(found, 3, 7)
        assert all(meet(found, a, b) for a in range(60) for b in range(a) if same(a, b) >= shared)


def test_links_lost_by_signatures_are_few():
    """Fewer than by 26 of 48 coordinates alone from a similarity of 0.8 on, until neither is ever seen."""
    fewer = lambda n, p, k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    n = minhash.COORDINATES
    for s in (0.8, 0.82, 0.85, 0.9, 0.95):
        assert fewer(n, s, minhash.MATCHES) + fewer(n // 2, s * s, minhash.SHARED) < min(6.1e-6, max(1e-15, fewer(n, s, 26)))
