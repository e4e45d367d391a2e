"""Every stage of the pipeline on the rows that the one before kept, against plain versions."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_packing_mixing import plain_schedule

from pixelmill.llm import line_dedup, quality_rules
from pixelmill.llm.common import table, written
from pixelmill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows, model):
    out = []
    for r in rows:
        data = (r["text"] or "").encode()
        words = data.split()
        if len(words) >= 10 and 100 * quality_rules.repeat_words(words) <= 20 * len(words) and quality_rules.content_share(*quality_rules.read_lines(data)[:2], model) >= 0.5:
            out.append(r)
    return out


def without_lines(rows):
    texts = {r["doc_id"]: r["text"] for r in rows}
    places, out = brute.line_places(texts, min_words=1, chars=5), []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        left = [x for i, x in enumerate(lines) if places.get((r["doc_id"], i), (r["doc_id"], i)) == (r["doc_id"], i)]
        if len(left) == len(lines) or "".join(left).split():
            text = "\n".join(left)
            out.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    return out


def test_stages_equal_plain_versions(spark):
    import corpus_pipeline

    docs, model = table(spark, SF, "documents"), None
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        assert docs.columns == columns
        out = written(stage(spark, docs, SF), name)
        got = out.collect()
        seen.append((name, len(got)))
        if name == "quality_rules":
            model = quality_rules.train(docs, table(spark, SF, "labels"))
            assert sorted(map(tuple, got)) == sorted(map(tuple, kept_by_rules(rows, model)))
        elif name == "line_dedup":
            want = {r[0]: r for r in without_lines(rows)}
            mine = {r["doc_id"]: tuple(r) for r in got}
            assert len(mine) == len(got) and sum(mine.get(k) != want.get(k) for k in mine.keys() | want.keys()) <= len(want) // 50  # banding: recall above 0.99
        elif name == "near_duplicates":
            comps = brute.document_components({r["doc_id"]: r["text"] for r in rows}, 5)
            assert sorted(r["doc_id"] for r in got) == sorted(k for k, (n, comp) in comps.items() if comp == k)
        elif name == "mixing":
            assert sorted(map(tuple, got)) == sorted(map(tuple, rows))
            sizes = {k: sum(r["source"] == k for r in rows) for k in {r["source"] for r in rows}}
            order = plain_schedule({k: -(-n // 64) for k, n in sizes.items()}, {k: n**0.5 for k, n in sizes.items()})
            want = [k for k, j in order for _ in range(min(64, sizes[k] - 64 * j))]
            assert [r["source"] for r in got] == want  # the files hold the order
        else:
            from tokenizers import Tokenizer

            tokenizer, pieces, sequences = Tokenizer.from_file(tokenizer_path()), {}, {}
            for r in got:
                pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
                sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for r in rows:
                ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
                own = sorted(pieces.pop(r["doc_id"]))
                assert [x for s, n, _ in own for x in range(s, s + n)] == list(range(len(ids)))
                assert all(crc == brute.crc32(ids[s : s + n]) for s, n, crc in own)
            assert not pieces
            for own in sequences.values():
                at = 0
                for offset, n in sorted(own):
                    assert offset == at
                    at += n
                assert at == 4096 or at & (at - 1) == 0
        docs = out
    assert [n for n, _ in seen] == [n for n, _ in corpus_pipeline.STAGES] and all(n for _, n in seen)


def test_lines_without_a_word_stay(spark):
    docs = spark.createDataFrame([(1, "a b c\n\n  \nd e", "en", "s", 13), (2, " \n", None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, line_dedup.without_repeats(docs, **line_dedup.FINE).collect())) == sorted(map(tuple, docs.collect()))
