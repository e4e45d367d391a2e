import numpy as np

import __spark_entry__ as entry
from pixelmill.operators import screen_gate

SF = "/root/testdata/sf0.001"
SCHEMA = "image long, height int, width int, samples array<int>"


def found(spark, planes, step=40, **more):
    rows = [(k, *p.shape, p.ravel().tolist()) for k, p in enumerate(planes)]
    return [r for r in screen_gate.gate(spark.createDataFrame(rows, SCHEMA), step, superblock=16, **more).orderBy("image").collect()]


def test_both_sides_of_each_threshold(spark):
    rng = np.random.default_rng(1)
    noise, glyph = rng.integers(0, 256, (64, 64)), rng.integers(0, 2, (16, 16)) * 200
    text = np.tile(glyph, (4, 4))
    mixed = noise.copy()
    mixed[:16] = text[:16]
    one = rng.integers(0, 256, (64, 160))
    one[:16, :64] = text[:16]  # 4 of 40 blocks are of few colours
    less = rng.integers(0, 256, (64, 176))
    less[:16, :64] = text[:16]  # 4 of 44
    flat, soft = np.full((64, 64), 7), np.add.outer(np.arange(64), np.arange(64))
    rows = found(spark, [noise, text, mixed, one, less, flat, soft])
    assert [r["few_colours"] for r in rows] == [False, True, True, True, False, False, False]
    assert [r["copies_pay"] for r in rows] == [False, True, False, False, False, False, False]
    assert rows[0]["gain"] is None and rows[5]["gain"] is None and rows[1]["loss"] == 0 and rows[1]["gain"] > 0
    assert rows[2]["loss"] == 48 * 32 * 40


def test_the_step_decides(spark):
    """The same image pays at a fine step and doesn't at a coarse one, unless nothing is smoothed."""
    rng = np.random.default_rng(2)
    plane = np.concatenate([np.tile(rng.integers(0, 9, (16, 16)) * 8, (2, 6)), rng.integers(0, 256, (32, 96))])
    pay = {step: found(spark, [plane], step)[0] for step in (4, 600)}
    assert pay[4]["copies_pay"] and not pay[600]["copies_pay"] and pay[4]["loss"] == 48 * 32 * 4
    assert found(spark, [plane], 60, filtered=False)[0]["loss"] == 0


def test_odd_rows(spark):
    rows = [(1, 8, 64, [1] * 512), (2, 16, 16, [None] * 256), (3, 16, 16, [1] * 255), (4, 16, 16, None), (None, 16, 16, [1] * 256), (5, 17, 31, [1] * 527)]
    images = spark.createDataFrame(rows, SCHEMA)
    assert [r["image"] for r in screen_gate.gate(images, 40).collect()] == [5]
    assert screen_gate.gate(images.limit(0), 40).count() == 0


def test_query_has_both_sides(spark):
    rows = entry.OWN["screen_gate_copies"][0](spark, SF).collect()
    assert {r["copies_pay"] for r in rows} == {r["few_colours"] for r in rows} == {True, False}
