from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelmill.operators import compensation

SF = "/root/testdata/sf0.001"


def at(plane, y, x):
    h, w = len(plane), len(plane[0])
    return plane[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]


def plain_prediction(plane, y0, x0, row, col, size):
    taps, out = compensation.TAPS.tolist(), []
    for y in range(size):
        line = []
        for x in range(size):
            column = []
            for t in range(8):
                yy = y0 + y + (row >> 3) + t - 3
                column.append((sum(c * at(plane, yy, x0 + x + (col >> 3) + k - 3) for k, c in enumerate(taps[(col & 7) * 2])) + 4) >> 3)
            line.append(min(255, max(0, (sum(c * v for c, v in zip(taps[(row & 7) * 2], column, strict=True)) + 1024) >> 11)))
        out.append(line)
    return out


def bits(v):
    return 2 * (abs(v) + 1).bit_length() + (v != 0)


def plain_search(cur, ref, y0, x0, start, size, reach, dense, weight):
    price = lambda v: (2 + bits(v[0]) + bits(v[1])) * weight
    block = [r[x0 : x0 + size] for r in cur[y0 : y0 + size]]

    @cache
    def sad(v):
        if max(abs(v[0]), abs(v[1])) > 8 * reach:
            return float("inf")
        return price(v) + sum(abs(block[y][x] - at(ref, y0 + y + (v[0] >> 3), x0 + x + (v[1] >> 3))) for y in range(size) for x in range(size))

    @cache
    def satd(v):
        d = np.array(block) - np.array(plain_prediction(ref, y0, x0, *v, size))
        h, total = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]), 0
        for y in range(0, size, 4):
            for x in range(0, size, 4):
                total += np.abs(h @ d[y : y + 4, x : x + 4] @ h).sum()
        return price(v) + int(total)

    best = min([(0, 0), start], key=sad)
    cost, step = sad(best), 8 * 2 ** (reach.bit_length() - 1)
    while step >= 8:
        around = [(best[0] + a * step, best[1] + b * step) for a, b in [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]]
        new = min(around, key=sad)
        if sad(new) < cost:
            best, cost = new, sad(new)
        else:
            step //= 2
    near = [best] + [(best[0] + 8 * a, best[1] + 8 * b) for a in range(-dense, dense + 1) for b in range(-dense, dense + 1)]
    best = min(near, key=sad)
    for step in (4, 2):
        best = min([best] + [(best[0] + a * step, best[1] + b * step) for a, b in [(-1, 0), (1, 0), (0, -1), (0, 1)]], key=satd)
    return (*best, satd(best))


@pytest.fixture(scope="module")
def moving():
    """A plane, and where it was: moved by known shifts, with noise."""
    rng = np.random.default_rng(4)
    world = np.kron(rng.integers(0, 256, (14, 14)), np.ones((4, 4), int)) + rng.integers(-9, 9, (56, 56))
    world = np.clip(world, 0, 255)
    shifts = [(0, 0), (3, -2), (-4, 5), (1, 7)]
    return np.stack([world[8:40, 8:40]] * 4), np.stack([world[8 - a : 40 - a, 8 - b : 40 - b] for a, b in shifts]), np.array(shifts)


def test_prediction(moving):
    cur, ref, _ = moving
    rng = np.random.default_rng(1)
    of, y, x = rng.integers(0, 4, 30), rng.integers(0, 24, 30), rng.integers(0, 24, 30)
    vectors = rng.integers(-90, 90, (30, 2))
    found = compensation.predicted(ref, of, y, x, vectors, 8)
    for k in range(30):
        assert found[k].tolist() == plain_prediction(ref[of[k]].tolist(), y[k], x[k], *vectors[k].tolist(), 8)


def test_global_motion_finds_the_shift(moving):
    cur, ref, shifts = moving
    assert compensation.translation(cur, ref, 3, 8).tolist() == shifts.tolist()


def test_search_equals_a_plain_one(moving):
    cur, ref, shifts = moving
    starts = 8 * np.array([[0, 0], [3, -2], [0, 0], [2, 6]])
    found = compensation.searched(cur, ref, starts, 8, 8, 2, 4)
    assert len(found["of"]) == 4 * 16
    for k in range(0, 64, 3):
        n, y, x = (int(found[c][k]) for c in ("of", "y", "x"))
        assert (found["mv_row"][k], found["mv_col"][k], found["cost"][k]) == plain_search(cur[n].tolist(), ref[n].tolist(), y, x, tuple(starts[n].tolist()), 8, 8, 2, 4)
    inside = (found["of"] == 1) & (found["y"] > 0) & (found["y"] < 24) & (found["x"] > 0) & (found["x"] < 24)
    assert (found["mv_row"][inside] == 24).all() and (found["mv_col"][inside] == -16).all()


def plain_pyramid(plane, levels):
    out = [[list(map(float, r)) for r in plane]]
    while len(out) < levels:
        p = out[-1]
        out.append([[sum(p[yy][xx] for yy in range(2 * y, min(2 * y + 2, len(p))) for xx in range(2 * x, min(2 * x + 2, len(p[0])))) / (len(range(2 * y, min(2 * y + 2, len(p)))) * len(range(2 * x, min(2 * x + 2, len(p[0]))))) for x in range((len(p[0]) + 1) // 2)] for y in range((len(p) + 1) // 2)])
    return out


def plain_translation(cur, ref, levels, reach):
    cur, ref, best = plain_pyramid(cur, levels), plain_pyramid(ref, levels), (0, 0)

    @cache
    def cost(level, v):
        a, b = cur[level], ref[level]
        ys, xs = [y for y in range(len(a)) if 0 <= y + v[0] < len(a)], [x for x in range(len(a[0])) if 0 <= x + v[1] < len(a[0])]
        if len(ys) < len(a) // 2 or len(xs) < len(a[0]) // 2:
            return float("inf")
        return int(sum(abs(a[y][x] - b[y + v[0]][x + v[1]]) for y in ys for x in xs) * 1e6 / (len(ys) * len(xs)))

    for level in range(levels - 1, -1, -1):
        most = max(1, reach >> level)
        clip = lambda v: tuple(max(-most, min(most, c)) for c in v)  # noqa: B023, E731
        best = clip(best if level == levels - 1 else (2 * best[0], 2 * best[1]))
        step = 2 ** (most.bit_length() - 1) if level == levels - 1 else min(2, most)
        while step:
            old = best
            for a, b in [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)]:
                new = clip((best[0] + a * step, best[1] + b * step))
                if cost(level, new) < cost(level, best):
                    best = new
            step = step if best != old else step // 2
    for seed in (best, (0, 0)):
        for a in range(-8, 9):
            for b in range(-8, 9):
                new = clip((seed[0] + a, seed[1] + b))
                if cost(0, new) < cost(0, best):
                    best = new
    return best


def test_queries_equal_plain_searches(spark):
    """The first stream's frames, and one with odd sides."""
    pairs = compensation.pairs(entry.video_queries.rasters.pan_frames(spark, SF)).where("stream < 1").collect()
    planes = {r["frame"]: (np.array(r["samples"]).reshape(32, 32).tolist(), np.array(r["before"]).reshape(32, 32).tolist()) for r in pairs}
    shifts = {r["frame"]: (r["dy"], r["dx"]) for r in entry.OWN["global_motion"][0](spark, SF).where("stream = 0").collect()}
    assert set(shifts) == set(planes) == {1, 2, 3, 4}
    for k in (1, 2):
        assert shifts[k] == plain_translation(*planes[k], 3, 8)
    found = entry.OWN["subpel_search"][0](spark, SF)
    assert found.count() == 12 * 4 * 16
    for r in found.where("stream = 0 and frame <= 2 and x = y").collect():
        start = tuple(8 * c for c in shifts[r["frame"]])
        assert tuple(r)[4:] == plain_search(*planes[r["frame"]], r["y"], r["x"], start, 8, 8, 2, 4)
    rng = np.random.default_rng(3)
    odd = [rng.integers(0, 256, (2, 13, 11)) for _ in range(2)]
    for k in range(2):
        assert tuple(compensation.translation(*odd, 3, 5)[k]) == plain_translation(odd[0][k].tolist(), odd[1][k].tolist(), 3, 5)


def test_the_view_moves_as_stated(spark):
    """Two rows and two and a half columns a frame: the search finds rows, and a column on either side, or between."""
    shift = entry.OWN["global_motion"][0](spark, SF)
    assert shift.where("dy = 2 and dx in (2, 3)").count() == shift.count() == 48
    inner = entry.OWN["subpel_search"][0](spark, SF).where("y = 8 and x = 8").select(F.avg((F.abs(F.col("mv_row") - 16) <= 4).cast("int")), F.avg(F.col("mv_col").between(16, 24).cast("int"))).first()
    assert min(inner) > 0.9


def test_frames_that_do_not_pair(spark):
    rows = [(1, 0, [1] * 16), (1, 1, [2] * 16), (1, 3, [3] * 16), (2, 0, [1] * 15), (2, 1, [1] * 16), (3, 0, [None] * 16), (3, 1, [1] * 16), (4, 0, None), (4, 1, [1] * 16), (None, 0, [1] * 16), (None, 1, [1] * 16)]
    frames = spark.createDataFrame(rows, "stream long, frame long, samples array<int>")
    pairs = compensation.pairs(frames)
    assert [tuple(r) for r in compensation.global_motion(pairs, 4, 4).collect()] == [(1, 1, 0, 0)]
    assert compensation.search(pairs.limit(0), 4, 4, 4).count() == 0
