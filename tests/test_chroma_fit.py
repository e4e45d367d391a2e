"""The fixed-point fit against plain whole numbers, one value at a time."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pixelmill.operators import chroma_fit as fit

SF = "/root/testdata/sf0.001"


def times(a, b, shift):
    excess = max(0, max(abs(a), 1).bit_length() + max(abs(b), 1).bit_length() - 29)
    product, left = (a >> excess // 2) * (b >> excess - excess // 2), shift - excess
    if left <= 0:
        return product
    if left > 29:
        return 0
    found = (abs(product) + 2 ** (left - 1)) // 2**left
    return found if product >= 0 else -found


def over(d):
    shift = d.bit_length() - 1
    norm = (d + (1 << shift - 14) // 2) >> (shift - 14) if shift > 14 else d << (14 - shift)
    part = min(norm, 32767) % 16384
    k = part // 2048
    off = part - int(fit.ORIGINS[k])
    return (int(fit.WEIGHTS[k]) * (off * off // 16384) // 256 - off // 2 + int(fit.HEIGHTS[k])) * 4, shift


def eliminate(matrix, right):
    n = len(right)
    rows = [[v + (2 if i == j else 0) for j, v in enumerate(r)] + [y] for i, (r, y) in enumerate(zip(matrix, right, strict=True))]
    for i in range(n):
        scale, shift = over(max(1, abs(rows[i][i])))
        for k in range(i + 1, n + 1):
            rows[i][k] = times(rows[i][k], scale, shift)
        for j in range(i + 1, n):
            for k in range(i + 1, n + 1):
                rows[j][k] -= times(rows[j][i], rows[i][k], 16)
    out = [0] * n
    for i in reversed(range(n)):
        out[i] = rows[i][n] - sum(times(rows[i][j], out[j], 16) for j in range(i + 1, n))
    return out


def plain(luma, chroma, y0, x0, size, tap):
    """(parameters, prediction) of one block."""
    at = lambda y, x: luma[y + tap[0]][x + tap[1]] if y + tap[0] >= 0 and x + tap[1] >= 0 else luma[y][x]
    terms = lambda y, x: (at(y, x), (luma[y][x] ** 2 + 128) // 256, 128)
    top, left = (2 if y0 else 0), (2 if x0 else 0)
    places = [(y, x) for y in range(y0 - top + 1, y0 + size - 1) for x in range(x0 - left + 1, x0 + size - 1) if y < y0 or x < x0]
    p = [0, 0, 65536]
    if places:
        shift = 6 - (len(places) - 1).bit_length()
        move = lambda v: v << shift if shift >= 0 else v >> -shift
        matrix = [[move(sum(terms(*q)[i] * terms(*q)[j] for q in places)) for j in range(3)] for i in range(3)]
        p = eliminate(matrix, [move(sum(terms(y, x)[i] * chroma[y][x] for y, x in places)) for i in range(3)])
    return p, [max(0, min(255, sum(times(a, b, 16) for a, b in zip(p, terms(y, x), strict=True)))) for y in range(y0, y0 + size) for x in range(x0, x0 + size)]


def test_products_and_reciprocals():
    rng = random.Random(3)
    pairs = [(rng.randint(-(2 ** rng.randint(1, 31)), 2 ** rng.randint(1, 31)), rng.randint(-(2 ** rng.randint(1, 31)), 2 ** rng.randint(1, 31)), rng.randint(0, 32)) for _ in range(4000)]
    a, b, s = (np.array(x) for x in zip(*pairs, strict=True))
    assert fit.multiplied(a, b, s).tolist() == [times(*p) for p in pairs]
    ds = [1, 2, 3, 2**14, 2**15 - 1, 2**31 - 1] + [rng.randint(1, 2 ** rng.randint(1, 31)) for _ in range(2000)]
    scale, shift = fit.reciprocal(np.array(ds))
    assert list(zip(scale.tolist(), shift.tolist(), strict=True)) == [over(d) for d in ds]
    assert all(abs(float(k) / 2 ** int(h) * d / 65536 - 1) < 2e-3 for d, k, h in zip(ds, scale, shift, strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_elimination(seed):
    rng = random.Random(seed)
    cases = [([[0] * 3] * 3, [0] * 3), ([[1 << 20] * 3] * 3, [1 << 20] * 3), ([[4, 0, 0], [0, 0, 0], [0, 0, 0]], [9, 5, -5])]  # singular ones
    for _ in range(300):
        v = [[rng.randint(0, 255) for _ in range(3)] for _ in range(rng.randint(1, 16))]
        cases.append(([[sum(r[i] * r[j] for r in v) << 2 for j in range(3)] for i in range(3)], [sum(r[i] * rng.randint(0, 255) for r in v) << 2 for i in range(3)]))
    found = fit.solved(np.array([m for m, _ in cases], np.int64), np.array([y for _, y in cases], np.int64))
    assert found.tolist() == [eliminate(m, y) for m, y in cases]


def test_blocks_against_plain(spark):
    rng = np.random.default_rng(9)
    luma = [rng.integers(0, 256, (16, 24)), np.full((16, 24), 255), np.add.outer(np.arange(16) * 4, np.arange(24) * 5), np.zeros((16, 24), int)]
    chroma = [rng.integers(0, 256, (16, 24)), np.full((16, 24), 3), np.add.outer(np.arange(16) * 2, np.arange(24) * 3) + 20, rng.integers(0, 256, (16, 24))]
    rows = [(i, a.ravel().tolist(), b.ravel().tolist()) for i, (a, b) in enumerate(zip(luma, chroma, strict=True))] + [(7, [1] * 24, [None] * 24), (8, None, [1]), (9, [1] * 25, [1] * 25), (10, [], []), (11, [1] * 48, [1] * 24), (None, [5] * 384, [6] * 384)]
    found = fit.fits(spark.createDataFrame(rows, "image long, luma array<int>, chroma array<int>"), 24).collect()
    assert len(found) == 5 * 6 * 3
    for r in found:
        k = r["image"]
        a, b = (luma[k].tolist(), chroma[k].tolist()) if k is not None else ([[5] * 24] * 16, [[6] * 24] * 16)
        p, samples = plain(a, b, r["block"] // 3 * 8, r["block"] % 3 * 8, 8, fit.TAPS[r["direction"]])
        assert (r["parameters"], r["samples"]) == (p, samples)
        assert r["sad"] == sum(abs(b[r["block"] // 3 * 8 + i // 8][r["block"] % 3 * 8 + i % 8] - v) for i, v in enumerate(samples))
    assert max(r["sad"] for r in found if r["image"] == 2 and r["block"] == 4) < 64 * 4  # a linear plane is met closely


def test_query(spark):
    """Each block's row is the least of the three directions, by the plain version."""
    planes = {r["image"]: r["samples"] for r in entry.coding_queries.rasters.stacked_planes(spark, SF).collect()}
    found = entry.OWN["chroma_fit"][0](spark, SF).collect()
    assert sorted((r["image"], r["block"]) for r in found) == [(i, b) for i in sorted(planes) if i + 1 in planes for b in range(16)]
    grid = lambda s: [s[k : k + 32] for k in range(0, 1024, 32)]
    for r in found[::5]:
        luma, chroma, y0, x0 = grid(planes[r["image"]]), grid(planes[r["image"] + 1]), r["block"] // 4 * 8, r["block"] % 4 * 8
        own = [chroma[y0 + i // 8][x0 + i % 8] for i in range(64)]
        every = [plain(luma, chroma, y0, x0, 8, tap) for tap in fit.TAPS]
        sads = [sum(abs(a - b) for a, b in zip(own, s, strict=True)) for _, s in every]
        d = sads.index(min(sads))
        assert (r["direction"], r["sad"], [r["p0"], r["p1"], r["p2"]]) == (d, sads[d], every[d][0])
