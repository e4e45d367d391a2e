import math

import numpy as np
import pytest

import __spark_entry__ as entry
from pixelmill.operators import directional, integer_transforms

SF = "/root/testdata/sf0.001"
SHAPES = [(h, w) for h in integer_transforms.SIDES for w in integer_transforms.SIDES if max(h, w) <= 4 * min(h, w)]


def basis(n):
    return np.array([[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)])


@pytest.mark.parametrize("n", integer_transforms.SIDES)
def test_lanes_are_the_cosine_transform(n):
    x = np.random.default_rng(n).integers(-2000, 2000, (50, n))
    ahead = np.stack(integer_transforms.forward_lanes(list(x.T)), 1)
    assert np.abs(ahead - x @ basis(n).T * math.sqrt(n)).max() < 2 + n / 2  # each product is rounded, and the last odd ones are sums of up to n / 2
    back = np.stack(integer_transforms.inverse_lanes(list(x.T)), 1)
    assert np.abs(back - x @ basis(n) * math.sqrt(n / 2)).max() < 2 + n / 4  # sines of 12 bits, of sums up to 8,000


def test_lanes_of_numbers_and_arrays_agree():
    x = [5, -3, 250, 17, 0, 255, -255, 9]
    assert integer_transforms.forward_lanes(x) == [int(v[0]) for v in integer_transforms.forward_lanes([np.array([v]) for v in x])]


@pytest.mark.parametrize("shape", SHAPES)
def test_round_trip_is_within_two(shape):
    rng = np.random.default_rng(1)
    blocks = np.concatenate([rng.integers(-255, 256, (300, *shape)), rng.choice([-255, 255], (200, *shape)), np.full((1, *shape), 255), np.full((1, *shape), -255), np.zeros((1, *shape), int)])
    found = integer_transforms.forward(blocks)
    assert np.abs(found - 8 * (basis(shape[0]) @ blocks @ basis(shape[1]).T)).max() < 40
    assert np.abs(integer_transforms.inverse(found) - blocks).max() <= 2


def test_round_trip_query(spark):
    planes = {r["image"]: np.array(r["samples"]).reshape(32, 32) - 128 for r in entry.coding_queries.rasters.stacked_planes(spark, SF).collect()}
    found = entry.OWN["integer_round_trip"][0](spark, SF).toPandas()
    assert len(found) == len(planes) * 1024 * len(SHAPES)
    for (image, height, width), part in found[found.image < 3].groupby(["image", "height", "width"]):
        got = part.sort_values(["block", "i"])["sample"].to_numpy().reshape(32 // height, 32 // width, height, width).transpose(0, 2, 1, 3).reshape(32, 32)
        assert np.abs(got - planes[image]).max() <= 2


def plain_edge(edge, count, power):
    """edge: dict of place to sample, the corner at -1."""
    if not power:
        return edge
    taps = directional.SMOOTHERS[power - 1]
    return {**edge, **{o: (sum(w * edge[max(-1, min(count - 1, o + k - 2))] for k, w in enumerate(taps)) + 8) >> 4 for o in range(count)}}


def plain_doubled(edge, count):
    at = lambda k: edge[max(-1, min(count - 1, k))]
    out = {-2: edge[-1]}
    for i in range(count):
        out[2 * i - 1] = max(0, min(255, (9 * (at(i - 1) + at(i)) - at(i - 2) - at(i + 1) + 8) >> 4))
        out[2 * i] = edge[i]
    return out


def plain_direction(above, left, n, angle, smooth):
    """Sample by sample, after the text of the specification."""
    top, side = ({k - 1: int(v) for k, v in enumerate(e)} for e in (above, left))
    if angle == 90:
        return [[top[x] for x in range(n)] for _ in range(n)]
    if angle == 180:
        return [[side[y]] * n for y in range(n)]
    if 90 < angle < 180 and n + n >= 24:
        top[-1] = side[-1] = (5 * side[0] + 6 * top[-1] + 5 * top[0] + 8) >> 4
    counts = n + n * (angle < 90), n + n * (angle > 180)
    power = lambda d: max([s for least, s in next(r for most, r in directional.STRENGTHS[smooth].items() if 2 * n <= most) if abs(d) >= least], default=0)
    top, side = plain_edge(top, counts[0], power(angle - 90)), plain_edge(side, counts[1], power(angle - 180))
    up = [0 < abs(angle - a) < 40 and 2 * n <= (8 if smooth else 16) for a in (90, 180)]
    top, side = plain_doubled(top, counts[0]) if up[0] else top, plain_doubled(side, counts[1]) if up[1] else side
    mix = lambda e, b, s: (e[b] * (32 - s) + e[b + 1] * s + 16) >> 5
    out = []
    for y in range(n):
        row = []
        for x in range(n):
            if angle < 90:
                along = (y + 1) * directional.STEPS[angle]
                b, last = (along >> (6 - up[0])) + (x << up[0]), (2 * n - 1) << up[0]
                row.append(mix(top, b, ((along << up[0]) >> 1) & 31) if b < last else top[last])
            elif angle > 180:
                along = (x + 1) * directional.STEPS[270 - angle]
                row.append(mix(side, (along >> (6 - up[1])) + (y << up[1]), ((along << up[1]) >> 1) & 31))
            else:
                along = (x << 6) - (y + 1) * directional.STEPS[180 - angle]
                b, e, u = along >> (6 - up[0]), top, up[0]
                if b < -(1 << up[0]):
                    along = (y << 6) - (x + 1) * directional.STEPS[angle - 90]
                    b, e, u = along >> (6 - up[1]), side, up[1]
                row.append(mix(e, b, ((along << u) >> 1) & 31))
        out.append(row)
    return out


@pytest.mark.parametrize("n", [4, 8, 16, 32])
@pytest.mark.parametrize("smooth", [False, True])
def test_directions_against_the_text(n, smooth):
    rng = np.random.default_rng(n)
    corner = rng.integers(0, 256, (3, 1))
    above, left = (np.concatenate([corner, rng.integers(0, 256, (3, 2 * n))], 1) for _ in range(2))
    for angle in directional.ANGLES[:: 1 if n < 16 else 4]:
        found = directional.predicted(above, left, angle, smooth)
        for k in range(3):
            assert found[k].tolist() == plain_direction(above[k], left[k], n, angle, smooth)


def test_angles_have_steps():
    assert len(directional.ANGLES) == 56
    for a in set(directional.ANGLES) - {90, 180}:
        assert {a} if a < 90 else {180 - a, a - 90} if a < 180 else {270 - a} <= set(directional.STEPS)


def test_edges_of_blocks():
    plane = np.arange(64).reshape(1, 8, 8)
    above, left = directional.edges(plane, 4)
    assert above.tolist() == [[128] + [127] * 8, [3] * 9, [24] + [24, 25, 26, 27, 28, 29, 30, 31], [27, 28, 29, 30, 31, 31, 31, 31, 31]]
    assert left.tolist() == [[128] + [129] * 8, [3, 3, 11, 19, 27, 35, 43, 51, 59], [24] * 9, [27, 35, 43, 51, 59, 59, 59, 59, 59]]


def test_filter_taps():
    """Two modes in full, and that every patch of a flat surrounding is flat."""
    assert directional.TAPS[0].tolist() == [[-6, 10, 0, 0, 0, 12, 0], [-5, 2, 10, 0, 0, 9, 0], [-3, 1, 1, 10, 0, 7, 0], [-3, 1, 1, 2, 10, 5, 0], [-4, 6, 0, 0, 0, 2, 12], [-3, 2, 6, 0, 0, 2, 9], [-3, 2, 2, 6, 0, 2, 7], [-3, 1, 2, 2, 6, 3, 5]]
    assert directional.TAPS[2][:4].tolist() == [[-8, 8, 0, 0, 0, 16, 0], [-8, 0, 8, 0, 0, 16, 0], [-8, 0, 0, 8, 0, 16, 0], [-8, 0, 0, 0, 8, 16, 0]]
    for taps in directional.TAPS:
        assert (taps.sum(1) == 16).all()


@pytest.mark.parametrize("mode", range(5))
def test_filters_against_a_plain_version(mode):
    rng = np.random.default_rng(mode)
    n = 8
    corner = rng.integers(0, 256, (4, 1))
    above, left = (np.concatenate([corner, rng.integers(0, 256, (4, 2 * n))], 1) for _ in range(2))
    found = directional.filtered(above, left, mode)
    for k in range(4):
        known = {(-1, x): int(above[k, x + 1]) for x in range(-1, n)} | {(y, -1): int(left[k, y + 1]) for y in range(n)}
        for y0 in range(0, n, 2):
            for x0 in range(0, n, 4):
                near = [known[y0 - 1, x0 + i] for i in range(-1, 4)] + [known[y0, x0 - 1], known[y0 + 1, x0 - 1]]
                for i, taps in enumerate(directional.TAPS[mode].tolist()):
                    known[y0 + i // 4, x0 + i % 4] = max(0, min(255, (sum(a * b for a, b in zip(taps, near, strict=True)) + 8) >> 4))
        assert found[k].tolist() == [[known[y, x] for x in range(n)] for y in range(n)]


def test_queries_of_filters_and_bad_rows(spark):
    found = entry.OWN["filter_prediction"][0](spark, SF)
    assert found.count() == 31 * 16 * 5 * 64
    planes = spark.createDataFrame([(1, [1] * 63), (2, None), (3, [None] * 64), (4, [7] * 64), (None, [7] * 64)], "image long, samples array<int>")
    assert {r["image"] for r in directional.by_filter(planes, 8, 8).collect()} == {4, None}
    assert {r["image"] for r in integer_transforms.coefficients(planes, 8, [(8, 8)]).collect()} == {4, None}
    assert directional.by_angle(planes.limit(0), 8, 8).count() == 0
