import itertools
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pixelmill.operators import causal_copies, index_maps

SF = "/root/testdata/sf0.001"


# copies


def plain_copies(plane, size, sb, lead):
    h, w = plane.shape
    every = {(y, x): plane[y : y + size, x : x + size].tobytes() for y in range(h - size + 1) for x in range(w - size + 1)}
    out = {}
    for y in range(0, h - size + 1, size):
        for x in range(0, w - size + 1, size):
            own_row, own_col, best = y // sb, x // sb, None
            for (ry, rx), samples in every.items():
                row, col = (ry + size - 1) // sb, (rx + size - 1) // sb
                if samples == every[y, x] and ((row < own_row and col <= own_col + lead * (own_row - row)) or (row == own_row and col < own_col)):
                    best = max(best or (-1,), (row, col, ry, rx))
            if best:
                out[y, x] = best[2:]
    return out


def test_copies_against_a_plain_search(spark):
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 2, (24, 40)), np.tile(rng.integers(0, 300, (5, 7)), (6, 7))[:26, :45], np.full((32, 32), 9), rng.integers(0, 9, (3, 50)), np.kron(rng.integers(0, 2, (6, 9)), np.ones((4, 4), int))]
    rows = [(k, *p.shape, p.ravel().tolist()) for k, p in enumerate(planes)] + [(90, 4, 4, [1] * 15), (91, 4, 4, [None] * 16), (92, 4, 4, None), (None, 8, 8, [1] * 64)]
    images = spark.createDataFrame(rows, "image long, height int, width int, samples array<int>")
    for size, sb, lead in ((4, 8, 2), (4, 8, 1), (2, 4, 0)):
        found = causal_copies.latest(images, size, sb, lead).where("image is not null").collect()
        got = {k: {(r["y"], r["x"]): (r["ref_y"], r["ref_x"]) for r in found if r["image"] == k} for k in range(5)}
        assert got == {k: plain_copies(p, size, sb, lead) for k, p in enumerate(planes)}
        assert {r["image"] for r in found} <= set(range(5)) and got[2]
    assert causal_copies.latest(images.limit(0)).count() == 0


def test_a_flat_image_makes_no_pairs(spark):
    """All windows of an image are equal: rows stay blocks times rows of superblocks."""
    images = spark.createDataFrame([(1, 128, 128, [7] * 128 * 128)], "image long, height int, width int, samples array<int>")
    found = causal_copies.latest(images, 4, 16).collect()
    assert len(found) == 32 * 32 - 16  # the first superblock has nothing before it
    assert {(r["y"], r["x"]): (r["ref_y"], r["ref_x"]) for r in found}[16, 16] == (28, 12)


# index maps


def row_cost(row, above, errors, prices, weight):
    total = 0
    for x, i in enumerate(row):
        total += errors[x][i]
        near = ([(row[x - 1], 2)] if x else []) + ([(above[x], 2)] if above else []) + ([(above[x - 1], 1)] if x and above else [])
        if near:
            context, rank = index_maps.place(i, near)
            total += weight * prices[context][rank]
    return total


@pytest.mark.parametrize("seed", range(12))
def test_rows_are_the_best_ones(seed):
    rng = random.Random(seed)
    width, height, n, weight = rng.randint(1, 5), 3, rng.randint(1, 4), rng.choice([0, 1, 9, 60])
    centres, samples = [rng.randrange(6) for _ in range(n)], [[rng.randrange(6) for _ in range(width)] for _ in range(height)]
    errors = np.full((1, height, width, 8), 1 << 50)
    for y, x, i in itertools.product(range(height), range(width), range(n)):
        errors[0, y, x, i] = 16 * (samples[y][x] - centres[i]) ** 2
    found = index_maps.smoothed(errors, *index_maps.price_tables(index_maps.PRICES, weight))[0].tolist()
    above = None
    for y in range(height):
        cost = lambda r: row_cost(r, above, errors[0, y].tolist(), index_maps.PRICES, weight)  # noqa: B023, E731
        assert cost(found[y]) == min(map(cost, itertools.product(range(n), repeat=width)))
        nearest = [min(range(n), key=lambda i: errors[0, y, x, i]) for x in range(width)]  # noqa: B023
        assert cost(found[y]) <= cost(nearest)
        above = found[y]


def test_places():
    assert index_maps.place(5, [(5, 2), (5, 2), (5, 1)]) == (4, 0)
    assert index_maps.place(2, [(5, 2), (5, 2), (2, 1)]) == (3, 1)
    assert index_maps.place(0, [(5, 2), (3, 2), (7, 1)]) == (1, 3)
    assert index_maps.place(6, [(5, 2), (3, 2), (7, 1)]) == (1, 7)
    assert index_maps.place(3, [(3, 2)]) == (0, 0)


def test_ties_go_to_the_lower_index(spark):
    rows = [(1, [5, 5, 5, 5], [4, 6]), (2, [5, 5, 5, 5], [6, 4, 5]), (3, [1, 2, 3], [1]), (4, [1, 2], []), (5, None, [1]), (6, [1, 1], [1, None]), (None, [3, 9], [9])]
    blocks = spark.createDataFrame(rows, "vec_id long, block array<int>, centres array<int>")
    found = {r["vec_id"]: r["indices"] for r in index_maps.smooth_maps(blocks, 2).collect()}
    assert found == {1: [0, 0, 0, 0], 2: [2, 2, 2, 2], None: [0, 0]}


def test_smoothing_follows_the_weight(spark):
    """Without weight a map is that of the nearest centres; with much of it a block has few changes."""
    blocks = entry.coding_queries.rasters.embed_blocks(spark, SF).limit(20).selectExpr("vec_id", "block", "array(40, 100, 150, 220) as centres")
    maps = {w: {r["vec_id"]: r["indices"] for r in index_maps.smooth_maps(blocks, 8, w).collect()} for w in (0, 40, 4000)}
    changes = lambda m: sum(a != b for row in itertools.batched(m, 8) for a, b in itertools.pairwise(row))
    for r in blocks.collect():
        assert maps[0][r["vec_id"]] == [min(range(4), key=lambda i: (v - r["centres"][i]) ** 2) for v in r["block"]]  # noqa: B023
    assert sum(map(changes, maps[0].values())) > sum(map(changes, maps[40].values())) > sum(map(changes, maps[4000].values()))


def test_query_of_maps(spark):
    found = entry.OWN["smoothed_palette_maps"][0](spark, SF)
    assert found.count() == 500 * 64 and found.where("centre not between 0 and 3").count() == 0
