import math
import random

import pytest
from pyspark.sql import functions as F

from pixelmill.functions import laws
from pixelmill.operators import adaptive_grid as grid

SCHEMA = "image long, height int, width int, samples array<int>, q int"


def spread(values):
    return max(0.0, sum(v * v for v in values) / len(values) - (sum(values) / len(values)) ** 2)


def step(q):
    """Doubling every 24 quantizers, one after the other."""
    steps = list(laws.WIDE_STEPS)
    while len(steps) <= 255:
        steps.append(2 * steps[-24])
    return steps[q]


def lap(p):
    inner = [abs(4 * p[y][x] - p[y - 1][x] - p[y + 1][x] - p[y][x - 1] - p[y][x + 1]) for y in range(1, len(p) - 1) for x in range(1, len(p[0]) - 1)]
    return sum(inner) / len(inner) if inner else 0.0


def away(x):
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def plain(height, width, samples, base, uv=0, octile=6, strength=1.0, boost_only=False, dark=False, padded=False):
    """Superblock after superblock with a running quantizer."""
    plane = [samples[y * width : (y + 1) * width] for y in range(height)]
    corners = [(y, x) for y in range(0, height, 64) for x in range(0, width, 64)]
    part = {(y, x): [line[x : x + 64] for line in plane[y : y + 64]] for y, x in corners}
    anchor = 0.95 * sum(math.log1p(spread(sum(p, []))) for p in part.values()) / len(part)
    out, running = [], base
    for (y, x), p in part.items():
        subs = [spread(sum((line[i : i + 8] for line in p[j : j + 8]), [])) for j in range(0, len(p), 8) for i in range(0, len(p[0]), 8)]
        subs = sorted(subs + [sum(subs) / len(subs)] * (64 - len(subs)))
        v = math.log1p(subs[8 * octile - 1])
        delta = -away(min((5.549076 - v) * 5 * strength, 18)) if v < 5.549076 else away(min(max(v - max(anchor, 5.549076), 0) * 6 * strength, 16))
        delta = min(delta, 0) if boost_only else delta
        guard = max(0, -delta)
        if dark and base >= 150:
            half = [[(p[j][i] + p[j][i + 1] + p[j + 1][i] + p[j + 1][i + 1]) / 4 for i in range(0, len(p[0]) - 1, 2)] for j in range(0, len(p) - 1, 2)]
            energy = math.sqrt(lap(p) * (lap(half) if half and half[0] else 0))
            weight = min(4.5, max(1.0, (72 / (16 + sum(sum(p, [])) / sum(map(len, p)))) ** 1.2))
            guard = max(guard, away(min(16, max(0, math.log1p(energy * (weight - 1)) * 4))))
        target = max(1, min(255, base + (-guard if guard else delta)))
        signal = 0
        if padded or (len(p) == 64 and len(p[0]) == 64):
            signal = max(-6, min(6, away((target - running) / 4)))
            running = max(1, min(255, running + 4 * signal))
        chroma = step(max(1, min(255, running + uv)))
        out.append((y // 64, x // 64, target, signal, running, step(running), chroma, step(base) / step(running), step(base) / chroma))
    return out


def image(rng, height, width):
    """Squares that differ in contrast and brightness."""
    kinds = {(y, x): (rng.choice((0, 1, 2, 8, 30, 120)), rng.choice((4, 30, 120))) for y in range(0, height, 64) for x in range(0, width, 64)}
    return [max(0, min(255, kinds[y // 64 * 64, x // 64 * 64][1] + rng.randint(-k, k))) for y in range(height) for x in range(width) for k in (kinds[y // 64 * 64, x // 64 * 64][0],)]


@pytest.mark.parametrize(
    "options",
    [{"base": 120}, {"base": 160, "dark": True, "uv": -20}, {"base": 5, "octile": 1, "padded": True}, {"base": 250, "octile": 8, "strength": 2.5, "uv": 30}, {"base": 149, "dark": True, "boost_only": True}],
)
def test_equals_a_running_quantizer(spark, options):
    rng = random.Random(7)
    sizes = [(64, 64), (128, 192), (130, 70), (1, 1), (2, 200), (65, 128)]
    images = [(i, h, w, image(rng, h, w), 0) for i, (h, w) in enumerate(sizes)]
    rows = grid.grid(spark.createDataFrame(images, SCHEMA).repartition(3), **options).orderBy("image", "row", "col").collect()
    names = ("row", "col", "target", "signal", "q", "step", "chroma_step", "scale", "chroma_scale")
    for i, h, w, samples, _ in images:
        got, want = [tuple(r[k] for k in names) for r in rows if r["image"] == i], plain(h, w, samples, **options)
        assert [g[:7] for g in got] == [x[:7] for x in want]
        assert [g[7:] for g in got] == [pytest.approx(x[7:]) for x in want]


def test_odd_images(spark):
    flat = [9] * 64
    rows = [(1, 8, 8, flat, 0), (1, 8, 8, flat, 1), (2, 8, 8, flat[:-1], 0), (3, 8, 8, flat[:-1] + [None], 0), (4, None, 8, flat, 0), (5, 8, 8, None, 0), (6, 0, 0, [], 0), (None, 8, 8, flat, 0)]
    found = grid.grid(spark.createDataFrame(rows, SCHEMA), 100)
    assert sorted((r["image"] or 0, r["q"]) for r in found.collect()) == [(0, 100), (1, 100), (1, 100)]  # repeats stay, so do images without a name
    assert grid.grid(spark.createDataFrame([], SCHEMA), 100).count() == 0
    with pytest.raises(ValueError):
        grid.grid(spark.createDataFrame([], SCHEMA), 100, octile=9)


def test_steps(spark):
    got = spark.range(-3, 260).select("id", laws.wide_step(F.col("id").cast("int")).alias("step")).collect()
    assert [r["step"] for r in got] == [step(max(0, min(255, r["id"]))) for r in got]
