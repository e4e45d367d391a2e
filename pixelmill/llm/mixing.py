"""Operator 3: mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. A source of weight w gets, for its block j (from 1), the window of
slots from floor((j - 1) / w) to ceil(j / w); slots go to the released block with the earliest deadline. At any
slot, each source is then less than one block away from its share. Weights are taken as the exact fractions that they
are, and windows are reckoned in whole numbers from the start of a phase, so nothing is rounded however long a phase
lasts. A phase ends when a source runs out; the others go on by their own weights.

The driver deals the slots: it takes a step and holds a number (8 bytes) for each block. A block has 64 documents,
or as many as it takes for a million blocks in all (MOST_BLOCKS), so that the schedule stays some megabytes however
large the corpus is; it is broadcast. Executors look up a block's slot in the stretch of its source that the block
lies in. Sources are taken to be few, as their weights are given one by one: the driver holds a count for each.
Documents of a source are ordered by a hash of doc_id and text, and counted off in hash ranges of bounded size, so a
source with most of the rows is spread over many tasks, and so are rows with one doc_id or none.

Defined results: a null source is a source of its own; a source without a weight, or with none above 0, counts as one
of the smallest weight given (by default weights are square roots of the counts); rows that are equal in doc_id and
text are interchangeable; a null or empty text is a document like any other; an empty table gives no rows; further
columns are carried, whatever their names.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.llm.common import BROADCAST_ROWS, free_names

#: Documents of a block, at least, and blocks of a schedule, at most (but for a last one of each source).
BLOCK_DOCS = 64
MOST_BLOCKS = 1 << 20
#: Blocks of a source whose slots stand in one row of the schedule.
PERIOD = 1024
#: Documents that a hash range of a source holds, about.
RANGE_DOCS = 16_384


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the exact proportions of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def phase_slots(blocks: dict[str | None, int], share: dict[str | None, int]) -> tuple[dict[str | None, array], int]:
    """The slots of each source's blocks until one runs out, earliest deadline first among the released; their count.

    A source's next block waits for its release, then for a slot; one after it has a later deadline, so it needn't be
    looked at before.
    """
    n, t = sum(share.values()), 0
    slots = {k: array("q") for k in blocks}
    names = sorted(blocks, key=lambda k: (str(k), k is None))
    ready, waiting = [], [(0, i) for i in range(len(names))]
    while True:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[names[i]]) + 1) * n // share[names[i]]), i))
        i = heapq.heappop(ready)[1]
        own = slots[names[i]]
        own.append(t)
        t += 1
        if len(own) == blocks[names[i]]:
            return slots, t
        heapq.heappush(waiting, (len(own) * n // share[names[i]], i))


def plan(blocks: dict[str | None, int], weights: dict[str | None, float], period: int = PERIOD) -> list[tuple]:
    """(source, first block, end block, first slot of the phase, share, whole, slots): where blocks of a source stand.

    share / whole is the source's exact weight in the phase, share no less than the blocks of the row; slots are
    counted from the first of the phase. A row's blocks have the same number div period.
    """
    done, at, out = dict.fromkeys(blocks, 0), 0, []
    while left := {k: n - done[k] for k, n in blocks.items() if n > done[k]}:
        share = whole({k: weights[k] for k in left})
        slots, end = phase_slots(left, share)
        n = sum(share.values())
        for k, own in slots.items():
            first = done[k]
            done[k] += len(own)
            while first < done[k]:
                stop = min(done[k], (first // period + 1) * period)
                times = -(-(stop - first) // share[k])
                out.append((k, first, stop, at, times * share[k], times * n, own[len(own) - done[k] + first : len(own) - done[k] + stop]))
                first = stop
        at += end
    return out


#: What mix_order adds: the number of the block in its source, its slot, and the place in the block.
PLACES = ("_mix_block", "_mix_slot", "_mix_in_block")


def mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD, places: tuple[str, ...] = PLACES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows with three places (names that docs doesn't have), in no particular order."""
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(F.col("source").cast("string")).count().collect()}
    given = {k: w for k, w in (weights or {k: n**0.5 for k, n in counts.items()}).items() if w > 0}
    least = min(given.values(), default=1.0)
    total = sum(counts.values())
    block_docs = max(block_docs, -(-total // most_blocks))
    rows = plan({k: -(-n // block_docs) for k, n in counts.items()}, {k: given.get(k, least) for k in counts}, period)
    rows = [(k, first // period, first, end, [at + t for t in slots]) for k, first, end, at, _, _, slots in rows]
    source, key, part, start, rank, p_source, p_stretch, p_first, p_end, p_slots, s_source, s_part = free_names(docs, *(f"mix {x}" for x in ("source", "key", "part", "start", "rank", "p_source", "p_stretch", "p_first", "p_end", "p_slots", "s_source", "s_part")))
    stretches = F.broadcast(spark.createDataFrame(rows, "s string, t long, f long, e long, l array<long>", verifySchema=False).toDF(p_source, p_stretch, p_first, p_end, p_slots))  # at most most_blocks numbers and a row for each source
    bits = max(0, (total // RANGE_DOCS).bit_length())

    named = docs.withColumn(source, F.col("source").cast("string")).withColumn(key, F.xxhash64("doc_id", "text"))
    named = named.withColumn(part, F.shiftright(key, 63 - bits))
    sizes = named.groupBy(source, part).agg(F.count(F.lit(1)).alias(start))
    before = W.partitionBy(source).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(source).alias(s_source), F.col(part).alias(s_part), F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    if len(counts) << bits + 1 <= BROADCAST_ROWS:  # a row for each hash range at most; a join by shuffle would deal the texts out once more
        starts = F.broadcast(starts)
    within = W.partitionBy(source, part).orderBy(key, "doc_id")
    ranked = named.withColumn(rank, F.row_number().over(within) - 1)
    ranked = ranked.join(starts, F.col(source).eqNullSafe(F.col(s_source)) & (F.col(part) == F.col(s_part)))
    number = F.col(start) + F.col(rank)
    ranked = ranked.withColumn(places[0], F.floor(number / block_docs)).withColumn(places[2], number % block_docs)
    own = F.col(source).eqNullSafe(F.col(p_source)) & (F.floor(F.col(places[0]) / period) == F.col(p_stretch))
    put = ranked.join(stretches, own & (F.col(places[0]) >= F.col(p_first)) & (F.col(places[0]) < F.col(p_end)))
    slot = F.get(p_slots, (F.col(places[0]) - F.col(p_first)).cast("int"))
    return put.select(*docs.columns, places[0], slot.alias(places[1]), places[2])


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """The rows in the order of the schedule: written files, in the order of their names, hold it."""
    places = tuple(free_names(docs, *PLACES))
    return mix_order(docs, weights, block_docs, period, places).orderBy(places[1], places[2]).select(docs.columns)
