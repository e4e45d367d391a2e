"""Queries of the motion operators over moving views: name to (plan, SQL)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import compensation
from pixelmill.plans.raster_queries import BLOCK_SQL, Plan
from pixelmill.sources import rasters

QUERIES: dict[str, tuple[Plan, str | None]] = {}
SIDE = 32


def query(sql: str | None = None):  # noqa: ANN201
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


PAN_SQL = f"""{BLOCK_SQL}, strips as (
  select vec_id // 40 as stream, vec_id % 40 as r, block from eb where vec_id // 40 in (select vec_id // 40 from eb group by 1 having count(*) = 40)
), pan as (
  select stream, t as frame, cast(r - 2 * t as bigint) as y, x, case when t % 2 = 0 then block[x + (5 * t) // 2 + 1] else (block[x + (5 * t) // 2 + 1] + block[x + (5 * t) // 2 + 2] + 1) >> 1 end as v
  from strips, range(5) f(t), range({SIDE}) c(x) where r - 2 * t between 0 and {SIDE - 1}
)"""


def pan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compensation.pairs(rasters.pan_frames(spark, sf_dir, SIDE))


CLAMPED = f"greatest(0, least({SIDE - 1}, %s))"
TAPS_SQL = f"taps as (select {compensation.TAPS.tolist()} as taps)"


@query(f"""with {PAN_SQL}, {TAPS_SQL}, planes as (select stream, frame + 1 as frame, list(v order by y, x) as p from pan group by 1, 2), b as (
  select stream, frame, p, taps, 8 * by_ as y0, 8 * bx_ as x0, (21 * by_ + 8 * bx_) % 49 - 24 as mr, (8 * by_ + 24 * bx_ + 5) % 49 - 24 as mc from planes, taps, range(4) r(by_), range(4) c(bx_) where frame < 5
), l as (
  select stream, frame, taps, y0, x0, mr, j, list_transform(range(-3, 12), lambda i: (cast(list_sum(list_transform(range(8), lambda k:
    taps[(mc & 7) * 2 + 1][k + 1] * p[{SIDE} * {CLAMPED % "y0 + (mr >> 3) + i"} + {CLAMPED % "x0 + (mc >> 3) + j + k - 3"} + 1])) as bigint) + 4) >> 3) as half from b, range(8) q(j)
) select stream, frame, cast(y0 + i as integer) as y, cast(x0 + j as integer) as x,
  cast(greatest(0, least(255, (cast(list_sum(list_transform(range(8), lambda k: taps[(mr & 7) * 2 + 1][k + 1] * half[i + k + 1])) as bigint) + 1024) >> 11)) as integer) as predicted from l, range(8) r(i)""")
def motion_compensated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 8x8 block of a frame, predicted from the frame before by a vector of eighths of a sample that its place decides."""

    def vectors(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        by, bx = y // 8, x // 8
        return np.stack([(21 * by + 8 * bx) % 49 - 24, (8 * by + 24 * bx + 5) % 49 - 24], 1)

    return compensation.compensated(pan_pairs(spark, sf_dir), SIDE, SIDE, vectors)


@query()
def subpel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector (eighths of a sample) and cost of every 8x8 block of every frame; tested against a plain search."""
    return compensation.search(pan_pairs(spark, sf_dir), SIDE, SIDE)


@query()
def global_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole shift of every frame by three levels of resolution; tested against a plain search."""
    return compensation.global_motion(pan_pairs(spark, sf_dir), SIDE, SIDE)


@query(f"""with {PAN_SQL}, shifts as (
  select a.stream, a.frame, dy, dx, floor(sum(abs(a.v - b.v)) * 1000000.0 / count(*)) as cost from pan a, range(-4, 5) r(dy), range(-4, 5) c(dx), pan b
  where b.stream = a.stream and b.frame = a.frame - 1 and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3, 4
), r as (select *, row_number() over (partition by stream, frame order by cost, dy, dx) as k from shifts)
select stream, frame, cast(dy as integer) as dy, cast(dx as integer) as dx, cast(cost as bigint) as cost from r where k = 1""")
def best_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all whole shifts of a frame by up to four samples: what the pyramid's search approximates, exhaustively."""
    return compensation.best_shift(pan_pairs(spark, sf_dir), SIDE, SIDE, 4)
