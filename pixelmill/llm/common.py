"""What the operators share: the shared work folder, written intermediates, slices of Arrow batches, free names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that Python works on at once; one row may be longer.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20
#: A side of a join with at most this many rows of a few bytes each is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns beside a caller's: as wanted, with underscores in front where the caller has them."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (k * "_" + name for k in range(len(taken) + 1)) if x.lower() not in taken) for name in wanted]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and about so many bytes where one row isn't more.

    Spark bounds a batch by bytes too (64 MB and a row, by default), whatever the session's setting of rows.
    """
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n = n // 2
            yield b.slice(at, n)
            at += n
        b = None
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no batches


@cache
def own_dir(master: str) -> str:
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="pixelmill-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Without that setting there is no such folder: on one machine (a local master) a temporary one serves, on a cluster
    this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or own_dir(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (written) table with a broadcast hint if it is counted to be small; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def heavy_and_light(rows: DataFrame, groups: DataFrame, key: str, weight: Column, total: int, parts: int = 10_000) -> DataFrame:
    """rows, left-joined with the (written) groups by key; no task gets much more than total / parts rows of one key.

    weight: how many rows have a group's key. Groups of more than total / parts rows (so fewer than `parts`) are
    broadcast; the rows of all others are shuffled. A null key matches nothing and isn't shuffled.
    """
    (heavy,) = free_names(rows.join(groups.limit(0), key), "heavy")
    big = groups.where(weight * parts > total).withColumn(heavy, F.lit(True))
    found = rows.join(F.broadcast(big), key, "left")
    done = found.where(F.col(heavy).isNotNull() | F.col(key).isNull()).drop(heavy)
    rest = found.where(F.col(heavy).isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(rest.join(groups.where(weight * parts <= total), key, "left"))
