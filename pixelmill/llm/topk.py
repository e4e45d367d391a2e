"""Operator 5: exact top-k search by distributed histogram selection.

Vectors are quantised to integers and packed into blocks, candidates by the tasks that read them. Each round scores
all pairs of a query block and a candidate block and adds up, for every query, a histogram of scores over the interval that still holds its k-th
value; the bin of the k-th value is the next interval, until it is a single value. A last pass keeps what scores at
least that much; ties go to the smaller vec_id. A block reports only its bins down to its own k-th score, since the
k-th score of all candidates is never below that of a block, and passes on at most k rows of a query.

Candidates are never shuffled: query blocks go to them, broadcast in groups of about GROUP_BYTES (a join each, so more
queries mean more joins and no larger ones), and a task holds one block of each at a time. What is shuffled grows with
the queries and their histograms.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; a query compares
with vectors of its own length only; of rows that share a vec_id, one query (the largest vector) and all candidates
take part, but none of a query's own vec_id; scores of more than 62 bits are clamped to those; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, written

CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 512
#: Bytes of the query blocks that are broadcast at once, about, and of the candidates that a task packs at once.
GROUP_BYTES, PACKED_BYTES = 128 << 20, 64 << 20
BINS = 4096
#: Scores are clamped to these, so that differences of scores fit a long too.
LONG = (-(1 << 62), (1 << 62) - 1)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, dim, x): floor(scale * component), as float64 bytes (whole numbers)."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [x if x is None else np.floor(np.array([np.nan if v is None else v for v in x], np.float64) * scale) for x in b["embedding"].to_pylist()]
            keep = [i for i, x in enumerate(rows) if x is not None and len(x) and np.isfinite(x).all()]
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(keep, pa.int64())), pa.array([len(rows[i]) for i in keep], pa.int32()), pa.array([rows[i].tobytes() for i in keep], pa.binary())], ["vec_id", "dim", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").mapInArrow(floor, "vec_id long, dim int, x binary")


def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(dim, name, ids, xs): about size vectors of one length in a row, their ids and values as bytes."""
    counts = rows.groupBy("dim").count().select("dim", F.greatest(F.lit(1), F.ceil(F.col("count") / size)).alias("n"))

    def join(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        ids, xs = t["vec_id"].to_numpy()[order], t["x"].to_pylist()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int64()), f"{name}_ids": pa.array([ids.tobytes()], pa.binary()), f"{name}_xs": pa.array([b"".join(xs[i] for i in order)], pa.binary())})

    dealt = rows.join(counts, "dim").withColumn(name, F.pmod(F.xxhash64("vec_id", "x"), F.col("n"))).drop("n")
    return written(dealt.groupBy("dim", name).applyInArrow(join, f"dim int, {name} long, {name}_ids binary, {name}_xs binary"), name)


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, cb_ids, cb_xs): up to size vectors of one length in a row, packed where they are read; nothing is shuffled."""

    def row(dim: int, kept: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, xs = zip(*kept, strict=True)
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "cb_ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "cb_xs": pa.array([b"".join(xs)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        weight = 0
        for b in slices(batches):
            for dim, vec_id, x in zip(b["dim"].to_pylist(), b["vec_id"].to_pylist(), b["x"].to_pylist(), strict=True):
                own = held.setdefault(dim, [])
                own.append((vec_id, x))
                weight += len(x)
                if len(own) >= size or weight > PACKED_BYTES:  # the fullest goes, whatever the number of lengths
                    most = max(held, key=lambda d: d * len(held[d]))
                    done = held.pop(most)
                    weight -= sum(len(v) for _, v in done)
                    yield row(most, done)
        for dim, own in held.items():
            yield row(dim, own)

    return written(vectors.mapInArrow(run, "dim int, cb_ids binary, cb_xs binary"), "cb")


def dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in float64 where all sums are exact there, else in Python's integers, clamped to a long."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(q).dot(whole(c).T), *LONG).astype(np.int64)


def scored(ids: bytes, xs: bytes, cand_ids: bytes, cand_xs: bytes, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query of a block: its id, the candidates' ids and scores, its own id left out."""
    q_ids, c_ids = np.frombuffer(ids, np.int64), np.frombuffer(cand_ids, np.int64)
    q, c = np.frombuffer(xs).reshape(-1, dim), np.frombuffer(cand_xs).reshape(-1, dim)
    for at in range(0, len(q_ids), 64):
        for i, scores in enumerate(dot(q[at : at + 64], c), at):
            own = c_ids == q_ids[i]
            yield (q_ids[i], c_ids[~own], scores[~own]) if own.any() else (q_ids[i], c_ids, scores)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bins: int = BINS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, both tables being (vec_id, dim, x)."""
    q = blocks(queries.groupBy("vec_id").agg(F.max(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x"), "qb", query_block)
    c = packed(vectors, candidate_block)
    size = q.agg(F.sum(F.octet_length("qb_ids") + F.octet_length("qb_xs"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1

    def each(rows: DataFrame, one: Callable[..., list[tuple]], schema: str, stateless: bool = False) -> DataFrame:
        """one(query id, state of the query or None, candidate ids, scores) for all pairs of blocks; only queries with a state, unless stateless."""
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
                known = dict(zip(np.frombuffer(x["s_ids"], np.int64).tolist(), np.frombuffer(x["s_vals"], np.int64).reshape(-1, 3).tolist(), strict=True)) if "s_ids" in x else {}
                out: list[tuple] = []
                for query, ids, scores in scored(x["qb_ids"], x["qb_xs"], x["cb_ids"], x["cb_xs"], x["dim"]):
                    if stateless or int(query) in known:
                        out += one(int(query), known.get(int(query)), ids, scores)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)

        group = F.pmod(F.xxhash64("dim", "qb"), F.lit(groups))
        pairs = [c.join(F.broadcast(rows.where(group == g)), "dim") for g in range(groups)]
        return reduce(DataFrame.unionAll, [p.mapInArrow(run, schema) for p in pairs])

    def with_state(state: DataFrame) -> DataFrame:
        """The query blocks with the states (lo, width, span) of their queries, packed alike."""

        def gather(key: tuple, t: pa.Table) -> pa.Table:
            vals = np.stack([t[n].to_numpy() for n in ("lo", "width", "span")], 1)
            return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "qb": pa.array([key[1].as_py()], pa.int64()), "s_ids": pa.array([t["query_id"].to_numpy().tobytes()], pa.binary()), "s_vals": pa.array([vals.tobytes()], pa.binary())})

        stated = state.groupBy("dim", "qb").applyInArrow(gather, "dim int, qb long, s_ids binary, s_vals binary")
        return written(q.join(stated, ["dim", "qb"]), "stated")

    def top(scores: np.ndarray) -> np.ndarray:
        """Places of the scores from a block's own k-th upward."""
        return np.arange(len(scores)) if len(scores) <= k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])

    def bounds(query: int, _: None, ids: np.ndarray, scores: np.ndarray) -> list[tuple]:
        return [(query, int(scores.min()), int(scores.max()), len(scores))] if len(scores) else []

    def histogram(query: int, known: list[int], ids: np.ndarray, scores: np.ndarray) -> list[tuple]:
        lo, width, span = known
        s = scores[top(scores)]
        s = s[(s >= lo) & (s - lo < span)]
        found, n = np.unique((s - lo) // width, return_counts=True)
        return [(query, int(b), int(x)) for b, x in zip(found, n, strict=True)]

    def best(query: int, known: list[int], ids: np.ndarray, scores: np.ndarray) -> list[tuple]:
        keep = np.flatnonzero(scores >= known[0])
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
        return [(query, int(ids[i]), int(scores[i])) for i in keep]

    ranges = written(each(q, bounds, "query_id long, low long, high long, n long", stateless=True), "ranges")
    q_of = q.select("dim", "qb", F.explode(_ids_of("qb_ids")).alias("query_id"))
    all_of = ranges.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # a query of no more than k candidates takes them all: its interval is the lowest score
    width = F.when(F.col("n") <= k, F.lit(1)).otherwise(F.expr(f"(high - low) div {bins} + 1"))
    state = written(q_of.join(all_of, "query_id").select("dim", "qb", "query_id", F.col("low").alias("lo"), width.alias("width"), (F.col("high") - F.col("low") + 1).alias("span"), F.lit(0).cast("long").alias("above"), (F.col("n") <= k).alias("done")), "state")
    while not state.where("not done").isEmpty():
        open_ = state.where("not done")
        bars = each(with_state(open_), histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
        bars = bars.join(open_, "query_id").withColumn("upto", F.col("above") + F.sum("n").over(down)).where(F.col("upto") >= k)
        kth = bars.groupBy("query_id").agg(F.max(F.struct("bin", F.col("upto"), "n")).alias("b"))
        moved = open_.join(kth, "query_id").select("dim", "qb", "query_id", (F.col("lo") + F.col("b.bin") * F.col("width")).alias("lo"), F.col("width").alias("span"), (F.col("b.upto") - F.col("b.n")).alias("above"))
        moved = moved.select("dim", "qb", "query_id", "lo", F.expr(f"(span - 1) div {bins} + 1").alias("width"), "span", "above", (F.col("span") == 1).alias("done"))
        state = written(moved.unionByName(state.where("done")), "state")
    chosen = each(with_state(state), best, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of(column: str):  # noqa: ANN202
    @F.arrow_udf("array<long>")
    def read(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, np.int64) for x in packed.to_pylist()], pa.list_(pa.int64()))

    return read(F.col(column))
