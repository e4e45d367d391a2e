"""Components of a similarity graph from postings, without all pairs of a group.

Vertices are posted under keys such that vertices which have to be compared share a key. Only the components of the
true links matter, so within a key it is enough to find links that join what is not joined yet:

1. every key has a leader, its most central vertex (many others share its keys, as the text does that a group of near
   copies was made from). Each vertex is compared with the most central of its leaders: one pair for each vertex;
2. what isn't joined with the leader of one of its keys then is compared with that leader too; pairs are at most as
   many as postings. Components are taken of all links found;
3. in short keys that still hold several components, the vertices of different components are compared, but for the
   leader;
4. in long keys, the strays (the vertices outside the leader's component) are a query set that is held against all
   vertices of the leader, in blocks: a task has one block of strays and one of vertices, counts what their sets have
   in common from an inverted list of the block, and reports only links that join components. Two sets differ as
   their differences from the leader do, and these are short, so the lists are short too.

No pair of different components is left out, so no link is lost; pairs inside a component can't change the result. At
no step are the pairs of a group made as rows.

Defined results: no postings, or none that share a key, give no rows; a vertex may be posted under a key twice, and
may have several sets, each of which can link it; a vertex without a set is linked with nothing; null keys or vertices
are the caller's to leave out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, small, written
from pixelmill.llm.components import stars

#: Keys that a task holds at once, and about as many fall into a bucket, when keys are counted.
HELD_KEYS = 1 << 20
#: Vertices of a key that are compared pair by pair.
SHORT = 8
#: Bytes of sets, the leader's counted with each, that a block of step 4 holds about.
BLOCK_BYTES = 8 << 20


def unpacked(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint64)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of 64-bit numbers as one value of bytes each."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(8 * rows.shape[1])), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked_all(values: pa.Array) -> np.ndarray:
    """The unsigned 64-bit numbers of all lists, or of all packed values, one after the other, but for nulls."""
    if not pa.types.is_binary(values.type):
        return values.flatten().drop_null().to_numpy().view(np.uint64)
    values = values.drop_null()
    if not len(values):
        return np.empty(0, np.uint64)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def shared_keys(lists: DataFrame, keys: str, held: int = HELD_KEYS, total: int | None = None) -> DataFrame:
    """(key, df) of the keys that stand more than once in the lists, a (written) table's column of array<long> or packed ones.

    Keys are hashes, most of which stand once, so rows of one key and a count would be costly: every task sums up what
    it reads and sends a bucket's keys as one value, and so a hot key is one entry for each task. Null lists and keys count
    as none. total: about how many keys there are, where the caller knows that without reading them.
    """
    lists = lists.select(F.col(keys).alias("keys")).where("keys is not null")
    total = total if total is not None else lists.agg(F.sum(F.expr("octet_length(keys) div 8") if dict(lists.dtypes)["keys"] == "binary" else F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-total // held))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            parts.append(unpacked_all(b["keys"]))
            size += len(parts[-1])
            if size >= held:
                yield dealt(np.concatenate(parts))
                parts, size = [], 0
        if size:
            yield dealt(np.concatenate(parts))

    def dealt(found: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(found, return_counts=True)
        bucket = (found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = [*cuts[1:].tolist(), len(found)]
        each = [(found[i:j].tobytes(), counts[i:j].tobytes()) for i, j in zip(cuts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array([x for x, _ in each], pa.binary()), pa.array([x for _, x in each], pa.binary())], ["bucket", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b["keys"].to_pylist()]
            counts += [np.frombuffer(x, np.int64) for x in b["counts"].to_pylist()]
            size += sum(map(len, keys[-b.num_rows :]))
            if size >= 2 * held:
                keys, counts = map(list, zip(counted(np.concatenate(keys), np.concatenate(counts)), strict=True))
                size = 0  # of what came since
        found, df = counted(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(found[df > 1].view(np.int64)), pa.array(df[df > 1])], ["key", "df"])

    dealt_keys = lists.mapInArrow(deal, "bucket long, keys binary, counts binary")
    return dealt_keys.groupBy("bucket").applyInArrow(count, "key long, df long")


def pairs_of(ends: DataFrame) -> DataFrame:
    """(a, b), a < b, each once, of (v, leader)."""
    return ends.select(F.least("v", "leader").alias("a"), F.greatest("v", "leader").alias("b")).distinct()


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (v, leader, ...) with comp and leader_comp; what stars() doesn't name is a component of its own."""
    comps = small(comps)
    rows = rows.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    return rows.join(comps.toDF("leader", "leader_comp"), "leader", "left").withColumn("leader_comp", F.coalesce("leader_comp", "leader"))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components of links beside those found before, written."""
    return written(stars(comps.select(F.col("comp").alias("a"), F.col("v").alias("b")).unionAll(links.select("a", "b"))), "components")


def linked(postings: DataFrame, confirm: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], percent: int, sized: bool = True, unpack: Callable[[bytes], np.ndarray] = unpacked, swell: int = 1) -> DataFrame:
    """(v, comp) of the vertices with links but the roots, as stars() gives them; linked are those whose sets have a
    Jaccard similarity of percent or more.

    postings: (key, v, n, w), v long; n is the size of v's set, or anything where not sized, w how central it is. confirm: the true links
    among pairs (a, b), a < b. elements: the sets (v, s) of a table of v; unpack makes sorted unsigned 64-bit numbers of s, at
    most swell bytes for each byte of it.
    """
    like = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent if sized else F.lit(True)
    lead = postings.groupBy("key").agg(F.max(F.struct(F.round("w", 3).alias("w"), (-F.col("v")).alias("low"), "v", "n")).alias("hi"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lead = lead.select("key", "size", F.col("hi.v").alias("leader"), F.col("hi.n").alias("leader_n"), F.col("hi.w").alias("central"))
    near = written(postings.select("key", "v", "n").join(lead, "key"), "near")

    ends = near.where("v <> leader").where(like(F.col("n"), F.col("leader_n")))
    first = ends.groupBy("v").agg(F.max(F.struct("central", (-F.col("leader")).alias("low"), "leader")).alias("l")).select("v", "l.leader")
    tried = written(pairs_of(first), "pairs")
    comps = written(stars(written(confirm(tried), "links")), "components")
    others = pairs_of(with_components(ends.select("v", "leader").distinct(), comps).where("comp <> leader_comp"))
    comps = joined(comps, written(confirm(written(others.join(tried, ["a", "b"], "left_anti"), "pairs")), "links"))

    own = written(with_components(near.select("key", "size", "v", "n", "leader"), comps), "postings")
    mixed = small(written(own.where("comp <> leader_comp").select("key").distinct(), "mixed"))
    rest = written(own.join(mixed, "key", "left_semi").where("v <> leader"), "rest")  # with the leader, all have been compared that can be like it
    short = rest.where(F.col("size") <= SHORT)
    one = short.select("key", F.col("v").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"))
    pairs = one.join(short, "key").where("x_comp <> comp and x < v").where(like(F.col("x_n"), F.col("n"))).select(F.col("x").alias("a"), F.col("v").alias("b"))
    close = written(confirm(written(pairs.distinct(), "pairs")), "links")
    far = written(apart(rest.where(F.col("size") > SHORT).select("leader", "leader_comp", "v", "comp").distinct(), elements, percent, unpack=unpack, swell=swell), "links")
    return joined(comps, close.unionAll(far))


def apart(members: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int, block_bytes: int = BLOCK_BYTES, unpack: Callable[[bytes], np.ndarray] = unpacked, swell: int = 1) -> DataFrame:
    """True links (a, b) that join what can be joined of the members (leader, leader_comp, v, comp) of each leader.

    Strays, which aren't in the leader's component, are compared with all members of other components than their own.
    """
    members = written(members, "members")
    sets = written(elements(written(members.select(F.explode(F.array("leader", "v")).alias("v")).distinct(), "wanted")), "sets")
    size = sets.groupBy("v").agg(F.sum(F.octet_length("s") * swell).alias("bytes"))
    sizes = members.join(size, "v").join(size.toDF("leader", "leader_bytes"), "leader", "left")
    blocks = written(sizes.groupBy("leader").agg(F.ceil((F.sum("bytes") + F.count(F.lit(1)) * F.max(F.coalesce("leader_bytes", F.lit(0)))) / block_bytes).alias("blocks")), "blocks")
    dealt = members.join(small(blocks), "leader").select("leader", F.pmod(F.xxhash64("v"), "blocks").alias("block"), "blocks", "v", "comp", (F.col("comp") != F.col("leader_comp")).alias("stray"))
    leads = blocks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks", F.col("leader").alias("v"), F.lit(None).cast("long").alias("comp"), F.lit(False).alias("stray"))
    packed = written(dealt.unionAll(leads).join(sets, "v").groupBy("leader", "block", "blocks").applyInArrow(lambda key, rows: pack(key, rows, unpack), PACKED), "blocks")
    # a block of strays meets every block of its leader, each pair of blocks in a task of its own; the only block of a
    # leader meets itself, where it lies
    both = [*STRAYS, *PARTS]
    alone, several = packed.where("blocks = 1 and q_vs is not null").select(*both), packed.where("blocks > 1")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    queries = several.where("q_vs is not null").select("leader", F.col("block").alias("q"), numbers.alias("m"), *STRAYS)
    all_of = several.select("leader", numbers.alias("q"), F.col("block").alias("m"), *PARTS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found = [pair for r in b.to_pylist() for pair in joining(*([Block(r, p) for p in ("q_", "")]), percent)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return alone.unionAll(queries.join(all_of, ["leader", "q", "m"]).select(*both)).mapInArrow(compare, "a long, b long")


#: A block's vertices, their components, the sizes of their sets and of their differences from the leader's, and the latter.
PARTS = ("vs", "comps", "ns", "ds", "elements")
STRAYS = tuple(f"q_{c}" for c in PARTS)
PACKED = "leader long, block long, blocks long, " + ", ".join(f"{c} binary" for c in (*PARTS, *STRAYS))


def pack(key: tuple, rows: pa.Table, unpack: Callable[[bytes], np.ndarray]) -> pa.Table:
    """A block's members, and beside them those of them that are strays, if there are any; no row for a block without members."""
    leader = key[0].as_py()
    raw = rows["s"].to_pylist()
    sets = [unpack(s) for s in raw]
    vs, comps, stray = rows["v"].to_pylist(), rows["comp"].to_pylist(), rows["stray"].to_pylist()
    base = min((s for s, c in zip(raw, comps, strict=True) if c is None), default=None)  # any set serves that all blocks share
    base = np.empty(0, np.uint64) if base is None else unpack(base)
    members = [i for i in sorted(range(len(vs)), key=vs.__getitem__) if comps[i] is not None]
    row = [leader, key[1].as_py(), key[2].as_py()]
    for at in (members, [i for i in members if stray[i]]):
        if at:
            d = [np.setxor1d(sets[i], base, assume_unique=True) for i in at]
            parts = (np.array([vs[i] for i in at]), np.array([comps[i] for i in at]), np.array([len(sets[i]) for i in at]), np.array([len(x) for x in d]), np.concatenate(d))
            row += [p.tobytes() for p in parts]
        else:
            row += [None] * len(PARTS)
    kinds = (*[pa.int64()] * 3, *[pa.binary()] * (2 * len(PARTS)))
    return pa.table({c.split()[0]: pa.array([x] if members else [], kind) for c, x, kind in zip(PACKED.split(", "), row, kinds, strict=True)})


class Block:
    def __init__(self, row: dict, prefix: str) -> None:
        self.vs, self.comps, self.ns, self.ds = (np.frombuffer(row[prefix + c], np.int64) for c in PARTS[:4])
        self.elements = np.frombuffer(row[prefix + "elements"], np.uint64)


def joining(strays: Block, block: Block, percent: int) -> Iterator[tuple[int, int]]:
    """Links of strays with a block's vertices, each of which joins two components that the ones before left apart."""
    order = np.argsort(block.elements, kind="stable")
    values, owner = block.elements[order], np.repeat(np.arange(len(block.vs)), block.ds)[order]
    roots, codes = np.unique(np.concatenate([strays.comps, block.comps]), return_inverse=True)
    root = np.arange(len(roots))  # of each component
    own, theirs = codes[: len(strays.vs)], codes[len(strays.vs) :]
    ends = np.cumsum(strays.ds)
    for i, (x, c, end, d, n) in enumerate(zip(strays.vs.tolist(), own.tolist(), ends.tolist(), strays.ds.tolist(), strays.ns.tolist(), strict=True)):
        open_ = root[theirs] != root[c]
        if not open_.any():
            continue
        mine = strays.elements[end - d : end]
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        counts = high - low
        places = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
        apart_ = block.ds + d - 2 * np.bincount(owner[places], minlength=len(block.vs))  # elements that one of both sets has
        like = open_ & (100 * (block.ns + n - apart_) >= percent * (block.ns + n + apart_)) & (block.ns + n > apart_)
        while like.any():
            k = int(like.argmax())
            yield x, int(block.vs[k])
            root[root == root[theirs[k]]] = root[c]
            like &= root[theirs] != root[c]
