"""Operator 12: exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every row gets a print: its address (file and row in it) and the SHA-256 of its text. Fingerprints are the first
   bits of it, SPARE_BITS more than the number of rows needs, so about one row in 2^SPARE_BITS is suspected for nothing.
2. Partitions of the prints send each owner (a range of fingerprints) the sorted distinct fingerprints that they hold
   of it, as Golomb-coded gaps (fragments). Of a group of copies an owner gets one fingerprint from each fragment.
3. Owners return a bitmap for each fragment that holds a fingerprint which another holds too. A row is suspect by its
   bit, or because its fragment holds its fingerprint twice.
4. Only suspects' texts are shuffled, and grouped by their bytes (with partial groups before the shuffle, so a group of
   copies of any size is one row from each task). Suspects then look their group up by SHA-256; two texts of one SHA-256
   would be an error, not a group.

Bitmaps (one bit for a row at most) are broadcast while they are counted to be under BROADCAST_BYTES, about two billion
rows; beyond that the same joins are shuffled, by fragment and by address. Groups with over a ten-thousandth of all rows
(ten thousand at most) are broadcast to their suspects, the others are shuffled. Nothing is collected but counts.

Addresses have to hold when a table is read again. A table that is read from files, as it stands, has such addresses
(in_files); any other is written to the shared folder first.

Defined results: a null text is empty, and empty texts are copies of each other. Of equal texts the row of the largest
doc_id stays, null ids being the smallest; of rows that share that id too, one stays. Texts are compared whole, however
long they are. An empty table gives no rows. Further columns are ignored or, in without_copies(), carried along.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import free_names, heavy_and_light, written

#: Bits of a fingerprint beyond those that number the rows.
SPARE_BITS = 10
#: Fingerprints that an owner decides on about, the fewest owners (as a power of two), and rows of a fragment at most.
OWNER_HASHES, LEAST_OWNERS, FRAGMENT_ROWS = 1 << 22, 6, 1 << 19
#: Bitmaps of more bytes are joined by shuffle.
BROADCAST_BYTES = 256 << 20
SENT = "fragment long, owner int, n int, code binary, row long, doc_id long, file string, file_row long, sha binary, rank int, again boolean"


def encode(values: np.ndarray) -> bytes:
    """Golomb code (its divisor a power of two) of ascending distinct numbers: divisor, quotients in unary, remainders."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(math.log2(max(1.0, 0.69 * (int(values[-1]) + 1) / len(values)))))
    ones = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    unary = np.packbits(unary).tobytes()
    rest = np.packbits(((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()).tobytes()
    return struct.pack(">BI", k, len(unary)) + unary + rest


def decode(code: bytes, n: int) -> np.ndarray:
    """The n numbers of a code."""
    k, size = struct.unpack_from(">BI", code)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 5)))
    rest = np.unpackbits(np.frombuffer(code, np.uint8, -1, 5 + size))[: n * k].reshape(n, k).astype(np.int64)
    gaps = ((np.diff(ones, prepend=-1) - 1) << k) + rest @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def messages(prints: np.ndarray, owner_bits: int, bits: int) -> tuple[list[tuple[int, int, bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Of a fragment's fingerprints: (owner, n, code) for each owner; each row's owner, rank in its message, and whether it repeats."""
    distinct, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
    owners = distinct >> (bits - owner_bits)
    first = np.searchsorted(owners, owners)  # where the owner's fingerprints begin
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    sent = []
    for a, b in zip(starts, [*starts[1:], len(owners)], strict=True):
        low = distinct[a:b] & ((1 << (bits - owner_bits)) - 1)
        sent.append((int(owners[a]), int(b - a), encode(low)))
    return sent, owners[inverse], (np.arange(len(distinct)) - first)[inverse], (count > 1)[inverse]


def duplicate_bitmaps(codes: list[tuple[int, bytes]]) -> list[bytes | None]:
    """For each message (n, code) of an owner: the bitmap of what another message holds too; None if there is nothing."""
    values = [decode(code, n) for n, code in codes]
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    marks = np.zeros(len(every), bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    at, out = 0, []
    for v in values:
        mine = marks[at : at + len(v)]
        out.append(np.packbits(mine, bitorder="little").tobytes() if mine.any() else None)
        at += len(v)
    return out


def exchanged(prints: DataFrame, rows: int) -> DataFrame:
    """prints (doc_id, file, file_row, sha) as SENT: the rows, and beside them the messages (those with a code)."""
    bits = min(62, max(1, rows).bit_length() + SPARE_BITS)
    owner_bits = min(bits, max(LEAST_OWNERS, (rows // OWNER_HASHES).bit_length()))
    names = [x.split()[0] for x in SENT.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in SENT.split(", ")]

    def batch(size: int, /, **given: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], kind) if c in given else pa.nulls(size, kind) for c, kind in zip(names, kinds, strict=True)], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, count, k = TaskContext.get().partitionId(), [], 0, 0

        def fragment() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            n, number = t.num_rows, (part << 16) + k
            sha = np.frombuffer(b"".join(t["sha"].to_pylist()), ">u8").reshape(n, 4)[:, 0]
            sent, owner, rank, again = messages((sha.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), owner_bits, bits)
            for at in range(0, len(sent), 1024):
                some = sent[at : at + 1024]
                yield batch(len(some), fragment=[number] * len(some), owner=[m[0] for m in some], n=[m[1] for m in some], code=[m[2] for m in some])
            for at in range(0, n, 10_000):
                to, own = min(n, at + 10_000), t.slice(at, 10_000)
                columns = {c: own[c].combine_chunks() for c in ("doc_id", "file", "file_row", "sha")}
                yield batch(to - at, fragment=[number] * (to - at), owner=owner[at:to], row=(number << 20) + np.arange(at, to), rank=rank[at:to], again=again[at:to], **columns)

        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= FRAGMENT_ROWS:
                yield from fragment()
                held, count, k = [], 0, k + 1
        if count:
            yield from fragment()

    return prints.select("doc_id", "file", "file_row", "sha").mapInArrow(send, SENT)


def answered(sent: DataFrame) -> DataFrame:
    """(fragment, owner, bitmap): what the owners return."""

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bitmaps = duplicate_bitmaps(list(zip(group["n"].to_pylist(), group["code"].to_pylist(), strict=True)))
        told = [i for i, x in enumerate(bitmaps) if x]
        return pa.table({"fragment": group["fragment"].combine_chunks().take(pa.array(told, pa.int64())), "owner": pa.array([key[0].as_py()] * len(told), pa.int32()), "bitmap": pa.array([bitmaps[i] for i in told], pa.binary())})

    return sent.where("code is not null").select("fragment", "owner", "n", "code").groupBy("owner").applyInArrow(answer, "fragment long, owner int, bitmap binary")


def bit(bitmap: Column, at: Column) -> Column:
    """Whether that bit of a bitmap is set; null if there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0


def fits(bitmaps: DataFrame) -> bool:
    """Whether the (written) bitmaps may be broadcast."""
    return (bitmaps.agg(F.sum(F.octet_length("bitmap") + 64)).first()[0] or 0) <= BROADCAST_BYTES


def addressed(docs: DataFrame, in_files: bool, *columns: Column) -> DataFrame:
    """Those columns, with file and file_row."""
    return (docs if in_files else written(docs, "docs")).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"))


def picked(docs: DataFrame, places: DataFrame, on: tuple[str, str] = ("file", "file_row"), keep: bool = True) -> DataFrame:
    """The rows of docs whose address is in the (written) places (file, file_row), or with keep=False the others.

    Places become bitmaps of 32,768 rows each, and docs aren't shuffled, while those are small.
    """
    bucket, bitmap, hit = free_names(docs, "bucket", "bitmap", "hit")
    number = F.col("file_row") + 1
    bitmaps = written(places.groupBy("file", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")), "bitmaps")
    if fits(bitmaps):
        of = bitmaps.select(F.col("file").alias(on[0]), F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
        at = F.col(on[1]) + 1
        found = docs.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(of), [on[0], bucket], "inner" if keep else "left")
        chosen = F.coalesce(bit(F.col(bitmap), F.bitmap_bit_position(at)), F.lit(False))
        return found.where(chosen if keep else ~chosen).select(*docs.columns)
    return docs.join(places.select(F.col("file").alias(on[0]), F.col("file_row").alias(on[1])), list(on), "left_semi" if keep else "left_anti").select(*docs.columns)


def _resolved(docs: DataFrame, in_files: bool, normal: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with their group: (doc_id, keep_id, group_size, kept, sha, file, file_row), those without copies and those with."""
    text = normal(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = addressed(docs, in_files, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    prints = written(texts.select("doc_id", "file", "file_row", F.unhex(F.sha2(F.col("text"), 256)).alias("sha")), "prints")
    total = prints.count()
    sent = written(exchanged(prints, total), "sent")
    bitmaps = written(answered(sent), "answers")
    rows = sent.where("code is null").drop("code", "n")
    told = F.broadcast(bitmaps) if fits(bitmaps) else bitmaps
    rows = rows.join(told, ["fragment", "owner"], "left").withColumn("suspect", F.col("again") | F.coalesce(bit(F.col("bitmap"), F.col("rank")), F.lit(False)))
    rows = rows.select("row", "doc_id", "file", "file_row", "sha", "suspect")
    suspects = written(rows.where("suspect").drop("suspect"), "suspects")
    # equal bytes are a group
    same = picked(texts, suspects).groupBy("text").agg(F.count(F.lit(1)).alias("group_size"))
    same = same.where("group_size > 1").select(F.unhex(F.sha2(F.col("text"), 256)).alias("sha"), "group_size")
    clash = F.raise_error(F.lit("two texts have one SHA-256")).cast("long")
    same = same.groupBy("sha").agg(F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.max("group_size")).alias("group_size"))
    first = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("best")).select("sha", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_row"))
    groups = written(same.join(first, "sha"), "groups")
    joined = heavy_and_light(suspects, groups, "sha", F.col("group_size"), total)
    alone = rows.where("not suspect").unionByName(joined.where("group_size is null").select(*rows.columns[:-1]).withColumn("suspect", F.lit(False)))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "file", "file_row")
    copies = joined.where("group_size is not null").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "file", "file_row")
    return alone, copies


def exact_groups(docs: DataFrame, in_files: bool = False, normal: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    normal: what is done to texts (columns) before they are compared. in_files: docs is read from files, as it stands.
    """
    alone, copies = _resolved(docs, in_files, normal)
    return alone.unionByName(copies).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, normal: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = written(docs, "docs")
    _, copies = _resolved(docs, True, normal)
    gone = written(copies.where("not kept").select("file", "file_row"), "gone")
    file, file_row = free_names(docs, "file", "file_row")
    return picked(docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(file_row)), gone, (file, file_row), keep=False).select(*docs.columns)
