"""Operator 7: fuzzy line deduplication by MinHash.

Lines of all documents are collapsed to distinct lines first. Distinct lines get MinHash signatures over character
shingles, are banded so that pairs at the threshold meet with probability above 0.99, and pairs that meet are
confirmed by their exact Jaccard similarity; components follow by union-find (linking.py compares what meets in a
band without all pairs of a hot bucket). Of each component the first occurrence of a line, by (doc_id, line number),
stays.

Lines of fewer than min_words words are left alone; the query and the pipeline let every line that holds a word take
part. White space at a line's ends and runs
of spaces don't count, and A-Z are lower-cased.

Defined results: a null text has no lines and stays null; an empty text has one empty line, which doesn't take part;
identical rows are one document, so both keep the same lines; rows with one doc_id but different texts are told apart
by their texts; of ties the smaller text hash goes first; a null doc_id sorts first; an empty table gives no rows;
further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pixelmill.llm.common import BROADCAST_ROWS, free_names, slices, small, written
from pixelmill.llm.components import with_roots
from pixelmill.llm.linking import linked, packed, shared_keys, unpacked_all
from pixelmill.llm.minhash import mixed, permutations

BANDS = 10
ROWS = 4
#: Characters (bytes) of a shingle, 8 at most, where a caller names none.
CHARS = 8
MIN_WORDS = 5
PERCENT = 80
#: Lines of a batch of sketches, at most.
SKETCHED = 1 << 20
#: First bits of keys by which those are left out that no other line has.
MAP_BITS = 23
#: How the query and the pipeline call this: every line that holds a word takes part, and at 5 bytes near copies of
#: short lines are linked too. Lines share many short shingles by chance; longer bands keep such pairs from meeting, and
#: so many of them meet a pair at 0.8 with probability 0.9958.
FINE = {"chars": 5, "min_words": 1, "bands": 18, "rows": 6}


def windows(data: bytes, chars: int) -> np.ndarray:
    """The bytes from every position on, chars of them, as one number each."""
    x = np.ndarray(max(0, len(data) - chars + 1), "<u8", data + bytes(8 - chars), strides=1)  # of eight bytes each, which overlap
    return x & np.uint64((1 << 8 * chars) - 1)


def char_shingles(line: bytes, chars: int) -> np.ndarray:
    """Sorted distinct shingles; one, the line itself, where it is no longer."""
    x = np.sort(windows(line.ljust(chars, b"\0"), chars))
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def line_hashes(lines: bytes, stops: np.ndarray, chars: int) -> np.ndarray:
    """32-bit hashes of the shingles that begin at the bytes of joined lines, which end at the stops.

    Where a line ends before a shingle does, its last whole shingle stands instead, which changes no set.
    """
    factor = np.uint64((0x9E3779B97F4A7C15 << 8 * (8 - chars)) % (1 << 64))  # what follows a shingle in its eight bytes is shifted out
    x = ((np.ndarray(len(lines), "<u8", lines + bytes(7), strides=1) * factor) >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    for k in range(1, chars):
        x[stops - k] = x[stops - chars]
    return x


def line_signatures(lines: list[bytes], count: int, chars: int, part: int = 1 << 16) -> np.ndarray:
    """MinHash signatures, a column for each line: extremes over its stretch of the joined shingles, in parts that stay in a cache.

    An order of hashes gives four extremes, the least and the greatest as unsigned and as signed numbers: the next ones
    around the circle of numbers from two points of it, either way. Each is any shingle with the same chance, so two lines
    agree with the chance of their similarity, as with four orders; rows that follow each other are of different orders.
    """
    out = np.empty((count, len(lines)), np.uint32)
    if not lines:
        return out
    padded = [x.ljust(chars, b"\0") for x in lines]
    sizes = np.array([len(x) for x in padded])
    ends = np.cumsum(sizes)
    orders = -(-count // 4)
    a, b = permutations(orders)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + part)))
        stops = np.cumsum(sizes[at:to])
        x = line_hashes(b"".join(padded[at:to]), stops, chars)
        cuts, y = stops - sizes[at:to], np.empty_like(x)
        ways = [(least, y.view(kind), out.view(kind)) for kind in (np.uint32, np.int32) for least in (np.minimum, np.maximum)]
        for k in range(orders):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            for row, (extreme, values, found) in zip(range(k, count, orders), ways):
                extreme.reduceat(values, cuts, out=found[row, at:to])
        at = to
    return out


def band_keys(lines: list[bytes], chars: int, bands: int, rows: int) -> np.ndarray:
    """A row of keys for each line; of a band's rows no two are of one order."""
    orders = max(rows, -(-bands * rows // 4))
    sig = line_signatures(lines, 4 * orders, chars)[: bands * rows]
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for k in range(rows):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + sig[k::rows]
    return mixed(keys).T


def eligible(data: bytes | None, min_words: int) -> Iterator[tuple[int, bytes]]:
    """Numbers and normal forms of a text's lines that take part."""
    data = (data or b"").lower()
    odd = any(x in data for x in (b"\t", b"\r", b"\v", b"\f", b"  "))
    for no, line in enumerate(data.split(b"\n")):
        if odd or line and (line[0] == 32 or line[-1] == 32):
            line = b" ".join(line.split())
        # one space stands between two words now, and none elsewhere
        if min_words <= (1 if line else 0) or line and line.count(b" ") + 1 >= min_words:
            yield no, line


def sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(docs).alias("version"), F.col("text").cast("string").alias("text"))


def places(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, line_no, line_id) of the lines that take part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            numbers, ids, ends = [], [], [0]
            for data in b["text"].cast(pa.binary()).to_pylist():
                for no, x in eligible(data, min_words):
                    numbers.append(no)
                    ids.append(xxhash.xxh3_128_digest(x))
                ends.append(len(ids))
            at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["version"].take(at), pa.array(numbers, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "version", "line_no", "line_id"])

    return sources(docs).mapInArrow(read, "doc_id long, version long, line_no int, line_id binary")


def sketches(docs: DataFrame, min_words: int, chars: int, bands: int, rows: int) -> DataFrame:
    """(line_id, doc_id, version, line_no, times, keys) of each batch's distinct lines, with the first place and the number of places.

    keys: a line's bands, packed as 64-bit numbers; one value is carried, written and read much cheaper than an array.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            first, times = {}, {}
            docs_, versions = b["doc_id"].to_pylist(), b["version"].to_pylist()
            order = lambda p: (docs_[p[0]] is not None, docs_[p[0]] or 0, versions[p[0]] is not None, versions[p[0]] or 0, p[1])
            for i, data in enumerate(b["text"].cast(pa.binary()).to_pylist()):
                for no, line in eligible(data, min_words):
                    times[line] = times.get(line, 0) + 1
                    if line not in first or order((i, no)) < order(first[line]):
                        first[line] = (i, no)
            keys = band_keys(list(first), chars, bands, rows)
            at = pa.array([i for i, _ in first.values()], pa.int64())
            parts = [pa.array([xxhash.xxh3_128_digest(x) for x in first], pa.binary()), b["doc_id"].take(at), b["version"].take(at), pa.array([no for _, no in first.values()], pa.int32()), pa.array(times.values(), pa.int64())]
            for k in range(0, len(first), SKETCHED):  # an Arrow array of bytes ends at 2 GB
                yield pa.RecordBatch.from_arrays([*(x.slice(k, SKETCHED) for x in parts), packed(keys[k : k + SKETCHED])], ["line_id", "doc_id", "version", "line_no", "times", "keys"])

    return sources(docs).mapInArrow(sketch, "line_id binary, doc_id long, version long, line_no int, times long, keys binary")


def shared(distinct: DataFrame, keys: DataFrame) -> DataFrame:
    """(v, key, df) of the lines (v, keys) and those of their keys that are in the (written) table (key, df).

    Most keys stand once and are left out where they are unpacked, by a map of the first bits of those in the table, if
    these are few enough to be broadcast; the join decides.
    """
    bits = None
    if keys.count() <= BROADCAST_ROWS:
        map_ = np.zeros(1 << MAP_BITS, bool)
        map_[keys.select("key").toArrow()["key"].to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)] = True
        bits = distinct.sparkSession.sparkContext.broadcast(np.packbits(map_).tobytes())

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_ = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        for b in slices(batches, SKETCHED // 16):
            found = unpacked_all(b["keys"])
            vs = np.repeat(b["v"].to_numpy(), len(found) // b.num_rows)
            if map_ is not None:
                some = map_[found >> np.uint64(64 - MAP_BITS)]
                vs, found = vs[some], found[some]
            yield pa.RecordBatch.from_arrays([pa.array(vs), pa.array(found.view(np.int64))], ["v", "key"])

    return distinct.select("v", "keys").mapInArrow(posted, "v long, key long").join(keys, "key")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, line) of the wanted lines, a written table of (v, line_id) and one place (doc_id, version, line_no) each.

    Lines are read where they stand: texts without a wanted line aren't split, and only wanted ones come back. Ids
    are compared, should two texts of one doc_id have one version.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            vs, lines = [], []
            places = zip(*(x.to_pylist() for x in b["places"].flatten().flatten()), strict=True)
            for data, n in zip(b["text"].cast(pa.binary()).to_pylist(), pc.list_value_length(b["places"]).to_pylist(), strict=True):
                own = (data or b"").lower().split(b"\n")
                for no, line_id, v in islice(places, n):
                    line = b" ".join(own[no].split()) if no < len(own) else b""
                    if xxhash.xxh3_128_digest(line) == line_id:
                        vs.append(v)
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(lines, pa.binary())], ["v", "line"])

    at_doc, at_version = F.col("at_doc"), F.col("at_version")
    by_doc = wanted.groupBy(F.col("doc_id").alias("at_doc"), F.col("version").alias("at_version")).agg(F.collect_list(F.struct("line_no", "line_id", "v")).alias("places"))
    if wanted.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    texts = sources(docs).join(by_doc, F.col("doc_id").eqNullSafe(at_doc) & (F.col("version") == at_version)).select("text", "places")
    # dealt out first, since lines come twice only where rows do
    return texts.mapInArrow(read, "v long, line binary").repartition("v").groupBy("v").agg(F.first("line").alias("line"))


def version(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def confirmed(pairs: DataFrame, lines: DataFrame, chars: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines' exact Jaccard similarity reaches the threshold; lines: (v, line)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep, sets = [], {}
            for pair in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                for line in pair:
                    if line not in sets:
                        sets[line] = char_shingles(line, chars)
                x, y = map(sets.__getitem__, pair)
                least = percent * (len(x) + len(y))  # they share s: 100 s >= percent (|x| + |y| - s)
                keep.append(min(len(x), len(y)) * (100 + percent) >= least and len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= least)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("v"))
    if ends.count() <= BROADCAST_ROWS:  # else most lines are wanted, or a filter would be a shuffle of its own
        lines = lines.join(F.broadcast(ends), "v", "left_semi")
    both = pairs.join(lines.toDF("a", "x"), "a").join(lines.toDF("b", "y"), "b")
    return both.mapInArrow(compare, "a long, b long")


def line_components(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, chars: int = CHARS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, version, line_no, line_id, kept_doc_id, kept_line_no, kept) of every line that takes part.

    kept_*: the occurrence that stays for the line's component.
    """
    place = F.struct("doc_id", "version", "line_no")
    # dealt out first: nearly all lines of a task are distinct already, so sums before the shuffle would only be a sort more
    distinct = sketches(docs, min_words, chars, bands, rows).repartition("line_id").groupBy("line_id").agg(F.min(place).alias("first"), F.sum("times").alias("times"), F.first("keys").alias("keys"))
    distinct = written(distinct.withColumn("v", F.monotonically_increasing_id()), "distinct")  # short numbers, fixed by the written table
    common = small(written(shared_keys(distinct, "keys", total=distinct.count() * bands), "shared"))
    met = shared(distinct, common).groupBy("v").agg(F.collect_list("key").alias("keys"), F.sum(F.log2("df")).alias("w"))
    met = written(met, "met")  # a row for each line that shares a key, of at most its bands' keys
    postings = met.select(F.explode("keys").alias("key"), "v", F.lit(0).alias("n"), "w")
    wanted = written(distinct.select("v", "line_id", "first.*").join(met.select("v").hint("shuffle_hash"), "v", "left_semi"), "wanted")
    lines = written(line_texts(docs, wanted), "lines")
    comps = written(with_roots(linked(postings, lambda pairs: confirmed(pairs, lines, chars, percent), lambda wanted: lines.join(small(wanted), "v", "left_semi").withColumnRenamed("line", "s"), percent, sized=False, unpack=lambda line: char_shingles(line, chars), swell=8)), "linked")
    # only lines that stand more than once, or are linked, can give way to another
    of = distinct.select("line_id", "first", "times", "v").join(small(comps), "v", "left").where("times > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "v"))
    of = written(of, "components")
    best = of.join(small(written(of.groupBy("comp").agg(F.min("first").alias("kept_at")), "first")), "comp").select("line_id", "kept_at")
    found = places(docs, min_words).join(written(best, "best").hint("shuffle_hash"), "line_id", "left").withColumn("kept_at", F.coalesce("kept_at", place))
    return found.select("doc_id", "version", "line_no", "line_id", F.col("kept_at.doc_id").alias("kept_doc_id"), F.col("kept_at.line_no").alias("kept_line_no"), place.eqNullSafe(F.col("kept_at")).alias("kept"))


@F.arrow_udf(StringType())
def lines_left(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of those numbers, in one pass over each; null where either is."""
    out = []
    for text, numbers in zip(texts, gone, strict=True):
        if text.is_valid and numbers.is_valid:
            drop = set(numbers.as_py())
            out.append("\n".join(line for no, line in enumerate(text.as_py().split("\n")) if no not in drop))
        else:
            out.append(None)
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, **how: int) -> DataFrame:
    """The documents with the lines taken out that repeat an earlier one; n_chars, if there, is set anew.

    Documents that lose all lines that hold a word are dropped; those that had none to begin with stay as they are.
    """
    gone_doc, gone_version, gone, new = free_names(docs, "gone_doc", "gone_version", "gone", "new_text")
    lost = line_components(docs, **how).where("not kept").groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone"))
    lost = written(lost, "gone").toDF(gone_doc, gone_version, gone)
    hit = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_doc)) & (version(docs) == F.col(gone_version)), "left")
    # as if by chance, else the filter would be pushed below and the function called twice, in two workers of a task
    kept = lines_left.asNondeterministic()(F.when(F.col(gone).isNotNull(), F.col("text").cast("string")), F.col(gone))
    out = hit.withColumn(new, F.when(F.col(gone).isNull(), F.col("text").cast("string")).otherwise(kept))
    out = out.where(F.col(gone).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col(new).alias("text") if c == "text" else F.length(new).cast(kind).alias("n_chars") if c == "n_chars" else F.col(c) for c, kind in docs.dtypes]
    return out.select(columns)
