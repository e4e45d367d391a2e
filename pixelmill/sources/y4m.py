"""Y4M files as rows of frames: a table function finds the frames by range reads, then tasks of about SPLIT bytes read them.

Finding a frame takes the line before it and no sample, so a long file costs a read of MARK bytes a frame in one task,
while the samples are read by as many tasks as all files together need. Lost tasks read their ranges again.

Defined results: a file that breaks off or can't be read has its whole frames, then one row with an error and no planes:
"no header", "no size" (none above 0), "unknown chroma" (other than 8 bits of 4:2:0, 4:2:2, 4:4:4 or mono), "no frame
mark", "truncated frame". An empty file named to `frames` has the error "no header" (`read` has no row for it: Spark's listing
leaves empty files out); a file of a header only has no rows. Without a C token
chroma is 4:2:0, without an F token the rate is 30:1; of a token given twice the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: How far a header, and the line before a frame, may reach; bytes of frames that a task reads, and of an Arrow batch.
HEAD, MARK, SPLIT, BATCH = 4096, 256, 128 << 20, 32 << 20
#: What C tokens of 8 bits begin with, and those that mean deeper samples or alpha.
CHROMA, OTHERS = ("420", "422", "444", "mono"), ("p9", "p10", "p12", "p14", "p16", "alpha", "mono9", "mono10", "mono12", "mono16")

Read = Callable[[int, int], bytes]


def chroma_size(width: int, height: int, chroma: str) -> int:
    """Samples of one chroma plane."""
    wide = width if chroma == "444" else (width + 1) // 2
    high = (height + 1) // 2 if chroma == "420" else height
    return 0 if chroma == "mono" else wide * high


def places(read: Read, size: int) -> Iterator[tuple]:
    """(frame, offset, size, width, height, chroma, rate, error) of each frame; read(offset, length) gives bytes."""
    head, end, _ = read(0, min(HEAD, size)).partition(b"\n")
    tokens = head.decode("latin-1").split(" ")
    if tokens[0] != "YUV4MPEG2" or not end:
        yield None, None, None, None, None, None, None, "no header"
        return
    fields = {t[0]: t[1:] for t in tokens[1:] if t}
    width, height = (int(fields[k]) if fields.get(k, "").isdecimal() and len(fields[k]) < 10 else 0 for k in "WH")
    if width <= 0 or height <= 0:
        yield None, None, None, None, None, None, None, "no size"
        return
    name, rate = fields.get("C", "420"), fields.get("F", "30:1")
    chroma = next((k for k in CHROMA if name.startswith(k)), None)
    if chroma is None or any(name.endswith(k) for k in OTHERS):
        yield None, None, None, width, height, None, rate, "unknown chroma"
        return
    length, at, frame = width * height + 2 * chroma_size(width, height, chroma), len(head) + 1, 0
    while at < size:
        mark, end, _ = read(at, min(MARK, size - at)).partition(b"\n")
        start = at + len(mark) + 1
        error = "no frame mark" if not end or mark.split(b" ")[0] != b"FRAME" else "truncated frame" if start + length > size else None
        yield frame, start, length, width, height, chroma, rate, error
        if error:
            return
        at, frame = start + length, frame + 1


def parse(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(width, height, chroma, planes) of each frame of a file in memory; a broken file is a ValueError."""
    for _, at, length, width, height, chroma, _, error in places(lambda k, n: data[k : k + n], len(data)):
        if error:
            raise ValueError(error)
        yield width, height, chroma, data[at : at + length]


@udtf(returnType="frame long, offset long, size long, width int, height int, chroma string, rate string, error string")
class FindFrames:
    """The frames of the file at a path."""

    def eval(self, path: str | None) -> Iterator[tuple]:
        from pyarrow import fs

        if path is not None:
            files, inner = fs.FileSystem.from_uri(path)
            with files.open_input_file(inner) as f:
                yield from places(lambda at, n: f.read_at(n, at), f.size())


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found frames with their planes, in batches of at most BATCH bytes, or of one larger frame."""
    from pyarrow import fs

    def batch(rows: list[dict], planes: list[bytes | None], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema] + [pa.array(planes, pa.binary())], [*schema.names, "planes"])

    for b in batches:
        rows, planes, held, open_path, f = [], [], 0, None, None
        try:
            for row in sorted(b.to_pylist(), key=lambda r: (r["path"], r["offset"] or 0)):
                if row["path"] != open_path and row["error"] is None:
                    if f:
                        f.close()
                    files, inner = fs.FileSystem.from_uri(row["path"])
                    open_path, f = row["path"], files.open_input_file(inner)
                if held and held + (row["size"] or 0) > BATCH:
                    yield batch(rows, planes, b.schema)
                    rows, planes, held = [], [], 0
                data = None if row["error"] else f.read_at(row["size"], row["offset"])
                if data is not None and len(data) != row["size"]:
                    raise OSError(f"{row['path']} has changed while it was read")
                rows.append(row)
                planes.append(data)
                held += len(data or b"")
        finally:
            if f:
                f.close()
        if rows:
            yield batch(rows, planes, b.schema)


def frames(files: DataFrame, tasks: int) -> DataFrame:
    """(path, frame, width, height, chroma, rate, error, planes) of files (path); only places are shuffled, to so many tasks."""
    found = files.select("path").lateralJoin(FindFrames(F.col("path").outer())).repartition(tasks, "path", "frame")
    types = {"path": "string", "frame": "long", "offset": "long", "size": "long", "width": "int", "height": "int", "chroma": "string", "rate": "string", "error": "string"}
    read = found.select(*types).mapInArrow(fetched, ", ".join(f"{k} {t}" for k, t in types.items()) + ", planes binary")
    return read.drop("offset", "size")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all files at a path or pattern, in as many tasks as their bytes need."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    return frames(files, max(spark.sparkContext.defaultParallelism, -(-total // SPLIT)))


def plane(planes: Column, width: Column, height: Column, chroma: Column, which: int) -> Column:
    """Plane 0 (luma), 1 or 2 (chroma) of a frame's planes; chroma of mono frames is null."""
    wide = F.when(chroma == "444", width).otherwise(F.floor((width + 1) / 2))
    high = F.when(chroma == "420", F.floor((height + 1) / 2)).otherwise(height)
    size = (wide * high).cast("int")
    if which == 0:
        return F.substring(planes, F.lit(1), width * height)
    return F.when(chroma != "mono", F.substring(planes, width * height + 1 + size * (which - 1), size))
