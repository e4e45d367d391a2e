"""Files of nested boxes (ISO base media): every box by its place, walked by range reads, and the codec they hold.

A Python table function walks a file: it reads headers of 8 to 16 bytes, and the few bytes that say what an item or a
file is, never the data between. Files are rows, so a cluster walks them side by side.

Defined results: a box that isn't whole is a row with an error, and its siblings behind it aren't looked for, as nobody
can say where they begin; what encloses it goes on. Errors: "truncated header" (fewer bytes left than a header has),
"size below its header", "beyond its parent" (or beyond the file), "too deep" (more than DEEPEST levels; not entered).
Size 0 means to the end of what encloses the box. An empty file has no rows; a null path has none either.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Fixed values of the format: boxes that hold boxes, and how many bytes stand before the first of them.
HOLDERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"moof": 0, b"traf": 0, b"iprp": 0, b"ipco": 0, b"meta": 4, b"iinf": 6}
#: Brands of files, boxes of codec settings, and item types, by the kind of image.
HEVC_BRANDS, AV1_BRANDS, OPEN_BRANDS = ("heic", "heix", "hevc", "hevx", "MiHE"), ("avif", "avis", "MA1A", "MA1B"), ("mif1", "msf1", "miaf")
SETTINGS = {"hvcC": "heic", "av1C": "avif", "av2C": "av2", "vvcC": "vvc"}
ITEMS = {"hvc1": "heic", "hev1": "heic", "av01": "avif", "vvc1": "vvc", "vvi1": "vvc"}
#: Levels that are entered, and bytes of brands that are looked at.
DEEPEST, BRAND_BYTES = 8, 512

Read = Callable[[int, int], bytes]


def printable(kind: bytes) -> str:
    return "".join(chr(c) if 32 < c < 127 and c != 47 else "." for c in kind)


def about(kind: bytes, read: Read, start: int, end: int) -> str | None:
    """Brands of a file type box, joined by commas (the major one first), or the type of an item."""
    if kind == b"ftyp":
        data = read(start, min(end - start, BRAND_BYTES))
        return ",".join(printable(data[k : k + 4]) for k in (0, *range(8, len(data) - 3, 4)) if k + 4 <= len(data))
    if kind == b"infe":
        data = read(start, min(end - start, 16))
        at = {2: 8, 3: 10}.get(data[0] if data else None)
        return printable(data[at : at + 4]) if at and len(data) >= at + 4 else None
    return None


def walk(read: Read, size: int, deepest: int = DEEPEST) -> Iterator[tuple]:
    """(path, depth, offset, header, size, about, error) of each box in the order of the file; read(offset, length) gives bytes."""
    open_ = [(0, size, "")]  # what is still to be walked: from, to, path of what encloses it
    while open_:
        at, end, above = open_.pop()
        if at >= end:
            continue
        depth = above.count("/")
        head = read(at, min(16, end - at))
        if len(head) < 8:
            yield above, depth, at, len(head), end - at, None, "truncated header"
            continue
        length, kind = struct.unpack(">I4s", head[:8])
        path, header = f"{above}/{printable(kind)}", 8
        if length == 1:
            header = 16
            if len(head) < 16:
                yield path, depth, at, len(head), end - at, None, "truncated header"
                continue
            (length,) = struct.unpack(">Q", head[8:])
        elif length == 0:
            length = end - at
        error = "size below its header" if length < header else "beyond its parent" if at + length > end else None
        if error:
            yield path, depth, at, header, min(length, 2**63 - 1), None, error
            continue
        open_.append((at + length, end, above))
        skip = HOLDERS.get(kind)
        if kind == b"iinf" and length > header and read(at + header, 1) != b"\0":
            skip = 8  # later versions count in 32 bits
        inside = skip is not None and length > header + skip
        deep = inside and depth + 1 > deepest
        yield path, depth, at, header, length, about(kind, read, at + header, at + length), "too deep" if deep else None
        if inside and not deep:
            open_.append((at + header + skip, at + length, path))


@udtf(returnType="box string, depth int, offset long, header int, size long, about string, error string")
class WalkBoxes:
    """The boxes of the file at a path."""

    def eval(self, path: str | None) -> Iterator[tuple]:
        from pyarrow import fs

        if path is not None:
            files, inner = fs.FileSystem.from_uri(path)
            with files.open_input_file(inner) as f:
                yield from walk(lambda at, n: f.read_at(n, at), f.size())


def boxes(files: DataFrame) -> DataFrame:
    """The columns of files (path, ...) with a row for each box: box (its path), depth, offset, header, size, about, error."""
    return files.lateralJoin(WalkBoxes(F.col("path").outer()))


def first(what: Column, names: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for name, kind in names.items():
        found = F.when(what == name, kind).otherwise(found)
    return found


def kinds(walked: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, boxes, errors): avif, heic, av2, vvc or unknown, for each file of `boxes`.

    A major brand of HEVC decides at once, as does one that comes before any of AV1 behind an open brand at the front;
    else the first box of codec settings, or item of a known type, in the order of the file.
    """
    brand = F.split("about", ",")
    known = F.filter(brand, lambda b: b.isin(*HEVC_BRANDS, *AV1_BRANDS))
    leads = (F.col("offset") == 0) & F.col("box").eqNullSafe("/ftyp")
    heic = leads & (brand[0].isin(*HEVC_BRANDS) | (brand[0].isin(*OPEN_BRANDS) & F.coalesce(F.get(known, F.lit(0)).isin(*HEVC_BRANDS), F.lit(False))))
    last = F.substring_index("box", "/", -1)
    held = F.coalesce(F.when(F.col("error").isNull(), first(last, SETTINGS)), F.when(last == "infe", first(F.col("about"), ITEMS)))
    branded = F.max(F.when(heic, "heic"))
    by_box = F.min(F.when(held.isNotNull(), F.struct("offset", held.alias("kind"))))["kind"]
    return walked.groupBy(*keys).agg(F.coalesce(branded, by_box, F.lit("unknown")).alias("kind"), F.count(F.lit(1)).alias("boxes"), F.count("error").alias("errors"))
