"""Queries of gain map parameters and of files of boxes: name to (plan, SQL)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import gain_maps
from pixelmill.plans.raster_queries import BLOCK_SQL, Plan
from pixelmill.plans.video_queries import PAN_SQL
from pixelmill.sources import boxes, rasters, shared, y4m

QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


FRACTION_SQL = """v as (
  select *, abs(cast(cast(x as float) as double)) as v, case when cast(x as float) < 0 then -1 else 1 end as side from given
), f as (
  select id, v, side, case when v <= 1 then 4294967295.0::double else floor(2147483647.0 / floor(v)) end as bound, 1.0::double as d, 0.0::double as before, v - floor(v) as rest, 0 as step from v
  union all
  select id, v, side, bound, before + floor(1 / rest) * d, d, 1 / rest - floor(1 / rest), step + 1 from f
  where step < 39 and d * v <> round(d * v) and rest > 0 and before + floor(1 / rest) * d <= bound
), last as (
  select id, side * cast(round(arg_max(d, step) * any_value(v)) as bigint) as n, cast(arg_max(d, step) as bigint) as d from f group by id, side
)"""


@query(f"with recursive given as (select o_orderkey as id, (o_totalprice - 200000) / 1e5 as x from orders), {FRACTION_SQL} select id, n, d from last")
def gain_map_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders, shifted and scaled, as fractions."""
    found = rasters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), gain_maps.fraction((F.col("o_totalprice") - 200000) / 1e5).alias("f"))
    return found.select("id", "f.n", "f.d")


#: Channels of a gain map by part: every third has three that differ, every eleventh a gamma of zero.
CHANNEL_EXPR = "array(-id - c, 1000, {size} + c, 7, if(id % 11 = 5, 0, 5 + c), 2, id % 64 - 32, 64, c, 128)"
WORDS_SQL = "[-id - c, 1000, size + c, 7, case when id % 11 = 5 then 0 else 5 + c end, 2, id % 64 - 32, 64, c, 128]"


@query(f"""with p as (select p_partkey as id, cast(p_size as bigint) as size, case when p_partkey % 3 = 0 then [0, 1, 2] else [0] end as cs from part where p_partkey is not null), w as (
  select id, cs, [id, 10, size + 1, 3] || flatten(list_transform(cs, lambda c: {WORDS_SQL})) as words from p
), h as (
  select id, words, '00000000' || case when len(cs) = 3 then 'C0' else '40' end || array_to_string(list_transform(words, lambda n: printf('%08X', n & 4294967295)), '') as made from w where id % 11 <> 5
  union all select id, words, null from w where id % 11 = 5
), b as (
  select id, words, made, case id % 5 when 1 then left(made, len(made) - 2) when 2 then made || '00' when 3 then '0001' || substr(made, 5) else made end as read from h
) select id, made, case when made is null then 'truncated' when id % 5 = 1 then 'truncated' when id % 5 = 2 then 'trailing bytes' when id % 5 = 3 then 'unsupported version' end as error,
  case when made is not null and id % 5 in (0, 4) then words[1] end as headroom, case when made is not null and id % 5 in (0, 4) then words[5] end as low, case when made is not null and id % 5 in (0, 4) then words[len(words) - 1] end as other_offset from b""")
def gain_map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary records of parameters made from parts, read back whole, cut, lengthened, and of another version."""
    size = "cast(p_size as bigint)"
    parts = rasters.table(spark, sf_dir, "part").where("p_partkey is not null").withColumnRenamed("p_partkey", "id")
    given = parts.select("id", F.expr(f"array(id, 10L, {size} + 1, 3L)").alias("headrooms"), F.expr(f"transform(if(id % 3 = 0, array(0L, 1L, 2L), array(0L, 0L, 0L)), c -> {CHANNEL_EXPR.format(size=size)})").alias("channels"))
    made = given.withColumn("record", gain_maps.record(F.col("headrooms"), F.col("channels"), F.lit(True)))
    damaged = F.expr("case id % 5 when 1 then substring(record, 1, octet_length(record) - 1) when 2 then concat(record, X'00') when 3 then concat(X'0001', substring(record, 3)) else record end")
    read = made.select("id", F.hex("record").alias("made"), gain_maps.parsed(damaged).alias("r"))
    return read.select("id", "made", "r.error", F.col("r.headrooms")[0].alias("headroom"), F.col("r.channels")[0][0].alias("low"), F.col("r.channels")[2][8].alias("other_offset"))


def box(kind: bytes, payload: bytes, wide: bool = False) -> bytes:
    return struct.pack(">I4sQ", 1, kind, 16 + len(payload)) + payload if wide else struct.pack(">I4s", 8 + len(payload), kind) + payload


def image_file(image: int, samples: list[int]) -> bytes:
    """A plane as a file of boxes: four codecs in turn, every third with a wide data box, every fifth (from the second on) cut short."""
    major, brand, item, settings = ((b"avif", b"mif1", b"av01", b"av1C"), (b"heic", b"mif1", b"hvc1", b"hvcC"), (b"mif1", b"miaf", b"vvc1", b"vvcC"), (b"mif1", b"avif", b"av02", b"av2C"))[image % 4]
    entry = box(b"infe", struct.pack(">BxxxHH4sx", 2, 1, 0, item))
    properties = box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 32, 32)) + box(settings, b"\x81\0\0\0")))
    meta = box(b"meta", b"\0" * 4 + box(b"iinf", struct.pack(">IH", 0, 1) + entry) + properties)
    data = box(b"ftyp", major + b"\0" * 4 + b"miaf" + brand) + meta + box(b"mdat", bytes(samples), image % 3 == 1)
    return data[:-100] if image % 5 == 2 else data


def boxed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, image): files of the stacked planes, written by executors to the shared folder."""
    folder = shared.folder(spark, "boxes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        for b in batches:
            for image, samples in zip(b["image"].to_pylist(), b["samples"].to_pylist(), strict=True):
                with files.open_output_stream(f"{inner}/{image}.bin") as out:
                    out.write(image_file(image, samples))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i}.bin" for i in b["image"].to_pylist()], pa.string()), b["image"]], ["path", "image"])

    rows = rasters.stacked_planes(spark, sf_dir).mapInArrow(write, "path string, image long")
    rows.write.parquet(f"{folder}-list")
    return spark.read.schema("path string, image long").parquet(f"{folder}-list")


LAYOUT_SQL = f"""{BLOCK_SQL}, images as (select vec_id // 16 as image from eb group by 1 having count(*) = 16), layout(box, depth, "offset", size) as (
  values ('/ftyp', 0, 0, 24), ('/meta', 0, 24, 95), ('/meta/iinf', 1, 36, 35), ('/meta/iinf/infe', 2, 50, 21), ('/meta/iprp', 1, 71, 48), ('/meta/iprp/ipco', 2, 79, 40), ('/meta/iprp/ipco/ispe', 3, 87, 20), ('/meta/iprp/ipco/', 3, 107, 12), ('/mdat', 0, 119, 1032)
)"""


@query(f"""with {LAYOUT_SQL} select image, box || case when "offset" = 107 then ['av1C', 'hvcC', 'vvcC', 'av2C'][image % 4 + 1] else '' end as box, depth, cast("offset" as bigint) as "offset", case when box = '/mdat' and image % 3 = 1 then 16 else 8 end as header,
  cast(size + case when box = '/mdat' and image % 3 = 1 then 8 else 0 end as bigint) as size,
  case "offset" when 0 then ['avif,miaf,mif1', 'heic,miaf,mif1', 'mif1,miaf,miaf', 'mif1,miaf,avif'][image % 4 + 1] when 50 then ['av01', 'hvc1', 'vvc1', 'av02'][image % 4 + 1] end as about,
  case when box = '/mdat' and image % 5 = 2 then 'beyond its parent' end as error from images, layout""")
def container_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box of files written from planes, some of them cut short."""
    return boxes.boxes(boxed_files(spark, sf_dir)).drop("path")


@query(f"""with {LAYOUT_SQL} select image, ['avif', 'heic', 'vvc', 'av2'][image % 4 + 1] as kind, cast(9 as bigint) as boxes, cast(case when image % 5 = 2 then 1 else 0 end as bigint) as errors from images""")
def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of image each of those files holds, by brands, items and settings."""
    return boxes.kinds(boxes.boxes(boxed_files(spark, sf_dir)), "image")


#: Chroma tokens of the written videos, in turn.
TOKENS = ("420jpeg", "422", "444", "mono")


def video_file(stream: int, views: list[list[int]]) -> bytes:
    """Views of 32 x 32 samples as a Y4M file: chroma by turns (taken from the luma), every third with parameters of frames, every fifth (from the second on) cut short."""
    token = TOKENS[stream % 4]
    size = y4m.chroma_size(32, 32, token[:3] if token != "mono" else token)
    mark = b"FRAME Ip\n" if stream % 3 == 1 else b"FRAME\n"
    data = f"YUV4MPEG2 W32 H32 F{24 + stream % 3}:1 Ip A1:1 C{token} XNOTE=made\n".encode()
    data += b"".join(mark + bytes(v) + bytes(v[:size]) + bytes(255 - x for x in v[:size]) for v in views)
    return data[:-100] if stream % 5 == 2 else data


def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, stream): Y4M files of the moving views, written by executors to the shared folder."""
    folder = shared.folder(spark, "videos")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        for b in batches:
            for stream, views in zip(b["stream"].to_pylist(), b["views"].to_pylist(), strict=True):
                with files.open_output_stream(f"{inner}/{stream}.y4m") as out:
                    out.write(video_file(stream, views))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i}.y4m" for i in b["stream"].to_pylist()], pa.string()), b["stream"]], ["path", "stream"])

    views = rasters.pan_frames(spark, sf_dir).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("frame", "samples"))).alias("v"))
    views.select("stream", F.col("v.samples").alias("views")).mapInArrow(write, "path string, stream long").write.parquet(f"{folder}-list")
    return spark.read.schema("path string, stream long").parquet(f"{folder}-list")


HEX_SQL = "array_to_string(list_transform({}, lambda n: printf('%02X', n)), '')"


@query(f"""with {PAN_SQL}, views as (select stream, frame, list(v order by y, x) as p from pan group by 1, 2), t as (
  select *, stream % 5 = 2 and frame = 4 as cut, case stream % 4 when 0 then 256 when 1 then 512 when 2 then 1024 end as size from views
) select stream, frame, ['420', '422', '444', 'mono'][stream % 4 + 1] as chroma, (24 + stream % 3) || ':1' as rate, case when cut then 'truncated frame' end as error,
  case when not cut then md5({HEX_SQL.format('p')}) end as luma, case when not cut and size is not null then md5({HEX_SQL.format('p[:size]')}) end as blue,
  case when not cut and size is not null then md5({HEX_SQL.format('list_transform(p[:size], lambda n: 255 - n)')}) end as red from t""")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the planes of every frame, read back from Y4M files by ranges; some files are cut short."""
    files = video_files(spark, sf_dir)
    read = y4m.frames(files, spark.sparkContext.defaultParallelism)
    digest = lambda k: F.md5(F.hex(y4m.plane(F.col("planes"), F.col("width"), F.col("height"), F.col("chroma"), k)))
    stream = F.regexp_extract("path", r"([0-9]+)\.y4m$", 1).cast("long")
    return read.select(stream.alias("stream"), "frame", "chroma", "rate", "error", digest(0).alias("luma"), digest(1).alias("blue"), digest(2).alias("red"))
