"""Queries of the raster operators: name to (plan, SQL). Rasters come from sources.rasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import color, laws, prediction, transforms
from pixelmill.operators import blocks, entropy, geometry, palette
from pixelmill.sources import rasters

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


def pattern_sql(size: int = 16) -> str:
    return f"""px as (
  select s_suppkey as image_id, cast(ys.y as integer) as y, cast(xs.x as integer) as x,
    cast((37 * xs.x + 11 * ys.y + s_suppkey) & 255 as integer) as r, cast(((xs.x // 4) * 83 + (ys.y // 7) * 29 + s_suppkey) & 255 as integer) as g,
    cast((13 * xs.x + 53 * ys.y + (xor(xs.x, ys.y) & 15) * 7 + s_suppkey) & 255 as integer) as b
  from supplier, range({size}) ys(y), range({size}) xs(x)
), yc as (
  select *, greatest(0, least(255, (2449 * r + 4809 * g + 934 * b + 4096) >> 13)) as luma,
    (-1382 * r - 2714 * g + 4096 * b + (128 << 13)) as cbs, (4096 * r - 3430 * g - 666 * b + (128 << 13)) as crs from px
)"""


BLOCK_SQL = """eb as (
  select vec_id, list_transform(embedding, lambda x: cast(greatest(0, least(255, cast(floor((cast(x as double) + 1) * 127.5) as integer))) as bigint)) as block from embeddings where len(embedding) = 64
), es as (
  select vec_id, cast(i // 8 as integer) as y, cast(i % 8 as integer) as x, block[i + 1] as v from eb, range(64) g(i)
), ed as (
  select a.vec_id, a.y, a.x, a.v - b.v as d from es a join es b on b.vec_id = a.vec_id + 1 and a.y = b.y and a.x = b.x
)"""


def luma(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    rows = rasters.pattern_rgb(spark, sf_dir, size)
    return rows.select("image_id", "y", "x", color.ycbcr(F.col("r"), F.col("g"), F.col("b"))[0].alias("v"))


@query(f"with {pattern_sql()} select image_id, y, x, luma as yy, greatest(0, least(255, (cbs + 4096) >> 13)) as cb, greatest(0, least(255, (crs + 4096) >> 13)) as cr from yc")
def csc_ycbcr444(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.pattern_rgb(spark, sf_dir)
    y, cb, cr = color.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("image_id", "y", "x", y.alias("yy"), cb.alias("cb"), cr.alias("cr"))


# 15 wide and high, so that edges are odd
@query(f"""with {pattern_sql(15)}, t as (
  select image_id, y as r, x // 2 as c, cast(sum(cbs * case when x = 14 then 2 else 1 end) as bigint) as cb, cast(sum(crs * case when x = 14 then 2 else 1 end) as bigint) as cr from yc group by 1, 2, 3
) select image_id, r, cast(c as integer) as c, cast(greatest(0, least(255, (cb + (1 << 13)) >> 14)) as integer) as cb, cast(greatest(0, least(255, (cr + (1 << 13)) >> 14)) as integer) as cr from t""")
def chroma_422(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.subsampled(rasters.pattern_rgb(spark, sf_dir, 15), 15, 15, vertical=False)


@query(f"""with {pattern_sql(15)}, h as (
  select a.image_id, a.y, a.x // 2 as c, a.cbs + b.cbs as cb, a.crs + b.crs as cr from yc a join yc b on a.image_id = b.image_id and a.y = b.y and b.x = least(a.x + 1, 14) where a.x % 2 = 0
), t as (
  select a.image_id, a.y // 2 as r, a.c, a.cb + b.cb as cb, a.cr + b.cr as cr from h a join h b on a.image_id = b.image_id and a.c = b.c and b.y = least(a.y + 1, 14) where a.y % 2 = 0
) select image_id, cast(r as integer) as r, cast(c as integer) as c, greatest(0, least(255, (cb + (1 << 14)) >> 15)) as cb, greatest(0, least(255, (cr + (1 << 14)) >> 15)) as cr from t""")
def chroma_420(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.subsampled(rasters.pattern_rgb(spark, sf_dir, 15), 15, 15, vertical=True)


@query("""with s as (
  select cast(floor(l_quantity * 5) as bigint) % 256 as r, cast(floor(l_extendedprice) as bigint) % 256 as g, cast(floor(l_discount * 1000) as bigint) % 256 as b from lineitem
), y as (select greatest(0, least(255, (2449 * r + 4809 * g + 934 * b + 4096) >> 13)) as v from s)
select cast(v as integer) as v, count(*) as n from y group by v""")
def plane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = color.ycbcr(F.col("r"), F.col("g"), F.col("b"))[0]
    return rasters.lineitem_rgb(spark, sf_dir).groupBy(y.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.histogram(rasters.block_samples(rasters.embed_blocks(spark, sf_dir)), "vec_id", "v")


HIST_SQL = BLOCK_SQL + ", h as (select vec_id, v as value, count(*) as n from es group by 1, 2)"


@query(f"""with {HIST_SQL}, r as (
  select *, row_number() over (partition by vec_id order by n desc, value) as rank, count(*) over (partition by vec_id) as colours from h
) select vec_id, cast(row_number() over (partition by vec_id order by value) - 1 as integer) as place, cast(value as integer) as value from r where rank <= 8 and colours > 8""")
def palette_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.top_colours(block_histogram(spark, sf_dir), "vec_id", 8)


@query(f"with {HIST_SQL} select vec_id, count(*) as colours from h group by vec_id having count(*) between 2 and 40")
def palette_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.gate(block_histogram(spark, sf_dir), "vec_id", 2, 40)


@query(f"""with {pattern_sql()}, b as (
  select s_nationkey, image_id, y // 4 as bj, x // 4 as bi, count(*) as n, count(distinct luma) as colours from yc join supplier on s_suppkey = image_id group by 1, 2, 3, 4 having count(*) = 16
) select s_nationkey, count(*) as blocks, count(*) filter (colours between 2 and 8) / count(*) as share, count(*) filter (colours between 2 and 8) / count(*) >= 0.05 as screen from b group by 1""")
def screen_content_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), "s_nationkey")
    # samples count as few until they are made, so they would be broadcast; by image, they are shuffled once for join and blocks
    return palette.few_colour_share(luma(spark, sf_dir).join(of.hint("shuffle_hash"), "image_id"), "s_nationkey", size=4)


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.metrics(blocks.successive(rasters.embed_blocks(spark, sf_dir)))


@query(f"with {BLOCK_SQL} select vec_id, cast(sum(abs(d)) as bigint) as sad from ed group by vec_id")
def block_sad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_metrics(spark, sf_dir).select("vec_id", "sad")


@query(f"with {BLOCK_SQL} select vec_id, cast(sum(d * d) as bigint) as sse from ed group by vec_id")
def block_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_metrics(spark, sf_dir).select("vec_id", "sse")


@query(f"with {BLOCK_SQL} select vec_id, cast(sum(d) as bigint) as sum_d, cast(sum(d * d) as bigint) as sum_dd from ed group by vec_id")
def residual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_metrics(spark, sf_dir).select("vec_id", "sum_d", F.col("sse").alias("sum_dd"))


SATD_SQL = f"""{BLOCK_SQL}, h(k, i, s) as (values (0,0,1),(0,1,1),(0,2,1),(0,3,1),(1,0,1),(1,1,1),(1,2,-1),(1,3,-1),(2,0,1),(2,1,-1),(2,2,-1),(2,3,1),(3,0,1),(3,1,-1),(3,2,1),(3,3,-1)), c as (
  select vec_id, y // 4 as by_, x // 4 as bx_, p.k as u, q.k as w, abs(sum(d * p.s * q.s)) as a from ed join h p on p.i = y % 4 join h q on q.i = x % 4 group by 1, 2, 3, 4, 5
)"""


@query(f"with {SATD_SQL} select vec_id, cast(sum(a) as bigint) as satd from c group by vec_id")
def block_satd4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_metrics(spark, sf_dir).select("vec_id", "satd")


@query(f"with {SATD_SQL}, s as (select vec_id, sum(a) as satd from c group by 1), t as (select vec_id, sum(abs(d)) as sad from ed group by 1) select vec_id, cast(sad + (cast(satd as bigint) >> 2) as bigint) as proxy from s join t using (vec_id)")
def sad_satd_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_metrics(spark, sf_dir).select("vec_id", "proxy")


def _walsh_step(of: str, key: str) -> str:
    """One pass of the 4-point transform, as SQL over a, b, c, d of a row."""
    return f"select {key}, a + b - ((a + b - (d - c)) >> 1) + c as o0, ((a + b - (d - c)) >> 1) - c as o1, (d - c) + ((a + b - (d - c)) >> 1) - b as o2, ((a + b - (d - c)) >> 1) - b as o3 from {of}"


@query(f"""with {BLOCK_SQL}, p as (select vec_id, y // 4 as by_, x // 4 as bx_, y % 4 as i, x % 4 as j, v from es), cols as (
  select vec_id, by_, bx_, j, max(v) filter (i = 0) as a, max(v) filter (i = 1) as b, max(v) filter (i = 2) as c, max(v) filter (i = 3) as d from p group by 1, 2, 3, 4
), c1 as ({_walsh_step('cols', 'vec_id, by_, bx_, j')}), c2 as (
  select vec_id, by_, bx_, k as i, j, [o0, o1, o2, o3][k + 1] as v from c1, range(4) t(k)
), rws as (
  select vec_id, by_, bx_, i, max(v) filter (j = 0) as a, max(v) filter (j = 1) as b, max(v) filter (j = 2) as c, max(v) filter (j = 3) as d from c2 group by 1, 2, 3, 4
), r1 as ({_walsh_step('rws', 'vec_id, by_, bx_, i')})
select vec_id, cast(by_ as integer) as by, cast(bx_ as integer) as bx, cast(k * 4 + i as integer) as k, [o0, o1, o2, o3][k + 1] as coefficient from r1, range(4) t(k)""")
def wht4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.walsh(rasters.embed_blocks(spark, sf_dir))


@query(f"""with {pattern_sql(64)}, v as (
  select image_id, y // 8 as bj, x // 8 as bi, greatest(0, sum(luma * luma) / count(*) - (sum(luma) / count(*)) * (sum(luma) / count(*))) as variance from yc group by 1, 2, 3
) select image_id, round(list_sort(list(variance))[16], 6) as picked from v group by image_id""")
def sb_variance_octile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.octile(blocks.sub_block_variances(luma(spark, sf_dir, 64), "v"), 2)
    return found.select("image_id", F.round("picked", 6).alias("picked"))


@query(f"""with {pattern_sql()}, d as (
  select a.image_id, abs(b.luma - a.luma) as d from yc a join yc b on a.image_id = b.image_id and ((b.y = a.y and b.x = a.x + 1) or (b.y = a.y + 1 and b.x = a.x))
) select image_id, round(sum(d) / count(*), 9) as activity from d group by image_id""")
def spatial_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.spatial_activity(luma(spark, sf_dir), "v").select("image_id", F.round("activity", 9).alias("activity"))


@query(f"""with {BLOCK_SQL}, c as (select vec_id, y, x, v, i, (v - [32, 96, 128, 160, 224][i + 1]) ** 2 as d from es, range(5) t(i))
select vec_id, y, x, cast(arg_min(i, d * 10 + i) as integer) as centre from c group by vec_id, y, x""")
def nearest_palette_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = rasters.block_samples(rasters.embed_blocks(spark, sf_dir))
    return palette.nearest(samples, [32, 96, 128, 160, 224]).select("vec_id", "y", "x", "centre")


@query(f"with {BLOCK_SQL}, q as (select vec_id, list_transform(block[1:5], lambda v: v // 64) as block from eb), f as (select block, min(vec_id) as first_id from q group by block) select vec_id, first_id from q join f using (block) where vec_id > first_id")
def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = rasters.embed_blocks(spark, sf_dir).select("vec_id", F.transform(F.slice("block", 1, 5), lambda v: F.shiftright(v, 6)).alias("block"))
    return blocks.duplicates(coarse)


@query(f"""with {BLOCK_SQL}, l as (
  select vec_id, dir, case dir when 0 then y + x when 1 then y + x // 2 when 2 then y when 3 then 3 + y - x // 2 when 4 then 7 + y - x when 5 then 3 - y // 2 + x when 6 then x else y // 2 + x end as line, v - 128 as v from es, range(8) t(dir)
), s as (select vec_id, dir, line, sum(v) as s, count(*) as n from l group by 1, 2, 3), c as (
  select vec_id, dir, cast(sum(s * s * (840 // n)) as bigint) as cost from s group by 1, 2
), b as (select vec_id, max(cost) as best, arg_max(dir, cost * 8 + (7 - dir)) as dir from c group by 1)
select b.vec_id, cast(b.dir as integer) as direction, (b.best - c.cost) >> 10 as variance from b join c on c.vec_id = b.vec_id and c.dir = (b.dir + 4) % 8""")
def cdef_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.edge_directions(rasters.embed_blocks(spark, sf_dir))


#: Cumulative frequencies, counted down from 32768; symbol 12 has none, and costs as if it had one.
CDF = [32768 - x for x in (40, 130, 400, 1200, 3000, 6500, 12000, 19000, 25500, 29500, 31500, 32300, 32300, 32640, 32740, 32768)]


@query(f"""with {BLOCK_SQL}, t(symbol, above, below) as (values {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip([32768, *CDF], CDF, strict=False)))}), c as (select vec_id, v // 16 as symbol, count(*) as n from es group by 1, 2)
select vec_id, round(sum(round(-log2(greatest(1, above - below) / 32768), 6) * n), 6) as bits from c join t using (symbol) group by vec_id""")
def static_bit_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = rasters.block_samples(rasters.embed_blocks(spark, sf_dir)).select("vec_id", F.shiftright("v", 4).alias("symbol"))
    return entropy.bit_cost(symbols, "vec_id", CDF).select("vec_id", F.round("bits", 6).alias("bits"))


@query("""with a(l, q) as (values (1,215),(30,140),(40,116),(50,91),(60,70),(70,53),(80,35),(85,28),(90,17),(93,12),(96,7),(98,5),(99,3),(100,1)), s as (
  select l as l0, q as q0, lead(l) over (order by l) as l1, lead(q) over (order by l) as q1 from a
), p as (select p_partkey, cast(greatest(1, least(100, p_size * 2)) as integer) as quality from part)
select p_partkey, quality, cast(q0 + trunc((q1 - q0) * (quality - l0) / (l1 - l0)) as integer) as q from p join s on quality <= l1 and (quality > l0 or (quality = 1 and l0 = 1)) where l1 is not null""")
def quality_to_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rasters.table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1), F.least(F.lit(100), F.col("p_size") * 2)).cast("int").alias("quality"))
    return parts.withColumn("q", laws.quality_to_q(F.col("quality")))


Q_SQL = "with p as (select p_partkey, cast(p_partkey % 256 as integer) as q from part)"


def quantizer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("q"))


@query(f"""{Q_SQL} select p_partkey, q,
  cast(case when q <= 20 then 15 when q <= 48 then floor(15 - 7.0 * (q - 20) / 28 + 0.5) when q >= 128 then 0 else floor(8.0 * (128 - q) / 80 + 0.5) end as integer) as level,
  cast(case when q <= 48 then 8 when q >= 128 then 0 else floor(8.0 * (128 - q) / 80 + 0.5) end as integer) as level_subsampled from p""")
def quant_matrix_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return quantizer_parts(spark, sf_dir).select("p_partkey", "q", laws.matrix_level(q, False).alias("level"), laws.matrix_level(q, True).alias("level_subsampled"))


@query(f"""{Q_SQL} select p_partkey, q, cast(case when q <= 160 then 0 else -least((q - 160) // 3, 32) end as integer) as dc, cast(case when q <= 20 then 0 when q >= 96 then 24 else 24 * (q - 20) // 76 end as integer) as ac from p""")
def chroma_qdelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer_parts(spark, sf_dir).select("p_partkey", "q", laws.chroma_dc_delta(F.col("q")).alias("dc"), laws.chroma_ac_delta(F.col("q")).alias("ac"))


@query(f"""{Q_SQL} select p_partkey, q, cast(least(q // 8, 40) as integer) as luma, cast(case when q // 8 > 0 then greatest(1, least(q // 10, 32)) else 0 end as integer) as chroma from p""")
def loop_filter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, uv = laws.filter_levels(F.col("q"))
    return quantizer_parts(spark, sf_dir).select("p_partkey", "q", y.alias("luma"), uv.alias("chroma"))


# 6 wide and 4 high, so that swapped axes show
@query(f"""with {pattern_sql(6)}, p as (select *, cast(image_id % 8 + 1 as integer) as orientation from px where y < 4)
select image_id, orientation, cast(case orientation when 1 then y when 2 then y when 3 then 3 - y when 4 then 3 - y when 5 then x when 6 then x when 7 then 5 - x else 5 - x end as integer) as shown_y,
  cast(case orientation when 1 then x when 2 then 5 - x when 3 then 5 - x when 4 then x when 5 then y when 6 then 3 - y when 7 then 3 - y else y end as integer) as shown_x, r from p""")
def orientation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.pattern_rgb(spark, sf_dir, 6).where("y < 4").withColumn("orientation", (F.col("image_id") % 8 + 1).cast("int"))
    return geometry.oriented(rows, 6, 4).select("image_id", "orientation", "shown_y", "shown_x", "r")


@query("""with s as (select l_orderkey, l_linenumber, (cast(floor(l_extendedprice) as bigint) % 256) / 255 as v, (cast(floor(l_quantity * 5) as bigint) % 256) * 257 as m from lineitem)
select l_orderkey, l_linenumber, round((v + 0.015625) * 2 ** (pow(m / 65535, 1 / 1.5) * 2.5 + (1 - pow(m / 65535, 1 / 1.5)) * -0.5) - 0.015625, 7) as hdr from s""")
def gain_map_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.lineitem_rgb(spark, sf_dir).withColumn("v", F.col("g") / 255).withColumn("m", F.col("r") * 257)
    return rows.select("l_orderkey", "l_linenumber", F.round(color.gain_map_apply(F.col("v"), F.col("m"), -0.5, 2.5, 1.5, 1 / 64, 1 / 64), 7).alias("hdr"))


@query("""with s as (select l_orderkey, l_linenumber, (cast(floor(l_extendedprice) as bigint) % 256) / 64 as light from lineitem), p as (select max(light) as peak from s), t as (
  select l_orderkey, l_linenumber, light, case when light > 0.75 then 0.75 + (light - 0.75) / (1 + (light - 0.75) * case when peak > 1 then 1 / 0.25 - 1 / (peak - 0.75) else 0 end) else light end as sdr from s, p
) select l_orderkey, l_linenumber, round(sdr, 7) as sdr, round(case when sdr > 0 then log2(light / sdr) else 0 end, 7) as stops from t""")
def hdr_to_gain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.lineitem_rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("g") / 64).alias("light"))
    peak = F.broadcast(rows.agg(F.max("light").alias("peak")))  # one row
    done = rows.crossJoin(peak).withColumn("sdr", color.tone_mapped(F.col("light"), F.col("peak")))
    return done.select("l_orderkey", "l_linenumber", F.round("sdr", 7).alias("sdr"), F.round(F.when(F.col("sdr") > 0, F.log2(F.col("light") / F.col("sdr"))).otherwise(0.0), 7).alias("stops"))


@query("""with s as (select l_orderkey, l_linenumber, (cast(floor(l_extendedprice) as bigint) % 256) / 255 as v from lineitem), t as (
  select *, case when v <= 0.5 then v * v / 3 else (exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12 end as scene from s
) select l_orderkey, l_linenumber, round(scene, 7) as scene, round(case when scene <= 1 / 12 then sqrt(3 * scene) else 0.17883277 * ln(greatest(12 * scene - 0.28466892, 1e-12)) + 0.55991073 end, 7) as signal,
  round(pow((3424 / 4096 + 2413 / 128 * pow(v, 2610 / 16384)) / (1 + 2392 / 128 * pow(v, 2610 / 16384)), 2523 / 32), 7) as pq from t""")
def hlg_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.lineitem_rgb(spark, sf_dir).withColumn("v", F.col("g") / 255).withColumn("scene", color.hlg_to_scene(F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", F.round("scene", 7).alias("scene"), F.round(color.hlg_from_scene(F.col("scene")), 7).alias("signal"), F.round(color.pq_encode(F.col("v")), 7).alias("pq"))


@query("""with s as (select s_suppkey as image_id, s_suppkey % 40 + 1 as n from supplier), t as (select image_id, n, (n + 3) // 4 as step from s)
select image_id, cast(k as integer) as tile, cast(k * step as bigint) as start from t, range(4) g(k) where k * step < n""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 40 + 1).alias("superblocks"))
    return geometry.tiles(sizes)


@query("""with s as (select l_orderkey, l_linenumber, cast(floor(l_quantity * 5) as bigint) % 256 - 128 as r, cast(floor(l_discount * 1000) as bigint) % 256 - 64 as c from lineitem)
select l_orderkey, l_linenumber, cast(3 * (2 + 2 * (floor(log2(abs(r) + 1)) + 1) + (r <> 0)::int + 2 * (floor(log2(abs(c) + 1)) + 1) + (c <> 0)::int) as integer) as cost from s""")
def mv_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.lineitem_rgb(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", laws.motion_cost(F.col("r") - 128, F.col("b") - 64, 3).cast("int").alias("cost"))


@query("""with s as (select l_orderkey, l_linenumber, cast(floor(l_quantity * 5) as bigint) % 256 as l, cast(floor(l_extendedprice) as bigint) % 256 as t, cast(floor(l_discount * 1000) as bigint) % 256 as c from lineitem)
select l_orderkey, l_linenumber, cast(case when abs(t - c) <= abs(l - c) and abs(t - c) <= abs(l + t - 2 * c) then l when abs(l - c) <= abs(l + t - 2 * c) then t else c end as integer) as predicted from s""")
def paeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.lineitem_rgb(spark, sf_dir).select("l_orderkey", "l_linenumber", prediction.paeth(F.col("r"), F.col("g"), F.col("b")).alias("predicted"))


@query(f"""with {BLOCK_SQL}, b(k, i, c) as (values {", ".join(f"({k}, {i}, {c!r})" for k, row in enumerate(transforms.dct_basis(8)) for i, c in enumerate(row))})
select vec_id, cast(p.k * 8 + q.k as integer) as k, round(sum(cast(v - 128 as double) * p.c * q.c), 6) + 0.0 as coefficient from es join b p on p.i = y join b q on q.i = x group by vec_id, p.k, q.k""")
def dct8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.transform_8x8(rasters.embed_blocks(spark, sf_dir)).select("vec_id", F.posexplode("coefficients").alias("k", "coefficient"))
    return found.select("vec_id", "k", (F.col("coefficient") + 0.0).alias("coefficient"))


@query()
def dp_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.clustered(block_histogram(spark, sf_dir), "vec_id", 4)


@query()
def lloyd_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.clustered(block_histogram(spark, sf_dir), "vec_id", 4, "lloyd")
