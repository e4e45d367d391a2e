"""Queries of ingest, prediction, statistics, laws and motion: name to (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.functions import color, laws, prediction, transforms
from pixelmill.operators import blocks, geometry, motion, palette, statistics
from pixelmill.plans.frame_queries import FRAMES_SQL
from pixelmill.plans.raster_queries import BLOCK_SQL, HIST_SQL, Q_SQL, Plan, block_histogram, luma, pattern_sql, quantizer_parts
from pixelmill.sources import ingest, rasters

QUERIES: dict[str, tuple[Plan, str | None]] = {}
LINE_SQL = "s as (select l_orderkey, l_linenumber, cast(floor(l_quantity * 5) as bigint) % 256 as r, cast(floor(l_extendedprice) as bigint) % 256 as g, cast(floor(l_discount * 1000) as bigint) % 256 as b from lineitem)"
LINE_KEYS = ("l_orderkey", "l_linenumber")


def query(sql: str | None = None):  # noqa: ANN201
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


# ingest: the 64 samples of an embedding's block stand for an image's bytes


def planes_of(images: DataFrame, names: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("plane"), F.col(p).alias("samples")) for p in names])
    return images.select("vec_id", F.explode(each).alias("p")).select("vec_id", "p.plane", F.posexplode("p.samples").alias("i", "v"))


def interleaved_sql(order: str, n: int) -> str:
    return f"with {BLOCK_SQL}, c(plane, k) as (values {', '.join(f"('{p}', {k})" for k, p in enumerate(order))}) select vec_id, plane, cast(i as integer) as i, cast(block[i * {len(order)} + k + 1] as integer) as v from eb, c, range({n}) g(i)"


@query(interleaved_sql("rgb", 21))
def ingest_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = rasters.embed_blocks(spark, sf_dir).withColumn("block", F.slice("block", 1, 63))
    return planes_of(ingest.deinterleaved(images, "block", "rgb"), "gbr")


@query(interleaved_sql("rgba", 16))
def ingest_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_of(ingest.deinterleaved(rasters.embed_blocks(spark, sf_dir), "block", "rgba"), "gbra")


@query(interleaved_sql("ga", 32))
def ingest_gray_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_of(ingest.deinterleaved(rasters.embed_blocks(spark, sf_dir), "block", "ga"), "ga")


@query(interleaved_sql("g", 64))
def ingest_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes_of(ingest.deinterleaved(rasters.embed_blocks(spark, sf_dir), "block", "g"), "g")


# 6 wide and 5 high, so that chroma sizes round up
@query(f"with {BLOCK_SQL}, c(plane, k, n) as (values ('y', 0, 30), ('u', 30, 9), ('v', 39, 9)) select vec_id, plane, cast(i as integer) as i, cast(block[k + i + 1] as integer) as v from eb, c, range(30) g(i) where i < n")
def ingest_yuv420(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.yuv_planes(rasters.embed_blocks(spark, sf_dir), "block", 6, 5, "420")
    return planes_of(found, "yuv")


@query(f"with {BLOCK_SQL} select vec_id, cast(i as integer) as i, cast(block[(i // 3) * 4 + i % 3 + 1] as integer) as v from eb, range(48) g(i)")
def reinterleave_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = ingest.interleaved(ingest.deinterleaved(rasters.embed_blocks(spark, sf_dir), "block", "rgba"))
    return images.select("vec_id", F.posexplode("rgb").alias("i", "v"))


@query("""with p as (select p_partkey, p_size * 400 as width, p_partkey % 20 as height, p_size * 3 as quality, p_size * 400 * (p_partkey % 20) - (p_partkey % 7 = 0)::int as luma_samples, p_size * 200 * ((p_partkey % 20 + 1) // 2) + (p_partkey % 11 = 0)::int as chroma_samples from part)
select p_partkey, case when quality not between 1 and 100 then 'quality' when width not between 1 and 16383 or height not between 1 and 16383 then 'dimensions' when luma_samples <> width * height then 'luma' when chroma_samples <> ((width + 1) // 2) * ((height + 1) // 2) then 'chroma' end as error from p""")
def validate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rasters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 400).alias("width"), (F.col("p_partkey") % 20).alias("height"), (F.col("p_size") * 3).alias("quality"))
    flag = lambda n: (F.col("p_partkey") % n == 0).cast("int")
    parts = parts.withColumn("luma_samples", F.col("width") * F.col("height") - flag(7)).withColumn("chroma_samples", F.expr("width div 2") * F.expr("(height + 1) div 2") + flag(11))
    return ingest.checked(parts, "420").select("p_partkey", "error")


@query(f"""with {LINE_SQL}, t as (select l_orderkey, l_linenumber, r * 257 as v from s)
select l_orderkey, l_linenumber, cast(v >> 6 as integer) as ten, cast(((v >> 6) << 6) | (v >> 10) as integer) as ten_wide, cast(v >> 4 as integer) as twelve, cast(((v >> 4) << 4) | (v >> 12) as integer) as twelve_wide from t""")
def depth_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.lineitem_rgb(spark, sf_dir)
    (ten, ten_wide), (twelve, twelve_wide) = (color.deepened(F.col("r") * 257, d) for d in (10, 12))
    return rows.select(*LINE_KEYS, ten.alias("ten"), ten_wide.alias("ten_wide"), twelve.alias("twelve"), twelve_wide.alias("twelve_wide"))


# 6 wide and 5 high: both sides grow
@query(f"with {pattern_sql(6)}, g as (select s_suppkey as image_id, cast(ys.y as integer) as y, cast(xs.x as integer) as x from supplier, range(8) ys(y), range(8) xs(x)) select g.image_id, g.y, g.x, luma as v from g join yc on yc.image_id = g.image_id and yc.y = least(g.y, 4) and yc.x = least(g.x, 5)")
def pad_to_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.padded(luma(spark, sf_dir, 6).where("y < 5"), 6, 5)


# statistics


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.successive(rasters.embed_blocks(spark, sf_dir)).withColumn("d", blocks.differences(F.col("a"), F.col("b")))


@query(f"with {BLOCK_SQL} select vec_id, cast(sum(d * d) as bigint) as sse from ed where x < 6 and y < 5 group by vec_id")
def visible_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.transform("d", lambda v, i: F.when((i % 8 < 6) & (F.floor(i / 8) < 5), v).otherwise(0))
    return pairs(spark, sf_dir).select("vec_id", blocks.total(F.transform(masked, lambda v: v * v)).alias("sse"))


@query(f"""with {BLOCK_SQL}, r as (select a.vec_id, greatest(0, least(255, a.v + (b.v - a.v) * 2)) as rec, b.v from es a join es b on b.vec_id = a.vec_id + 1 and a.y = b.y and a.x = b.x)
select vec_id, cast(sum((v - rec) * (v - rec)) as bigint) as sse from r group by vec_id""")
def reconstruction_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction a and twice the residual, clamped, against b."""
    rec = F.zip_with("a", "d", lambda p, d: F.greatest(F.lit(0), F.least(F.lit(255), p - d * 2)))
    return pairs(spark, sf_dir).select("vec_id", blocks.total(F.transform(F.zip_with("b", rec, lambda x, y: x - y), lambda e: e * e)).alias("sse"))


@query(f"with {BLOCK_SQL} select vec_id, y, x, cast(greatest(0, least(255, 128 + d)) as integer) as v from ed")
def reconstruct_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat prediction and the residual, clamped to the depth."""
    rec = F.transform("d", lambda d: F.greatest(F.lit(0), F.least(F.lit(255), d + 128)).cast("int"))
    return rasters.block_samples(pairs(spark, sf_dir).select("vec_id", rec.alias("block")))


@query(f"with {pattern_sql()} select image_id, cast(sum(luma) as bigint) as s, cast(sum(luma * luma) as bigint) as ss from yc group by 1")
def plane_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v").cast("long")
    return luma(spark, sf_dir).groupBy("image_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def _rows(table: tuple) -> str:
    return ", ".join(f"({k}, {i}, {x!r})" for k, row in enumerate(table) for i, x in enumerate(row))


@query(f"""with {BLOCK_SQL}, b(k, i, c) as (values {_rows(statistics.DCT4)}), w(k, l, wt) as (values {_rows(statistics.WEIGHTS)}), c as (
  select vec_id, y // 4 as ty, x // 4 as tx, p.k as k, q.k as l, sum(cast(d as double) * p.c * q.c) as c from ed join b p on p.i = y % 4 join b q on q.i = x % 4 group by 1, 2, 3, 4, 5
) select vec_id, round(sum(c * c * wt / 0.4625), 4) as wsse from c join w using (k, l) group by vec_id""")
def weighted_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.weighted_sse(pairs(spark, sf_dir)).select("vec_id", F.round("wsse", 4).alias("wsse"))


@query(f"with {BLOCK_SQL} select a.vec_id, cast(a.v // 32 as integer) as u, cast(b.v // 32 as integer) as v, count(*) as n from es a join es b on a.vec_id = b.vec_id and a.y = b.y and b.x = a.x + 1 where a.x % 2 = 0 group by 1, 2, 3")
def uv_pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = ingest.deinterleaved(rasters.embed_blocks(spark, sf_dir), "block", "ga")
    each = planes.select("vec_id", F.explode(F.arrays_zip("g", "a")).alias("p"))
    return each.groupBy("vec_id", F.shiftright("p.g", 5).alias("u"), F.shiftright("p.a", 5).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {pattern_sql(64)}, v as (
  select image_id, y // 8 as bj, x // 8 as bi, greatest(0, sum(luma * luma) / count(*) - (sum(luma) / count(*)) * (sum(luma) / count(*))) as variance from yc group by 1, 2, 3
), p as (select image_id, ln(1 + list_sort(list(variance))[16]) as v from v group by 1), a as (
  select image_id, 0.95 * ln(1 + greatest(0, sum(luma * luma) / count(*) - (sum(luma) / count(*)) * (sum(luma) / count(*)))) as anchor from yc group by 1
) select image_id, cast(case when v < 5.549076 then -floor(least((5.549076 - v) * 5.0, 18.0) + 0.5) else floor(least(greatest(v - greatest(anchor, 5.549076), 0.0) * 6.0, 16.0) + 0.5) end as integer) as delta from p join a using (image_id)""")
def variance_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = luma(spark, sf_dir, 64)
    picked = blocks.octile(blocks.sub_block_variances(rows, "v"), 2)
    return picked.join(statistics.boost_anchor(rows, "v"), "image_id").select("image_id", statistics.boost_offset(F.col("picked"), F.col("anchor")).alias("delta"))


def _laplacian_sql(of: str, v: str) -> str:
    return f"select image_id, avg(abs(4 * {v} - l - r - u - d)) as lap from (select image_id, {v}, lag({v}) over ro as l, lead({v}) over ro as r, lag({v}) over co as u, lead({v}) over co as d from {of} window ro as (partition by image_id, y order by x), co as (partition by image_id, x order by y)) where l + r + u + d is not null group by 1"


@query(f"""with {pattern_sql(32)}, dk as (select image_id, y, x, luma // 4 as v from yc), half as (select image_id, y // 2 as y, x // 2 as x, avg(v) as h from dk group by 1, 2, 3), f as ({_laplacian_sql('dk', 'v')}), hl as ({_laplacian_sql('half', 'h')}), m as (select image_id, avg(v) as mean from dk group by 1), t as (
  select image_id, mean, sqrt(f.lap * hl.lap) as energy from m join f using (image_id) join hl using (image_id)
) select image_id, round(mean, 6) as mean, round(energy, 6) as energy, cast(floor(greatest(0.0, least(16.0, ln(1 + energy * (greatest(1.0, least(4.5, pow(72.0 / (16.0 + mean), 1.2))) - 1)) * 4.0)) + 0.5) as integer) as lowered from t""")
def dark_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = luma(spark, sf_dir, 32).select("image_id", "y", "x", F.shiftright("v", 2).alias("v"))
    found = statistics.dark_structure(rows, "v")
    return found.select("image_id", F.round("mean", 6).alias("mean"), F.round("energy", 6).alias("energy"), statistics.dark_offset(F.col("mean"), F.col("energy")).alias("lowered"))


@query(f"""with {BLOCK_SQL}, p as (select a.vec_id, a.v as a, b.v as b from es a join es b on b.vec_id = a.vec_id + 1 and a.y = b.y and a.x = b.x), t as (
  select vec_id, cast(sum(a * a) as bigint) - ((cast(sum(a) as bigint) * cast(sum(a) as bigint) + 32) >> 6) as va, cast(sum(b * b) as bigint) - ((cast(sum(b) as bigint) * cast(sum(b) as bigint) + 32) >> 6) as vb, sum((a - b) * (a - b)) as sse from p group by 1
) select vec_id, cast(floor(0.5 + sse * ((va + vb + 400) * 0.5::double / sqrt(20000 + cast(va as double) * vb))) as bigint) as distance from t""")
def structure_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.structure_distance(pairs(spark, sf_dir))


@query(f"""with {BLOCK_SQL}, f as (
  select a.vec_id, a.y, a.x, a.v, (coalesce(lag(a.v) over w, a.v) + 2 * a.v + coalesce(lead(a.v) over w, a.v) + 2) >> 2 as filtered from es a window w as (partition by a.vec_id, a.y order by a.x)
), e as (select f.vec_id // 8 as superblock, cast(sum((f.v - b.v) * (f.v - b.v)) as bigint) as plain, cast(sum((f.filtered - b.v) * (f.filtered - b.v)) as bigint) as filtered from f join es b on b.vec_id = f.vec_id + 1 and b.y = f.y and b.x = f.x group by 1)
select superblock, plain, filtered, filtered < plain as better from e""")
def filter_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors of a and of a smoothed along its rows, against b, by superblock of eight blocks."""
    near = lambda i, k: F.get("a", (F.floor(i / 8) * 8 + F.greatest(F.lit(0), F.least(F.lit(7), i % 8 + k))).cast("int"))
    smooth = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.shiftright(near(i, -1) + near(i, 0) * 2 + near(i, 1) + 2, 2))
    error = lambda c: blocks.total(F.transform(F.zip_with(c, "b", lambda x, y: x - y), lambda e: e * e))
    each = pairs(spark, sf_dir).select(F.expr("vec_id div 8").alias("superblock"), error("a").alias("plain"), error(smooth).alias("filtered"))
    sums = each.groupBy("superblock").agg(F.sum("plain").alias("plain"), F.sum("filtered").alias("filtered"))
    return sums.withColumn("better", F.col("filtered") < F.col("plain"))


@query(f"""with {BLOCK_SQL}, c as (
  select a.vec_id, a.v, b.v - a.v as err, case when coalesce(lag(a.v) over w, a.v) - a.v > 8 then 2 when coalesce(lag(a.v) over w, a.v) - a.v < -8 then 0 else 1 end as c0, case when coalesce(lead(a.v) over w, a.v) - a.v > 8 then 2 when coalesce(lead(a.v) over w, a.v) - a.v < -8 then 0 else 1 end as c1
  from es a join es b on b.vec_id = a.vec_id + 1 and b.y = a.y and b.x = a.x window w as (partition by a.vec_id, a.y order by a.x)
) select cast(k as integer) as log2, cast((v // 32) >> (3 - k) as bigint) as band, cast(c0 as integer) as c0, cast(c1 as integer) as c1, count(*) as n, cast(sum(err) as bigint) as e, cast(sum(err * err) as bigint) as ee from c, range(4) g(k) group by 1, 2, 3, 4""")
def band_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda i, k: F.get("a", (F.floor(i / 8) * 8 + F.greatest(F.lit(0), F.least(F.lit(7), i % 8 + k))).cast("int"))
    kind = lambda i, k: F.when(near(i, k) - near(i, 0) > 8, 2).when(near(i, k) - near(i, 0) < -8, 0).otherwise(1)
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(near(i, 0).alias("v"), kind(i, -1).alias("c0"), kind(i, 1).alias("c1"), (F.get("b", i) - near(i, 0)).cast("long").alias("err")))
    return statistics.rolled_up(statistics.band_sums(pairs(spark, sf_dir).select(F.explode(each).alias("s")).select("s.*")))


NORMAL_SQL = f"""{BLOCK_SQL}, p as (select a.vec_id, a.v as x, l.v as z, b.v as y from es a join es l on l.vec_id = a.vec_id and l.y = a.y and l.x = a.x - 1 join es b on b.vec_id = a.vec_id + 1 and b.y = a.y and b.x = a.x), n as (
  select vec_id, cast(sum(x * x) as bigint) as xx, cast(sum(x * z) as bigint) as xz, cast(sum(x) as bigint) as x1, cast(sum(z * z) as bigint) as zz, cast(sum(z) as bigint) as z1, count(*) as n, cast(sum(x * y) as bigint) as xy, cast(sum(z * y) as bigint) as zy, cast(sum(y) as bigint) as y1 from p group by 1
)"""


def fit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 8 > 0)
    points = F.transform(at, lambda i: F.struct(F.get("a", i).alias("x"), F.get("a", i - 1).alias("z"), F.get("b", i).alias("y")))
    return pairs(spark, sf_dir).select("vec_id", F.explode(points).alias("p")).select("vec_id", "p.*")


@query(f"with {NORMAL_SQL} select * from n")
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.normal_equations(fit_points(spark, sf_dir), "vec_id")


def _det(*m: str) -> str:
    a, b, c, d, e, f, g, h, i = (f"cast({x} as double)" for x in m)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@query(f"""with {NORMAL_SQL}, d as (select vec_id, {_det('xx', 'xz', 'x1', 'xz', 'zz', 'z1', 'x1', 'z1', 'n')} as det, {_det('xy', 'xz', 'x1', 'zy', 'zz', 'z1', 'y1', 'z1', 'n')} as d0, {_det('xx', 'xy', 'x1', 'xz', 'zy', 'z1', 'x1', 'y1', 'n')} as d1, {_det('xx', 'xz', 'xy', 'xz', 'zz', 'zy', 'x1', 'z1', 'y1')} as d2 from n)
select vec_id, round(case when det <> 0 then d0 / det end, 5) as kx, round(case when det <> 0 then d1 / det end, 5) as kz, round(case when det <> 0 then d2 / det end, 3) as k1 from d""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.solved(statistics.normal_equations(fit_points(spark, sf_dir), "vec_id"), "vec_id")
    return found.select("vec_id", F.round("kx", 5).alias("kx"), F.round("kz", 5).alias("kz"), F.round("k1", 3).alias("k1"))


# prediction: the block before stands above and to the left


@query(f"""with {BLOCK_SQL}, w(i, w) as (values {', '.join(f'({i}, {w})' for i, w in enumerate(prediction.SMOOTH[8]))}), n as (
  select c.vec_id, c.y, c.x, t.v as t, l.v as l, t7.v as r7, l7.v as b7, k.v as k, wy.w as wy, wx.w as wx from es c
  join es t on t.vec_id = c.vec_id - 1 and t.y = 7 and t.x = c.x join es l on l.vec_id = c.vec_id - 1 and l.x = 7 and l.y = c.y join es t7 on t7.vec_id = c.vec_id - 1 and t7.y = 7 and t7.x = 7
  join es l7 on l7.vec_id = c.vec_id - 1 and l7.x = 7 and l7.y = 7 join es k on k.vec_id = c.vec_id - 1 and k.y = 0 and k.x = 0 join w wy on wy.i = c.y join w wx on wx.i = c.x
), e as (select vec_id + 1 as vec_id, (cast(sum(case when y = 7 then v else 0 end) + sum(case when x = 7 then v else 0 end) as bigint) + 8) >> 4 as dc from es group by 1)
select n.vec_id, y, x, dc, cast(t as integer) as v_pred, cast(l as integer) as h_pred, (wy * t + (256 - wy) * b7 + 128) >> 8 as smooth_v, (wx * l + (256 - wx) * r7 + 128) >> 8 as smooth_h, (wy * t + (256 - wy) * b7 + wx * l + (256 - wx) * r7 + 256) >> 9 as smooth,
  cast(case when abs(t - k) <= abs(l - k) and abs(t - k) <= abs(l + t - 2 * k) then l when abs(l - k) <= abs(l + t - 2 * k) then t else k end as integer) as paeth from n join e using (vec_id)""")
def intra_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.embed_blocks(spark, sf_dir)
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.slice("block", 57, 8).alias("top"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("block", i * 8 + 7)).alias("left"), F.get("block", F.lit(0)).alias("corner"))
    at = rasters.block_samples(rows.join(before.select("vec_id"), "vec_id", "left_semi")).drop("v").join(before, "vec_id")
    at = at.withColumn("dc", prediction.mean_of_edges(F.col("top"), F.col("left"), 8)).withColumn("t", F.get("top", F.col("x"))).withColumn("l", F.get("left", F.col("y"))).withColumn("right", F.get("top", F.lit(7))).withColumn("bottom", F.get("left", F.lit(7)))
    t, left, right, bottom, wy, wx = F.col("t"), F.col("l"), F.col("right"), F.col("bottom"), prediction.smooth_weight(8, F.col("y")), prediction.smooth_weight(8, F.col("x"))
    return at.select("vec_id", "y", "x", "dc", t.alias("v_pred"), left.alias("h_pred"), prediction.smooth(t, bottom, wy).cast("long").alias("smooth_v"), prediction.smooth(left, right, wx).cast("long").alias("smooth_h"), prediction.smooth_both(t, bottom, wy, left, right, wx).cast("long").alias("smooth"), prediction.paeth(left, t, F.col("corner")).alias("paeth"))


@query(f"""with {BLOCK_SQL}, t as (select vec_id, x as i, v from es where y = 0), g as (select vec_id, i, k, w, greatest(0, least(7, i + k)) as j from t, (values (-2, 2), (-1, 4), (0, 4), (1, 4), (2, 2)) f(k, w))
select g.vec_id, g.i, cast((cast(sum(w * t.v) as bigint) + 8) >> 4 as integer) as v from g join t on t.vec_id = g.vec_id and t.i = g.j group by 1, 2""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = prediction.filtered_edge(F.slice("block", 1, 8))
    return rasters.embed_blocks(spark, sf_dir).select("vec_id", F.posexplode(edge).alias("i", "v"))


@query(f"""with {BLOCK_SQL}, c as (select vec_id, y, x, v, i, [32, 96, 128, 160, 224][i + 1] as p from es, range(5) t(i)), m as (select vec_id, y, x, any_value(v) as v, arg_min(p, abs(v - p) * 10 + i) as p from c group by 1, 2, 3)
select vec_id, y, x, cast(p as integer) as predicted, cast(v - p as integer) as residual from m""")
def palette_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = [32, 96, 128, 160, 224]
    at = palette.nearest(rasters.block_samples(rasters.embed_blocks(spark, sf_dir)), colours)
    p = F.get(F.array(*map(F.lit, colours)), F.col("centre"))
    return at.select("vec_id", "y", "x", p.alias("predicted"), (F.col("v") - p).alias("residual"))


CFL_SQL = f"""{BLOCK_SQL}, s as (select vec_id, y // 2 as r, x // 2 as c, cast(sum(v) as bigint) << 1 as q from es group by 1, 2, 3), m as (select vec_id, (cast(sum(q) as bigint) + 8) >> 4 as mean from s group by 1), ac as (select vec_id, r * 4 + c as i, q - mean as ac from s join m using (vec_id))"""


@query(f"with {CFL_SQL} select vec_id, cast(i as integer) as i, ac from ac")
def cfl_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.embed_blocks(spark, sf_dir).select("vec_id", F.posexplode(blocks.luma_ac(F.col("block"))).alias("i", "ac"))


@query(f"""with {CFL_SQL}, k as (select vec_id, i, ac, block[i + 1] as v from ac join (select vec_id - 1 as vec_id, block from eb) using (vec_id)), d as (select vec_id, (cast(sum(v) as bigint) + 8) >> 4 as dc from k group by 1), n as (
  select vec_id, any_value(dc) as dc, cast(sum((v - dc) * ac) as bigint) as num, cast(sum(ac * ac) as bigint) as den from k join d using (vec_id) group by 1
), a as (select vec_id, dc, case when den = 0 then 0 else greatest(-16, least(16, (64 * num + (den // 2) * sign(num)::bigint) // den)) end as a0, den from n), e as (
  select a.vec_id, a0 + o as a, any_value(den) as den, sum((v - greatest(0, least(255, dc + case when (a0 + o) * ac < 0 then -((-(a0 + o) * ac + 32) >> 6) else ((a0 + o) * ac + 32) >> 6 end))) ** 2) as err from a join k using (vec_id), range(-3, 4) g(o) where abs(a0 + o) <= 16 group by 1, 2
) select vec_id, cast(case when any_value(den) = 0 then 0 else arg_min(a, err * 64 + a + 20) end as integer) as alpha from e group by 1""")
def cfl_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block's luma predicts the first 16 samples of the next block, as 4x4 chroma."""
    rows = blocks.successive(rasters.embed_blocks(spark, sf_dir))
    return blocks.chroma_alpha(rows.select("vec_id", blocks.luma_ac(F.col("a")).alias("ac"), F.slice("b", 1, 16).alias("v"))).select("vec_id", "alpha")


@query(f"""with {BLOCK_SQL}, b(k, j, c) as (values {_rows(transforms.ADST8)}) select vec_id, y, cast(k as integer) as k, (cast(sum(c * v) as bigint) + 2048) >> 12 as coefficient from es join b on b.j = es.x group by 1, 2, 3""")
def adst8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rows of each block."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.struct(y.alias("y"), F.slice("block", y * 8 + 1, 8).alias("v")))
    each = rasters.embed_blocks(spark, sf_dir).select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.y", "r.v")
    return each.select("vec_id", "y", F.posexplode(transforms.adst8(F.col("v"))).alias("k", "coefficient"))


# palettes


@query(f"""with {HIST_SQL}, c as (select vec_id, value, sum(n) over (partition by vec_id order by value) as upto, sum(n) over (partition by vec_id) as total from h)
select vec_id, cast(k as integer) as k, cast(min(value) as integer) as centre from c, range(4) g(k) where upto > (2 * k + 1) * total // 8 group by 1, 2""")
def palette_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.quantiles(block_histogram(spark, sf_dir), "vec_id", 4)


@query(f"with {HIST_SQL} select vec_id, cast(value as integer) as value, cast(sum(n) over w as bigint) as w, cast(sum(n * value) over w as bigint) as s, cast(sum(n * value * value) over w as bigint) as ss from h window w as (partition by vec_id order by value)")
def histogram_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.prefix_sums(block_histogram(spark, sf_dir), "vec_id")


@query(f"""with {pattern_sql()}, v as (
  select image_id, y // 8 as bj, x // 8 as bi, round(greatest(0, sum(luma * luma) / count(*) - (sum(luma) / count(*)) * (sum(luma) / count(*))), 6) as cost from yc group by 1, 2, 3
), r as (select *, row_number() over (partition by image_id order by cost, bj, bi) as place from v) select image_id, cast(place as integer) as place, cast(bj as bigint) as by, cast(bi as bigint) as bx from r where place <= 3""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sub-blocks of least cost, ties in reading order."""
    costs = blocks.sub_block_variances(luma(spark, sf_dir), "v").withColumn("cost", F.round("variance", 6))
    place = F.row_number().over(W.partitionBy("image_id").orderBy("cost", "by", "bx"))
    return costs.withColumn("place", place).where("place <= 3").select("image_id", "place", "by", "bx")


# laws


@query("with p as (select p_partkey, cast(p_size * 2 as integer) as quality from part) select p_partkey, quality, cast(greatest(1, least(254, (100 - quality) * 254 // 99)) as integer) as q from p")
def linear_quality_to_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rasters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 2).cast("int").alias("quality"))
    return parts.withColumn("q", laws.linear_quality_to_q(F.col("quality")))


@query("with p as (select p_partkey, [8, 10, 12][p_partkey % 3 + 1] as depth, ['444', '422', '420', '400'][p_partkey % 4 + 1] as chroma from part) select p_partkey, case when depth = 12 or chroma = '422' then 2 when chroma = '444' then 1 else 0 end as profile from p")
def sequence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n, *x: F.get(F.array(*map(F.lit, x)), (F.col("p_partkey") % n).cast("int"))
    return rasters.table(spark, sf_dir, "part").select("p_partkey", laws.profile(pick(3, 8, 10, 12), pick(4, "444", "422", "420", "400")).alias("profile"))


@query(f"""{Q_SQL}, l as (select p_partkey, q, least(2, case when q <= 20 then 15 when q <= 48 then floor(15 - 7.0 * (q - 20) / 28 + 0.5) when q >= 128 then 0 else floor(8.0 * (128 - q) / 80 + 0.5) end) as pinned from p)
select p_partkey, q, cast(case when q < 12 then floor(pinned + (15 - pinned) * least(1.0, (12 - q) / 5) + 0.5) else pinned end as integer) as level from l""")
def chroma_matrix_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer_parts(spark, sf_dir).select("p_partkey", "q", laws.chroma_matrix_level(F.col("q")).alias("level"))


@query(f"""{Q_SQL} select p_partkey, q, cast(case when q <= 20 then 0 when q < 64 then -(28 * (q - 20) // 44) else -28 end as integer) as d420,
  cast(case when q <= 20 then 0 when q < 64 then -((28 * (q - 20) // 44) // 2) when q <= 96 then -14 when q < 136 then -((28 * (136 - q) // 40) // 2) else 0 end as integer) as d422 from p""")
def chroma_qdelta_subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer_parts(spark, sf_dir).select("p_partkey", "q", *[laws.subsampled_chroma_delta(F.col("q"), c).alias(f"d{c}") for c in ("420", "422")])


@query(f"""{Q_SQL}, k as (select p_partkey, q, unnest([24.5, 35.0]) as k0, unnest([21.3, 21.2]) as k1, unnest([18.2, 18.1]) as k2, unnest([true, false]) as subsampled from p)
select p_partkey, subsampled, round(cast(case when q <= 28 then k0 when q >= 140 then k2 when q <= 81 then k0 + (k1 - k0) * (q - 28) / 53 else k1 + (k2 - k1) * (q - 81) / 59 end as double), 6) as price from k""")
def satd_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("subsampled"), laws.satd_price(F.col("q"), x).alias("price")) for x in (True, False)]))
    return quantizer_parts(spark, sf_dir).select("p_partkey", each.alias("e")).select("p_partkey", "e.subsampled", F.round("e.price", 6).alias("price"))


@query(f"""with {LINE_SQL} select l_orderkey, l_linenumber, cast(((r * 4 + 4) * (g + 1) + 16) >> 5 as integer) as step, cast(r * r + 3 * (g + b) as bigint) as cost from s""")
def step_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dequantizer step under a matrix weight, and distortion with the price of a rate."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return rasters.lineitem_rgb(spark, sf_dir).select(*LINE_KEYS, laws.matrix_step(r * 4 + 4, g + 1).alias("step"), laws.rd_cost(r * r, g + b, 3).cast("long").alias("cost"))


@query(f"""with {LINE_SQL}, d as (select l_orderkey, l_linenumber, r / 64 / (1000 / 203) as r, g / 64 / (1000 / 203) as g, b / 64 / (1000 / 203) as b from s), l as (select *, 0.2627 * r + 0.6780 * g + 0.0593 * b as y from d), t as (
  select l_orderkey, l_linenumber, y, case when y > 0 then r * pow(y, 1 / 1.2 - 1) end as r, case when y > 0 then g * pow(y, 1 / 1.2 - 1) end as g, case when y > 0 then b * pow(y, 1 / 1.2 - 1) end as b from l
), c as (select *, greatest(1.0, r, g, b) as m from t), p as (select l_orderkey, l_linenumber, unnest(['r', 'g', 'b']) as channel, unnest([r / m, g / m, b / m]) as v, y from c)
select l_orderkey, l_linenumber, channel, round(cast(case when y > 0 then case when v <= 1 / 12 then sqrt(3 * v) else 0.17883277 * ln(greatest(12 * v - 0.28466892, 1e-12)) + 0.55991073 end else 0 end as double), 7) as signal from p""")
def hlg_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = tuple(F.col(c) / 64 for c in "rgb")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.round(s, 7).alias("signal")) for c, s in zip("rgb", color.hlg_signal(rgb), strict=True)]))
    return rasters.lineitem_rgb(spark, sf_dir).select(*LINE_KEYS, each.alias("e")).select(*LINE_KEYS, "e.*")


@query(f"""with {LINE_SQL}, l as (select l_orderkey, l_linenumber, pow(greatest(pow(g / 255, 32 / 2523) - 3424 / 4096, 0) / (2413 / 128 - 2392 / 128 * pow(g / 255, 32 / 2523)), 16384 / 2610) * 10 as light from s), t as (
  select l_orderkey, l_linenumber, light, case when light > 0 then least(1.0, light * pow(light, 1 / 1.2 - 1)) else 0 end as v from l
) select l_orderkey, l_linenumber, round(light, 7) as light, round(cast(case when light > 0 then case when v <= 1 / 12 then sqrt(3 * v) else 0.17883277 * ln(greatest(12 * v - 0.28466892, 1e-12)) + 0.55991073 end else 0 end as double), 7) as signal from t""")
def pq_to_hlg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey: PQ signals to light relative to HLG's peak, and to HLG signals."""
    light = color.pq_decode(F.col("g") / 255) * color.PQ_PEAK
    rows = rasters.lineitem_rgb(spark, sf_dir).withColumn("white", light)
    signal = color.hlg_signal((F.col("white"),) * 3)[0]
    return rows.select(*LINE_KEYS, F.round(F.col("white") / color.HLG_PEAK, 7).alias("light"), F.round(signal, 7).alias("signal"))


@query("select p_partkey, '6E636C78' || printf('%04X%04X%04X', p_partkey % 22, p_size, p_partkey % 700) || case when p_partkey % 2 = 0 then '80' else '00' end as payload from part")
def nclx_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return rasters.table(spark, sf_dir, "part").select("p_partkey", F.hex(color.nclx(key % 22, F.col("p_size"), key % 700, key % 2 == 0)).alias("payload"))


@query("""with o as (select o_orderkey, o_orderkey * 977 % 5000000 as x from orders), k as (select o_orderkey, x, k, (x >> cast(7 * k as integer)) & 127 as low, (x >> cast(7 * (k + 1) as integer)) > 0 as more from o, range(5) g(k) where k = 0 or (x >> cast(7 * k as integer)) > 0)
select o_orderkey, string_agg(printf('%02X', low + case when more then 128 else 0 end), '' order by k) as coded from k group by 1""")
def leb128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.table(spark, sf_dir, "orders").select("o_orderkey", F.hex(color.leb128(F.col("o_orderkey") * 977 % 5000000)).alias("coded"))


# motion and references


@query(f"""with {FRAMES_SQL}, g as (select frame, i // 8 as y, i % 8 as x, v from ef), c as (
  select a.frame, dy, dx, cast(sum(abs(a.v - p.v)) as bigint) + 2 * cast(2 + 2 * (floor(log2(abs(dy) + 1)) + 1) + (dy <> 0)::int + 2 * (floor(log2(abs(dx) + 1)) + 1) + (dx <> 0)::int as bigint) as cost
  from g a, range(-2, 3) r(dy), range(-2, 3) s(dx), g p where a.y between 2 and 5 and a.x between 2 and 5 and p.frame = a.frame - 1 and p.y = a.y + dy and p.x = a.x + dx group by 1, 2, 3
), r as (select *, row_number() over (partition by frame order by cost, dy, dx) as k from c) select frame, cast(dy as integer) as dy, cast(dx as integer) as dx, cost from r where k = 1""")
def motion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner 4x4 of each 8x8 frame in the frame before, two samples each way."""
    return motion.exhaustive(rasters.event_frames(spark, sf_dir), 8, 2, 4, 2, weight=2)


@query(f"""with {FRAMES_SQL}, k as (select frame, frame // 24 as gop, row_number() over (partition by frame // 24 order by frame) - 1 as n, frame % 24 = 0 as key from sad), s as (select *, n % 3 as slot from k)
select a.frame, cast(a.slot as integer) as slot, cast(row_number() over (partition by a.frame order by b.n desc) as integer) as place, b.frame as ref, cast(b.slot as integer) as ref_slot from s a join s b on a.gop = b.gop and b.n between a.n - 3 and a.n - 1 where a.gop * 24 in (select frame from sad)""")
def reference_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rasters.event_frames(spark, sf_dir).select("frame", F.expr("frame div 24").alias("gop"))
    whole = frames.where("frame % 24 = 0").select("gop")
    return motion.slots(frames.join(whole, "gop", "left_semi"))
