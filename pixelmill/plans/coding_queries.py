"""Queries of copies, index maps, transforms and prediction inside images: name to (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import laws
from pixelmill.operators import adaptive_grid, causal_copies, directional, index_maps, integer_transforms, palette, screen_gate
from pixelmill.operators import chroma_fit as fit
from pixelmill.plans.raster_queries import BLOCK_SQL, Plan, block_histogram
from pixelmill.sources import rasters

QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


@query(f"""with {BLOCK_SQL}, planes as (
  select vec_id // 40 as image, list(list_transform(range(64), lambda x: block[x % 20 + 1]) order by vec_id) as p from eb where vec_id % 40 < 12 group by 1 having count(*) = 12
), w as (
  select image, y, x, list_transform(range(8), lambda j: p[(y + j) % 12 + 1][x + 1 : x + 8]) as samples, (y + 7) // 16 as r, (x + 7) // 16 as c from planes, range(33) ys(y), range(57) xs(x)
), f as (
  select q.image, q.y, q.x, s.y as ref_y, s.x as ref_x, row_number() over (partition by q.image, q.y, q.x order by s.r desc, s.c desc, s.y desc, s.x desc) as k
  from w q join w s on s.image = q.image and s.samples = q.samples where q.y % 8 = 0 and q.x % 8 = 0 and ((s.r < q.r and s.c <= q.c + 2 * (q.r - s.r)) or (s.r = q.r and s.c < q.c))
) select image, cast(y as integer) as y, cast(x as integer) as x, cast(ref_y as integer) as ref_y, cast(ref_x as integer) as ref_x from f where k = 1""")
def causal_copies_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest legal exact copy of every 8x8 block, with superblocks of 16, in images that repeat every 12 rows and 20 columns."""
    return causal_copies.latest(rasters.repeating_images(spark, sf_dir), 8, 16)


@query()
def smoothed_palette_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index map of every block over its own four best centres, by error and price; tested against all rows."""
    blocks = rasters.embed_blocks(spark, sf_dir)
    centres = palette.clustered(block_histogram(spark, sf_dir), "vec_id", 4)
    found = index_maps.smooth_maps(blocks.join(centres, "vec_id"), 8, weight=40)
    return found.select("vec_id", F.posexplode("indices").alias("i", "centre"))


PLANES_SQL = f"{BLOCK_SQL}, planes as (select vec_id // 16 as image, flatten(list(block order by vec_id)) as p from eb group by 1 having count(*) = 16)"


class Lane:
    """A value in a SELECT: arithmetic on it adds an alias that later ones may use."""

    def __init__(self, made: list[str], of: str) -> None:
        self.made, self.name = made, f"t{len(made)}"
        made.append(f"{of} as {self.name}")

    def __add__(self, other: Lane) -> Lane:
        return Lane(self.made, f"{self.name} + {other.name}")

    def __sub__(self, other: Lane) -> Lane:
        return Lane(self.made, f"{self.name} - {other.name}")


def lanes_sql(n: int, source: str, keys: str) -> str:
    made: list[str] = []
    out = integer_transforms.forward_lanes([Lane(made, f"v[{i + 1}]") for i in range(n)], lambda x, w: Lane(made, f"(({x.name} * {w} + 32768) >> 16)"))
    return f"select {keys}, [{', '.join(x.name for x in out)}] as v from (select *, {', '.join(made)} from {source})"


def transform_sql(height: int, width: int, tag: str) -> str:
    block = f"(y // {height}) * {32 // width} + x // {width}"
    return f"""{tag}_columns as (select image, {block} as block, x % {width} as x, list(v order by y) as v from samples group by 1, 2, 3), {tag}_down as ({lanes_sql(height, f"{tag}_columns", "image, block, x")}),
  {tag}_rows as (select image, block, k as y, list(v[k + 1] order by x) as v from {tag}_down, range({height}) g(k) group by 1, 2, 3), {tag}_across as ({lanes_sql(width, f"{tag}_rows", "image, block, y")}),
  {tag}_found as (select image, {height} as height, {width} as width, cast(block as integer) as block, cast(y * {width} + k as integer) as i, cast((v[k + 1] * {integer_transforms.scale(height, width)} + 32768) >> 16 as integer) as coefficient from {tag}_across, range({width}) g(k))"""


@query(f"""with {PLANES_SQL}, samples as (select image, k // 32 as y, k % 32 as x, p[k + 1] - 128 as v from planes, range(1024) g(k)), {transform_sql(8, 8, "square")}, {transform_sql(8, 16, "wide")}
select * from square_found union all select * from wide_found""")
def integer_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number transforms of 8x8 and 8x16 blocks of planes."""
    planes = rasters.stacked_planes(spark, sf_dir).select("image", F.transform("samples", lambda v: v - 128).alias("samples"))
    found = integer_transforms.coefficients(planes, 32, [(8, 8), (8, 16)])
    return found.select("image", "height", "width", "block", F.posexplode("coefficients").alias("i", "coefficient"))


@query()
def integer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every block of every shape after forward and inverse transform; tested to be within two of the planes'."""
    planes = rasters.stacked_planes(spark, sf_dir).select("image", F.transform("samples", lambda v: v - 128).alias("samples"))
    shapes = [(h, w) for h in integer_transforms.SIDES for w in integer_transforms.SIDES if max(h, w) <= 4 * min(h, w)]
    found = integer_transforms.round_trip(planes, 32, shapes)
    return found.select("image", "height", "width", "block", F.posexplode("samples").alias("i", "sample"))


def _upsampled(edge: str, n: str) -> str:
    """An edge (list from the corner on) at half samples, as doubled() has it."""
    at = lambda k: f"{edge}[greatest(1, least({n} + 1, i + {k})) :: int]"
    return f"list_prepend({edge}[1], flatten(list_transform(range(0, {n}), lambda i: [greatest(0, least(255, (9 * ({at(1)} + {at(2)}) - {at(0)} - {at(3)} + 8) >> 4)), {edge}[i + 2]])))"


def _filtered(edge: str, n: str) -> str:
    return f"list_transform(range(0, 17), lambda i: case when i = 0 or i > {n} then {edge}[i + 1] else (4 * {edge}[i] + 8 * {edge}[i + 1] + 4 * {edge}[least(i + 1, {n}) + 1] + 8) >> 4 end)"


def _ready(edge: str, from_: int, n: str) -> str:
    return f"case when angle in (90, 180) then {edge} when abs(angle - {from_}) >= 40 then {_filtered(edge, n)} when abs(angle - {from_}) > 0 then {_upsampled(edge, n)} else {edge} end"


def _between(edge: str, up: str, base: str, along: str) -> str:
    share = f"((({along} << {up}) >> 1) & 31)"
    return f"(({edge}[{base} + {up} + 2] * (32 - {share}) + {edge}[{base} + {up} + 3] * {share} + 16) >> 5)"


@query(f"""with {PLANES_SQL}, steps(a, step) as (values {", ".join(f"({a}, {s})" for a, s in directional.STEPS.items())}), angles(angle) as (values {", ".join(f"({a})" for a in directional.ANGLES)}), b as (
  select image, p, cast(by_ * 4 + bx_ as integer) as block, 8 * by_ as y0, 8 * bx_ as x0 from planes, range(4) r(by_), range(4) c(bx_)
), e as (
  select *, case when y0 > 0 and x0 > 0 then p[(y0 - 1) * 32 + x0] when x0 > 0 then p[y0 * 32 + x0] when y0 > 0 then p[(y0 - 1) * 32 + x0 + 1] else 128 end as corner from b
), l as (
  select image, p, block, y0, x0, list_prepend(corner, list_transform(range(16), lambda k: case when y0 > 0 then p[(y0 - 1) * 32 + least(31, x0 + k) + 1] when x0 > 0 then p[y0 * 32 + x0] else 127 end)) as above,
    list_prepend(corner, list_transform(range(16), lambda k: case when x0 > 0 then p[least(31, y0 + k) * 32 + x0] when y0 > 0 then p[(y0 - 1) * 32 + x0 + 1] else 129 end)) as beside from e
), n as (
  select image, p, block, y0, x0, angle, {_ready("above", 90, "(case when angle < 90 then 16 else 8 end)")} as above, {_ready("beside", 180, "(case when angle > 180 then 16 else 8 end)")} as beside,
    (abs(angle - 90) between 1 and 39)::int as ua, (abs(angle - 180) between 1 and 39)::int as ul, coalesce(d.step, 0) as dx, coalesce(v.step, 0) as dy
  from l, angles left join steps d on d.a = case when angle < 90 then angle else 180 - angle end left join steps v on v.a = case when angle > 180 then 270 - angle else angle - 90 end
), s as (
  select image, block, angle, y, x, p[(y0 + y) * 32 + x0 + x + 1] as own, case when angle = 90 then above[x + 2] when angle = 180 then beside[y + 2]
    when angle < 90 then case when (((y + 1) * dx) >> (6 - ua)) + (x << ua) < 15 << ua then {_between("above", "ua", "(((y + 1) * dx) >> (6 - ua)) + (x << ua)", "((y + 1) * dx)")} else above[(15 << ua) + ua + 2] end
    when angle > 180 then {_between("beside", "ul", "(((x + 1) * dy) >> (6 - ul)) + (y << ul)", "((x + 1) * dy)")}
    when ((64 * x - (y + 1) * dx) >> (6 - ua)) >= -(1 << ua) then {_between("above", "ua", "((64 * x - (y + 1) * dx) >> (6 - ua))", "((64 * x - (y + 1) * dx) + 65536)")}
    else {_between("beside", "ul", "((64 * y - (x + 1) * dy) >> (6 - ul))", "((64 * y - (x + 1) * dy) + 65536)")} end as predicted from n, range(8) r(y), range(8) c(x)
) select image, block, cast(angle as integer) as angle, cast(sum(abs(own - predicted)) as bigint) as sad, cast(sum(predicted * (8 * y + x + 1)) as bigint) as weighed from s group by 1, 2, 3""")
def directional_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of 56 directions is off for each 8x8 block of planes, and a sum of its samples weighed by place."""
    found = directional.by_angle(rasters.stacked_planes(spark, sf_dir), 32, 8)
    return found.select("image", "block", "angle", "sad", F.expr("aggregate(transform(samples, (v, i) -> v * (i + 1L)), 0L, (a, x) -> a + x)").alias("weighed"))


@query()
def filter_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 8x8 block of planes by the five recursive filters; tested against a plain version."""
    found = directional.by_filter(rasters.stacked_planes(spark, sf_dir), 32, 8)
    return found.select("image", "block", "mode", "sad", F.posexplode("samples").alias("i", "predicted"))


@query()
def chroma_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 8x8 block of a plane by the plane before it, in the direction that fits best; tested against plain whole numbers."""
    planes = rasters.stacked_planes(spark, sf_dir)
    both = planes.select("image", F.col("samples").alias("luma")).join(planes.select((F.col("image") - 1).alias("image"), F.col("samples").alias("chroma")), "image")
    found = fit.best(fit.fits(both, 32))
    return found.select("image", "block", "direction", "sad", *[F.col("parameters")[k].alias(f"p{k}") for k in range(fit.TERMS)])


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, height, width, samples): repeating images, the same in two or six colours (every third, or each after it), and planes, which are noise."""
    coarse = "transform(samples, v -> case image % 3 when 0 then if(v < 128, 30, 220) when 1 then least(250, v div 50 * 50) else v end)"
    repeated = rasters.repeating_images(spark, sf_dir).select((F.col("image") * 2).alias("image"), "height", "width", F.expr(coarse).alias("samples"))
    return repeated.unionByName(rasters.stacked_planes(spark, sf_dir).select((F.col("image") * 2 + 1).alias("image"), F.lit(32).alias("height"), F.lit(32).alias("width"), F.col("samples").cast("array<bigint>").alias("samples")), allowMissingColumns=True)


QUARTER_ENERGY = "list_sum(list_transform(range(64), lambda k: case when k % 8 > 0 then (v[k + 1] - v[k]) * (v[k + 1] - v[k]) else 0 end + case when k >= 8 then (v[k + 1] - v[k - 7]) * (v[k + 1] - v[k - 7]) else 0 end))"


@query(f"""with {PLANES_SQL}, tiled as (
  select vec_id // 40 as image, list(list_transform(range(64), lambda x: block[x % 20 + 1]) order by vec_id) as p from eb where vec_id % 40 < 12 group by 1 having count(*) = 12
), imgs as (
  select image * 2 as image, 40 as h, 64 as w, list_transform(flatten(list_transform(range(40), lambda y: p[y % 12 + 1])), lambda v: case image % 3 when 0 then case when v < 128 then 30 else 220 end when 1 then least(250, v // 50 * 50) else v end) as s from tiled
  union all select image * 2 + 1, 32, 32, p from planes
), wins as (
  select image, y, x, flatten(list_transform(range(8), lambda j: s[(y + j) * w + x + 1 : (y + j) * w + x + 8])) as v, (y + 7) // 16 as r, (x + 7) // 16 as c, h, w from imgs, range(33) ys(y), range(57) xs(x) where y <= h - 8 and x <= w - 8
), q8 as (
  select *, {QUARTER_ENERGY} as e, len(list_distinct(v)) as n, list_max(v) - list_min(v) as span from wins where y % 8 = 0 and x % 8 = 0 and y < h // 16 * 16 and x < w // 16 * 16
), b16 as (
  select image, y // 16 * 16 as py, x // 16 * 16 as px, sum(e) as mass, len(list_distinct(flatten(list(v)))) as n, list_max(flatten(list(v))) - list_min(flatten(list(v))) as span, count(*) filter (e > 0 and not (n <= 12 and span >= 64)) as photo from q8 group by 1, 2, 3
), s1 as (
  select image, count(*) as blocks, count(*) filter (n <= 8 and span >= 64) as few, count(*) filter (n <= 16 and span >= 64) as lenient from b16 group by 1
), d8 as (select image, count(*) - count(distinct v) as repeats from q8 where e > 0 group by 1), passed as (
  select s1.image from s1 left join d8 using (image) where lenient / blocks >= 0.02 or coalesce(repeats, 0) / (4 * blocks) >= 0.02
), f as (
  select q.image, q.y, q.x, t.y as ref_y, t.x as ref_x, row_number() over (partition by q.image, q.y, q.x order by t.r desc, t.c desc, t.y desc, t.x desc) as k
  from q8 q join wins t on t.image = q.image and t.v = q.v where q.image in (select image from passed) and ((t.r < q.r and t.c <= q.c + 2 * (q.r - t.r)) or (t.r = q.r and t.c < q.c))
), moves as (
  select image, y // 16 * 16 as py, x // 16 * 16 as px, y // 16 * 16 + ref_y - y as ry, x // 16 * 16 + ref_x - x as rx from f where k = 1
), res as (
  select a.image, py, px, min(list_sum(list_transform(range(256), lambda k: (s[(py + k // 16) * w + px + k % 16 + 1] - s[(ry + k // 16) * w + rx + k % 16 + 1]) * (s[(py + k // 16) * w + px + k % 16 + 1] - s[(ry + k // 16) * w + rx + k % 16 + 1])))) as res
  from moves a join imgs i on i.image = a.image where (abs(ry - py) >= 16 or abs(rx - px) >= 16) and ry between 0 and h // 16 * 16 - 16 and rx between 0 and w // 16 * 16 - 16 group by 1, 2, 3
), g as (
  select b.*, case when res is null then 0 else greatest(0, mass - res - 1600) end as gain from b16 b left join res using (image, py, px) where b.image in (select image from passed)
), t as (
  select image, sum(gain) as gain, sum(photo) filter (gain = 0 and not (n <= 8 and span >= 64)) as photo, count(*) filter (gain > 0) as copied from g group by 1
) select s1.image, few / blocks >= 0.1 as few_colours, coalesce(copied >= 4 and gain > coalesce(photo, 0) * 32.0 * 40, false) as copies_pay, few / blocks as few_share, cast(gain as bigint) as gain, cast(case when gain is not null then coalesce(photo, 0) * 32.0 * 40 end as double) as loss from s1 left join t using (image)""")
def screen_gate_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether images are screen content, by colours and by what copies gain, at a quantizer step of 40."""
    return screen_gate.gate(sheets(spark, sf_dir), 40, superblock=16)


VARIANCE_SQL = "greatest(0, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)))"
STEP_SQL = f"{list(laws.WIDE_STEPS[1:])}[({{0}} - 1) % 24 + 1] << (({{0}} - 1) // 24)"
GRID_BASE, GRID_UV = 120, -12


@query(f"""with recursive {BLOCK_SQL}, strips as (select vec_id // 40 as image, list(block order by vec_id) as rows from eb group by 1 having count(*) = 40), px as (
  select image, y, x, y // 64 as r, x // 64 as c, greatest(0, least(255, 24 + 40 * ((image + y // 64 * 3 + x // 64) % 5) + ((rows[(y + 8 * (x // 64)) % 40 + 1][x % 64 + 1] - 128) >> ((5 * image + 3 * (y // 64 * 3 + x // 64)) % 7)))) as v
  from strips, range(128) ys(y), range(160) xs(x)
), subs as (select image, r, c, {VARIANCE_SQL} as s from px group by image, r, c, y // 8, x // 8), cells as (
  select image, r, c, list_sort(list(s) || list_transform(range(64 - count(*)), lambda k: avg(s)))[48] as picked from subs group by 1, 2, 3
), activity as (select image, r, c, ln(1 + {VARIANCE_SQL}) as a from px group by 1, 2, 3), anchors as (select image, 0.95 * avg(a) as anchor from activity group by 1), t as (
  select image, r, c, r * 3 + c as k, c < 2 as signals, greatest(1, least(255, {GRID_BASE} + cast(case when ln(1 + picked) < 5.549076 then -floor(least((5.549076 - ln(1 + picked)) * 5.0, 18.0) + 0.5) else floor(least(greatest(ln(1 + picked) - greatest(anchor, 5.549076), 0.0) * 6.0, 16.0) + 0.5) end as integer))) as target
  from cells join anchors using (image)
), f as (
  select image, -1::bigint as k, 0 as signal, {GRID_BASE} as q from anchors
  union all
  select f.image, t.k, cast(case when signals then sign(target - q) * least(6, (abs(target - q) + 2) // 4) else 0 end as integer) as signal, cast(case when signals then greatest(1, least(255, q + sign(target - q) * least(6, (abs(target - q) + 2) // 4) * 4)) else q end as integer) as q
  from f join t on t.image = f.image and t.k = f.k + 1
), g as (select image, r as row, c as col, target, signal, q, {STEP_SQL.format('q')} as step, {STEP_SQL.format(f'greatest(1, least(255, q + {GRID_UV}))')} as chroma_step from f join t using (image, k))
select *, ({STEP_SQL.format(GRID_BASE)}) / step as scale, ({STEP_SQL.format(GRID_BASE)}) / chroma_step as chroma_scale from g""")
def adaptive_quantizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, signalled steps and running quantizers of all superblocks of images of uneven contrast, some at the edge."""
    return adaptive_grid.grid(rasters.contrast_sheets(spark, sf_dir), GRID_BASE, GRID_UV)
