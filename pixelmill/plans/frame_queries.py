"""Queries of the frame stream operators: name to (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators import frames
from pixelmill.plans.raster_queries import Plan
from pixelmill.sources import rasters
from pixelmill.streaming import frame_push

QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = (plan, sql)
        return plan

    return put


FRAMES_SQL = """e as (select event_id // 64 as frame, event_id % 64 as i, cast(floor(value) as bigint) % 256 as v from events), ef as (
  select * from e where frame in (select frame from e group by frame having count(*) = 64)
), fs as (select frame from ef group by frame), sad as (
  select f.frame, coalesce(d.sad, 0) as sad from fs f left join (select a.frame, cast(sum(abs(a.v - b.v)) as bigint) // 64 as sad from ef a join ef b on b.frame = a.frame - 1 and b.i = a.i group by 1) d using (frame)
)"""
ACTIVITY_SQL = """act as (
  select a.frame, sum(abs(b.v - a.v)) / 112 as activity from ef a join ef b on a.frame = b.frame and ((b.i = a.i + 1 and a.i % 8 < 7) or b.i = a.i + 8) group by 1
)"""


@query(f"with {FRAMES_SQL} select frame, sad from sad")
def frame_mean_sad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.mean_sad(rasters.event_frames(spark, sf_dir))


@query(f"with {FRAMES_SQL} select frame, round(coalesce(avg(sad) over (order by frame rows between 8 preceding and 1 preceding), 0), 9) as mean from sad")
def lookahead_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frames.lookahead(frames.mean_sad(rasters.event_frames(spark, sf_dir)), "sad", 8, span=64)
    return found.select("frame", F.round("mean", 9).alias("mean"))


@query(f"""with {FRAMES_SQL}, {ACTIVITY_SQL}, m as (
  select frame, sad, activity, coalesce(avg(sad) over w, 0) as tm, coalesce(avg(activity) over w, 0) as sm from sad join act using (frame) window w as (order by frame rows between 8 preceding and 1 preceding)
) select frame, cast(case when tm <= 0 and sm <= 0 then 100 else greatest(1, least(254, 100 + greatest(-12, least(12, round(3 * log2((sad + 1) / (tm + 1)) - 2 * log2((activity + 1) / (sm + 1))))))) end as integer) as quantizer from m""")
def cq_qindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.event_frames(spark, sf_dir)
    return frames.quantizers(frames.mean_sad(rows).join(frames.activity(rows), "frame"))


@query(f"with {FRAMES_SQL} select frame, frame % 24 = 0 as key from sad")
def gop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.event_frames(spark, sf_dir).select("frame", (F.col("frame") % 24 == 0).alias("key"))


@query(f"""with recursive {FRAMES_SQL}, k as (
  select frame, true as key, 0 as since from sad where frame = (select min(frame) from sad)
  union all
  select s.frame, s.frame % 48 = 0 or (s.sad >= 75 and k.since >= 3), case when s.frame % 48 = 0 or (s.sad >= 75 and k.since >= 3) then 0 else k.since + 1 end from k join sad s on s.frame = k.frame + 1
) select frame, key from k""")
def scene_cut_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = frames.mean_sad(rasters.event_frames(spark, sf_dir)).withColumn("stream", F.lit(0).cast("long"))
    return frames.key_frames(stats, 48, 75, 3).select("frame", "key")


@query(f"""with {FRAMES_SQL}, c as (
  select a.frame, b.frame as ref, 4 * (cast(sum(abs(a.v - b.v)) as bigint) // 64) as score from ef a join ef b on b.i = a.i and b.frame between a.frame - 4 and a.frame - 1 group by 1, 2
), r as (select frame, ref, cast(row_number() over (partition by frame order by score, ref desc) as integer) as place from c) select frame, place, ref from r where place <= 2""")
def topk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.references(rasters.event_frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL}, b as (
  select a.frame, a.i // 16 as b, sum(abs(a.v - p.v)) as s0, sum(abs(a.v - q.v)) as s1 from ef a join ef p on p.frame = a.frame - 1 and p.i = a.i join ef q on q.frame = a.frame - 2 and q.i = a.i group by 1, 2
) select frame, count(*) filter (s1 * 12 < s0 * 10 and s0 > 32) / count(*) as share from b group by frame""")
def reference_preferred_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.second_preferred(rasters.event_frames(spark, sf_dir))


@query("""with recursive e as (select event_id // 64 as frame, event_id % 64 as i, cast(floor(value) as bigint) % 256 as v from events), ef as (
  select frame, frame // 48 as stream, list(v order by i) as v, row_number() over (partition by frame // 48 order by frame) - 1 as place from e group by frame having count(*) = 64
), s as (
  select f.stream, f.frame, f.place, coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(f.v[i] - b.v[i])))::bigint // 64, 0) as sad from ef f left join ef b on b.stream = f.stream and b.place = f.place - 1
), m as (
  select *, round(coalesce(avg(sad) over (w rows between 8 preceding and 1 preceding), 0), 9) as mean, lag(frame, 1) over w as r1, lag(frame, 2) over w as r2, lag(frame, 3) over w as r3 from s window w as (partition by stream order by place)
), k as (
  select stream, place, true as key, 0 as since, 0 as at from m where place = 0
  union all
  select m.stream, m.place, m.place % 24 = 0 or (m.sad >= 75 and k.since >= 3), case when m.place % 24 = 0 or (m.sad >= 75 and k.since >= 3) then 0 else k.since + 1 end, case when m.place % 24 = 0 or (m.sad >= 75 and k.since >= 3) then 0 else k.at + 1 end
  from k join m on m.stream = k.stream and m.place = k.place + 1
) select m.stream, m.frame, m.place, k.key, m.sad, m.mean, cast(k.at % 3 as integer) as slot, case when k.at >= 1 then r1 end as ref1, case when k.at >= 2 then r2 end as ref2, case when k.at >= 3 then r3 end as ref3 from m join k using (stream, place)""")
def pushed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames pushed with state, 48 to a stream: the streaming operator over a table."""
    rows = rasters.event_frames(spark, sf_dir).withColumn("stream", F.expr("frame div 48"))
    found = frame_push.push(rows, 24, 75, 3).where("error is null")
    return found.select("stream", "frame", "place", "key", "sad", F.round("mean", 9).alias("mean"), "slot", *[F.get("refs", F.lit(k)).alias(f"ref{k + 1}") for k in range(3)])
