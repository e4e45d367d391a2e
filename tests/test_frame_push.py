import random

from pyspark.sql import functions as F

from pixelmill.operators import frames as batch_frames
from pixelmill.streaming import frame_push

SCHEMA = "stream long, frame long, samples array<int>"


def made(seed, count, streams=(0, 1, 5)):
    rng = random.Random(seed)
    return [(s, f, [rng.choice([10, 10 + 60 * (f // 7 % 2)]) + rng.randrange(40) for _ in range(16)]) for s in streams for f in range(count)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x if not isinstance(x, list) else tuple(x)) for x in r[:3]))


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    """Micro-batches of a file each; the query is stopped half way and begun again from its checkpoint, with broken frames between."""
    rows = made(1, 40)
    broken = [(0, 11, None), (1, 11, [1, 2]), (5, 30, [1, None] * 8), (5, 3, [9] * 16)]
    for part in range(4):
        inside = [r for r in rows if r[1] // 10 == part and not (r[1], r[0]) in {(11, 0), (11, 1), (30, 5)}] + [b for b in broken[:3] if b[1] // 10 == part] + (broken[3:] if part == 2 else [])
        random.Random(part).shuffle(inside)
        spark.createDataFrame(inside, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")

    def run(parts):
        for p in parts:
            spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in{p}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = frame_push.push(source, 16, 20, 3)
        q = found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    run([0])
    run([1])
    run([2, 3][:1])
    run([3])
    got = spark.read.parquet(f"{tmp_path}/out")
    errors = {(r["stream"], r["frame"], r["error"]) for r in got.where("error is not null").collect()}
    assert errors == {(0, 11, "no samples"), (1, 11, "other size"), (5, 30, "no samples"), (5, 3, "late")}
    good = [r for r in rows if (r[1], r[0]) not in {(11, 0), (11, 1), (30, 5)}]
    once = frame_push.push(spark.createDataFrame(good, SCHEMA), 16, 20, 3)
    assert rows_of(got.where("error is null").select(once.columns)) == rows_of(once) and got.where("key and place % 16 != 0").count() > 0


def test_decisions_equal_the_batch_operators(spark):
    rows = spark.createDataFrame(made(2, 50, (3,)), SCHEMA)
    found = {r["frame"]: r for r in frame_push.push(rows, 24, 20, 3).collect()}
    sads = {r["frame"]: r["sad"] for r in batch_frames.mean_sad(rows).collect()}
    assert {f: r["sad"] for f, r in found.items()} == sads
    stats = spark.createDataFrame([(3, f, s) for f, s in sads.items()], "stream long, frame long, sad long")
    assert {f: r["key"] for f, r in found.items()} == {r["frame"]: r["key"] for r in batch_frames.key_frames(stats, 24, 20, 3).collect()}
    means = {r["frame"]: r["mean"] for r in batch_frames.lookahead(stats, "sad", 8).collect()}
    assert all(abs(found[f]["mean"] - m) < 1e-9 for f, m in means.items())
    keys = [f for f, r in found.items() if r["key"]]
    for f, r in found.items():
        last = max(k for k in keys if k <= f)
        assert r["refs"] == [k for k in (f - 1, f - 2, f - 3) if k >= last] and r["slot"] == (f - last) % 3


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, [1]), (None, 1, [1]), (2, 1, [5]), (2, 1, [4]), (2, 9, []), (2, -3, [7]), (2, 20, [9])], SCHEMA).withColumn("key", F.lit("x"))
    found = sorted((str(r["stream"]), str(r["frame"]), str(r["error"]), str(r["sad"])) for r in frame_push.push(rows, 8, 0, 0).collect())
    assert found == [("1", "None", "no number", "None"), ("2", "-3", "None", "0"), ("2", "1", "None", "3"), ("2", "1", "late", "None"), ("2", "20", "None", "5"), ("2", "9", "no samples", "None"), ("None", "1", "no number", "None")]
    assert frame_push.push(rows.limit(0), 8, 0, 0).count() == 0
