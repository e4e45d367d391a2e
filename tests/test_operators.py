import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import transforms
from pixelmill.operators import blocks, frames, geometry, motion, palette, statistics
from pixelmill.sources import ingest, rasters, y4m
from pixelmill.streaming.key_frames import key_frames

SF = "/root/testdata/sf0.001"


def error(values, counts, cuts):
    total = 0
    for a, b in itertools.pairwise(cuts):
        w, s, q = counts[a:b].sum(), (counts[a:b] * values[a:b]).sum(), (counts[a:b] * values[a:b] ** 2).sum()
        c = (s + w // 2) // w
        total += q - 2 * c * s + c * c * w
    return total


@pytest.mark.parametrize("seed", range(8))
def test_best_centres_are_optimal(seed):
    rng = np.random.default_rng(seed)
    values, counts, k = np.sort(rng.choice(256, 9, replace=False)), rng.integers(1, 9, 9), int(rng.integers(2, 5))
    centres = palette.best_centres(values, counts, k)
    least = min(error(values, counts, (0, *cuts, 9)) for cuts in itertools.combinations(range(1, 9), k - 1))
    nearest = np.abs(values[:, None] - np.array(centres)[None, :]).min(1)
    assert (counts * nearest**2).sum() <= least


def test_few_values_have_no_centres():
    assert palette.best_centres(np.array([3]), np.array([5]), 2) is None
    assert palette.best_centres(np.array([3, 9]), np.array([5, 1]), 2) == [3, 9]
    assert palette.lloyd(np.array([3, 9]), np.array([5, 1]), 2) == [3, 9]


def test_lloyd_finds_clear_clusters():
    values, counts = np.array([1, 2, 3, 100, 101, 102]), np.ones(6, int)
    assert palette.lloyd(values, counts, 2) == [2, 101]


def test_dct_is_orthonormal(spark):
    basis = np.array(transforms.dct_basis(8))
    assert np.allclose(basis @ basis.T, np.eye(8))
    some = rasters.embed_blocks(spark, SF).limit(3)
    for row in blocks.transform_8x8(some).join(some, "vec_id").collect():
        back = basis.T @ np.array(row["coefficients"]).reshape(8, 8) @ basis + 128
        assert np.abs(back.ravel() - np.array(row["block"])).max() < 1e-4


def test_metrics_of_equal_blocks_are_zero(spark):
    rows = spark.createDataFrame([(0, list(range(64)), list(range(64)))], "vec_id long, a array<int>, b array<int>")
    assert blocks.metrics(rows).first()[1:] == (0, 0, 0, 0, 0)


def test_walsh_keeps_a_flat_block_in_one_coefficient(spark):
    rows = spark.createDataFrame([(0, [5] * 64)], "vec_id long, block array<int>")
    found = blocks.walsh(rows).where("coefficient <> 0")
    assert found.count() == 4 and {r["k"] for r in found.collect()} == {0}


def test_orientation_is_a_permutation(spark):
    rows = rasters.grid(spark.range(1, 9).select(F.col("id").cast("int").alias("orientation")), 3, 5)
    for k, part in geometry.oriented(rows, 5, 3).toPandas().groupby("orientation"):
        high, wide = (5, 3) if k >= 5 else (3, 5)
        assert set(zip(part.shown_y, part.shown_x, strict=True)) == set(itertools.product(range(high), range(wide)))


def test_partitions_do_not_change_results(spark):
    samples = rasters.pattern_rgb(spark, SF, 7)
    one, many = (geometry.subsampled(samples.repartition(n), 7, 7, vertical=True).toPandas() for n in (1, 9))
    order = list(one.columns)
    pd.testing.assert_frame_equal(one.sort_values(order).reset_index(drop=True), many.sort_values(order).reset_index(drop=True))


def test_lookahead_spans_do_not_show(spark):
    rows = spark.range(100).select(F.col("id").alias("frame"), (F.col("id") * 7 % 13).alias("sad"))
    small, large = (frames.lookahead(rows, "sad", 5, span).orderBy("frame").collect() for span in (10, 1000))
    assert small == large


def test_streamed_keys_equal_batch(spark, tmp_path):
    random.seed(5)
    stats = pd.DataFrame([(s, f, random.randrange(100)) for s in (0, 1) for f in range(60)], columns=["stream", "frame", "sad"])
    for k in range(3):
        spark.createDataFrame(stats[stats.frame // 20 == k]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "stream long, frame long, sad long"
    batch = frames.key_frames(spark.read.schema(schema).parquet(f"{tmp_path}/in"), 24, 60, 3).toPandas()
    stream = key_frames(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in"), 24, 60, 3)
    q = stream.writeStream.outputMode("append").format("memory").queryName("keys").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    q.processAllAvailable()
    q.stop()
    order = ["stream", "frame"]
    got = spark.table("keys").toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, batch.sort_values(order).reset_index(drop=True))


def test_y4m(spark, tmp_path):
    frame = bytes(range(24))
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F25:1 C420\n" + b"".join(b"FRAME\n" + frame for _ in range(3)))
    rows = y4m.read(spark, f"{tmp_path}/*.y4m").orderBy("frame").collect()
    assert [(r["frame"], r["width"], r["height"], r["chroma"], bytes(r["planes"])) for r in rows] == [(i, 4, 4, "420", frame) for i in range(3)]
    with pytest.raises(ValueError):
        list(y4m.parse(b"RIFF"))


def test_ingest_round_trip(spark):
    images = spark.createDataFrame([(1, [10, 20, 30, 40, 11, 21, 31, 41], [1, 2, 3, 4, 5, 6])], "vec_id long, rgba array<int>, gray array<int>")
    row = ingest.interleaved(ingest.deinterleaved(images, "rgba", "rgba")).first()
    assert (row["r"], row["g"], row["b"], row["a"], row["rgb"]) == ([10, 11], [20, 21], [30, 31], [40, 41], [10, 20, 30, 11, 21, 31])
    row = ingest.deinterleaved(images.drop("g"), "gray", "ga").first()
    assert (row["g"], row["a"]) == ([1, 3, 5], [2, 4, 6])


def test_bad_images_stay_with_their_error(spark):
    rows = [(4, 3, 50, 12, 4, None), (4, 3, 0, 12, 4, "quality"), (0, 3, 50, 0, 0, "dimensions"), (16384, 1, 50, 16384, 8192, "dimensions"), (4, 3, 50, 11, 4, "luma"), (5, 3, 50, 15, 4, "chroma"), (5, 3, 50, 15, 6, None)]
    found = ingest.checked(spark.createDataFrame(rows, "width int, height int, quality int, luma_samples long, chroma_samples long, want string"), "420").collect()
    assert [r["error"] for r in found] == [r["want"] for r in found]


def test_weighted_error_of_a_flat_block_is_its_dc(spark):
    rows = spark.createDataFrame([(1, [3] * 64)], "vec_id long, d array<long>")
    assert statistics.weighted_sse(rows).first()["wsse"] == pytest.approx(64 * 9 * 1.8 / 0.4625)


def test_motion_search_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 256, (10, 10))
    frames_ = [(0, wide[1:9, 1:9].ravel().tolist()), (1, wide[2:10, 0:8].ravel().tolist())]
    assert tuple(motion.exhaustive(spark.createDataFrame(frames_, "frame long, samples array<int>"), 8, 2, 4, 2, 1).first())[:3] == (1, 1, -1)


def test_ring_restarts_at_keys(spark):
    rows = spark.range(10).selectExpr("id as frame", "id div 5 as gop")
    found = {(r["frame"], r["place"]): (r["ref"], r["ref_slot"]) for r in motion.slots(rows).collect()}
    assert not any(f in (0, 5) for f, _ in found) and found[4, 1] == (3, 0) and found[4, 3] == (1, 1) and found[6, 1] == (5, 0) and (6, 2) not in found


def test_entry_hides_no_broken_import(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def broken(name, *args, **kwargs):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kwargs)

    if importlib.util.find_spec("pixelmill.llm"):
        gone = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("pixelmill.llm") or k in ("xxhash", "corpus_pipeline")}
        monkeypatch.setattr(builtins, "__import__", broken)
        with pytest.raises(ModuleNotFoundError, match="xxhash"):
            importlib.reload(entry)
        monkeypatch.setattr(builtins, "__import__", real)
        sys.modules.update(gone)
        importlib.reload(entry)
