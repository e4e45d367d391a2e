"""Deterministic adapters: tables to samples, blocks and frames. All are narrow or one explode; none shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(df: DataFrame, height: int, width: int) -> DataFrame:
    """Each row for every (y, x) of a raster."""
    ys, xs = F.sequence(F.lit(0), F.lit(height - 1)), F.sequence(F.lit(0), F.lit(width - 1))
    return df.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs))


def pattern_rgb(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """(image_id, y, x, r, g, b): a patterned image for each supplier."""
    rows = grid(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")), size, size)
    low = lambda e: F.expr(f"cast(({e}) & 255 as int)")
    return rows.select(
        "image_id", "y", "x", low("37 * x + 11 * y + image_id").alias("r"), low("(x div 4) * 83 + (y div 7) * 29 + image_id").alias("g"), low("13 * x + 53 * y + ((x ^ y) & 15) * 7 + image_id").alias("b")
    )


def lineitem_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, r, g, b): a sample for each line item, without geometry."""
    byte = lambda e: F.expr(f"cast(floor({e}) % 256 as int)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", byte("l_quantity * 5").alias("r"), byte("l_extendedprice").alias("g"), byte("l_discount * 1000").alias("b"))


def embed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, block): an 8x8 block of bytes, row by row, for each vector of 64 components."""
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int")))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.transform("embedding", byte).alias("block"))


def block_samples(blocks: DataFrame, width: int = 8) -> DataFrame:
    """(vec_id, y, x, v) of blocks."""
    return blocks.select("vec_id", F.posexplode("block").alias("i", "v")).select("vec_id", F.expr(f"cast(i div {width} as int)").alias("y"), F.expr(f"cast(i % {width} as int)").alias("x"), "v")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, samples): 64 events in order make a frame; frames with other than 64 events (a short last one, or one with a gap) are dropped."""
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 64").alias("frame"), F.struct((F.col("event_id") % 64).alias("i"), F.expr("cast(floor(value) % 256 as int)").alias("v")).alias("s"))
    frames = rows.groupBy("frame").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return frames.where(F.size("s") == 64).select("frame", F.col("s.v").alias("samples"))


def pan_frames(spark: SparkSession, sf_dir: str, size: int = 32, frames: int = 5) -> DataFrame:
    """(stream, frame, samples): a view of size x size samples that moves over strips of 40 vectors of 64 components.

    From frame to frame it moves down by two rows, and right by two and a half columns: between columns, the rounded
    mean of both is seen. A last strip of fewer vectors is left out.
    """
    rows = embed_blocks(spark, sf_dir).select(F.expr("vec_id div 40").alias("stream"), F.struct((F.col("vec_id") % 40).alias("r"), "block").alias("row"))
    strips = rows.groupBy("stream").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") == 40)
    seen = strips.select("stream", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("t"), "rows")
    part = lambda at: f"slice(row.block, (5 * t) div 2 + {at}, {size})"
    view = f"flatten(transform(slice(rows, 2 * t + 1, {size}), row -> if(t % 2 = 0, {part(1)}, zip_with({part(1)}, {part(2)}, (a, b) -> (a + b + 1) >> 1))))"
    return seen.select("stream", F.col("t").cast("long").alias("frame"), F.expr(view).alias("samples"))


def repeating_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, height, width, samples): 40 rows of 64 samples that repeat every 12 rows and 20 columns.

    An image is made of the first 12 of 40 vectors of 64 components; a last image of fewer is left out.
    """
    rows = embed_blocks(spark, sf_dir).where("vec_id % 40 < 12").select(F.expr("vec_id div 40").alias("image"), F.struct("vec_id", F.expr("transform(sequence(0, 63), x -> block[x % 20])").alias("line")).alias("row"))
    images = rows.groupBy("image").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") == 12)
    return images.select("image", F.lit(40).alias("height"), F.lit(64).alias("width"), F.expr("flatten(transform(sequence(0, 39), y -> rows[y % 12].line))").alias("samples"))


def stacked_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, samples): planes of 32 x 32 samples, each the components of 16 successive vectors of 64, one after the other."""
    rows = embed_blocks(spark, sf_dir).select(F.expr("vec_id div 16").alias("image"), F.struct("vec_id", "block").alias("row"))
    return rows.groupBy("image").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") == 16).select("image", F.flatten("rows.block").alias("samples"))


def contrast_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, height, width, samples): 128 x 160 samples whose squares of 64 differ in contrast and brightness.

    An image is made of 40 vectors of 64 components; a last image of fewer is left out. Square k of image i keeps the
    distance of a component from 128, divided by 2^((5 * i + 3 * k) % 7), around 24 + 40 * ((i + k) % 5), inside a byte.
    """
    rows = embed_blocks(spark, sf_dir).select(F.expr("vec_id div 40").alias("image"), F.struct("vec_id", "block").alias("row"))
    strips = rows.groupBy("image").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") == 40)
    sample = "transform(sequence(0, 159), x -> cast(greatest(0, least(255, 24 + 40 * ((image + y div 64 * 3 + x div 64) % 5) + ((rows[(y + 8 * (x div 64)) % 40].block[x % 64] - 128) >> cast((5 * image + 3 * (y div 64 * 3 + x div 64)) % 7 as int)))) as int))"
    return strips.select("image", F.lit(128).alias("height"), F.lit(160).alias("width"), F.expr(f"flatten(transform(sequence(0, 127), y -> {sample}))").alias("samples"))
