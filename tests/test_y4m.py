import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelmill.sources import y4m

made = entry.container_queries
VIEWS = [[(7 * i + k) % 256 for i in range(1024)] for k in range(3)]


def found(data):
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    rows = list(y4m.places(read, len(data)))
    assert max(asked) <= y4m.HEAD  # no sample is read but what follows a frame's mark
    return rows


def test_frames_of_each_chroma():
    for stream, (token, size) in enumerate((("420", 256), ("422", 512), ("444", 1024), ("mono", 0))):
        stream += 4 * (stream == 2)  # the third is cut short
        data = made.video_file(stream, VIEWS)
        rows = found(data)
        assert [(r[0], r[2], r[5], r[6], r[7]) for r in rows] == [(k, 1024 + 2 * size, token, f"{24 + stream % 3}:1", None) for k in range(3)]
        assert [data[r[1] : r[1] + 1024] for r in rows] == [bytes(v) for v in VIEWS]


@pytest.mark.parametrize("cut", range(0, 3700, 97))
def test_any_cut_is_reported(cut):
    """Whole frames come first, then just one row says what is missing; at a border between frames nothing is."""
    data = made.video_file(3, VIEWS)
    rows, whole = found(data[:cut]), found(data)
    ends = {r[1] + r[2] for r in whole} | {whole[0][1] - len(b"FRAME\n")}
    assert [r for r in rows if r[7] is None] == [r for r in whole if r[1] + r[2] <= cut]
    assert len([r for r in rows if r[7]]) == (0 if min(cut, len(data)) in ends else 1)


@pytest.mark.parametrize(
    ("head", "error"),
    [
        (b"", "no header"), (b"RIFF\n", "no header"), (b"YUV4MPEG2 W4 H4", "no header"), (b"YUV4MPEG2 W4 H4 " + b"X" * 5000 + b"\n", "no header"), (b"YUV4MPEG2 W4\n", "no size"), (b"YUV4MPEG2 W4 H0\n", "no size"),
        (b"YUV4MPEG2 W-4 H4\n", "no size"), (b"YUV4MPEG2 W4 H99999999999\n", "no size"), (b"YUV4MPEG2 W4 H4 C411\n", "unknown chroma"), (b"YUV4MPEG2 W4 H4 C420p10\n", "unknown chroma"), (b"YUV4MPEG2 W4 H4 Cmono16\n", "unknown chroma"),
        (b"YUV4MPEG2 W4 H4 C444alpha\n", "unknown chroma"), (b"YUV4MPEG2 W4 H4\nframe\n", "no frame mark"), (b"YUV4MPEG2 W4 H4\nFRAMES\n", "no frame mark"), (b"YUV4MPEG2 W4 H4\nFRAME\n1234", "truncated frame"),
    ],
)
def test_broken_files(head, error):
    assert [r[7] for r in found(head)] == [error]
    with pytest.raises(ValueError):
        list(y4m.parse(head))


def test_tokens():
    assert found(b"YUV4MPEG2 W4 H4\n") == []
    (row,) = found(b"YUV4MPEG2 W9  W5 H3 \nFRAME\n" + bytes(15 + 2 * 6))
    assert row == (0, 27, 27, 5, 3, "420", "30:1", None)  # the last of two counts, halves are rounded up


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    """Frames of many files in many tasks, in small batches, with broken files among them."""
    files = {f"{stream}.y4m": made.video_file(stream, VIEWS) for stream in range(12)} | {"bad.y4m": b"RIFF", "head.y4m": b"YUV4MPEG2 W4 H4\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(y4m, "BATCH", 2000)
    rows = y4m.read(spark, f"{tmp_path}/*.y4m").withColumn("luma", y4m.plane(F.col("planes"), F.col("width"), F.col("height"), F.col("chroma"), 0)).collect()
    for name, data in files.items():
        mine = sorted((r for r in rows if r["path"].endswith(f"/{name}")), key=lambda r: r["frame"] or 0)
        whole = [r for r in mine if r["error"] is None]
        assert [r["error"] for r in mine if r["error"]] == [r[7] for r in found(data) if r[7]]
        assert [bytes(r["planes"]) for r in whole] == [data[r[1] : r[1] + r[2]] for r in found(data) if r[7] is None]
        assert all(bytes(r["luma"]) == bytes(VIEWS[r["frame"]]) for r in whole)
        assert all(r["planes"] is None for r in mine if r["error"])


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.y4m").write_bytes(b"")
    named = spark.createDataFrame([(None,), (f"file://{tmp_path}/empty.y4m",)], "path string")
    assert [r["error"] for r in y4m.frames(named, 2).collect()] == ["no header"]
    assert y4m.read(spark, f"{tmp_path}/*.y4m").count() == 0
    (tmp_path / "other.txt").write_text("x")
    assert y4m.read(spark, f"{tmp_path}/*.txt").select("error", "planes").collect() == [("no header", None)]
