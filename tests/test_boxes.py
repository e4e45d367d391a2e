import struct

import pytest

import __spark_entry__ as entry
from pixelmill.sources import boxes

made = entry.container_queries


def walked(data, **limits):
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    rows = list(boxes.walk(read, len(data), **limits))
    assert max(asked, default=0) <= boxes.BRAND_BYTES
    return rows


def short(rows):
    return [(path, at, size, error) for path, _, at, _, size, _, error in rows]


def test_whole_files():
    data = made.image_file(0, [7] * 1024)
    assert [(r[0].rpartition("/")[2], r[2], r[4]) for r in walked(data)] == [("ftyp", 0, 24), ("meta", 24, 95), ("iinf", 36, 35), ("infe", 50, 21), ("iprp", 71, 48), ("ipco", 79, 40), ("ispe", 87, 20), ("av1C", 107, 12), ("mdat", 119, 1032)]
    assert walked(b"") == []
    assert [r[3] for r in walked(made.image_file(1, [7] * 1024))][-1] == 16


@pytest.mark.parametrize("cut", range(0, 1151, 13))
def test_any_cut_is_reported(cut):
    """However short a file is, boxes before the cut come whole, and just one row says what is missing."""
    data = made.image_file(0, [7] * 1024)
    rows, whole = walked(data[:cut]), walked(data)
    bad = [r for r in rows if r[6]]
    assert len(bad) == (0 if cut in (0, 24, 119) else 1)
    assert [r for r in rows if not r[6]] == [r for r in whole if r[2] + r[4] <= cut and not (24 < r[2] < 119 and cut < 119)]


def test_broken_boxes():
    tail = made.box(b"free", b"")
    assert short(walked(struct.pack(">I4s", 7, b"free") + tail)) == [("/free", 0, 7, "size below its header")]
    assert short(walked(struct.pack(">I4sQ", 1, b"free", 15) + tail)) == [("/free", 0, 15, "size below its header")]
    assert short(walked(struct.pack(">I4sQ", 1, b"free", 2**64 - 1))) == [("/free", 0, 2**63 - 1, "beyond its parent")]
    assert short(walked(struct.pack(">I4s", 1, b"free"))) == [("/free", 0, 8, "truncated header")]
    assert short(walked(struct.pack(">I4s", 0, b"free") + b"12345")) == [("/free", 0, 13, None)]
    assert short(walked(made.box(b"a/\x00b", b"") + b"xyz")) == [("/a..b", 0, 8, None), ("", 8, 3, "truncated header")]
    inner = made.box(b"moov", struct.pack(">I4s", 99, b"trak")) + tail  # the fault stays inside
    assert short(walked(inner)) == [("/moov", 0, 16, None), ("/moov/trak", 8, 99, "beyond its parent"), ("/free", 16, 8, None)]


def test_depth():
    data = made.box(b"free", b"")
    for _ in range(20_000):  # no recursion, and no path grows beyond the levels that are entered
        data = made.box(b"moov", data) if len(data) < 200_000 else data
    rows = walked(data)
    assert len(rows) == boxes.DEEPEST + 1 and rows[-1][6] == "too deep" and not any(r[6] for r in rows[:-1])
    assert [r[6] for r in walked(made.box(b"moov", made.box(b"trak", made.box(b"free", b""))), deepest=1)] == [None, "too deep"]


def test_items():
    entry_box = lambda version, before, kind: made.box(b"infe", bytes([version, 0, 0, 0]) + b"\0" * before + kind)
    for data, found in ((entry_box(2, 4, b"hvc1"), "hvc1"), (entry_box(3, 6, b"av01"), "av01"), (entry_box(0, 4, b"av01"), None), (entry_box(2, 4, b"hv"), None), (made.box(b"infe", b""), None)):
        assert walked(data)[0][5] == found
    wide = made.box(b"iinf", b"\1\0\0\0" + struct.pack(">I", 1) + entry_box(2, 4, b"vvc1"))
    assert [r[5] for r in walked(wide)] == [None, "vvc1"]


def test_kinds_by_brand_item_and_settings(spark, tmp_path):
    brand = lambda *names: made.box(b"ftyp", names[0] + b"\0" * 4 + b"".join(names[1:]))
    av1, hevc = (made.box(b"iprp", made.box(b"ipco", made.box(k, b"1234"))) for k in (b"av1C", b"hvcC"))
    files = {
        "heic": brand(b"heix") + av1, "heic2": brand(b"mif1", b"miaf", b"heic", b"avif") + av1, "avif": brand(b"mif1", b"avif", b"heic") + av1, "heic3": brand(b"mif1", b"avif") + hevc, "heic4": made.box(b"free", b"1") + brand(b"avif", b"heic") + hevc,
        "unknown": brand(b"avif"), "unknown2": brand(b"mif1", b"miaf"), "unknown3": b"\xff" * 50, "vvc": made.box(b"meta", b"\0" * 4 + made.box(b"iinf", b"\0" * 6 + made.box(b"infe", b"\2\0\0\0\0\1\0\0vvi1"))) + av1,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    rows = spark.createDataFrame([(f"file://{tmp_path}/{n}", n, "x") for n in [*files, "empty"]] + [(None, "none", "x")], "path string, name string, extra string")
    found = {r["name"]: r["kind"] for r in boxes.kinds(boxes.boxes(rows), "name").collect()}
    assert found == {n: n.rstrip("234") for n in files}
