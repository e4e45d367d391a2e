import gzip
import hashlib
import io
import json
import struct
import zipfile

import duckdb
import numpy as np
import pytest

from pixelmill.llm import archives, queries, topk
from pixelmill.llm.common import work_dir

SF = "/root/testdata/sf0.001"


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_directory(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"archive/{k}"), "w", force_zip64=wide) as f:
                f.write(bytes([k]) * (k * 1000))
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    members = archives.directory(reader(data), len(data))
    assert [m.name for m in members] == ["archive/0", "archive/1", "archive/2"]
    for k, m in enumerate(members):
        at = archives.data_start(reader(data), m)
        assert data[at : at + m.size] == bytes([k]) * (k * 1000)


def test_zip64_directory():
    """A package whose sizes and offsets are only in the ZIP64 records."""
    body, name, ones = b"hello", b"archive/x", 0xFFFFFFFF
    local = archives.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, ones, ones, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 7)
    central = archives.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, ones, ones, len(name), len(extra), 0, 0, 0, 0, ones) + name + extra
    data = b"\0" * 7 + local
    at = len(data)
    end64 = archives.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    data += central + end64 + archives.LOCATOR + struct.pack("<IQI", 0, at + len(central), 1) + archives.END + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, ones, ones, 0)
    (m,) = archives.directory(reader(data), len(data))
    assert m == archives.Member("archive/x", 0, 5, 7)
    assert data[archives.data_start(reader(data), m) :][:5] == body


def test_broken_packages():
    for data in (b"", b"no zip at all", b"PK\x05\x06" + b"\0" * 10):
        with pytest.raises(ValueError):
            archives.directory(reader(data), len(data))


def test_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a/\r\nx", "small"), (2, "http://a", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (None, "u", big), (9, "u", "\r\n\r\nWARC/1.1\r\n\x00" + "z" * 300_000), (6, "u", big)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    manifest = archives.write_archives(pages.repartition(3), work_dir(spark, "archives"), package_records=2)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() >= 4
    out = archives.read_archives(manifest).collect()
    assert len(out) == len(rows) and all(r["digest_ok"] for r in out)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in out:
        assert r["payload_bytes"] == len(html[r["page_id"]])
        copy = r["page_id"] in (None, 2, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 6) if copy else ("response", None))
        assert copy or bytes(r["payload"]) == html[r["page_id"]]
    none = archives.write_archives(pages.limit(0), work_dir(spark, "archives"))
    assert archives.read_archives(none).count() == 0


def foreign(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            z.writestr(name, data)


def warc(url, payload, kind="response"):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(http)}\r\n\r\n"
    return gzip.compress(head.encode() + http + b"\r\n\r\n")


def test_packages_from_elsewhere(spark, tmp_path):
    """Two archives, two indexes (plain and gzipped CDXJ, sorted by key), one archive without an index line, and extra members."""
    a, b, c = ([warc(f"http://{x}/{i}", f"{x} {i}".encode()) for i in range(5)] for x in "abc")
    line = lambda parts, i, name: "com,%s)/%d 20240101000000 %s" % (name, i, json.dumps({"url": "u", "filename": name, "offset": str(sum(map(len, parts[:i]))), "length": str(len(parts[i]))}))
    plain = "\n".join(["!meta {}", *(line(a, i, "a.warc.gz") for i in (3, 0, 4, 1, 2)), ""]).encode()
    packed = b"".join(gzip.compress((line(b, i, "b.warc.gz") + "\n").encode()) for i in (2, 1, 0, 4, 3))
    members = [("archive/a.warc.gz", b"".join(a)), ("indexes/one.cdxj", plain), ("archive/b.warc.gz", b"".join(b)), ("indexes/two.cdx.gz", packed), ("archive/c.warc.gz", b"".join(c)), ("archive/empty.warc.gz", b""), ("pages/pages.jsonl", b"{}")]
    foreign(tmp_path / "x.wacz", members)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")
    rows = archives.read_archives(manifest).collect()
    assert sorted((r["url"], bytes(r["payload"])) for r in rows) == sorted((f"http://{x}/{i}", f"{x} {i}".encode()) for x in "abc" for i in range(5))
    assert all(r["page_id"] is None and r["digest_ok"] and r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in rows)
    foreign(tmp_path / "y.wacz", [("archive/a.warc.gz", b"".join(a)), ("indexes/i.cdxj", line(a, 0, "gone.warc.gz").encode())])
    read = lambda data: archives.records(reader(data), len(data))
    with pytest.raises(ValueError, match="names no archive member"):
        read((tmp_path / "y.wacz").read_bytes())
    foreign(tmp_path / "z.wacz", [("archive/a.warc.gz", b"".join(a)[:-3])])
    with pytest.raises(ValueError, match="ends inside a record"):
        read((tmp_path / "z.wacz").read_bytes())


def test_one_digest_on_most_rows(spark):
    pages = spark.range(600).selectExpr("id as page_id", "concat('http://h/', id) as url", "case when id % 3 = 0 then '' when id % 3 = 1 then repeat('e', 2000) else repeat(cast(id as string), 500) end as html")
    rows = archives.read_archives(archives.write_archives(pages, work_dir(spark, "archives"))).collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == 600 and kinds == {i: ("revisit", 598) if i % 3 == 1 and i < 598 else ("response", None) for i in range(600)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)))
    assert columns == sorted(got.columns) and len(got) == len(want)
    plain = lambda df: sorted(str([None if x != x or x is None else int(x) if isinstance(x, float) else x for x in r]) for r in df[columns].itertuples(index=False, name=None))
    assert rows(want) and plain(got.astype(object).where(got.notna(), None)) == plain(want.astype(object).where(want.notna(), None))


def plain_topk(vectors, k):
    out = []
    for q, x in vectors:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors if v != q and len(y) == len(x))
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6).round(1)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, []), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] * 6), (2400, [1.0, 2.0]), (2401, [1.0, 1.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, dim int, x string")
    vectors = topk.quantised(table)
    good = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    got = topk.search(vectors, vectors.where("vec_id % 100 = 0"), bins=16, candidate_block=64, query_block=4).collect()
    assert sorted(map(tuple, got)) == plain_topk(good, 10)
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_groups_and_plan(spark, monkeypatch):
    """Queries in many groups and lengths find the same; a task gives its blocks away before it holds much; no plan shuffles candidates."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 1 + i // 100 % 4).round(1)]) for i in range(1200)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    good = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows]
    found = topk.search(vectors, vectors.where("vec_id % 100 = 0"), query_block=1, group_bytes=40)
    assert sorted(map(tuple, found.collect())) == plain_topk(good, 10)
    blocks = [(r["dim"], np.frombuffer(r["cb_ids"], np.int64).tolist()) for r in topk.packed(vectors, 50).collect()]
    assert max(len(ids) for _, ids in blocks) == 50 and sorted((i, d) for d, ids in blocks for i in ids) == [(i, len(x)) for i, x in rows]
    monkeypatch.setattr(topk, "PACKED_BYTES", 0)
    assert topk.packed(vectors, 50).count() == len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "CoGroup" not in plan and plan.count("strategy=broadcast") >= 5


def test_huge_components():
    q, c = np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 3.0], [-(2.0**60), 3.0], [0.0, 7.0]])
    assert topk.dot(q, c).tolist() == [[(1 << 62) - 1, -(1 << 62), 7]]
