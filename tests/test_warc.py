"""WARC round trips, ranges that begin anywhere, and files that are cut or damaged."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from quillcast.sources import articles_of, read_warc, write_warc

RECORD = "id string, uri string, date string, payload binary"
PAGES = [
    (f"<urn:{i}>", f"https://news{i % 3}.example.org/a/{i}", f"2024-01-{1 + i % 20:02d}T10:00:00Z", (f"<title> Page\n {i} </title>" + "ä WARC/1.0\r\n\r\n" * (i * 37 % 90)).encode() + os.urandom(i % 50) + b"\x1f\x8b\x08" * (i % 3))
    for i in range(120)
]


def back(df):
    return sorted((r.id, r.uri, r.date, bytes(r.payload)) for r in df.collect())


def test_round_trip_in_ranges_of_any_size(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(spark.createDataFrame(PAGES, RECORD).repartition(3), path)
    assert sum(f.endswith(".warc.gz") for f in os.listdir(path)) == 3 and not any(f.startswith("_") for f in os.listdir(path))
    for split in (97, 1000, 4096, 1 << 30):
        df = read_warc(spark, path, split)
        assert back(df) == sorted(PAGES)
    assert {(r.type, r.status) for r in df.collect()} == {("response", 200)}


def test_cut_and_damaged_files(spark, tmp_path):
    whole = [gzip.compress(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r{i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n") for i, b in enumerate(os.urandom(3000) for _ in range(20))]
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(whole)[:-100])
    hurt = bytearray(whole[4])
    hurt[len(hurt) // 2 :] = b"\0" * (len(hurt) - len(hurt) // 2)
    (tmp_path / "hurt.warc.gz").write_bytes(b"".join(whole[:4]) + bytes(hurt) + b"".join(whole[5:]))
    for split in (500, 10_000, 1 << 30):
        assert {r.id for r in read_warc(spark, str(tmp_path / "cut.warc.gz"), split).collect()} == {f"r{i}" for i in range(19)}
        got = [r.id for r in read_warc(spark, str(tmp_path / "hurt.warc.gz"), split).collect()]
        assert sorted(got) == sorted(f"r{i}" for i in range(20) if i != 4)


def test_plain_files_one_member_and_nothing(spark, tmp_path):
    records = b"".join(f"WARC/1.0\r\nWARC-Type: {t}\r\nWARC-Record-ID: {i}\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n".encode() for i, t in enumerate(("warcinfo", "request", "metadata")))
    (tmp_path / "p.warc").write_bytes(records + b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(records))
    (tmp_path / "other.txt").write_text("no record")
    for name in ("p.warc", "one.warc.gz"):
        assert [(r.id, r.type, r.status, bytes(r.payload)) for r in read_warc(spark, str(tmp_path / name)).orderBy("id").collect()] == [("0", "warcinfo", None, b"ab\r\nc"), ("1", "request", None, b"ab\r\nc"), ("2", "metadata", None, b"ab\r\nc")]
    assert read_warc(spark, str(tmp_path)).count() == 6
    write_warc(spark.createDataFrame([], RECORD), str(tmp_path / "none"))
    write_warc(spark.createDataFrame([(None, None, None, None)], RECORD), str(tmp_path / "null"))
    assert [tuple(r) for r in read_warc(spark, str(tmp_path / "null")).withColumn("payload", F.decode("payload", "UTF-8")).collect()] == [(None, None, None, "response", 200, "")]


@pytest.mark.parametrize("hosts,since,count", [((), None, 120), (("news1.example.org",), None, 40), (("example.org",), "2024-01-20", 6), (("other.org",), None, 0)])
def test_articles(spark, tmp_path, hosts, since, count):
    records = spark.createDataFrame([(*p, "response", 200) for p in PAGES] + [("x", "https://example.org/", "2024-01-20T00:00:00Z", b"", "response", 404), ("y", "https://example.org/", "2024-01-20T00:00:00Z", b"", "request", None)], RECORD + ", type string, status int")
    got = articles_of(records, hosts, since).collect()
    assert len(got) == count and all(r.title_page.startswith("Page ") for r in got)
