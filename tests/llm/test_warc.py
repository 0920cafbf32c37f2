from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tallyline.llm import warc

pytest.importorskip("zstandard")
SAME, SHORT = "<p>" + "same " * 300, "<p>short</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


ROWS = [
    (1, "http://a/", SAME, "mine"),
    (5, "http://b/\r\nWARC-Type: x", SAME, "mine"),
    (3, None, SAME, "mine"),
    (None, "http://c/", SAME, "mine"),
    (7, "http://é/ ", SHORT, "mine"),
    (8, "http://d/", SHORT, "mine"),
    (9, "http://d/", None, "mine"),
    (10, "", "", "mine"),
    (11, "http://e/", "é\r\n\r\nWARC/1.1\r\n" * 20_000, "mine"),
    (12, "http://f/", "twice " * 400, "mine"),
    (12, "http://f/", "twice " * 400, "mine"),
    *[(100 + i, "http://x/", f"<html>{i} " + "body " * (i % 50) + "</html>", "mine") for i in range(400)],
]


@pytest.fixture
def round_trip(spark, tmp_path):
    manifest = warc.write(warc.payload_records(pages(spark, ROWS).repartition(3)), f"file://{tmp_path}")
    return manifest, warc.read(manifest, f"file://{tmp_path}"), tmp_path


def test_every_page_comes_back(round_trip):
    _, records, _ = round_trip
    got = records.orderBy("page_id", "record_type").collect()
    assert len(got) == len(ROWS)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5)} <= kinds
    assert {(7, "response", None), (8, "response", None), (9, "response", None), (12, "response", None)} <= kinds
    html = {r[0]: r[2] or "" for r in ROWS}
    for r in got:
        payload = html[r["page_id"]]
        assert r["payload_bytes"] == len(payload.encode())
        assert r["payload_digest"] == hashlib.sha1(payload.encode()).hexdigest()
        assert r["payload"] == (payload if r["record_type"] == "response" else None)


def test_archives_begin_with_their_dictionary(round_trip):
    manifest, _, folder = round_trip
    found = manifest.collect()
    assert sum(r["n_records"] for r in found) == len(ROWS)
    data = [(folder / r["archive"]).read_bytes() for r in found]
    assert [len(d) for d in data] == [r["n_bytes"] for r in found]
    assert all(d[:4] == struct.pack("<I", warc.DICTIONARY_FRAME) for d in data)


def test_records_are_frames_of_their_own():
    records = [warc.render(i, None, f"<html>{i} " + "words and more words " * 20, "00" * 20, 1, None) for i in range(500)]
    frames = list(warc.archive(records))
    assert len(frames) == 501
    assert list(warc.unpack(b"".join(frames))) == records
    # One record read without the others.
    assert list(warc.unpack(frames[0] + frames[300])) == [records[299]]
    assert sum(map(len, frames[1:])) < sum(map(len, warc.archive(records, with_dictionary=False)))


def test_unmanifested_files_are_not_read(round_trip, spark):
    manifest, records, folder = round_trip
    (folder / "left-over.warc.zst").write_bytes(b"broken")
    assert records.count() == len(ROWS)


@pytest.mark.parametrize("payload", ["x", "long " * 100_000])
def test_few_records_are_their_own_dictionary(payload):
    record = warc.render(1, None, payload, "00" * 20, 1, None)
    packed = b"".join(warc.archive([record]))
    assert packed[:4] == struct.pack("<I", warc.DICTIONARY_FRAME)
    assert list(warc.unpack(packed)) == [record]


def test_a_cut_archive_is_an_error():
    packed = b"".join(warc.archive([warc.render(i, None, f"{i}" * 500, "00" * 20, 1, None) for i in range(50)]))
    with pytest.raises(ValueError):
        list(warc.unpack(packed[:-3]))


def test_empty_table(spark, tmp_path):
    manifest = warc.write(warc.payload_records(pages(spark, [])), f"file://{tmp_path}/new")
    assert manifest.count() == 0 and warc.read(manifest, f"file://{tmp_path}/new").count() == 0


def test_archives_are_cut(spark, tmp_path):
    manifest = warc.write(warc.payload_records(pages(spark, ROWS).coalesce(1)), str(tmp_path), archive_bytes=20_000)
    assert manifest.count() > 3
    assert warc.read(manifest, str(tmp_path)).agg(F.count("*")).first()[0] == len(ROWS)


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    rows = [(i, "http://x/", f"<html>{i}</html>" * 50, "mine") for i in range(400)]
    manifest = warc.write(warc.payload_records(pages(spark, rows).coalesce(1)), str(tmp_path), archive_bytes=8_000)
    assert manifest.count() >= 40
    tasks = warc.read(manifest, str(tmp_path)).select(F.spark_partition_id().alias("task"), "page_id")
    assert tasks.select("task").distinct().count() == spark.sparkContext.defaultParallelism
    assert tasks.count() == 400
