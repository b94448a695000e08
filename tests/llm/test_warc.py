from __future__ import annotations

import glob
import hashlib

import pytest
import zstandard
from conftest_llm import SF, read
from pyspark.sql import functions as F

from fhirlake.llm import warc


def rows_of(spark, manifest):
    return sorted(
        ((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.read_archives(spark, manifest).collect()),
        key=str,
    )


def brute(rows):
    out, firsts = [], {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            firsts[body] = min(page, firsts.get(body, page))
    for page, html in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        again = first is not None and page != first
        name = None if page is None else str(page)
        kind = ("revisit", str(first)) if again else ("response", None)
        out.append((name, *kind, len(body), hashlib.sha256(body).hexdigest(), None if again else bytearray(body)))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = read(SF, "pages", "page_id, html")
    manifest = warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), f"file://{tmp_path}/w", archive_bytes=20_000)
    assert manifest.count() > 1 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert rows_of(spark, manifest) == brute(rows)


def test_edges(spark, table):
    body = "<p>" + "é word " * 40
    rows = [(3, body), (1, body), (1, body), (2, body), (None, body), (4, "short"), (5, "short"), (6, None), (7, ""), (8, "x" * 3_000_000)]
    urls = ["http://a/\r\nX: y", None, "http://ü/ b"]
    df = table([(p, urls[n % 3], h, n) for n, (p, h) in enumerate(rows)], "page_id long, url string, html string, first int")
    manifest = warc.write_archives(df)
    assert rows_of(spark, manifest) == brute(rows)
    assert warc.write_archives(df.filter("page_id is null")).agg({"records": "sum"}).first()[0] == 1


def test_archives_are_read_by_many_tasks(spark, table, tmp_path):
    rows = [(n, f"<p>{n}" + "word " * 200) for n in range(200)]
    df = table([(p, "http://a/", h) for p, h in rows], "page_id long, url string, html string").repartition(40)
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=1)
    assert manifest.count() >= 40
    tasks = warc.read_archives(spark, manifest, payloads=False).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 20 and max(r["count"] for r in tasks) <= 40


def test_a_shared_payload_is_split(spark, table):
    """The join to the first page of a payload has plain shuffles on both sides, which adaptive execution can split."""
    same = "<p>" + "error " * 60
    df = table([(n, "http://a/", same if n % 3 == 0 else f"{same}{n}") for n in range(600)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.classify(df, "page_id", "html", "url", 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Aggregate" not in plan
    kinds = warc.classify(df, "page_id", "html", "url", 100).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in kinds} == {"response": 401, "revisit": 199}


def test_records_without_a_page_are_written_alike(table):
    row = {"page_id": None, "url": "u", "payload": b"x", "payload_bytes": 1, "payload_digest": "d", "record_type": "response"}
    assert warc.record(row, "1970-01-01T00:00:00Z") == warc.record(row, "1970-01-01T00:00:00Z")


def test_empty_table(spark, table):
    manifest = warc.write_archives(table([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc.read_archives(spark, manifest).count() == 0


def test_dictionary_is_in_front_and_damage_is_found(spark, tmp_path):
    warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), f"file://{tmp_path}/w")
    (path,) = glob.glob(f"{tmp_path}/w/*.warc.zst")[:1]
    data = open(path, "rb").read()
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    size = int.from_bytes(data[4:8], "little")
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert shared.dict_id() != 0
    first = zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n")
    open(path, "wb").write(data[:-5])
    broken = spark.createDataFrame([(f"file://{path}",)], "path string")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, broken).count()
