import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from dealflow.llm import warc
from dealflow.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


def expected(pages, least=1000):
    best = {}
    for page, _, html in pages:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    count = {}
    for _, _, html in pages:
        count[html or ""] = count.get(html or "", 0) + 1
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        stored = best.get(html or "")
        again = len(data) >= least and count[html or ""] > 1 and stored is not None and page != stored
        out.append((str(page), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", stored if again else None))
    return sorted(out, key=str)


def rows(df):
    names = ["payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted([(str(r["page_id"]), *[r[n] for n in names]) for r in df.collect()], key=str)


def test_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(QUERIES["op9_warc"](spark, sf)) == expected(pages)


def test_odd_pages_come_back_whole(spark, tmp_path):
    long = "é<p>" * 400
    pages = [
        (1, "http://a/\r\nx: y", long), (2, None, long), (3, "http://ä/ b", long), (4, "u", None), (5, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999),
        (8, "u", "\r\n\r\n\x00" * 300), (None, "u", long), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (9, "u", "big " * 700_000),
        (10, "u", "twice" * 300), (10, "u", "twice" * 300), (-3, "u", "twice" * 300),
    ]
    table = spark.createDataFrame(pages, SCHEMA).withColumns({"digest": F.lit(1), "stored": F.lit(2), "page": F.lit(3)})
    assert rows(warc.archive_round_trip(table)) == expected(pages)
    archives = warc.write_pages(table, str(tmp_path / "w"))
    found = warc.read_pages(spark, archives).where("record_type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in found} == {h or "" for _, _, h in pages}
    assert rows(warc.archive_round_trip(table.limit(0))) == []


def archive(records):
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    return out.getvalue()


HEADERS = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Date": warc.DATE}


def test_one_frame_per_record_behind_the_dictionary():
    records = [warc.encode_record(HEADERS | {"n": str(i)}, b"block %d " % i * 50) for i in range(300)]
    data = archive(records)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    found = list(warc.read_archive(io.BytesIO(data)))
    assert [r.headers["n"] for r in found] == [str(i) for i in range(300)]
    assert [r.block for r in found] == [b"block %d " % i * 50 for i in range(300)]
    assert list(warc.read_archive(io.BytesIO(archive([])))) == []


@pytest.mark.parametrize(
    "record",
    [b"", b"WARC/2.0\r\n\r\n", warc.encode_record({"WARC-Type": "response"}, b"x"), warc.encode_record(HEADERS, b"abc")[:-1],
     warc.encode_record(HEADERS, b"abc").replace(b"Length: 3", b"Length: 4"), b"WARC/1.1\r\nno colon\r\n\r\n\r\n\r\n"],
)
def test_bad_records_are_errors(record):
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(archive([record]))))


def test_damaged_archives_are_errors():
    data = archive([warc.encode_record(HEADERS, b"abc" * 500)] * 3)
    for bad in (data[:-3], data[:5], b"", data[8:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
