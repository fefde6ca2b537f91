import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

import edge
from tidewheel.llm import files, warc
from tidewheel.llm.tables import fresh_path

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2 b\n", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5", "é日本🙂\r\n\r\nWARC/1.1\r\n"), (6, "http://a/6", "x" * 3_000_000), (6, "http://a/6", "x" * 3_000_000),
    (None, "http://a/n", "<p>same</p>"), (0, "u", "other"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, min_bytes=0):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for n, page in enumerate(ids):
            again = n > 0 and len(payload) >= min_bytes
            out.append((page, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def facts(df):
    return edge.rows_of(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    read = warc.archive_pages(edge.clashing(pages), min_bytes=min_bytes).cache()
    assert facts(read) == brute(PAGES, min_bytes)
    texts = {(r.page_id, r.payload) for r in read.collect() if r.record_type == "response"}
    assert texts <= {(p, h or "") for p, _, h in PAGES}


def test_small_tables(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert facts(warc.archive_pages(pages)) == brute(rows)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_members_and_sidecar(spark):
    folder = fresh_path(spark, "warc-test")
    written = warc.write_monolithic(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), f"{folder}/raw")
    raw = files.read_bytes(written.first().path)
    with pytest.raises(EOFError):  # one stream: no record can be read on its own
        warc.rewrite(_put(spark, raw[: len(raw) // 2]), f"{folder}/half.warc.gz", {})
    index = warc.normalise(written, f"{folder}/records").collect()
    data = files.read_bytes(index[0].path)
    assert [r["offset"] for r in warc.sidecar(index[0].path)] == sorted(r.offset for r in index)
    for r in index:
        assert gzip.decompress(data[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n")
    assert gzip.decompress(data) == gzip.decompress(raw)  # the records themselves are unchanged


def _put(spark, data):
    path = f"{fresh_path(spark, 'put')}/x.warc.gz"
    sink = files.Sink(path)
    sink.write(data)
    sink.close()
    return path


def test_foreign_archive(spark):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: one\r\n two\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    source = _put(spark, gzip.compress(record) + gzip.compress(record * 2))
    places = warc.rewrite(source, f"{source}.out", {})
    data = files.read_bytes(f"{source}.out")
    assert len(places) == 3 and sum(n for _, n in places) == len(data)
    fields = warc.read_head(io.BytesIO(gzip.decompress(data[places[1][0] :][: places[1][1]])))
    assert warc.field(fields, "x-long") == "one two"
