import gzip
import random

import pytest
from pyspark.sql import functions as F

from podium.llm import warc
from podium.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, offset string, sha string"


def test_round_trip_of_all_kinds_of_rows(spark):
    rng = random.Random(1)
    html = ["", None, "<p>é\r\n\r\nContent-Length: 3\r\n\r\n</p>", "x" * 200_000, *(f"<p>{i}</p>" for i in range(20))]
    rows = [(i, None if i % 9 == 0 else f"http://h/{i}\nx", rng.choice(html), "o", "s") for i in range(120)]
    rows += [rows[3], (None, "u", "<p>1</p>", "", ""), (None, "u", "only without key", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = warc.archive_round_trip(df).collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, h, *_ in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, u, h, *_ in rows:
        body, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and f != k
        want.append((k, u and u.replace("\n", " "), "revisit" if revisit else "response", f if revisit else None,
                     None if revisit else body, len(body), warc.sha1_base32(body)))
    order = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r[:1]) + (r[6], str(r[1]))
    have = [(r.key and int(r.key), r.url, r.record_type, r.refers_to and int(r.refers_to),
             None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest) for r in got]
    assert sorted(have, key=order) == sorted(want, key=order)


def test_index_gives_byte_ranges_and_selected_reads(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}" * 50) for i in range(60)],
                               "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(df, scratch_path(spark, "w"), archive_bytes=2_000)
    rows = index.collect()
    assert len({r.archive for r in rows}) > 2
    for r in rows[:5]:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = warc.parse_record(gzip.decompress(f.read(r.length)))
        assert (record["url"], record["payload_digest"]) == (r.url, r.digest)
    some = index.where(F.col("key").cast("long") % 7 == 0)
    for gap in (0, 10**6):
        assert sorted(int(r.key) for r in warc.read_records(some, max_gap=gap).collect()) == list(range(0, 60, 7))
    assert len(warc.read_records(index, max_read=1).collect()) == 60


def test_empty_table_and_corrupt_record(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    record = warc.record_bytes("1", "u", b"abc", None, warc.sha1_base32(b"abc"))
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))
