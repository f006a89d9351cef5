import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loresift.llm.warc import archives, decide, members, normalise, read_records, records_of, round_trip, sidecar

ROWS = [(3, "http://a/ x", "<p>é\r\n\r\nContent-Length: 7</p>"), (1, "http://b/", "same"), (2, None, "same"), (9, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (None, "u", "same"), (7, "u\r\nv", "only"), (7, "u", "only")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("sha1", F.lit("x"))


def test_round_trip(spark):
    got = sorted((x["page_id"] or 0, x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in round_trip(pages(spark)).collect())
    first = {3: None, 1: None, 2: 1, 9: 1, 4: None, 5: 4, 6: None, None: 1, 7: None}
    want = sorted((i or 0, len((t or "").encode()), digest(t), "response" if first[i] is None else "revisit", first[i]) for i, _, t in ROWS)
    assert got == want


def test_threshold_and_empty(spark):
    got = {x["page_id"]: x["record_type"] for x in round_trip(pages(spark), min_revisit_bytes=5).collect()}
    assert set(got.values()) == {"response"}
    assert round_trip(pages(spark).limit(0)).collect() == []


def test_members_stand_alone(spark):
    mono = archives(decide(pages(spark)).coalesce(1), archive_bytes=1000)
    for size in (1, 400, 1 << 20):
        files = normalise(mono, segment_bytes=size)
        rows = files.collect()
        index = sidecar(files).collect()
        cut = {(x["name"], x["offset"]): bytes(x["member"]) for x in members(files, sidecar(files)).collect()}
        assert len(index) == len(cut) == len(ROWS) and (size > 1 or len(rows) == len(ROWS))
        for m in mono.collect():
            whole = b"".join(bytes(x["content"]) for x in sorted((x for x in rows if x["name"] == m["name"]), key=lambda x: x["at"]))
            assert gzip.decompress(m["content"]) == gzip.decompress(whole)
            z = zlib.decompressobj(31)
            z.decompress(m["content"])
            assert z.eof and not z.unused_data  # one member over the whole file
            entries = sorted((e for e in index if e["name"] == m["name"]), key=lambda e: e["offset"])
            own = [whole[e["offset"] : e["offset"] + e["length"]] for e in entries]
            assert b"".join(own) == whole and [cut[m["name"], e["offset"]] for e in entries] == own
            assert [zlib.decompress(w, 31) for w in own] == list(records_of(m["content"])) == list(records_of(whole, 64))


def test_the_index_is_read_without_content(spark, tmp_path):
    normalise(archives(decide(pages(spark)))).write.parquet(f"{tmp_path}/files")
    stored = spark.read.parquet(f"{tmp_path}/files")
    plan = sidecar(stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan
    one = sidecar(stored).where("record_id = '<urn:page:6>'")
    got = members(stored, one).collect()
    assert len(got) == 1 and zlib.decompress(got[0]["member"], 31).endswith(b"x" * 300_000 + b"\r\n\r\n")


def test_many_members_in_linear_time():
    import time

    from loresift.llm.warc import record

    def took(n):
        data = b"".join(gzip.compress(record(i, "http://u/", b"%d " % i * 40, digest("x"), None), 1) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in records_of(data)) == n
        return time.process_time() - began

    took(1000)
    assert took(100_000) < 25 * took(10_000)


def test_padding_large_output_and_cut_members():
    from loresift.llm.warc import inflated

    data = gzip.compress(b"z" * 5_000_000)
    parts = list(inflated(data + b"\0" * 512, most=1 << 16))
    assert b"".join(parts) == b"z" * 5_000_000 and max(map(len, parts)) <= 1 << 16
    assert list(inflated(b"")) == []
    for cut in (data[:-1], data + data[:9], data[:40]):
        with pytest.raises(ValueError):
            list(inflated(cut))


def test_cut_archive_is_an_error():
    from loresift.llm.warc import record

    data = gzip.compress(record(1, "u", b"abc", digest("abc"), None)[:-9])
    with pytest.raises(ValueError):
        list(records_of(data))
    assert read_records is not None


def test_reading_a_long_record_is_linear():
    """A record is joined once: twice the record takes about twice the pieces handled."""
    from loresift.llm.warc import _Records, record

    body = record(1, "u", b"x" * (48 << 20), digest("x"), None)
    small = record(2, "u", b"y", digest("y"), None)
    reader, out = _Records(), []
    stream = body + small * 3
    for at in range(0, len(stream), 1 << 18):
        out += list(reader.add(stream[at : at + (1 << 18)]))
        assert reader.size is None or len(reader.head) == 0  # nothing already placed is looked at again
    assert out == [body, small, small, small] and reader.rest() == b""
    bits, out = _Records(), []
    for i in range(len(small * 3)):
        out += list(bits.add((small * 3)[i : i + 1]))
    assert out == [small] * 3
