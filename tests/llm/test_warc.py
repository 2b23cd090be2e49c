import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest

from attest.llm.warc import archive_folder, read_archives, read_records, record, write_archives


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages():
    r = random.Random(2)
    rows = [(i, f"http://x/{i}\r\nX-Page-Id: 9", r.choice(["", None, "<p>é</p>", "a\r\n\r\nb", "x" * 300_000, f"own {i}"]), 1)
            for i in range(80)]
    return rows + [(None, None, "<p>é</p>", 1), (None, "u", "only null", 1), (3, "again", rows[3][2], 1)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    manifest = write_archives(df, archive_folder(spark), file_bytes=3_000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    largest = {}
    for i, _, html, _ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        keep = (-1 if i is None else i) == largest[html or ""]
        want[(i, len(data), b32(data), "response" if keep else "revisit", None if keep else largest[html or ""])] += 1
    got = read_archives(manifest).collect()
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
    for x in got:
        if x.record_type == "response":
            assert b32(bytes(x.payload)) == x.payload_digest


def test_short_payloads_do_not_revisit(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    got = read_archives(write_archives(df, archive_folder(spark), least_bytes=3)).collect()
    assert {x.page_id: x.refers_to for x in got} == {1: None, 2: None, 3: 4, 4: None}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(df, archive_folder(spark))).collect() == []


def test_damage_is_found():
    whole = record(1, "u", b"hello" * 50_000, None, False, 6) + record(2, None, b"hello", 1, True, 1)
    assert [f["warc-type"] for f, _ in read_records(io.BytesIO(whole))] == ["response", "revisit"]
    plain = gzip.decompress(whole)
    for bad in (whole[:-20], gzip.compress(plain.replace(b"hellohello", b"hellohellO", 1)), gzip.compress(plain[:300]),
                gzip.compress(b"junk")):
        with pytest.raises((ValueError, OSError)):
            list(read_records(io.BytesIO(bad)))
