from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from promolift.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(
        [(n, u, h, "x") for n, u, h in rows], "page_id LONG, url STRING, html STRING, digest STRING"
    ).repartition(2)


def test_round_trip(spark):
    long = "x" * 99 + "é"
    given = [
        (1, "http://a/ü b", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
        (7, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 9), (None, "u", long), (1, "http://a/ü b", long),
    ]
    found = warc.record_summary(warc.round_trip(pages(spark, given)))
    expected = []
    for number, _, html in given:
        data = (html or "").encode()
        first = min(n for n, _, h in given if h == html and n is not None)
        revisit = len(data) >= 100 and first != number
        kind = ("revisit", first) if revisit else ("response", None)
        expected.append((number, len(data), hashlib.sha256(data).hexdigest(), *kind))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert warc.record_summary(warc.round_trip(pages(spark, given).limit(0))).collect() == []


def test_only_null_ids_are_all_responses(spark):
    found = warc.record_summary(warc.round_trip(pages(spark, [(None, "u", "z" * 200)] * 2))).collect()
    assert [row.record_type for row in found] == ["response", "response"]


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK_BYTES, warc.CHUNK_BYTES + 1, warc.SEGMENT_BYTES, 3 * warc.SEGMENT_BYTES + 7])
def test_long_payloads_come_back_in_chunks(size):
    payload = bytes(at * 7 % 251 for at in range(size))
    members = list(warc.records_of(9, "http://a/", payload, None, "n"))
    assert len(members) == max(1, -(-size // warc.SEGMENT_BYTES))
    assert gzip.decompress(members[0]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    rows = list(warc.chunks_of(io.BytesIO(b"".join(members))))
    assert b"".join(row[6] for row in rows) == payload
    assert [row[4] for row in rows] == list(range(len(rows)))
    assert max(len(row[6]) for row in rows) <= warc.CHUNK_BYTES
    done = b""
    for row in rows:
        done += row[6]
        assert row[7] == hashlib.sha256(done).hexdigest()
    assert [row[8] for row in rows] == [False] * (len(rows) - 1) + [True]


def test_damaged_archives_are_refused():
    data = b"".join(warc.records_of(1, "u", b"abc" * 100, None, "n"))
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(gzip.compress(b"hello\r\n"))))
