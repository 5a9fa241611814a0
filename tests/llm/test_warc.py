import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from tidemark.llm._common import scratch
from tidemark.llm.warc import Inflated, filesystem, mark_revisits, normalise, normalise_stream, read_archives, read_member, record, warc_round_trip, write_archives

PAGES = [(5, "http://a/", "<p>x</p>"), (3, "http://b/\r\n%0A", "<p>x</p>"), (9, None, None), (1, "u", ""), (7, "http://é/", "é" * 100_000), (8, "z", "\r\n\r\nWARC/1.1\r\n\r\n"), (3, "http://b/", "<p>x</p>"), (11, "q", "<p>x</p> ")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(2)


def expected(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        low = first[h or ""]
        out.append((i, len(body), digest, "response" if i == low else "revisit", None if i == low else low))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [PAGES, [], [(i, "u", "same") for i in range(200)]])
def test_round_trip(spark, rows):
    assert sorted(map(tuple, warc_round_trip(frame(spark, rows)).collect()), key=str) == expected(rows)


def test_many_revisits_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.warc.BROADCAST_ROWS", 1)
    assert sorted(map(tuple, warc_round_trip(frame(spark, PAGES)).collect()), key=str) == expected(PAGES)


def test_least_bytes(spark):
    got = {(r.page_id, r.record_type) for r in warc_round_trip(frame(spark, PAGES), least_bytes=9).collect()}
    assert (9, "response") in got and (5, "response") in got and all(t == "response" for _, t in got)


def test_files(spark):
    """Raw archives are one member each; normalised ones have a member per record, where the index says."""
    folder = scratch(spark, "test")
    raw = write_archives(mark_revisits(frame(spark, PAGES)), folder, archive_bytes=1000)
    made = normalise(raw, folder)
    system, base = filesystem(folder)
    read = lambda path: system.open_input_stream(f"{base}/{path}", compression=None).read()
    whole = sorted(gzip.decompress(read(r.path)) for r in raw.collect())
    for r in raw.collect():
        one = zlib.decompressobj(31)
        one.decompress(read(r.path))
        assert one.eof and not one.unused_data
    again, count = [], 0
    for r in made.collect():
        data, index = read(r.path), [json.loads(x) for x in read(r.index_path).splitlines()]
        again.append(b"".join(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in index))
        assert sum(x["length"] for x in index) == len(data)
        assert r.records == len(index)
        count += len(index)
    assert sorted(again) == whole and count == len(PAGES)
    pages = {(r.page_id, r.url, None if r.payload is None else bytes(r.payload)) for r in read_archives(made, folder).collect()}
    assert (7, "http://é/", ("é" * 100_000).encode()) in pages
    assert (3, "http://b/\r\n%0A", b"<p>x</p>") in pages


def test_stream_in_pieces():
    records = [record(i, f"u{i}", bytes([i]) * n, None) for i, n in enumerate((0, 5, 3_000_000, 17))]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    source = io.BytesIO(squeeze.compress(b"".join(records)) + squeeze.flush())
    target, index = io.BytesIO(), io.BytesIO()
    assert normalise_stream(source, target, index) == 4
    lines = [json.loads(x) for x in index.getvalue().splitlines()]
    back = [read_member(target.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in lines]
    assert [(b["page_id"], b["payload_bytes"], len(b["payload"])) for b in back] == [(0, 0, 0), (1, 5, 5), (2, 3_000_000, 3_000_000), (3, 17, 17)]


def test_cut_archive():
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = squeeze.compress(record(1, "u", b"x" * 1000, None)[:300]) + squeeze.flush()
    with pytest.raises(ValueError, match="inside a record"):
        normalise_stream(io.BytesIO(whole), io.BytesIO(), io.BytesIO())


def test_members_and_a_stream_read_alike():
    parts = [b"a" * 70_000, b"", b"bc"]
    plain = Inflated(io.BytesIO(b"".join(gzip.compress(p) for p in parts)))
    assert b"".join(plain.copy(70_002)) == b"".join(parts)
