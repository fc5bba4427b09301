import base64
import hashlib
import io

import pytest
import zstandard

from labelscope.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, size int, path string"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1, "clash") for r in rows], PAGES)


def expected(rows):
    first = {}
    for i, _, html in rows:
        key = (html or "").encode()
        if i is not None:
            first[key] = min(first.get(key, i), i)
    out = []
    for i, url, html in rows:
        key = (html or "").encode()
        again = key in first and first[key] != i
        out.append((i, len(key), sha(key), "revisit" if again else "response", first[key] if again else None, None))
    return sorted(out, key=repr)


def test_round_trip_and_edges(spark, tmp_path):
    rows = [
        (5, "http://a/x", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://a/ü b\r\nInjected: yes", "<p>one</p>"), (1, "u", None), (3, "u", ""),
        (4, "v", "é" * 300_000), (7, "w", "same"), (7, "w", "same"), (None, "n", "same"), (None, None, "alone"),
        *[(100 + i, f"http://h/{i}", f"<html>page {i % 40} " + "text " * 50) for i in range(200)],
    ]
    archives = warc.write(table(spark, rows), str(tmp_path / "a"), most=4000)
    assert archives.count() > 1 and archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read(archives).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=repr) == expected(rows)
    bodies = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id is not None}
    assert bodies[4] == ("é" * 300_000).encode() and bodies[1] == b""
    assert {r.url for r in got if r.page_id == 9} == {"http://a/ü%20b%0D%0AInjected:%20yes"}
    assert warc.write(table(spark, []), str(tmp_path / "b")).collect() == []


def test_every_frame_is_one_record(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 40) for i in range(30)]
    path = warc.write(table(spark, rows).coalesce(1), str(tmp_path / "a")).first().path
    data = open(path, "rb").read()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    found = list(warc.frames(io.BytesIO(data), most=100))
    assert all(f.startswith(b"WARC/1.1\r\n") and warc.parse(f)["error"] is None for f in found)


@pytest.mark.parametrize("spoil, says", [
    (lambda b: b.replace(b"WARC/1.1", b"WARC/9.9"), "no record header"),
    (lambda b: b.replace(b"WARC-Date", b"WARC-Dote"), "missing WARC-Date"),
    (lambda b: b[:-2], "not as long"), (lambda b: b + b"x", "not as long"),
    (lambda b: b.replace(b"hello", b"jello"), "not the one digested"),
    (lambda b: b.replace(b"WARC-Type: response", b"WARC-Type: metadata"), "neither"),
    (lambda b: b"", "no record header"),
])
def test_validation(spoil, says):
    good = warc.record(1, "u", b"hello", 5, sha(b"hello"), None)
    assert warc.parse(good)["payload"] == b"hello"
    assert says in warc.parse(spoil(good))["error"]


def test_broken_archives(spark, tmp_path):
    shared = warc.leading_frame(b"")
    one = zstandard.ZstdCompressor().compress(warc.record(1, "u", b"x", 1, sha(b"x"), None))
    files = {"ok": shared + one, "cut": shared + one + one[:9], "plain": one, "empty": b"", "junk": shared + b"not zstd at all"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = [(str(tmp_path / n),) for n in files] + [(str(tmp_path / "absent"),), (None,)]
    rows = warc.read(spark.createDataFrame(paths, "path string")).collect()
    assert sum(r.error is None for r in rows) == 2
    assert sum(r.error is not None for r in rows) == 5
