"""Archives: round trips, false magic in payloads, and chains against a plain walk."""

import base64
import hashlib
import random

import pytest

from siftline.llm import warc
from siftline.llm.warc import archive_pages, candidates, reachable, read_archives

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    best = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= least:
            best[digest(html)] = max(i, best.get(digest(html), i))
    out = []
    for i, _, html in pages:
        top = best.get(digest(html)) if i is not None else None
        revisit = top is not None and i < top and len((html or "").encode()) >= least
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(3)
    rows = []
    for i in range(200):
        parts = [rng.choice(["text é😀 ", "\r\n", "\n", FAKE, "\nWARC/1.0\r\n", "WARC/1.", "\r\n\r\n", "x" * 3000]) for _ in range(rng.randrange(8))]
        rows.append((i, f"http://h/{i}", "".join(parts)))
    rows += [(300, None, None), (301, "u", ""), (302, "", None), (303, "a\r\nWARC/1.0\r\nb", "same"), (304, "http://x/\nWARC/1.0", "same")]
    rows += [(305, "u", "same"), (305, "u", "same"), (None, "u", "same"), (None, None, "alone"), (306, "u", FAKE * 50), (307, "u", "y" * 400_000 + "\n" + FAKE + "z" * 300_000)]
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = pages()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, block int").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = archive_pages(frame, min_bytes=least).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows, least)
    assert all(r.digest_holds for r in got)


def write(folder, data):
    folder.mkdir()
    (folder / "a.warc").write_bytes(data)
    return f"file://{folder}"


def test_foreign_archives(spark, tmp_path):
    def record(body, kind="resource", version="1.1"):
        return (f"WARC/{version}\r\nwarc-type: {kind}\r\nContent-LENGTH:{len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    bodies = [b"", b"\xff\xfe\x00 raw", b"\r\n\r\n" * 9, FAKE.encode(), b"a\nWARC/1.1\r\n", b"end"]
    path = write(tmp_path / "f", b"".join(map(record, bodies)))
    got = sorted((r.start, r.payload_bytes, r.payload_digest) for r in read_archives(spark, path).collect())
    assert [(n, d) for _, n, d in got] == [(len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in bodies]


def test_nothing_behind_a_broken_link(spark, tmp_path):
    good = b"WARC/1.0\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    path = write(tmp_path / "g", good + good.replace(b"ok", b"oops") + good)
    assert [r.start for r in read_archives(spark, path).collect()].count(0) == 1
    assert read_archives(spark, path).count() == 2
    path = write(tmp_path / "h", b"no archive\n" + good)
    assert read_archives(spark, path).collect() == []


def test_chains_equal_a_plain_walk(spark, monkeypatch):
    rng = random.Random(9)
    rows, want = [], set()
    for f in range(6):
        starts = [0] + sorted(rng.sample(range(1, 4000), 300))
        successor = {s: rng.choice(starts[k + 1 : k + 6] or [9999]) for k, s in enumerate(starts)}
        rows += [(f"f{f}", s // 100 * 100, s, 1, 1, t) for s, t in successor.items()]
        s = 0
        while s in successor:
            want.add((f"f{f}", s))
            s = successor[s]
    frame = spark.createDataFrame(rows, "file string, block long, start long, header_bytes long, content long, successor long")
    assert {(r.file, r.start) for r in reachable(frame).collect()} == want


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_pages(frame).collect() == []


def test_the_second_read_may_be_split_otherwise(spark, monkeypatch):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    sizes, read = iter(["40000", "130000"]), warc._pieces
    def pieces(session, path):
        session.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return read(session, path)
    monkeypatch.setattr(warc, "_pieces", pieces)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = archive_pages(frame).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert next(sizes, None) is None
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)
    assert all(r.digest_holds for r in got)
