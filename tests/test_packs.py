"""Compaction of parts: equal rows before, during and after, few files, reruns that replace."""

import json
from collections import Counter

import pytest

from siftline import schemas
from siftline.session import files_below
from siftline.sinks import packs, tables
from siftline.sinks.packs import compact, complete_parts, read_parts
from siftline.sinks.tables import LOG, OUTBOX, read_match_log, read_outbox, write_match_log, write_part


def put_batches(folder, numbers, tag="a"):
    """Parts as the stream leaves them, one JSON record each."""
    for n in numbers:
        part = folder / f"batch={n}"
        part.mkdir(parents=True, exist_ok=True)
        for old in part.iterdir():
            old.unlink()
        record = {"time": "2024-01-01T00:00:00.123456Z", "channel_id": n % 3, "channel": "", "msg_id": n,
                  "reason": tag, "link": "", "source": "live"}
        (part / f"part-00000-{tag}.json").write_text(json.dumps(record) + "\n")
        (part / "_SUCCESS").touch()


def found(spark, path):
    return Counter((r.msg_id, r.reason) for r in read_match_log(spark, str(path)).collect())


def test_two_hundred_batches_leave_few_files(spark, tmp_path):
    folder = tmp_path / "stream=s"
    for top in range(25, 201, 25):
        put_batches(folder, range(top - 25, top))
        compact(spark, str(folder), LOG, lambda p, top=top: int(p[6:]) < top - 1, fan=4)
        assert found(spark, tmp_path) == Counter({(n, "a"): 1 for n in range(top)})
    compact(spark, str(folder), LOG)
    compact(spark, str(folder), LOG)
    assert found(spark, tmp_path) == Counter({(n, "a"): 1 for n in range(200)})
    names = files_below(spark, str(tmp_path))
    assert not complete_parts(names)
    data = [n for n in names if "/rows/part-" in n]
    assert len(data) < 20
    times = {r.time for r in read_match_log(spark, str(tmp_path)).select("time").distinct().collect()}
    assert [t.microsecond for t in times] == [123456]


@pytest.mark.parametrize("cut", range(8))
def test_a_cut_at_any_write_or_removal_leaves_the_rows(spark, tmp_path, monkeypatch, cut):
    folder = tmp_path / "stream=s"
    put_batches(folder, range(4))
    compact(spark, str(folder), LOG)
    put_batches(folder, range(4, 8))
    expected = Counter({(n, "a"): 1 for n in range(8)})
    left = [cut]
    drop, write = packs.drop_path, packs.Layout.write

    def step():
        left[0] -= 1
        if left[0] < 0:
            raise InterruptedError

    def dropping(*args):
        step()
        drop(*args)

    def writing(*args):
        step()
        write(*args)

    monkeypatch.setattr(packs, "drop_path", dropping)
    monkeypatch.setattr(packs.Layout, "write", writing)
    try:
        compact(spark, str(folder), LOG, fan=2)
    except InterruptedError:
        pass
    assert found(spark, tmp_path) == expected
    left[0] = 1000
    compact(spark, str(folder), LOG, fan=2)
    assert found(spark, tmp_path) == expected


def test_a_batch_written_again_replaces_its_packed_rows(spark, tmp_path):
    folder = tmp_path / "stream=s"
    put_batches(folder, range(5))
    assert compact(spark, str(folder), LOG) == 5
    put_batches(folder, [2], "again")  # before the folder was removed
    put_batches(folder, [5])
    assert compact(spark, str(folder), LOG) == 1
    expected = Counter({(n, "again" if n == 2 else "a"): 1 for n in range(6)})
    assert found(spark, tmp_path) == expected
    put_batches(folder, [4], "late")  # after it was
    expected[(4, "a")], expected[(4, "late")] = 0, 1
    for _ in range(2):
        assert found(spark, tmp_path) == +expected
        assert compact(spark, str(folder), LOG) == 0


def test_a_part_begun_anew_counts_as_packed_until_it_stands(spark, tmp_path):
    folder = tmp_path / "stream=s"
    put_batches(folder, range(3))
    compact(spark, str(folder), LOG)
    put_batches(folder, [1], "half")
    (folder / "batch=1" / "_SUCCESS").unlink()
    assert found(spark, tmp_path) == Counter({(n, "a"): 1 for n in range(3)})


def test_a_cut_manifest_does_not_count(spark, tmp_path):
    folder = tmp_path / "stream=s"
    put_batches(folder, range(3))
    compact(spark, str(folder), LOG)
    (folder / "_manifest" / "1" / "_SUCCESS").unlink()
    assert found(spark, tmp_path) == Counter({(n, "a"): 1 for n in range(3)})
    assert compact(spark, str(folder), LOG) == 3
    assert found(spark, tmp_path) == Counter({(n, "a"): 1 for n in range(3)})


def test_other_streams_sweeps_and_parts_without_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    put_batches(tmp_path / "log" / "stream=s", range(3))
    put_batches(tmp_path / "log" / "stream=t", range(10, 12))
    row = spark.createDataFrame(
        [(None, 1, "c", 99, "swept", "", "backfill")], schemas.MATCHES
    )
    write_match_log(row, log, "sweep=0/round=0")
    write_match_log(row.limit(0), log, "stream=s/batch=3")
    assert compact(spark, f"{log}/stream=s", LOG) == 4
    assert found(spark, log) == Counter({(n, "a"): 1 for n in [0, 1, 2, 10, 11]}) + Counter({(99, "swept"): 1})


def test_parquet_with_nulls_and_no_table_at_all(spark, tmp_path):
    path = str(tmp_path / "outbox")
    assert compact(spark, path, OUTBOX) == 0 and read_outbox(spark, path).isEmpty()
    rows = spark.createDataFrame([("me", None, 1), (None, "t\n", 2), (None, "t\n", 2)], schemas.OUTBOX)
    for n in range(2):
        write_part(rows, path, f"batch={n}")
    before = Counter(tuple(r) for r in read_parts(spark, path, OUTBOX).collect())
    assert compact(spark, path, OUTBOX) == 2
    assert compact(spark, path, OUTBOX) == 0
    after = read_outbox(spark, path)
    assert Counter(tuple(r) for r in after.collect()) == before and sum(before.values()) == 6
    assert after.schema == rows.schema


def test_an_unset_log_is_left_out(spark, tmp_path):
    paths = tables.SinkPaths(None, *(str(tmp_path / n) for n in ("o", "v", "q", "s")))
    tables.compact_batches(spark, paths, "stream=s", 5, fan=8)
