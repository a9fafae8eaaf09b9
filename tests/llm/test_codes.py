"""Vector codes against plain loops over all entries."""

import hashlib
import random

import numpy as np
import pytest

from siftline.llm.codes import CellMemory, compress, nearest_entries


def brute(rows, parts=8, entries=16, rounds=6):
    ok = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept = [(v, [int(np.floor(4096 * float(np.float32(x)))) for x in e], l) for v, e, l in ok]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[r[1][p * d : (p + 1) * d] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(g) for col in zip(*g)] if (g := groups.get(i)) else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for r, c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(s for s, _ in found), r[2]))
    by_label = {}
    for _, _, e, l in out:
        by_label[l] = by_label.get(l, 0) + e
    return sorted(((v, c, e, by_label[l], digest) for v, c, e, l in out), key=repr)


def vectors(seed, n=120, dims=16):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(1, rows[4][1], 2), (1, rows[5][1], 2), (1, rows[5][1], 2), (None, rows[6][1], None)]
    bad = [(500, None, 1), (501, [None] + [0.1] * (dims - 1), 1), (502, [float("nan")] * dims, 1), (503, [float("inf")] * dims, 1)]
    return rows + bad + [(504, [0.0] * dims, 3), (505, [-0.00001] * dims, 3)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("n", [120, 3])
def test_codes_equal_plain_loops(spark, n):
    rows = vectors(n, n if n > 9 else 9)[: None if n > 9 else n]
    got = sorted((tuple(r) for r in compress(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_cells_keep_every_nearest_entry(monkeypatch):
    from siftline.llm import codes

    rng = np.random.default_rng(4)
    entries = rng.integers(-900, 900, (16, 4))
    entries[9] = entries[2]  # a tie goes to the lower
    points = rng.integers(-1500, 1500, (4000, 4))
    squared = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    monkeypatch.setattr(codes, "KEPT_CELLS", 50)
    for width in (64, 512, 4096):
        memory = CellMemory(entries, width)
        for part in np.array_split(points, 7):
            code, distance = memory.assign(part)
            own = ((part[:, None, :] - entries) ** 2).sum(axis=2)
            assert (code == own.argmin(axis=1)).all() and (distance == own.min(axis=1)).all()
        masks = nearest_entries(points // width, width, entries)
        assert masks[np.arange(len(points)), squared.argmin(axis=1)].all()
    assert nearest_entries(points // 64, 64, entries).mean() < 0.5


def test_empty_and_unequal_vectors(spark):
    assert compress(frame(spark, [])).collect() == [] and compress(frame(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)]))
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [1e9] * 8, 1)]))
