"""Vector links against all cosines in double precision."""

import math

import numpy as np
import pytest

from siftline.llm import embeddings
from siftline.llm.embeddings import _unit, near_duplicate_vectors, near_pairs, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, node string, tile int"


def brute(rows, threshold):
    fit = []
    for i, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        fit.append(np.float32(v).astype(np.float64) if ok else None)
    n = len(rows)
    links = [0] * n
    parent = list(range(n))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            u, v = fit[a], fit[b]
            if u is None or v is None or rows[a][2] != rows[b][2] or len(u) != len(v):
                continue
            if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold or (u == v).all():
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return [(rows[a][0], links[a], least.get(find(a)), rows[a][0] == least.get(find(a))) for a in range(n)]


def vectors(width=16):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(width)
        for _ in range(rng.integers(1, 8)):
            v = base + rng.standard_normal(width) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((len(rows), [float(x) for x in np.float32(v * rng.choice([1, 1e-3, 50]))], int(rng.integers(0, 3))))
    some = rows[0][1]
    rows += [(1000, None, 0), (1001, [0.0] * width, 0), (1002, [math.nan] * width, 0), (1003, [None] + some[1:], 0)]
    rows += [(1004, [math.inf] + some[1:], 0), (1005, some, None), (1006, some[:5], 0), (1007, [], 0), (1008, some[:5], 0)]
    rows += [(1009, [3e38] * width, 1), (1010, [1e-30] * width, 1), (7, some, 0), (7, some, 0), (None, some, 0), (None, [1.0] + [0.0] * (width - 1), 2)]
    return rows


@pytest.mark.parametrize("tile_rows, threshold", [(1024, 0.98), (8, 0.98), (16, 0.9)])
def test_links_equal_all_cosines(spark, monkeypatch, tile_rows, threshold):
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile_rows)
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicate_vectors(frame, threshold).collect()), key=repr)
    want = [(i, n, c, k if i is not None else c is None) for i, n, c, k in brute(rows, threshold)]
    assert got == sorted(want, key=repr)
    assert sum(n for _, n, _, _ in want) > 200


def test_bounds_hold_and_pairs_are_exact():
    rng = np.random.default_rng(2)
    for width in (1, 3, 64, 1500):
        base = rng.standard_normal((40, width))
        unit = _unit(np.concatenate([base, base + rng.standard_normal((40, width)) * 0.15]))
        codes, scale, lost = quantise(unit)
        back = codes * scale[:, None]
        assert (np.linalg.norm(unit - back, axis=1) <= lost + 1e-12).all()
        bound = np.linalg.norm(back, axis=1)[:, None] * lost + lost[:, None]
        assert (np.abs(unit @ unit.T - back @ back.T) <= bound + 1e-9).all()
        tile = (unit, codes, scale, lost)
        for threshold in (0.9, 0.98):
            got = set(zip(*(x.tolist() for x in near_pairs(tile, tile, threshold))))
            assert got == set(zip(*(x.tolist() for x in np.nonzero(np.einsum("id,jd->ij", unit, unit) >= threshold))))


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, 0, "x", 1)], SCHEMA)
    assert [tuple(r) for r in near_duplicate_vectors(only).collect()] == [(1, 0, 1, True)]
