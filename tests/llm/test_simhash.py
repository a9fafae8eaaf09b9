"""SimHash groups against all pairs, BK-trees against all distances."""

import random

import numpy as np
import pytest
import xxhash

from siftline.llm import simhash
from siftline.llm.components import components
from siftline.llm.simhash import BkForest, block_masks, distinct_documents, near_duplicates, near_links


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(values, radius):
    """Component of every index by all pairs."""
    label = list(range(len(values)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) for i in range(len(values))]


def documents():
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(300)]
    docs = []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        docs.append((len(docs) + 10, " ".join(base)))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            docs.append((len(docs) + 10, "\n".join(copy).upper()))
    docs += [(3, None), (900, ""), (901, "\t \x0b"), (902, "One"), (903, "one TWO"), (904, "É é Ü"), (905, "É É Ü"), (906, "w " * 30000)]
    docs += [(907, docs[0][1]), (907, docs[0][1]), (None, docs[5][1]), (None, "no id and alone")]
    return docs


def test_groups_equal_all_pairs(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, bits int, part string")
    got = near_duplicates(frame).collect()
    values = [fingerprint(t) for _, t in docs]
    found = groups(values, 3)
    least = {}
    for (i, _), g in zip(docs, found):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = [(i, f"{v:016x}", least.get(g)) for (i, _), v, g in zip(docs, values, found)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len(set(found)) < len(docs) - 30


def test_distinct_documents_keep_one_of_each_group(spark):
    docs = documents()
    frame = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, bits int, component_id string")
    marks = {r.doc_id: r.component_id for r in near_duplicates(frame).collect()}
    kept = distinct_documents(frame)
    assert kept.columns == frame.columns
    assert sorted({r.doc_id for r in kept.collect()}, key=repr) == sorted({i for i, c in marks.items() if i is None or i == c}, key=repr)


@pytest.mark.parametrize("tree_rows", [4, 1024])
def test_links_of_crowded_shards(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(simhash, "TREE_ROWS", tree_rows)
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(50)}
    for center in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(150):
            v = center
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "bits long"))
    found = {r.node: r.component for r in components(links).collect()}
    label = {}
    for v, g in zip(signed, groups(values, 3)):
        label.setdefault(g, []).append(v)
    want = {v: min(own) for own in label.values() if len(own) > 1 for v in own}
    assert found == want


def test_trees_find_what_all_distances_find():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    groups_ = np.sort(rng.integers(0, 5, len(values)))
    forest = BkForest(values, groups_)
    for radius in (0, 1, 3):
        queries = rng.integers(0, 1 << 12, 60, dtype=np.uint64)
        trees = rng.integers(0, 5, 60)
        got = set(zip(*(x.tolist() for x in forest.search(queries, trees, radius))))
        names = np.unique(groups_)
        assert got == {
            (q, v)
            for q in range(60)
            for v in range(len(values))
            if groups_[v] == names[trees[q]] and np.bitwise_count(queries[q] ^ values[v]) <= radius
        }


def test_blocks_catch_every_pair_in_radius():
    masks = [m % (1 << 64) for m in block_masks(3)]
    assert len(masks) == 10
    rng = random.Random(2)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(x & m == 0 for m in masks)


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(frame).collect() == [] and distinct_documents(frame).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 400)] + [(7, 7), (None, 3), (3, None), (50, 51), (51, 50), (-5, 60), (60, 61)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 401)} | {50: 50, 51: 50, -5: -5, 60: -5, 61: -5}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
