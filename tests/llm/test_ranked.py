"""Ranked search against a plain computation of every score."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import ranked
from siftline.llm.ranked import Item, TermLists, evaluate, item_blocks, length_norms, search, terms_of


def brute(docs, items, top):
    plain = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(i, Counter(plain.findall((t or "").translate(low)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    held = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = 0
            for term, often in Counter(plain.findall((text or "").translate(low))).items():
                if tf := c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                    score += often * w * (1000000000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scores)[:top], 1):
            out.append((item_id, rank, None if null else doc_id, -score))
    return sorted(out, key=repr)


def tables(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "x9", "ÀB", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    prose = lambda k: " ".join(rng.choices(words, weights, k=k))
    docs = [(i, prose(rng.randrange(40))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?! .."), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1])]
    docs += [(n + 3 + i, "same TEXT w59") for i in range(50)] + [(n + 60, prose(9000))]
    items = [(i, prose(rng.randrange(1, 25))) for i in range(12)]
    items += [(3, "w0 W0 w0 w59"), (20, None), (21, ""), (22, "nowhere"), (None, "w1 same"), (3, "w0 W0 w0 w59")]
    return docs, items


@pytest.mark.parametrize("top", [3, 20])
def test_search_equals_all_scores(spark, monkeypatch, top):
    docs, items = tables(top)
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = sorted((tuple(r) for r in search(frame, asked, top).collect()), key=repr)
        monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)
        blocks = sorted((tuple(r) for r in search(frame, asked, top).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(docs, items, top)
    assert got == want and blocks == want


def test_blocks_keep_to_the_limit_and_lose_no_item(spark):
    items = spark.createDataFrame([(i, "x" * (i * 7 % 50), i) for i in range(24)] + [(99, "y" * 900, 99)], "item_id long, text string, _row long")
    blocks = [b.collect() for b in item_blocks(items, 200)]
    assert sorted(r.item_id for b in blocks for r in b) == [*range(24), 99]
    assert all(len(b) <= 1 or sum(len(r.text) + 16 for r in b) <= 200 for b in blocks)


def test_accumulators_stop_and_results_stay():
    rng = np.random.default_rng(1)
    terms = np.concatenate([np.full(5, 0), np.full(400, 1), np.full(900, 2)])
    doc = np.concatenate([rng.choice(1000, k, replace=False) for k in (5, 400, 900)])
    parts = np.concatenate([rng.integers(900, 1000, 5), rng.integers(50, 60, 400), rng.integers(1, 5, 900)])
    lists = TermLists(terms, doc, parts, 3)
    plain = np.zeros(1000, np.int64)
    np.add.at(plain, doc, parts * np.array([1, 2, 3])[terms])
    rows, score = evaluate(lists, Item((0, 1, 2), (1, 2, 3)), 1000, 5)
    assert len(rows) == 5 and (plain[rows] == score).all() and sorted(score) == sorted(plain)[-5:]
    assert len(evaluate(lists, Item((0, 1, 2), (1, 2, 3)), 1000, 5, reached=5000)[0]) == 0


def test_terms_and_wide_numbers():
    assert terms_of("Ab-cD é_9 x".encode()) == [b"ab", b"cd", "é".encode(), "9 x".encode()]
    assert length_norms(np.array([10**9, 3]), 10**12, 10**13).tolist() == [75 + 25 * 10**9 * 10**12 // 10**13, 75 + 7]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")], 20)
