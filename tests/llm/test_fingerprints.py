"""Fingerprints: likeness against generalised Jaccard, edits against a plain walk."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftline.llm import fingerprints
from siftline.llm.fingerprints import compare_edits, fingerprint, likeness, shown, signatures


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    top = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x | y) / top if top else 1.0


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    pairs = []
    for k in range(12):
        a = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 300))]
        b = a[: len(a) * k // 12] + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        pairs.append((" ".join(a).encode(), " ".join(b).encode()))
    n = 4096
    left, right = (signatures([p[i] for p in pairs], n) for i in (0, 1))
    want = np.array([jaccard(a, b) for a, b in pairs])
    error = np.abs(likeness(left, right) - want)
    assert (error < 4 * np.sqrt(want * (1 - want) / n) + 2e-3).all()


def test_company_does_not_matter():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(80))).encode() for _ in range(60)]
    texts += [b"", b" \n", texts[3], texts[5], b"one"]
    together = signatures(texts)
    alone = np.concatenate([signatures([t]) for t in texts])
    assert (together == alone).all()
    assert (together[-3] == together[3]).all() and not together[-5].any()


def brute(docs):
    rows = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        own, changed, other = signatures([text.encode(), new.encode(), following.encode()])
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(own), shown(changed), float((own == changed).mean()), float((own == other).mean())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [200, 3 << 20])
def test_edits_equal_a_plain_walk(spark, monkeypatch, held):
    monkeypatch.setattr(fingerprints, "HELD_BYTES", held)
    rng = random.Random(3)
    docs = [(i * 3, "".join(rng.choice("ab é😀\n") for _ in range(rng.randrange(90)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "x"), (6, "again"), (6, "again"), (None, "no id"), (None, "none either"), (1003, "long words " * 9000)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, 5, "p") for i, t in docs], "doc_id long, text string, part int, head string")
    got = sorted((tuple(r) for r in compare_edits(frame).collect()), key=repr)
    assert got == brute(docs)
    marks = {r.doc_id: r.fingerprint for r in fingerprint(frame.where("doc_id > 1000")).collect()}
    assert marks.items() <= {g[0]: g[3] for g in got}.items()


@pytest.mark.parametrize("docs", [[], [(1, "only one here")], [(1, None), (2, None)]])
def test_few_documents(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in compare_edits(frame).collect()), key=repr) == brute(docs)
