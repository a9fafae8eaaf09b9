"""Mixing against a plain water-filling and a plain walk through the order."""

import hashlib
import re

from siftline.llm.mixing import mix_documents, mix_plan

SCHEMA = "doc_id long, text string, source string, n_chars long, taken int"


def brute(docs, share=1.5, most=2):
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    names = sorted({s for _, s, _ in sizes if s is not None}) + [None] * any(s is None for _, s, _ in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for _, t, n in sizes if t == s) for s in names}
    full, target = set(), {}
    while True:
        left = share * sum(size.values()) - sum(most * size[s] for s in full)
        rest = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest} | {s: most * size[s] for s in full}
        over = {s for s in rest if target[s] >= most * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        rounds = int(target[s] // size[s]) if size[s] else 0
        room = int(target[s]) - rounds * size[s]
        own = [(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for i, t, n in sizes if t == s]
        for _, i, n in sorted(own):
            more = max(0, min(n, room))
            room -= n
            out.append((i, s, n, size[s], round(target[s], 6), rounds * n + more))
    return sorted(out, key=repr)


def documents():
    docs = [(i, "w " * (i * 37 % 90), f"s{'aé😀zB'[i % 5]}") for i in range(300)]
    docs += [(i, "big " * 400, "sB") for i in range(300, 400)]  # a source with most of all words
    docs += [(900, None, "sz"), (901, "", None), (None, "no id here", None), (903, "tie tie", "sz"), (903, "tie tie", "sz"), (904, "", "empty")]
    return docs


def test_plan(spark):
    docs = documents()
    frame = spark.createDataFrame([(i, t, s, 1, 5) for i, t, s in docs], SCHEMA)
    rows = mix_plan(frame).collect()
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows), key=repr)
    assert got == brute(docs)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
        assert all(r.taken <= 2 * r["size"] for r in own)


def test_documents_come_as_often_as_taken(spark):
    docs = documents()
    schema = "size int, text string, doc_id long, source string, n_chars int, _bucket string, taken double"
    frame = spark.createDataFrame([(7, t, i, s, len(t or ""), "b", 0.5) for i, t, s in docs], schema)
    mixed = mix_documents(frame)
    assert mixed.dtypes == frame.dtypes
    assert {(r["size"], r._bucket, r.taken) for r in mixed.collect()} == {(7, "b", 0.5)}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    want = {}
    for i, _, _, _, _, taken in brute(docs):
        want[None if i == -1 else i] = want.get(None if i == -1 else i, 0) + taken
    assert words == {i: n for i, n in want.items() if n}


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(frame).collect() == [] and mix_documents(frame).collect() == []


def test_sources_without_words(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mix_plan(frame).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
