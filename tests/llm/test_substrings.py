"""Removal of repeated windows against a plain count of word tuples."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftline.llm import substrings
from siftline.llm.substrings import remove_repeats, removal_report
from siftline.llm.words import WordDigests, WordRuns, run_hashes, sliding_min


def brute(docs, length):
    words = [(t or "").encode().split() for _, t in docs]
    windows = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if windows[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def documents(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "NBSP joins", "x\x1cy"]
    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [prose(n) for n in (34, 35, 36, 50, 80)]
    docs = []
    for i in range(120):
        text = prose(rng.randrange(120))
        for p in rng.sample(passages, rng.randrange(3)):
            text += "\n\t" + p + "  " + prose(rng.randrange(6))
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "one"), (203, "same " * 36), (204, "alone " * 35), (205, "ab cd " * 100)]
    docs += [(206, docs[7][1]), (206, docs[7][1]), (None, docs[3][1]), (207, prose(4000)), (208, passages[3]), (208, prose(60))]
    return docs


@pytest.mark.parametrize("length", [35, 4])
def test_report_equals_plain_count(spark, length):
    docs = documents()
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, start int, ref string").repartition(5)
    got = sorted((tuple(r) for r in removal_report(frame, length).collect()), key=repr)
    assert got == sorted(brute(docs, length), key=repr)


def test_batches_and_crowded_sketches_change_nothing(spark, monkeypatch):
    docs = documents(6)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(substrings, "MOST_CELLS", 256)
    monkeypatch.setattr(substrings, "SHARD_BITS", 4)
    try:
        got = sorted((tuple(r) for r in removal_report(frame).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute(docs, 35), key=repr)


def test_rewritten_documents(spark):
    docs = documents()
    schema = "ranges string, doc_id long, ref int, text string, n_chars int, _doc long"
    frame = spark.createDataFrame([("en", i, 5, t, len(t or ""), 6) for i, t in docs], schema)
    out = remove_repeats(frame)
    assert out.dtypes == frame.dtypes
    assert {(r.ranges, r.ref, r._doc) for r in out.collect()} == {("en", 5, 6)}
    digests = Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in out.collect())
    assert digests == Counter((i, h) for i, n, gone, h in brute(docs, 35) if not gone or gone < n)
    old = {i: t for i, t in docs}
    same = {i for i, n, gone, _ in brute(docs, 35) if not gone and i not in (206, 208, None)}
    for r in out.collect():
        if r.doc_id in same:
            assert r.text == old[r.doc_id]
        assert r.n_chars == len(r.text or "")


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert removal_report(empty).collect() == [] and remove_repeats(empty).collect() == []
    short = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in removal_report(short).collect()] == [(1, 3, 0)]


def test_word_runs_and_hashes():
    texts = [b"", b" a  bc\td\n", b"\n", b"a bc d", b"bc d e"]
    words = WordRuns(texts)
    assert np.diff(words.first).tolist() == [0, 3, 0, 3, 3]
    assert words.letters.tobytes() == b"a bc d a bc d bc d e "
    starts = words.run_starts(2)
    found = run_hashes(WordDigests().of(words)[0], 2)[0][starts]
    spelled = [words.letters[words.bounds[s] : words.bounds[s + 2]].tobytes() for s in starts]
    assert len(set(found.tolist())) == len(set(spelled)) == 3
    assert all((a == b) == (x == y) for a, x in zip(found, spelled) for b, y in zip(found, spelled))
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in range(1, 20):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]


@pytest.mark.parametrize("length", [35, 4])
def test_crowded_anchors_are_dealt_by_window(spark, monkeypatch, length):
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(20))
    unlike = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))
    docs = documents(7) + [(1000 + i, f"{unlike()} {shared} {unlike()}") for i in range(60)]
    docs += [(2000 + i, docs[-1 - i][1]) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substrings, "ANCHOR_WINDOWS", 40)
    groups, by_anchor = [], substrings._by_anchor
    def seen(suspects):
        groups.extend(r[1] for r in suspects.where("hashes IS NOT NULL").groupBy("anchor").agg({"n": "sum"}).collect())
        return by_anchor(suspects)
    monkeypatch.setattr(substrings, "_by_anchor", seen)
    got = sorted((tuple(r) for r in removal_report(frame, length).collect()), key=repr)
    assert got == sorted(brute(docs, length), key=repr)
    assert groups and max(groups) <= 40


def test_runs_of_any_length_tell_words_apart():
    words = WordRuns([b"a b a b b a a b a b", b"b a b a"])
    digests = WordDigests(limit=0).of(words)
    spelled = words.letters.tobytes().split()
    for size in range(1, 17):
        runs = [tuple(spelled[i : i + size]) for i in range(len(spelled) - size + 1)]
        for lane in digests:
            found = run_hashes(lane, size)[0].tolist()
            assert [h.tolist() for h in run_hashes(lane, (size + 1) // 2, size)][1] == found
            assert len(found) == len(runs) and len(set(zip(found, runs))) == len(set(runs)) == len(set(found))


def test_words_that_meet_in_polynomial_hashes_stay(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 in any base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    word, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    shared = " ".join(f"w{i}" for i in range(34))
    docs = [(1, f"{shared} {word}"), (2, f"{shared} {other}"), (3, f"{shared} {word}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in removal_report(frame).collect())
    assert got == sorted(brute(docs, 35)) and [r[2] for r in got] == [35, 0, 35]


def test_many_equal_rows_carry_their_ranges_once(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = [(7, text)] * 300
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ranges = substrings._with_ranges(frame, 35).selectExpr("size(ranges) AS n").agg({"n": "max"}).first()[0]
    assert ranges <= 90
    assert {tuple(r)[1:3] for r in removal_report(frame).collect()} == {(90, 90)}
