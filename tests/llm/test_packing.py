"""Packing: token pieces against whole-text tokenising, plans against their bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siftline.llm.packing import ENDINGS, WordIds, pack, plan_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "A<|endoftext|>B <|EndofText|> x", "é ́a\x1cb\x85Q I'LL 12ab ÀÉ İ ΣΑΣ ΑΣ\n\n\tok", "don't　we'VE"]


def texts_of(seed, n=1500):
    rng = random.Random(seed)
    letters = "aAbB1'sSdD \n\t ́éüΣ#<|>\x1c,.!"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_memory_equals_whole_texts(name):
    texts = texts_of(1)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    words = WordIds(public_tokenizers.path(name))
    assert words.by_word is (name == "word_bpe_49k.json")
    got = [ids.tolist() for at in range(0, len(texts), 400) for ids in words.encode([t.encode() for t in texts[at : at + 400]])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_letter_merges_equal_the_library():
    rng = random.Random(5)
    own = WordIds(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "aeiourstn" * 9 + "ßàáâäçèéêëíñóöüÿ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(60_000)}
    # Every entry of the vocabulary is the encoding of itself.
    words |= {t[:-4] for t in own.tokenizer.get_vocab() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()}
    words = sorted(words)
    whole = [e.ids for e in own.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [ids.tolist() for ids in own.encode([w.encode() for w in words])] == whole
    known = [w.encode() for w in words if w.encode()[-1] in ENDINGS]
    assert own.letters.ids(known).tolist() == [i for w, ids in zip(words, whole) if w.encode()[-1] in ENDINGS for i in ids]


def least_sequences(counts, capacity):
    """Sequences that pieces above a third of the capacity need, two to one at most and the longest first."""
    large = sorted(s for s, n in counts.items() for _ in range(n) if 3 * s > capacity)
    used = 0
    while large:
        size = large.pop()
        fits = [i for i, s in enumerate(large) if s + size <= capacity]
        if fits:
            large.pop(fits[-1])
        used += 1
    return used


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 400), max_size=30))
def test_plans_place_each_rank_once_and_close_the_gaps(counts):
    capacity = 64
    plan = plan_packing(counts, capacity)
    placed = {}
    for size in counts:
        runs = [r for r in plan.tolist() if r[0] == size]
        bounds = [r[1] for r in runs] + [counts[size]]
        assert bounds[0] == 0 if counts[size] else not runs
        for (_, first, sequence, per, offset), end in zip(runs, bounds[1:]):
            for rank in range(first, end):
                i = rank - first
                placed.setdefault(sequence + i // per, []).append((offset + i % per * size, size))
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
        assert sum(3 * s > capacity for _, s in parts) <= 2
    tokens = sum(s * n for s, n in counts.items())
    # Either no small piece opened a sequence, or all but the last are two thirds full.
    assert len(placed) <= max(least_sequences(counts, capacity), 3 * tokens // (2 * capacity) + 1)


def test_plan_is_small_and_rejects_lengths_outside():
    rng = random.Random(2)
    counts = {s: rng.randrange(1, 10**9) for s in range(1, 2049)}
    plan = plan_packing(counts)
    assert len(plan) < 60_000
    with pytest.raises(ValueError):
        plan_packing({2049: 1})


def brute(docs, capacity):
    whole = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents_are_packed_whole(spark, capacity):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta,", "x1", "zwölf"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    docs += [(500, None), (501, ""), (None, "no id"), (7, "same id"), (7, "same id"), (502, "word " * 9000)]
    frame = spark.createDataFrame(
        [(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, length int, offset int, piece string"
    )
    rows = pack(frame, PATH, capacity=capacity, with_ids=True).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == brute(docs, capacity)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    tokens = sum(r.length for r in rows)
    assert len(by) <= 1.12 * tokens / capacity + 1


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert pack(frame, PATH).collect() == []
