"""Byte-level BPE: whole-text results of the library, however texts are cut and joined."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siftline.llm import bpe
from siftline.llm.bpe import ByteBpe, round_trips

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
NASTY = "aAbe's'reLl 12\n\t é日本 　\x85\x1c\x1d!?<|>_endoftext|>𝔘 "


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiny():
    """Leaves of a few bytes, so that everything is cut and joined."""
    return ByteBpe(PATH, leaf=5)


@pytest.fixture(scope="module")
def plain():
    return ByteBpe(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(NASTY), max_size=120))
def test_cut_and_joined_texts_equal_whole_ones(tiny, text):
    assert tiny.encode([text])[0].tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(NASTY + "the quick brown"), max_size=60), max_size=8))
def test_remembered_stretches_equal_whole_texts(plain, texts):
    assert [x.tolist() for x in plain.encode(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=1, max_size=200) | st.text("thequickbrownfx", min_size=1, max_size=200) | st.integers(1, 300).map(lambda n: "a" * n))
def test_trees_of_one_piece(tiny, text):
    assert tiny.unsplit(text.encode()).tolist() == ids_of(text)
    parts = [tiny.merged(text.encode()[i : i + 7]) for i in range(0, len(text), 7)]
    assert tiny.joined_all(parts).tolist() == ids_of(text)


def test_every_character_in_every_place(plain, tiny):
    for start in range(0, 0x110000, 0x10000):
        step = 1 if start < 0x30000 else 97  # mostly unassigned beyond
        letters = [chr(c) for c in range(start, start + 0x10000, step) if not 0xD800 <= c < 0xE000]
        text = "".join(f"{c}a {c} {c}{c}1{c}  b'{c}" for c in letters)
        assert plain.encode([text])[0].tolist() == ids_of(text)
    text = "".join(chr(c) for c in range(0x20, 0x3100)) * 3
    assert tiny.encode([text])[0].tolist() == ids_of(text)


def test_pieces_end_where_the_library_ends_them(plain, monkeypatch):
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 7)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("a's're  \n!1é'") for _ in range(rng.randrange(80)))
        want = [span for _, span in WHOLE.pre_tokenizer.pre_tokenize_str(text)]
        assert list(plain.pieces(text)) == want


def test_memory_that_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    own = ByteBpe(PATH)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in own.encode(texts)] == [ids_of(t) for t in texts]


def brute(rows):
    out = []
    for doc_id, text in rows:
        ids = ids_of(text or "")
        back = WHOLE.decode(ids, skip_special_tokens=False).encode()
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    return sorted(out, key=repr)


def test_round_trips_of_all_lengths(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgé日") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(rng.randrange(60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (None, rows[1][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(60, prose(900)), (60, rows[5][1] * 40), (None, prose(500)), (61, "a" * 9000), (62, "".join(rng.choice("ab") for _ in range(20000)))]
    rows += [(63, "日本" * 4000 + " x" + "=" * 5000 + "<|endoftext|>" + "=-" * 3000 + "'" * 4000 + "s"), (64, "<|endoftext|>" * 900), (65, " " * 9000 + "y")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(4)
    got = round_trips(frame, PATH, long=2000, segment=300, leaf=64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert round_trips(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_decoding_marks_bytes_that_are_no_text(plain):
    half = plain.merged("é".encode()[:1] + b"x" + "日".encode()[1:])
    assert plain.decode(half).decode() == WHOLE.decode(half.tolist(), skip_special_tokens=False)
