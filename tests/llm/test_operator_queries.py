"""Registered queries: SQL twins where there are, stated properties elsewhere, and the pipeline."""

import os
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from oracle import compare, duck
from siftline.llm.common import table
from siftline.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_twins(spark, name):
    rows, problem = compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name])
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", ["op5_license_scan", "op7_url_lists"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_archives(spark):
    import base64
    import hashlib

    pages = table(spark, SF_DIR, "pages").collect()
    got = {r.page_id: r for r in QUERIES["op1_warc_archives"](spark, SF_DIR).collect()}
    assert len(got) == len(pages)
    for p in pages:
        data = (p.html or "").encode()
        assert got[p.page_id].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[p.page_id].payload_bytes == len(data)


def test_packed_documents(spark):
    rows = QUERIES["op2_best_fit_packing"](spark, SF_DIR).toPandas()
    docs = table(spark, SF_DIR, "documents").toPandas()
    assert set(rows.doc_id) == set(docs.doc_id)
    placed = rows.sort_values(["sequence_id", "offset"])
    ends = placed.offset + placed.length
    assert ((placed.offset == 0) | (placed.offset == ends.shift())).all() and (ends <= 2048).all()
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) * 1.02 + 1


def _stages(spark):
    docs = table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        yield name, docs, out
        docs = out


def test_stages_keep_the_columns_and_take_effect(spark):
    names = []
    for name, docs, out in _stages(spark):
        names.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
            before, after = docs.toPandas(), out.toPandas()
            assert 0 < len(after)
            if name == "source mixing":
                words = lambda f: f.text.str.count(r"[^\x20\x09-\x0D]+").sum()
                assert words(after) <= 1.5 * words(before) + 1
            else:
                assert set(after.doc_id) <= set(before.doc_id) and (len(after) < len(before) or name == "substring dedup")
    assert len(names) == 5


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert len(rows) and rows.sequence_id.notna().all()


def test_round_trips(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in table(spark, SF_DIR, "documents").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        digests = (np.array(ids, "<u4").tobytes(), text.encode())
        want.append((r.doc_id, len(ids), *(hashlib.sha256(d).hexdigest() for d in digests)))
    got = [tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(want)
