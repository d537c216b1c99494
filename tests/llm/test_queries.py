"""The registered queries over the given tables."""

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from tokenizers import Tokenizer

from ledgerframe.llm import registered

SF_DIR = os.environ.get("LEDGERFRAME_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF_DIR}/documents.parquet' order by doc_id").fetchall()
    return {i: (text, lang) for i, text, lang in rows}


def result(spark, name):
    return registered.queries()[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_check(spark, con, name):
    got, want = compare(registered.queries()[name](spark, SF_DIR), con, registered.oracle_sql()[name])
    assert got == want


def test_suffix_dedup(spark, documents):
    seen, want = set(), set()
    for i, (text, _) in documents.items():
        data = (text or "").encode()
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = np.zeros(len(data) + 2, np.int8)
        for k, window in enumerate(windows):
            if window in seen:
                gone[k + 1 : k + 51] = 1
        seen.update(windows)
        kept = bytes(b for b, g in zip(data, gone[1:-1], strict=True) if not g)
        want.add((i, len(data), int(gone.sum()), int((np.diff(gone) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in result(spark, "op2_suffix_dedup")} == want


def test_packing(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(text or "", add_special_tokens=False).ids, 1] for i, (text, _) in documents.items()}
    rows = result(spark, "op5_packing")
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, size in [*((covered[i], len(x)) for i, x in ids.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == size if size is not None else at <= 2048
    assert len(sequences) * 2048 - sum(map(len, ids.values())) < 2048


def test_language_id_is_right_where_it_has_not_learned(spark, documents):
    rows = result(spark, "op6_language_id")
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in documents}
    held = [r for r in rows if r.held_out and documents[r.doc_id][1]]
    assert sum(r.lang_pred == documents[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_quality_keeps_good_documents(spark):
    quality = dict(duckdb.sql(f"select doc_id, quality from '{SF_DIR}/labels.parquet'").fetchall())
    rows = [r for r in result(spark, "op4_quality_rules") if r.doc_id in quality]
    good = [r.kept for r in rows if quality[r.doc_id] and not r.base_failed]
    bad = [r.kept for r in rows if not quality[r.doc_id]]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_sharding_is_even(spark, documents):
    rows = result(spark, "op8_sharding")
    sizes = {r.doc_id: r.size for r in rows}
    assert sizes == {i: len((text or "").encode()) + 16 for i, (text, _) in documents.items()}
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    # as even as the largest document lets it be
    assert max(loads.values()) <= sum(sizes.values()) / 40 + max(sizes.values())
    for shard in range(40):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_near_dedup_finds_alike_documents(spark, documents):
    shingles = {}
    for i, (text, _) in documents.items():
        found = (text or "").split()
        shingles[i] = {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))}
    classes = {r.doc_id: r.class_id for r in result(spark, "op10_near_dedup")}
    assert set(classes) == set(documents)
    ids = sorted(documents)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(shingles[i] & shingles[j])
            if common >= 0.8 * (len(shingles[i]) + len(shingles[j]) - common):
                assert classes[i] == classes[j]
            if not common and (documents[i][0] or "").strip():
                assert classes[i] != classes[j] or sum(c == classes[i] for c in classes.values()) > 2
