import zlib

import numpy as np
import pytest
from fixtures import CLASHES, EDGE, TOKENIZER, docs
from tokenizers import Tokenizer

from eoframe.llm import wavelet

LIBRARY = Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (7, 2), (511, 9), (512, 300), (513, 50000), (5000, 49408), (300, 1 << 20)])
def test_matrix_answers_as_the_array(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids))
    assert (m.decode() == ids).all() and len(m.decode()) == n
    for i in range(0, n, max(1, n // 17)):
        v = int(ids[i])
        places = np.flatnonzero(ids == v)
        assert m.access(i) == v and m.rank(v) == len(places) and m.rank(v, i) == (ids[:i] == v).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            assert m.select(v, k) == places[k]
    assert m.rank(top + 5) == 0
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(IndexError):
        m.select(0, n)


@pytest.mark.parametrize("shard_ids", [8, 1 << 20])
def test_files_hold_every_document(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(wavelet.write_shards, "__defaults__", (2, shard_ids))
    rows = [r for r in EDGE if r[0] not in (8,)] + [(100 + i, f"text number {i}", "s") for i in range(50)]
    found = {r.doc_id: r for r in wavelet.token_files(docs(spark, rows, CLASHES), TOKENIZER).collect()}
    at = 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(found) == len(rows)


def test_empty_table(spark):
    assert wavelet.token_files(docs(spark, []), TOKENIZER).count() == 0


def test_repeated_rows_lie_in_many_parts(spark, tmp_path):
    rows = [(None, "one and the same text", "s")] * 1000 + [(7, f"text {i}", "s") for i in range(1000)] + [(i, "x", "s") for i in range(8, 1008)]
    wavelet.write_shards(docs(spark, rows), TOKENIZER, str(tmp_path / "shards"))
    shards = spark.read.parquet(str(tmp_path / "shards"))
    held = {r.part: r.n for r in shards.selectExpr("part", "size(doc_ids) AS n").groupBy("part").agg({"n": "sum"}).toDF("part", "n").collect()}
    assert sum(held.values()) == 3000 and max(held.values()) < 900
    found = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in wavelet.read_documents(shards).collect())
    assert [f[2] for f in found] == [-1] * 1000 + [7] * 1000 + list(range(8, 1008))
    assert all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:]))
