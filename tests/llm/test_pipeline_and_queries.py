import hashlib

import pytest
from fixtures import SF
from test_mixing import plain as plain_mix
from test_near_copies import plain_kept
from test_tokens_and_packing import check as check_pieces

import corpus_pipeline
from eoframe.llm import quality
from eoframe.llm.queries import QUERIES, SQL
from eoframe.llm.tables import documents, materialize, table


def test_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    from oracle_check import compare, connect

    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before kept."""
    docs, kept = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name == "quality":
            model = quality.fit(documents(spark, SF), table(spark, SF, "labels"))
            good = model.scores([r.text for r in before]) >= 0.5
            assert sorted(r.doc_id for r in kept[name]) == sorted(r.doc_id for r, g in zip(before, good) if g)
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[hashlib.sha256(r.text.encode()).digest()] = max(last.get(hashlib.sha256(r.text.encode()).digest(), -1), r.doc_id)
            assert sorted(r.doc_id for r in kept[name]) == sorted(last.values())
        if name == "near_dedup":
            assert sorted(r.doc_id for r in kept[name]) == sorted(i for i, _ in plain_kept([(r.doc_id, r.text) for r in before]))
        if name == "mixing":
            rows = [(r.doc_id, r.text, r.source) for r in before]
            want = sorted(i for i, n, _, _, taken in plain_mix(rows) if taken for _ in range(taken // n))
            assert sorted(r.doc_id for r in kept[name]) == want
        if name == "packing":
            check_pieces(kept[name], [(r.doc_id, r.text, r.source) for r in before], 2048)
    assert len(kept["packing"]) == corpus_pipeline.run(spark, SF).count()


def test_all_but_the_last_return_documents(spark):
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns

