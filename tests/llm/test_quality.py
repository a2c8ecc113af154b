import zlib

import numpy as np
from fixtures import CLASHES, EDGE, SF, docs

from eoframe.llm import quality
from eoframe.llm.tables import table


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in EDGE]
    together, bounds = quality.features(texts)
    for i, t in enumerate(texts):
        alone, b = quality.features([t])
        assert together[bounds[i] : bounds[i + 1]].tolist() == alone[b[0] : b[1]].tolist()


def test_held_out_accuracy(spark):
    big = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in table(spark, big, "labels").collect()}
    found = quality.score_quality(table(spark, big, "documents"), table(spark, big, "labels")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    tested = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in tested if y], [s for s, y in tested if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == y for s, y in tested]) > 0.9


def test_edges(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, None, 0), (3, 0, 0), (None, 1, 0), (5, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int"
    )
    table_ = docs(spark, EDGE, CLASHES)
    found = quality.score_quality(table_, labels).collect()
    assert len(found) == len(EDGE) and all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(table_, labels)
    assert kept.columns == table_.columns
    assert kept.count() == sum(r.predicted for r in found)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs(spark, EDGE), none).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), none).count() == 0


def test_labels_decide_and_the_held_out_fold_does_not(spark):
    rows = [(i, ("good words here " if i % 2 else "bad *** junk *** ") * 5, "s") for i in range(200)]
    right = [(i, i % 2, 0) for i in range(200)]
    twisted = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, t) for i, q, t in right]
    schema, scores = "doc_id long, quality int, toxic int", []
    for known in (right, twisted):
        found = quality.score_quality(docs(spark, rows), spark.createDataFrame(known, schema)).collect()
        scores.append({r.doc_id: r.score for r in found})
    assert scores[0] == scores[1]
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in scores[0].items())
