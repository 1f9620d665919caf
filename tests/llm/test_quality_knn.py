import random

import numpy as np
import pytest
from conftest import prose

from riskframe.llm import quality_knn


@pytest.fixture(scope="module")
def labelled(spark, table):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(40, 300))) for i in range(60)]
    rows += [(100 + i, " ".join(w for x in prose(rng, 60).split() for w in [x] * 6)) for i in range(30)]
    rows += [(200 + i, "!! ".join(prose(rng, 120).upper().split())) for i in range(30)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    return rows, labels


def test_held_out_rows_are_told_apart(table, labelled):
    rows, labels = labelled
    got = quality_knn.scored(table(rows), labels).where("held_out").collect()
    assert len(got) > 10 and all(r.predicted == int(r.doc_id < 100) for r in got)


def test_votes_match_brute_force(table, labelled):
    rows, labels = labelled
    model = quality_knn.fit(table(rows), labels)
    got = {r.doc_id: r.score for r in quality_knn.scored(table(rows), labels).collect()}
    for d, t in rows:
        z = model.weighted(quality_knn.terms(t.encode())[None], model.idf) @ model.axes
        cosine = (model.vectors @ z[0]) / np.linalg.norm(z)
        best = np.argsort(-cosine)[:quality_knn.NEIGHBOURS]
        w = np.maximum(cosine[best], 0) ** 4
        assert abs(got[d] - (w * model.labels[best]).sum() / w.sum()) < 1e-3


def test_equally_near_neighbours_all_vote():
    at = np.eye(2, dtype=np.float32)
    model = quality_knn.Neighbours(np.ones(quality_knn.TERMS + quality_knn.MARKS, np.float32),
                                   np.zeros((quality_knn.TERMS + quality_knn.MARKS, 2), np.float32), at[[0] * 9 + [1] * 3],
                                   np.array([1] * 4 + [0] * 5 + [1] * 3, np.float32))
    model.axes[0] = at[0]
    counts = np.zeros((2, len(model.idf)), np.uint16)
    counts[:, 0] = 3
    assert np.allclose(model.scores(counts), 4 / 9) and np.allclose(model.scores(counts, neighbours=12), 4 / 9)


def test_odd_rows_scores_and_columns(table, labelled, odd_rows):
    rows, labels = labelled
    docs = table(rows + odd_rows)
    got = quality_knn.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality_knn.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"score"}


def test_null_repeated_and_absent_labels(spark, table, no_rows, no_labels, odd_rows):
    assert {r.score for r in quality_knn.scored(table(odd_rows), no_labels).collect()} == {0.5}
    assert quality_knn.scored(no_rows, no_labels).count() == 0
    some = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (7, 1, 0)], no_labels.schema)
    assert quality_knn.scored(table(odd_rows), some).count() == len(odd_rows)
