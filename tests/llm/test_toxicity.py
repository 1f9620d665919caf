import random

import numpy as np
import pytest
from conftest import prose

from riskframe.llm import toxicity

BAD = ["idiotic", "moronic", "disgusting"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(200):
        words = prose(rng, rng.randint(20, 200)).split(" ")
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(table, labelled):
    rows, labels = labelled
    got = toxicity.scored(table(rows), labels).where("held_out").collect()
    assert len(got) > 20 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in got]) > 0.95


def test_scores_match_brute_force(table, labelled):
    rows, labels = labelled
    model = toxicity.fit(table(rows), labels)
    got = {r.doc_id: r.score for r in toxicity.scored(table(rows), labels).collect()}
    for d, t in rows[:40]:
        letters = np.frombuffer(b" " + " ".join(t.lower().split()).encode() + b" ", np.uint8).astype(np.uint32)
        there = set(np.concatenate(list(toxicity.buckets(letters))).tolist())
        z = model.bias + sum(model.weight[model.place[b]] for b in there if model.place[b] >= 0)
        assert abs(got[d] - 1 / (1 + np.exp(-z))) < 1e-9


def test_long_texts_score_alike_in_parts(table, labelled, monkeypatch):
    rows, labels = labelled
    model = toxicity.fit(table(rows), labels)
    whole = [model.score(t.encode()) for _, t in rows[:20]]
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert np.allclose(whole, [model.score(t.encode()) for _, t in rows[:20]])


def test_odd_rows_and_absent_labels(table, labelled, odd_rows, no_rows, no_labels):
    rows, labels = labelled
    got = toxicity.scored(table(rows + odd_rows), labels).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.scored(table(odd_rows), no_labels).collect()} == {0.5}
    assert toxicity.scored(no_rows, labels).count() == 0
