import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from conftest import prose

from riskframe.llm import lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def corpus(odd_rows):
    rng = random.Random(13)
    return list(odd_rows) + [(100 + i, prose(rng, rng.randint(1, 300))) for i in range(60)]


def brute(rows):
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total = sum(count.values())
    below = math.log10(total + 0.5 * (len(count) + 1))
    out = []
    for d, t in rows:
        w = tokens(t)
        out.append((d, held(d), len(w), sum(count[x] > 0 for x in w), total,
                    sum(math.log10(count[x] + 0.5) for x in w) - len(w) * below))
    return out


def test_base_scores_match_brute_force_whatever_is_frequent(table, odd_rows):
    rows = corpus(odd_rows)
    for frequent in (3, 50, 200_000):
        got = lm_scoring.scores(table(rows), vocabulary=20, frequent=frequent).collect()
        key = lambda r: (str(r[0]), r[2], round(r[5], 6))
        got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
        want = sorted(brute(rows), key=key)
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in got], [x[5] for x in want])


def test_model_is_a_probability_and_learns():
    counts = np.array([400, 300, 200, 100, 50])
    model = lm_scoring.Model.start(counts, 8)
    rng = np.random.default_rng(0)
    text = np.array([0, 1, 2] * 400 + list(rng.integers(0, 5, 300)))
    trainer = lm_scoring.Trainer(model, np.bincount(text, minlength=5), 1)
    upto = np.array([0, 700, len(text)])
    for _ in range(60):
        trainer.learn(text, upto, 0)
    one, two = lm_scoring.contexts(text, upto, 0)

    def logp(m):
        s = m.predicted(one, two) @ m.target.T + m.bias - m.normalisers(one, two)[:, None]
        assert np.allclose(np.exp(s).sum(axis=1), 1, atol=1e-4)
        return s[np.arange(len(text)), text].mean()

    assert logp(trainer.model) > logp(model) + 0.2
    assert one[700] == two[700] == two[701] == 0 and one[701] == text[700]


def test_scores_match_the_model_token_by_token():
    frequent, counts = ["", "a", "b", "c", "d"], np.array([5, 9, 7, 3, 2])
    model = lm_scoring.Model.start(np.array([5, 9, 5]), 4)
    import pyarrow as pa
    texts = ["a b c a", "", "zz a d zz", " b  A "]
    batch = pa.RecordBatch.from_pydict({"uid": [0, 1, 2, 3], "doc_id": [7, 8, 9, 9], "text": texts})
    got = [r for b in lm_scoring._scored(model, frequent, counts, 2)([batch]) for r in b.to_pylist()]
    for r, t in zip(got, texts):
        w = tokens(t)
        c = [min(frequent.index(x), 2) if x in frequent else 2 for x in w]
        total = 0.0
        for i, x in enumerate(c):
            one, two = (c[i - 1] if i else 0), (c[i - 2] if i > 1 else 0)
            s = model.predicted(np.array([one]), np.array([two]))[0] @ model.target.T + model.bias
            total += (s[x] - np.log(np.exp(s).sum())) / math.log(10)
        assert r["n_tokens"] == len(w) and abs(r["neural"] - total) < 1e-4
        assert r["n_outside"] == sum(x == 2 for x in c) and r["n_frequent"] == sum(x in frequent for x in w)
        assert {x["token"]: x["n"] for x in r["rest"]} == Counter(x for x in w if x not in frequent)


def test_empty_table_and_nothing_to_learn(table, no_rows):
    assert lm_scoring.scores(no_rows).count() == 0
    only = [d for d in range(200) if held(d)][:2]
    got = lm_scoring.scores(table([(d, "a b") for d in only])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 2


def test_every_counted_word_has_its_own_probability_in_the_factored_model():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(20, 900, 1500))[::-1]
    model, out = lm_scoring.Model.start(counts, 8), lm_scoring.Outputs(len(counts))
    assert len(model.context) == 1500 and out.head < 1499 and out.width.max() > 1
    follows = rng.permutation(1499)
    text = np.empty(120_000, np.int64)
    text[0::2] = rng.integers(0, 1499, 60_000)
    text[1::2] = follows[text[0::2]]
    trainer = lm_scoring.Trainer(model, counts, 1)
    for _ in range(6):
        trainer.learn(text, np.array([0, len(text)]), 0)
    one, two = lm_scoring.contexts(text, np.array([0, len(text)]), 0)

    def logp(m, a, b, classes):
        q, to = m.predicted(a, b), out.of[classes]
        s = (q * m.target[to]).sum(1) + m.bias[to] - m.normalisers(a, b)
        tail = np.flatnonzero((classes >= out.head) & (classes < 1499))
        s[tail] += m.within(q[tail], classes[tail] - out.head, out)
        return s

    every = np.arange(1500)
    for a, b in ((3, 700), (1200, 5)):
        assert abs(np.exp(logp(trainer.model, np.full(1500, a), np.full(1500, b), every)).sum() - 1) < 1e-3
    late = np.flatnonzero((text > 700) & (np.arange(len(text)) % 2 == 1))  # words beyond any fixed 512, told by words
    gain = logp(trainer.model, one[late], two[late], text[late]) - logp(model, one[late], two[late], text[late])
    assert gain.mean() > 0.3


def test_the_vocabulary_follows_the_corpus(table, monkeypatch):
    sizes = []
    real = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda t, v, c: sizes.append(len(v)) or real(t, v, c))
    rng = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    rows = [(d, " ".join(rng.sample(words, 900))) for d in range(12)]
    got = lm_scoring.scores(table(rows)).collect()
    assert sizes == [901] and all(np.isfinite(r.score) for r in got)


def test_a_group_is_summed_once_for_a_context(monkeypatch):
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(20, 900, 600))[::-1]
    model, out = lm_scoring.Model.start(counts, 8), lm_scoring.Outputs(len(counts))
    q = rng.normal(0, 1, (7, 8)).astype(np.float32)
    place, row = rng.integers(0, len(out.group), 4000), rng.integers(0, 7, 4000)
    want = model.within(q[row], place, out)
    rows, real = [], lm_scoring._log_totals
    monkeypatch.setattr(lm_scoring, "_log_totals", lambda q, *a: rows.append(len(q)) or real(q, *a))
    got = model.within(q, place, out, row)
    assert np.allclose(got, want, atol=1e-5)
    assert sum(rows) == len(set(zip(row.tolist(), out.group[place].tolist()))) < 400
    assert len(model.within(q, place[:0], out, row[:0])) == 0


def test_a_step_reads_each_row_once_and_follows_the_plain_gradients(monkeypatch):
    """Batches that begin inside texts, texts of one token, repeated rows: the same vectors as sums token by token."""
    monkeypatch.setattr(lm_scoring, "BATCH", 37)
    rng = np.random.default_rng(6)
    counts = np.sort(rng.integers(1, 90, 200))[::-1]
    size, text = 6, rng.integers(0, 200, 300)
    upto = np.array([0, 1, 2, 36, 37, 38, 73, 74, 150, 300])
    model = lm_scoring.Model.start(counts, size)
    trainer = lm_scoring.Trainer(model, counts, 3)
    reads, real = [], lm_scoring.Rows.values
    monkeypatch.setattr(lm_scoring.Rows, "values", lambda r: reads.append((len(r.row), len(np.unique(r.row)))) or real(r))
    trainer.learn(text, upto, 0)
    assert reads and all(a == b for a, b in reads)

    m, out, draw = model.unpacked(model.packed().astype(np.float64)), trainer.out, np.random.default_rng((lm_scoring.SEED, 3))
    x = {k: getattr(m, k).astype(np.float64) for k in lm_scoring.NAMES}
    seen = {k: np.ones_like(v) for k, v in x.items()}
    share = out.counts(counts + 0.5) / out.counts(counts + 0.5).sum()
    ones, twos = lm_scoring.contexts(text, upto, 0)
    for i in range(0, len(text), 37):
        one, two, aim = ones[i:i + 37], twos[i:i + 37], text[i:i + 37]
        noise = np.searchsorted(np.cumsum(share), draw.random(lm_scoring.NOISE))
        g = {k: np.zeros_like(v) for k, v in x.items()}
        q = x["context"][one] * x["scale"][0] + x["context"][two] * x["scale"][1]
        dq = np.zeros_like(q)

        def pull(names, at, rows, odds, hit):
            s = (q[at] * x[names[0]][rows]).sum(1) + x[names[1]][rows] - odds
            w = hit - 1 / (1 + np.exp(-s))
            np.add.at(g[names[0]], rows, w[:, None] * q[at])
            np.add.at(g[names[1]], rows, w)
            np.add.at(dq, at, w[:, None] * x[names[0]][rows])

        every, log = np.arange(len(aim)), np.log(lm_scoring.NOISE * share)
        pull(("target", "bias"), every, out.of[aim], log[out.of[aim]], 1)
        for k in noise:
            pull(("target", "bias"), every, np.full(len(aim), k), log[k], 0)
        at = np.flatnonzero((aim >= out.head) & (aim < 199))
        group = out.group[aim[at] - out.head]
        width, odds = out.width[group], np.log(lm_scoring.GROUP_NOISE / out.width)[group]
        drawn = out.edges[group][:, None] + (draw.random((len(at), lm_scoring.GROUP_NOISE)) * width[:, None]).astype(int)
        pull(("tail", "tail_bias"), at, aim[at] - out.head, odds, 1)
        for k in range(lm_scoring.GROUP_NOISE):
            pull(("tail", "tail_bias"), at, drawn[:, k], odds, 0)
        np.add.at(g["context"], one, dq * x["scale"][0])
        np.add.at(g["context"], two, dq * x["scale"][1])
        g["scale"] = np.stack([(dq * x["context"][one]).sum(0), (dq * x["context"][two]).sum(0)])
        for k in x:
            seen[k] += g[k] ** 2
            x[k] += lm_scoring.RATE * g[k] / np.sqrt(seen[k])
    for k in x:
        assert np.allclose(getattr(trainer.model, k), x[k], atol=1e-4), k
