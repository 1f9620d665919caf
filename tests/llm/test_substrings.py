import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from riskframe.llm import substrings

W = 400


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i:i + W] for r in raws for i in range(len(r) - W + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - W + 1):
            if seen[r[i:i + W]] > 1:
                gone[i:i + W] = b"\x01" * W
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in substrings.cut_repeats(df).collect()], key=str)


def corpus():
    rng = random.Random(8)
    shared = [prose(rng, 90) for _ in range(5)]
    rows = [(i, prose(rng, rng.randint(5, 160))) for i in range(20)]
    for i in range(30):
        a = prose(rng, rng.randint(1, 30))
        s = rng.choice(shared)
        cut = s[rng.randint(0, 60):len(s) - rng.randint(0, 60)]
        rows.append((100 + i, a + cut + prose(rng, 20) + rng.choice(["", rng.choice(shared)])))
    exact = prose(rng, 100)[:400]
    rows += [(200, exact), (201, exact[:399]), (202, "é" + exact), (203, exact + exact), (204, "ab" * 350),
             (205, "x" * 401), (206, "x" * 400), (207, exact[1:] + "z"), (208, "q" + exact[:-1])]
    return rows


@pytest.mark.parametrize("runs, chunk, size", [(4096, 1 << 20, 2 << 20), (2, 1 << 11, 4000), (1, 1 << 20, 1)])
def test_cuts_match_brute_force(table, monkeypatch, odd_rows, runs, chunk, size):
    monkeypatch.setattr(substrings, "BLOCK_RUNS", runs)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
    rows = corpus() + [r for r in odd_rows if len(r[1] or "") < 4000]
    assert answer(table(rows)) == brute(rows)


def test_a_hot_passage(table):
    rng = random.Random(9)
    passage = prose(rng, 80)[:420]
    rows = [(i, prose(rng, 10) + str(i) + passage + str(i * 7) + prose(rng, 10)) for i in range(120)]
    assert answer(table(rows, 8)) == brute(rows)


def test_cover_and_ranks():
    cover = substrings.difference_cover()
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 900, dtype=np.uint8)
    buf = np.concatenate([buf, buf[100:700], np.zeros(substrings.RANKED + substrings.PERIOD, np.uint8)])
    mask, _ = substrings._steps()
    rank = substrings.cover_ranks(buf, mask)
    at = np.flatnonzero(rank >= 0)
    strings = {int(i): buf[i:i + substrings.RANKED].tobytes() for i in at if i < 1500 - substrings.RANKED}
    by = defaultdict(set)
    for i, s in strings.items():
        by[int(rank[i])].add(s)
    assert all(len(x) == 1 for x in by.values())
    assert [next(iter(by[k])) for k in sorted(by)] == sorted(set(strings.values()))


def test_empty_table(no_rows):
    assert substrings.cut_repeats(no_rows).count() == 0
