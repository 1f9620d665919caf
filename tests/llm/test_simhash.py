import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from riskframe.llm import graph, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for d, x in zip(ids, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [least.get(x) for x in label]


def test_golay_code_is_perfect_and_keys_meet():
    errors, near = simhash.golay()
    assert len(np.unique(errors)) == 2048 and np.bitwise_count(errors).max() == 3
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    other = bits.copy()
    for i in range(len(bits)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    place, key, _ = simhash.keys(bits)
    at, filed_key, filed = simhash.keys(other)
    looked = {i: set(key[place == i].tolist()) for i in range(len(bits))}
    stored = {i: set(filed_key[filed & (at == i)].tolist()) for i in range(len(bits))}
    assert all(looked[i] & stored[i] for i in range(len(bits)))


def test_groups_match_brute_force(table, odd_rows):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = list(odd_rows)
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        for j in range(rng.randint(1, 4)):
            rows.append((100 + 10 * i + j, " ".join(base)))
            base[rng.randrange(len(base))] = rng.choice(words)
    got = simhash.near_groups(table(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, brute_components([d for d, _ in rows], prints))]
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) == sum(r.kept for r in got)


def test_hot_keys_are_split(table, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 2)
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(600)]
    rows = []
    for i in range(60):
        base[rng.randrange(600)] = f"w{rng.randrange(300)}"
        rows.append((i, " ".join(base)))
    prints = [brute_print(t) for _, t in rows]
    want = dict(zip(range(60), brute_components(list(range(60)), prints)))
    assert {r.doc_id: r.component_id for r in simhash.near_groups(table(rows)).collect()} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 230)] + [(500, 501), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 200 for i in range(201, 230)}, 501: 500}


def test_empty_table(no_rows):
    assert simhash.near_groups(no_rows).count() == 0
    assert simhash.drop_near_copies(no_rows).columns == no_rows.columns
