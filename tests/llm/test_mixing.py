import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from riskframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(14)
    out, d = [], 0
    for source, n in (("hot", 120), ("b", 40), ("c", 12), ("d", 3), (None, 2)):
        for _ in range(n):
            out.append((d, prose(rng, rng.randint(1, 60)), "en", source))
            d += 1
    return out + [(d, None, "en", "empty"), (d + 1, "", "en", "b"), (5, out[5][1], "en", "hot")]


def brute_exponent(tokens, budget, flatter, repeats):
    total = sum(tokens.values())

    def curve(a):
        w = {s: (t / total) ** a for s, t in tokens.items()}
        z = sum(w.values())
        w = {s: x / z for s, x in w.items()}
        return -sum(x * math.log(x) for x in w.values()), max(w[s] * budget / t for s, t in tokens.items()), w

    target = curve(1)[0] + flatter * (curve(0)[0] - curve(1)[0])
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if curve(mid)[0] <= target + 1e-12 and curve(mid)[1] <= repeats + 1e-9:
            hi = mid
        else:
            lo = mid
    return hi, curve(hi)[2]


@pytest.mark.parametrize("flatter, repeats, share", [(0.5, 4.0, 1.0), (1.0, 2.0, 1.0), (0.5, 100.0, 0.3), (0.0, 4.0, 2.5)])
def test_weights_and_budget(table, rows, flatter, repeats, share):
    count = defaultdict(int)
    for _, t, _, s in rows:
        count[s or ""] += len((t or "").split())
    count = {s: n for s, n in count.items() if n}
    budget = share * sum(count.values())
    _, want = brute_exponent(count, budget, flatter, repeats)
    got = mixing.copies(table(rows), budget=budget, flatter=flatter, repeats=repeats, block_tokens=64).collect()
    used, weight, longest = Counter(), {}, 0
    for r in got:
        used[r.source] += r.n_tokens * r.passes
        weight[r.source] = r.weight
        longest = max(longest, r.n_tokens)
        assert r.passes in (math.floor(r.due), math.floor(r.due) + 1) and r.passes >= 1
    for s, w in weight.items():
        assert abs(w - want[s]) < 1e-5
        assert used[s] <= w * budget + 1e-3 and used[s] > w * budget - longest - 1
    assert sum(used.values()) <= budget + 1e-3


def test_partial_pass_takes_whole_blocks(table, rows):
    got = mixing.copies(table(rows), block_tokens=64).where("source = 'hot'").collect()
    passes = defaultdict(set)
    for r in got:
        passes[r.block].add(r.passes)
    assert sum(len(x) > 1 for x in passes.values()) <= 1


def test_permuted_and_mixed_rows(table, rows):
    docs = table(rows)
    used = mixing.copies(docs, flatter=0.9, block_tokens=64)
    want = Counter({(r.doc_id, r.source): 0 for r in used.collect()})
    for r in used.collect():
        want[r.doc_id, r.source] += r.passes
    each = mixing.permuted(used).collect()
    assert Counter((r.doc_id, r.source) for r in each) == want and all(0 <= r.turn <= 1 for r in each)
    mixed = mixing.mix(docs, flatter=0.9, block_tokens=64)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source or "") for r in mixed.collect()) == want


def test_odd_and_empty_tables(table, odd_rows, no_rows):
    docs = table(odd_rows)
    got = mixing.copies(docs).collect()
    assert {r.source for r in got} == {"src0"}
    assert sum(r.n_tokens * r.passes for r in got) == sum(len(WORD.findall(t or "")) for _, t in odd_rows)
    assert mixing.copies(no_rows).count() == 0 and mixing.mix(no_rows).count() == 0
    assert mixing.permuted(mixing.copies(table([(1, None), (2, " ")]))).count() == 0
    assert mixing.mix(docs.withColumn("passes", F.lit("x"))).columns == docs.columns


def test_a_long_document_costs_others_no_place(table):
    """The cut block holds one document longer than the room and many short ones: all of those that fit are used."""
    for seed in range(6):
        rows = [(1000 * seed + i, "w " * n, "en", "s") for i, n in enumerate([700] + [30] * 10)]
        used = {r.doc_id: r.passes for r in mixing.copies(table(rows), budget=320).collect()}
        assert set(used.values()) == {1} and len(used) == 10 and 1000 * seed not in used
        rows += [(5000 + i, "w " * 50, "en", "t") for i in range(20)]
        for budget in (300, 900, 1500):
            got = mixing.copies(table(rows), budget=budget).collect()
            for source in ("s", "t"):
                own = {r.doc_id: r.n_tokens for r in got if r.source == source}
                due = next((r.due for r in got if r.source == source), 0.0)
                if 0 < due < 1:
                    whole = sum(len(t.split()) for _, t, _, s in rows if s == source)
                    rest = [len(t.split()) for d, t, _, s in rows if s == source and d not in own]
                    room = due * whole - sum(own.values())
                    assert room >= -1e-3 and all(n > room + 1e-3 for n in rest)


def test_whole_passes_use_rows_without_tokens_no_more_often(table):
    rows = [(1, None), (2, ""), (3, " \n")] + [(10 + i, "w " * (i + 1)) for i in range(8)]
    for share, passes in ((1.0, 1), (2.0, 2)):
        got = mixing.copies(table(rows), budget=share * 36, block_tokens=4).collect()
        assert {r.doc_id: r.passes for r in got} == {d: passes for d, _ in rows}
