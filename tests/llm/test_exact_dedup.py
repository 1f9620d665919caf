import hashlib
from collections import defaultdict

import pytest

from riskframe.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep, len(ids), sha) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_groups_match_brute_force_whatever_the_block(table, odd_rows, block):
    rows = [r for r in odd_rows if block > 100 or len(r[1] or "") < 4000]
    rows += [(20, "ab" * 50), (21, "ab" * 50 + "c"), (22, "ab" * 50), (23, "b" + "ab" * 50), (24, "ab" * 51)]
    got = exact_dedup.exact_groups(table(rows), block_bytes=block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_drop_copies_keeps_all_columns(table, odd_rows):
    docs = table(odd_rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.text or "") for r in got) == sorted({t or "" for _, t in odd_rows})
    assert {r.uid for r in got} == {"uid"}


def test_a_hot_group_and_an_empty_table(table, no_rows):
    rows = [(i, "same text " * 900) for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(table(rows, 8)).collect()}
    assert all(got[i].keep_id == 299 and got[i].group_size == 300 for i in range(300))
    assert all(got[1000 + i].group_size == 1 for i in range(300))
    assert exact_dedup.exact_groups(no_rows).count() == 0
    assert exact_dedup.drop_copies(no_rows).count() == 0
