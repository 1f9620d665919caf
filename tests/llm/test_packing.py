import zlib

import numpy as np
import pytest

from riskframe.llm import packing
from riskframe.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file())


def test_ids_are_the_tokenizers_own(tokenizer):
    import pyarrow as pa
    texts = ["it's I'll a'sB !'s 'tis", "Straße ÄÖÜ ŒUVRE œ", "a\x1cb\x85c\xa0d x́ É", "<|endoftext|> a", "", "  ",
             "１２ ² ½ Ωσς ΑΣ", "İstanbul ıI", "日本語 text 🙂 x_y", " lead trail ", "…“q”—’s 'S", "99.5%!! (a)b"]
    ids, upto = packing.TokenIds(tokenizer_file(), keep=8)(pa.array(texts))
    for t, a, b in zip(texts, upto, upto[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check(rows, got, tokenizer, capacity):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    from collections import Counter
    want = Counter()
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[(d, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(sequences), sum(r.length for r in got)


def test_pieces_and_places(table, odd_rows, tokenizer):
    got = packing.pack(table(odd_rows), tokenizer_file()).collect()
    used, tokens = check(odd_rows, got, tokenizer, 4096)
    assert used <= -(-tokens // 4096) + 1


def test_small_capacity_and_empty_table(table, no_rows, odd_rows, tokenizer):
    rows = odd_rows[4:]
    used, tokens = check(rows, packing.pack(table(rows), tokenizer_file(), capacity=64).collect(), tokenizer, 64)
    assert used <= 1.1 * tokens / 64 + 1
    assert packing.pack(no_rows, tokenizer_file()).count() == 0


def test_knapsack_is_optimal_and_plan_is_tight():
    sizes, prices = np.array([3, 5, 7]), np.array([1.0, 1.8, 2.4])
    best = max(a * 1.0 + b * 1.8 + c * 2.4 for a in range(8) for b in range(5) for c in range(4)
               if 3 * a + 5 * b + 7 * c <= 22)
    chosen = packing.best_configuration(sizes, prices, 22)
    assert abs(prices[chosen].sum() - best) < 1e-12 and sizes[chosen].sum() <= 22
    histogram = {2000: 40, 2096: 40, 1504: 30, 1088: 15, 4096: 5, 10: 7}  # but for 10, whole units of 16
    plan, used = packing.packing_plan(histogram)
    assert used == -(-sum(k * v for k, v in histogram.items()) // 4096)
    hot = {1365: 100_000, 700: 3}
    assert packing.packing_plan(hot)[1] == 33_334
