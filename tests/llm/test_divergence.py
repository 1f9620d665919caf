import random
import re
from collections import Counter

import numpy as np
from conftest import prose

from riskframe.llm import divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = list(zip(w, w[1:], w[2:]))
    count = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def brute_shares(text):
    text = text or ""
    rest, chars = re.sub(r"[\x20\x09-\x0D]", "", text), [len(re.findall(r"[\x20\x09-\x0D]", text))]
    for kind in divergence.CLASSES:
        fewer = re.sub(kind, "", rest)
        chars.append(len(rest) - len(fewer))
        rest = fewer
    chars.append(len(rest))
    w = WORD.findall(text)
    count = Counter(x.lower() for x in w)
    common = [count[x] for x in divergence.WORDS]
    common.append(len(w) - sum(common))
    return (np.array(chars) / max(1, sum(chars)), np.array(common) / max(1, len(w)))


def js(p, q):
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


def corpus(odd_rows):
    rng = random.Random(5)
    rows = list(odd_rows) + [(100 + i, prose(rng, rng.randint(60, 700))) for i in range(40)]
    rows += [(200 + i, "!! ".join(prose(rng, 300).upper().split())) for i in range(5)]
    rows += [(300, "a b c " * 40), (301, "same line here\n" * 30), (302, "a\rb\n\n \nx\n" * 3),
             (303, " | ".join("".join(rng.choices("aeiounrst", k=7)) for _ in range(400)))]
    return rows


def test_counts_and_divergences_match_brute_force(table, odd_rows):
    rows = corpus(odd_rows)
    got = divergence.rules(table(rows)).collect()
    base = {(d, t): brute_base(t) for d, t in rows}
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got) == Counter((d, *base[d, t]) for d, t in rows)
    shares = {(d, t): brute_shares(t) for d, t in rows}
    fine = [shares[d, t] for d, t in rows if not base[d, t][-1]]  # all rows are of one language here
    middles = [np.array([sorted(np.round(s[k][i] * 4096) for s in fine)[(len(fine) - 1) // 2] for i in range(n)])
               for k, n in ((0, len(fine[0][0])), (1, len(fine[0][1])))]
    away = [np.round(sum(js(s[k], m / m.sum()) for k, m in enumerate(middles)) / 2 * 4096) for s in fine]
    near = [s for s, x in zip(fine, away) if x <= sorted(away)[(len(away) - 1) // 2]]
    means = [np.mean([s[k] for s in near], axis=0) for k in (0, 1)]
    want = {d: [js(shares[d, t][k], means[k]) for k in (0, 1)] for d, t in rows if d is not None}
    for r in got:
        if r.doc_id is None:
            continue
        assert np.allclose([r.char_divergence, r.word_divergence], want[r.doc_id], atol=1e-9)


def test_prose_stays_and_noise_goes(table, odd_rows):
    got = {r.doc_id: r for r in divergence.rules(table(corpus(odd_rows))).collect()}
    assert all(got[100 + i].kept for i in range(40) if not got[100 + i].base_failed)
    assert not any(got[200 + i].kept for i in range(5)) and not got[303].kept and not got[300].kept


def test_a_text_in_two_languages_stays(table):
    rng = random.Random(15)

    def german(words):
        common = divergence.COMMON["de"].split()
        return " ".join(rng.choice(common) if rng.random() < 0.45 else "".join(rng.choices(["schen", "ung", "ber", "ge"], k=2))
                        for _ in range(words))
    rows = [(i, prose(rng, 400), "en", "s") for i in range(20)] + [(100 + i, german(400), "de", "s") for i in range(20)]
    rows += [(200, prose(rng, 500) + " " + german(500), "en", "s")]
    got = {r.doc_id: r for r in divergence.rules(table(rows)).collect()}
    assert all(r.kept for r in got.values())
    assert got[200].word_divergence < divergence.WORD_LIMIT + divergence.WORD_NOISE / 1000 ** 0.5


def test_unknown_languages_and_empty_tables(table, no_rows):
    rng = random.Random(6)
    rows = [(i, prose(rng, 100), None if i % 2 else "xx", "s") for i in range(4)]
    got = divergence.rules(table(rows)).collect()
    assert all(r.char_divergence is None and r.kept == (not r.base_failed) for r in got)
    assert divergence.rules(no_rows).count() == 0


def test_texts_of_languages_without_a_reference_are_judged_by_the_base_rules(table):
    import random
    rng = random.Random(6)
    known = [(i, prose(rng, 200)) for i in range(30)]
    made = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(150))
    rows = [(100 + i, made("абвгдежзиклмн"), "ru", "s") for i in range(10)] + [(200 + i, made("aeioucrtnl"), "it", "s") for i in range(10)]
    rows += [(300, "uno due", "it", "s"), (301, "tre " * 80, "it", "s"), (302, rows[0][1], "en", "s")]
    got = {r.doc_id: r.kept for r in divergence.rules(table(known + rows)).collect()}
    assert all(got[d] for d in got if 100 <= d < 300) and not got[300] and not got[301] and not got[302]
