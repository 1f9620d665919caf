import collections
import random
import re
import zlib

import pytest
from conftest import SF

from riskframe.llm import compression_lang as cl
from riskframe.llm.common import documents

SYLLABLES = {"en": ["the", "an", "ing", "er", "ow"], "xx": ["zu", "ka", "ré", "mo", "ñi"], "ру": ["ка", "го", "ст", "ем", "ня"]}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, text_of(rng, lang, rng.randint(3, 200)), lang, "s") for i in range(240) for lang in [list(SYLLABLES)[i % 3]]]
    return out + [(900, text_of(rng, "en", 30_000), "en", "s"), (901, text_of(rng, "xx", 100), None, "s")]


def dictionaries(rows):
    words, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for d, text, lang, _ in rows:
        if lang is not None and text and zlib.crc32(("" if d is None else str(d)).encode()) % 3 != 1 and re.search(r"[^\W\d_]", text):
            texts[lang] += 1
            words[lang].update(set(re.findall(r"[^\W\d_]+", text.lower())))
    out = {}
    for lang in sorted(texts, key=lambda x: (-texts[x], x)):
        best, used = [], 0
        for w in sorted(words[lang], key=lambda w: (-words[lang][w], w.encode())):
            used += len(w.encode()) + 1
            if used > cl.DICTIONARY:
                break
            best.append(w)
        out[lang] = " ".join([*best[::-1], ""]).encode()
    return out


def brute(text, held):
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    plain = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    sizes = {}
    for lang, content in held.items():
        e, total = cl.compressor(content), 0
        for i in range(0, len(plain), cl.CHUNK):
            part = plain[i:i + cl.CHUNK]
            while len(part) < cl.LEAST:
                part = part + b" " + plain[i:i + cl.CHUNK]
            total += len(e.compress(part))
        sizes[lang] = total
    first, second = sorted(sizes.values())[:2]
    return min(sizes, key=sizes.get), 1 - first / second


def test_dictionaries_and_choice_match_brute_force(table, rows):
    docs = table(rows)
    held = cl.learn(docs)
    assert held == dictionaries(rows) and list(held) == list(dictionaries(rows))
    got = {r.doc_id: r for r in cl.identify(docs, held).collect()}
    for d, text, lang, _ in rows:
        want, score = brute(text, held)
        assert (got[d].lang_pred, got[d].held_out) == (want, zlib.crc32(str(d).encode()) % 3 == 1)
        assert abs(got[d].score - score) < 1e-12 and got[d].rejected == (score < cl.MARGIN)
    right = [got[d].lang_pred == lang for d, _, lang, _ in rows if lang and got[d].held_out]
    assert len(right) > 50 and sum(right) >= 0.99 * len(right)


def test_odd_rows(table, rows, odd_rows, no_rows):
    got = cl.predicted(table(rows + odd_rows)).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    held = cl.learn(table(rows))
    und = cl.identify(table([(1, None), (2, ""), (3, " \t"), (4, "12 !? 34"), (5, "ка"), (6, "日本")]), held).collect()
    assert [r.lang_pred == "und" for r in sorted(und, key=lambda r: r.doc_id)] == [True] * 4 + [False] * 2
    assert cl.predicted(no_rows).count() == 0
    assert {(r.lang_pred, r.score, r.rejected) for r in cl.predicted(table([(1, "a b", None, "s")])).collect()} == {("und", 0.0, True)}


def test_ties_go_to_the_commoner_language_and_are_rejected():
    assert cl.choose([5, 5, 7]) == (0, 0.0, True)
    assert cl.choose([9]) == (0, 1.0, False)


def test_sample_bound_and_copies_of_one_text(table, rows):
    many = rows + [(7, rows[6][1], "en", "s")] * 400
    held = cl.learn(table(many), sample=50)
    assert set(held) == set(SYLLABLES) and all(held.values())


def test_only_wanted_languages_stay(table, rows):
    docs = table(rows)
    kept = cl.keep_language(docs, cl.learn(docs), ["xx"])
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect()}
    assert got >= {d for d, t, lang, _ in rows if lang == "xx" and len(t) > 200} and not got & {d for d, _, lang, _ in rows if lang == "en"}


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = documents(spark, SF)
    got = cl.predicted(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
