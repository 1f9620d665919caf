import hashlib
import random
import re

from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, o = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if o % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows):
    out = middle.restore(middle.transform(docs))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()]
    want = [(d, *expected(d, t), t or "") for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_every_form_against_brute_force(table):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(300)]
    got = check(table(rows), rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_texts_and_sentinels(table, odd_rows, no_rows):
    more = [(100 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "< P >", " \n a", "a \t", "日本 語\x0b🙂", "\x85 \xa0"] * 8)]
    rows = [(d, t) for d, t, *_ in odd_rows] + more
    check(table(rows), rows)
    assert middle.restore(middle.transform(no_rows)).count() == 0


def test_clashing_columns_and_null_outputs(spark):
    odd = spark.createDataFrame([("psm", None, "x"), (None, "a", "y"), ("plain", "<P>", "z")], "form string, output string, restored string")
    got = middle.restore(odd)
    assert got.columns == ["form", "output", "restored", "restored_"]
    assert [r.restored_ for r in got.collect()] == [None, None, "<P>"]


def test_rate_bounds(table):
    rows = [(i, "one two three four") for i in range(50)]
    assert {r.form for r in middle.transform(table(rows), rate=0).collect()} == {"plain"}
    assert {r.form for r in middle.transform(table(rows), rate=100, suffix_first=0).collect()} == {"psm"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.data())
def test_rotation_is_an_exchange_and_its_inverse(raw, data):
    m = data.draw(st.integers(0, len(raw)))
    buffer = bytearray(raw)
    middle.rotate(buffer, 0, m, len(raw))
    assert bytes(buffer) == raw[m:] + raw[:m]
    middle.rotate(buffer, 0, len(raw) - m, len(raw))
    assert bytes(buffer) == raw


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\tñ日", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.booleans())
def test_round_trip(text, a, b, suffix_first):
    n, form, _, _, output = middle.cut(text.encode(), a, b, True, suffix_first)
    assert n == len(TOKEN.findall(text)) and middle.put_back(output, form).decode() == text
