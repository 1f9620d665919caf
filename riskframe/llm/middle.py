"""Fill-in-the-middle: a text's middle is moved to its end, in place.

A text is cut after two of its tokens. Sentinels are inserted before its three segments in one byte array, and two
neighbouring segments change places by three reversals (of each segment, then of both together), so no second copy
of the text is built. The same rotation with the parts' lengths exchanged puts them back, and the sentinels are
taken out again. A text that already contains a sentinel is never cut, so the way back is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import fresh, quoted

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many are cut, and of 100 cut ones so many have their suffix first.
RATE = 50
SUFFIX_FIRST = 80
SEED = 42
DRAWS = ("first", "second", "cut", "order")


def token_ends(raw: bytes) -> np.ndarray:
    """Where each token ends: a word with the white space before it, or the white space at the text's end. White
    space is ASCII, so bytes tell the same tokens as code points."""
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | (b - np.uint8(9) < 5)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(b)) if len(b) else ends


def _reverse(view: np.ndarray, a: int, z: int) -> None:
    half = (z - a) // 2
    head = view[a:a + half].copy()
    view[a:a + half] = view[z - half:z][::-1]
    view[z - half:z] = head[::-1]


def rotate(buffer: bytearray, a: int, m: int, z: int) -> None:
    """Exchange ``buffer[a:m]`` and ``buffer[m:z]`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    for x, y in ((a, m), (m, z), (a, z)):
        _reverse(view, x, y)


def moved(raw: bytes, form: str, lo: int, hi: int) -> bytearray:
    """The text with its segments (cut at the byte offsets ``lo`` and ``hi``) marked and in the order of ``form``."""
    out = bytearray(raw)
    out[hi:hi] = SUFFIX
    out[lo:lo] = MIDDLE
    out[:0] = PREFIX
    middle, suffix = lo + len(PREFIX), hi + len(PREFIX) + len(MIDDLE)
    rotate(out, *((middle, suffix, len(out)) if form == PSM else (0, suffix, len(out))))
    return out


def put_back(output: bytes, form: str) -> bytearray:
    """The text that ``moved`` made ``output`` of, found by its sentinels."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    if form == PSM:
        rotate(out, out.index(SUFFIX), out.index(MIDDLE), len(out))
    else:
        rotate(out, 0, out.index(PREFIX), len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at:at + len(mark)]
    return out


def _points(b: np.ndarray) -> int:
    return int(np.count_nonzero(b & 0xC0 != 0x80))


def cut(raw: bytes, first: int, second: int, chosen: bool, suffix_first: bool):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = token_ends(raw)
    n = len(ends)
    if not raw or not chosen or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, raw
    lo, hi = (int(ends[k - 1]) if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    b = np.frombuffer(raw, np.uint8)
    form = SPM if suffix_first else PSM
    return n, form, _points(b[:lo]), _points(b[lo:hi]), bytes(moved(raw, form, lo, hi))


def _transformer(rate: int, suffix_first: int):
    def run(batches):
        for batch in batches:
            draws = [batch.column(x).to_pylist() for x in DRAWS]
            rows = [cut(raw, a, b, c % 100 < rate, o % 100 < suffix_first)
                    for raw, a, b, c, o in zip(batch.column("raw").to_pylist(), *draws)]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts, form and order follow from a sha256 of the seed and the id, so equal ids cut alike, whatever the
    partitions; equal texts with other ids cut elsewhere. A null text counts as the empty one, which stays plain with
    n 0, and a null id as the empty string. White space alone is one token. Repeated rows give a row each, an empty
    table none. Texts of any length are handled whole. Other columns of ``docs`` are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(DRAWS)]
    rows = (docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
            .select("doc_id", "raw", *draws))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(_transformer(rate, suffix_first), f"doc_id {kind}, n long, form string, "
                            "prefix_chars long, middle_chars long, output binary")
            .withColumn("output", F.col("output").cast("string")))


def _restored(form: pa.Array, output: pa.Array) -> pa.Array:
    return pa.array([None if f is None or o is None else bytes(put_back(o, f))
                     for f, o in zip(form.to_pylist(), output.to_pylist())], pa.binary())


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """``outputs`` with the text that each output was made of, in a column ``name`` (with underscores added where the
    table has one of that name). A null form or output gives null."""
    back = F.arrow_udf(_restored, "binary")(F.col(form_col), F.col(output_col).cast("binary")).cast("string")
    return outputs.select(*map(quoted, outputs.columns), back.alias(fresh(outputs, name)))
