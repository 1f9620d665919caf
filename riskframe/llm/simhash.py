"""SimHash near-duplicates, found with the binary Golay code.

A fingerprint has 64 bits. They are cut into three segments, each padded to the 23 bits of the Golay code. That
code is perfect: every 23-bit word is within 3 bits of one codeword, and a word at distance 3 from it is within
4 bits of five more. So a word has one or six codewords within 4 bits, and if two words differ in at most one bit,
the nearest codeword of either is among those of the other.

Fingerprints at 3 bits or fewer differ in at most one bit in at least two of the three segments (two segments with
two errors each would make four). For each pair of segments a fingerprint is therefore filed once under its nearest
codewords and looked up under each combination of codewords within 4 bits: every link is found. Rows that meet are
verified by their bit distance.

Only distinct fingerprints take part. A key under which many are filed is split into blocks that are compared pair
by pair of blocks, so no task holds an unbounded group, and a block's links leave it as a spanning forest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import numbered, without, written
from riskframe.llm.graph import components, forest

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (23, 12): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BLOCK = 1024


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n:].tolist())
    hashes = np.array([xxh64_intdigest(text[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(x, shingle) for x in batch.column("raw").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(bits.view(np.int64))],
                                             ["uid", "doc_id", "bits"])
    return run


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern, and what to exclusive-or with the nearest codeword's index to get the
    indices of all codewords within 4 bits (0 first; six entries, 0 repeated where there is only one)."""
    rest = np.zeros(23, np.int64)
    for i in range(23):
        word = 1 << i
        for j in range(22, 10, -1):
            if word >> j & 1:
                word ^= GENERATOR << (j - 11)
        rest[i] = word
    code = np.zeros(4096, np.int64)
    for i in range(12):
        code ^= np.where(np.arange(4096) >> i & 1, 1 << (i + 11) | rest[i + 11], 0)
    errors = np.zeros(2048, np.int64)
    near = np.zeros((2048, 6), np.int64)
    sevens = code[np.bitwise_count(code) == 7]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                if (a == b) != (b == c) and a != b:
                    continue
                pattern = 1 << a | 1 << b | 1 << c
                syndrome = int(np.bitwise_xor.reduce(rest[[i for i in range(23) if pattern >> i & 1]]))
                errors[syndrome] = pattern
                if a < b < c:
                    near[syndrome, 1:] = sevens[sevens & pattern == pattern] >> 11
    return errors, near


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for j in range(22, 10, -1):
        out ^= np.where(out >> j & 1, GENERATOR << (j - 11), 0)
    return out


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of 23-bit words, one row of six each, the nearest first, and which of
    them count."""
    errors, near = golay()
    syndrome = _syndromes(words)
    first = (words ^ errors[syndrome]) >> 11
    return first[:, None] ^ near[syndrome], np.c_[np.ones(len(words), bool), near[syndrome, 1:] != 0]


def keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: (place, key, filed): one entry per key, ``filed`` for the nearest codewords."""
    segments = [codewords((bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    place, key, filed = [], [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, use_a), (b, use_b) = segments[i], segments[j]
        both = (use_a[:, :, None] & use_b[:, None, :]).reshape(len(bits), 36)
        pair = ((number << 24) + (a[:, :, None] << 12) + b[:, None, :]).reshape(len(bits), 36)
        row, col = np.nonzero(both)
        place.append(row)
        key.append(pair[row, col])
        filed.append(col == 0)
    return np.concatenate(place), np.concatenate(key), np.concatenate(filed)


def _rows(hot: np.ndarray, blocks: np.ndarray):
    """Fingerprints to (run, filed, bits). A key in ``hot`` is split in ``blocks`` runs: a fingerprint is filed in
    one of them and looked up in all."""
    def run(batches):
        for batch in batches:
            bits = batch.column("bits").to_numpy().view(np.uint64)
            for at in range(0, len(bits), 4096):
                place, key, filed = keys(bits[at:at + 4096])
                value = bits[at:at + 4096][place]
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    n = np.where(hot[i] == key, blocks[i], 1)
                    own = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % n
                    block = _ramp(n)
                    key, filed, own, value = (np.repeat(x, n) for x in (key, filed, own, value))
                    key, filed = key << 32 | block, filed & (own == block)
                else:
                    key = key << 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(filed), pa.array(value.view(np.int64))], ["run", "filed", "bits"])
    return run


def _filed(batches):
    for batch in batches:
        bits = batch.column("bits").to_numpy().view(np.uint64)
        place, key, filed = keys(bits)
        yield pa.RecordBatch.from_arrays([pa.array(key[filed])], ["key"])


def _links(distance: int, pairs: int = 1 << 20):
    """Rows sorted by run, filed ones first, to links. Each row of a run is compared with the filed ones, in steps
    of about ``pairs`` comparisons."""
    def compare(run, filed, bits):
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        size = np.diff(np.r_[starts, len(run)])
        kept = np.repeat(np.add.reduceat(filed.astype(np.int64), starts), size)
        first = np.repeat(starts, size)
        rows = np.flatnonzero((kept > 0) & (np.repeat(size, size) > 1))
        steps = np.flatnonzero(np.diff(np.cumsum(kept[rows]) // pairs)) + 1
        for some in np.split(rows, steps):
            times = kept[some]
            a = np.repeat(bits[some], times)
            b = bits[np.repeat(first[some], times) + _ramp(times)]
            close = (a != b) & (np.bitwise_count(a ^ b) <= distance)
            if close.any():
                x, y = forest(a[close].view(np.int64), b[close].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def link(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "filed", "bits")]
            held = [np.concatenate(x) for x in zip(held, (*got[:2], got[2].view(np.uint64)))]
            other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(other):
                whole = int(other[-1]) + 1
                yield from compare(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if len(held[0]):
            yield from compare(*held)
    return link


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``sizes``, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """One row per input row: uid, doc_id, fingerprint, component_id, kept.

    Fingerprints at ``distance`` (at most 3) or fewer differing bits link, and so do equal ones; component_id is the
    smallest id that links reach, and the first row with that id is kept. Null text counts as empty; all texts
    without a word have fingerprint zero. Null ids rank last. An empty table gives an empty result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the keys find every link up to 3 bits")
    src = numbered(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    rows = written(src.mapInArrow(_fingerprints(shingle), f"uid long, doc_id {kind}, bits long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    distinct = written(rows.groupBy("bits").agg(first), "distinct-fingerprints")
    block = max(BLOCK, 3 * distinct.count() >> 16)  # at most 2^16 keys are then hot
    hot = sorted((r["key"], -(-r["n"] // block)) for r in distinct.select("bits").mapInArrow(_filed, "key long")
                 .groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).collect())
    split = _rows(np.array([k for k, _ in hot], np.int64), np.array([n for _, n in hot], np.int64))
    met = distinct.select("bits").mapInArrow(split, "run long, filed boolean, bits long").repartition("run")
    links = met.sortWithinPartitions("run", F.desc("filed")).mapInArrow(_links(distance), "a long, b long")
    roots = components(links)
    labelled = written(distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", F.coalesce("root", "bits").alias("root"), "first"), "labelled")
    whole = labelled.groupBy("root").agg(F.min("first").alias("first"))
    whole = written(labelled.select("bits", "root").join(whole, "root").select("bits", "first"), "components")
    return rows.join(whole, "bits").select(
        "uid", "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group; all columns stay as they are."""
    return without(docs, near_groups(docs, id_col, text_col, shingle, distance).where("not kept"))
