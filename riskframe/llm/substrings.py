"""Removal of repeated 400-byte strings by a suffix array built one bucket at a time with a difference cover.

Only suffixes with at least 400 bytes left count, and only their first 400 bytes ("windows"). The work is dealt in
buckets that hold all equal windows together:

1. The bucket of a window is its anchor, the 128-byte string in it with the smallest hash (the leftmost of equal
   ones). Windows that follow one another mostly share their anchor, so a run of them travels as one row: the
   anchor's hash, fingerprints of the run's first and last window, and its place. Runs with equal fingerprints hold
   equal windows throughout; runs alone under their anchor hold none that repeat.
2. What remains are buckets with different runs. One run of each kind sends its bytes, and each bucket (a large one
   in blocks) is sorted: windows by offset of the anchor and by the fingerprints of their first and last bytes;
   windows that tie there are long ties, and are ordered by ranks.
3. Ranks exist for a difference cover of the block's positions only: residues modulo 32 such that any two positions
   reach cover positions by one common step below 32. The ranks order the 352 bytes at those positions and are
   computed once for a block, by naming 32-byte strings in sorted order and then pairs of names. Two windows compare
   by the ranks at their common step, so a tie costs one comparison however long it is, and memory is a few integers
   for a byte of the block.
4. The covered bytes are merged by document and cut out.

Blocks of one bucket exchange the 128-bit names of their distinct windows, so no bucket must fit one task. The names
are dealt by their bits to as many parts as the bucket has blocks, and travel packed, one row per block and part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import numbered, written

WINDOW = 400
ANCHOR = 128
CHUNK = 1 << 20
BLOCK_RUNS = 4096
BLOCK_BYTES = 2 << 20
PERIOD = 32
HEAD, TAIL = 32, 64
RANKED = 352  # from any step below PERIOD, between HEAD and TAIL nothing is left out and nothing beyond is compared
BASE = 0x9E3779B97F4A7C15
PLACE = pa.struct([("uid", pa.int64()), ("start", pa.int64())])


def _powers(base: int, bits: int = 10) -> list[np.uint64]:
    out = [base]
    for _ in range(bits - 1):
        out.append(out[-1] * out[-1] % (1 << 64))
    return [np.uint64(x) for x in out]


_POWER = _powers(BASE)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _doubled(buf: np.ndarray, upto: int, keep: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Fingerprints of the 2^k bytes from each position, by length, for the lengths in ``keep``."""
    h, n, out = _LETTER[buf], 1, {}
    for k in range(upto.bit_length()):
        if n in keep:
            out[n] = h
        if n == upto or len(h) <= n:
            break
        h = h[:-n] * _POWER[k] + h[n:]
        n *= 2
    return {k: out.get(k, np.zeros(0, np.uint64)) for k in keep}


def _power(n: int) -> np.uint64:
    x = 1
    for k in range(10):
        if n >> k & 1:
            x = x * int(_POWER[k]) % (1 << 64)
    return np.uint64(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _window_names(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Fingerprints of the 400 bytes at the positions, from those of 256, 128 and 16 bytes."""
    return (h[256][at] * _power(128) + h[128][at + 256]) * _power(16) + h[16][at + 384]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[:len(x) - (width - n)], x[width - n:])


def _runs(buf: np.ndarray, lows: np.ndarray, highs: np.ndarray):
    """Runs of windows with one anchor in a buffer of texts from ``lows`` to ``highs``: their first position, number
    of windows, anchor's hash and offset, and the names of their first and last window."""
    windows = np.maximum(highs - lows - WINDOW + 1, 0)
    if not windows.any():
        return None
    h = _doubled(buf, 256, (16, 128, 256))
    mask = np.uint64(CHUNK - 1)
    least = _sliding_least((_mixed(h[128]) & ~mask) | np.arange(len(h[128]), dtype=np.uint64), WINDOW - ANCHOR + 1)
    at = np.repeat(lows, windows) + _ramp(windows)
    anchor = (least[at] & mask).astype(np.int64)
    text = np.repeat(np.arange(len(lows)), windows)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[first, len(at)])
    start = at[first]
    return (text[first], start, n, _mixed(h[128][anchor[first]]), anchor[first] - start, _window_names(h, start),
            _window_names(h, start + n - 1))


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _parts(batches):
    """Texts in buffers of at most ``CHUNK`` bytes; a longer text in parts that overlap by a window less one."""
    held, size = [], 0
    for batch in batches:
        for uid, raw in zip(batch.column("uid").to_pylist(), batch.column("raw").to_pylist()):
            for at in range(0, max(1, len(raw) - WINDOW + 1), CHUNK - WINDOW + 1):
                part = raw[at:at + CHUNK]
                if len(part) < WINDOW:
                    continue
                if size + len(part) > CHUNK:
                    yield held
                    held, size = [], 0
                held.append((uid, at, part))
                size += len(part)
    if held:
        yield held


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _find_runs(batches):
    """Texts to (key, first, last, n, offset, places): one row per distinct run of a buffer."""
    for held in _parts(batches):
        size = np.array([len(p) for _, _, p in held])
        highs = np.cumsum(size)
        found = _runs(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), highs - size, highs)
        if found is None:
            continue
        text, start, n, key, offset, one, two = found
        uid, base = np.array([u for u, _, _ in held]), np.array([b for _, b, _ in held]) - (highs - size)
        order = np.lexsort((n, two, one, key))
        text, start, n, key, offset, one, two = (x[order] for x in (text, start, n, key, offset, one, two))
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                                   | (n[1:] != n[:-1])])
        places = pa.StructArray.from_arrays([pa.array(uid[text]), pa.array(start + base[text])], ["uid", "start"])
        ends = pa.array(np.r_[new, len(n)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [_signed(key[new]), _signed(one[new]), _signed(two[new]), pa.array(n[new]), pa.array(offset[new]),
             pa.ListArray.from_arrays(ends, places)], ["key", "first", "last", "n", "offset", "places"])


def _sort_runs(batches):
    """Runs sorted by key, then by kind of run, to places where all windows repeat (``block`` -1) and to one run of
    each kind in buckets with several kinds (``single``: it has no equal run)."""
    fields = ("key", "first", "last", "n", "offset")
    # the kind of run read last: its fields, a place of it, whether that is still to be told, its number of places
    # and how many kinds came before it in its bucket
    last: tuple | None = None

    def told(rows):
        cols = [np.concatenate([r[i] for r in rows]) for i in range(7)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                          ["uid", "start", "n", "key", "block", "offset", "single"])

    def rep(kind):
        values, uid, start, _, count, before = kind
        return [np.array([x]) for x in (uid, start, values[3], values[0], before // BLOCK_RUNS, values[4], count == 1)]

    for batch in batches:
        if not batch.num_rows:
            continue
        col = {f: batch.column(f).to_numpy() for f in fields}
        places = batch.column("places")
        count = np.diff(places.offsets.to_numpy())
        uid, start = (x.to_numpy() for x in places.flatten().flatten())
        row = np.repeat(np.arange(len(count)), count)
        new_key = np.r_[True, col["key"][1:] != col["key"][:-1]]
        new = new_key | np.r_[True, (col["first"][1:] != col["first"][:-1]) | (col["last"][1:] != col["last"][:-1])
                              | (col["n"][1:] != col["n"][:-1])]
        goes_on = last is not None and all(col[f][0] == v for f, v in zip(fields[:4], last[0]))
        same_key = last is not None and col["key"][0] == last[0][0]
        kind = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        total = np.add.reduceat(count, heads)
        if goes_on:
            total[0] += last[4]
        in_key = np.cumsum(new_key[heads]) - 1
        before = np.arange(len(heads)) - np.flatnonzero(new_key[heads])[in_key]
        before[in_key == 0] += (last[5] + (not goes_on)) if same_key else 0
        kinds = np.bincount(in_key)
        kinds[0] += (last[5] + (not goes_on)) if same_key else 0

        rows = []
        again = total[kind[row]] > 1
        rows.append([uid[again], start[again], col["n"][row[again]], col["key"][row[again]],
                     np.full(int(again.sum()), -1), col["offset"][row[again]], np.zeros(int(again.sum()), bool)])
        if goes_on and last[3]:
            rows.append([np.array([x]) for x in (last[1], last[2], last[0][3], last[0][0], -1, last[0][4], False)])
        if last is not None and not goes_on and (last[5] or same_key):
            rows.append(rep(last))
        closed = np.flatnonzero((kinds[in_key] > 1) & (np.arange(len(heads)) < len(heads) - 1))
        if goes_on and len(heads) > 1 and 0 in closed:
            closed = closed[closed != 0]
            rows.append(rep((last[0], last[1], last[2], False, int(total[0]), last[5])))
        spot = (np.cumsum(count) - count)[heads[closed]]
        rows.append([uid[spot], start[spot], col["n"][heads[closed]], col["key"][heads[closed]],
                     before[closed] // BLOCK_RUNS, col["offset"][heads[closed]], total[closed] == 1])
        yield told(rows)
        if goes_on and len(heads) == 1:
            last = (last[0], last[1], last[2], False, int(total[0]), last[5])
        else:
            i = heads[-1]
            at = int((np.cumsum(count) - count)[i])
            last = (tuple(int(col[f][i]) for f in fields), int(uid[at]), int(start[at]), bool(total[-1] == 1),
                    int(total[-1]), int(before[-1]))
    if last is not None and last[5]:
        yield told([rep(last)])


def difference_cover(period: int = PERIOD) -> np.ndarray:
    """Residues whose differences give every residue: 0, 1, ... up to a root of the period, then multiples of it."""
    root = int(np.ceil(np.sqrt(period)))
    return np.unique(np.r_[np.arange(root), np.arange(root, period, root) + root - 1, period - 1] % period)


def _steps(period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """Which residues are in the cover, and for two residues the least step that takes both into it."""
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    a, b, s = np.ogrid[:period, :period, :period]
    both = cover[(a + s) % period] & cover[(b + s) % period]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return cover, both.argmax(axis=2)


def _named(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, in order."""
    return np.unique(high.astype(np.int64) << 32 | low, return_inverse=True)[1]


def cover_ranks(buf: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """For each cover position the rank of its ``RANKED`` bytes among all of them; -1 elsewhere. The buffer must end
    in ``RANKED`` bytes that no comparison needs."""
    at = np.flatnonzero(cover[np.arange(len(buf) - RANKED) % PERIOD])
    more = np.flatnonzero(cover[np.arange(len(buf) - PERIOD) % PERIOD])  # also those that only end a longer string
    words = [np.zeros(len(more), np.uint64) for _ in range(4)]
    for k in range(PERIOD):
        words[k // 8] = words[k // 8] << np.uint64(8) | buf[more + k]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(more), np.int64)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    name = np.full(len(buf) + RANKED, 0, np.int64)
    name[more[order]] = np.cumsum(new)

    def joined(one: np.ndarray, two: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(name), np.int64)
        inside = more[more + step < len(name)]
        out[inside] = _named(one[inside], two[inside + step])
        return out

    two = joined(name, name, 32)
    four = joined(two, two, 64)
    eight = joined(four, four, 128)
    rank = np.full(len(buf), -1, np.int64)
    rank[at] = _named(_named(eight[at], two[at + 256]), name[at + 320])
    return rank


class Block:
    """Runs of one or several buckets, sorted window by window."""

    cover, step = _steps()

    def __init__(self, runs: list[bytes], bucket: np.ndarray, offset: np.ndarray):
        self.size = np.array([len(r) for r in runs])
        self.low = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(runs) + bytes(RANKED + PERIOD), np.uint8)
        n = self.size - WINDOW + 1
        self.run = np.repeat(np.arange(len(runs)), n)
        self.within = _ramp(n)
        self.at = self.low[self.run] + self.within
        self.h = _doubled(self.buf, 256, (16, 32, 64, 128, 256))
        place = (bucket[self.run].astype(np.uint64) << np.uint64(12)) + (offset[self.run] - self.within).astype(np.uint64)
        self.first_key = _mixed(_mixed(_mixed(place) + self.h[HEAD][self.at]) * np.uint64(3)
                                + self.h[TAIL][self.at + WINDOW - TAIL])

    def equal_groups(self) -> np.ndarray:
        """For each window the number of a group of equal windows of one bucket."""
        order = np.argsort(self.first_key, kind="stable")
        key = self.first_key[order]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        size = np.bincount(group)
        open_ = order[size[group[order]] > 1]  # long ties, group by group
        if not len(open_):
            return group
        rank = cover_ranks(self.buf, self.cover)
        fresh = len(size)
        tie = group[open_]
        while len(open_):
            heads = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
            count = np.diff(np.r_[heads, len(open_)])
            pivot = np.repeat(open_[heads + count // 2], count)
            a, b = self.at[open_], self.at[pivot]
            step = self.step[a % PERIOD, b % PERIOD]
            sign = np.sign(rank[a + step] - rank[b + step])
            order = np.argsort(np.repeat(np.arange(len(heads)), count) * 3 + sign + 1, kind="stable")
            open_, sign, tie = open_[order], sign[order], tie[order]
            part = np.cumsum(np.r_[False, (tie[1:] != tie[:-1]) | (sign[1:] != sign[:-1])])
            group[open_] = fresh + part
            fresh += int(part[-1]) + 1
            size = np.bincount(part)
            left = (sign != 0) & (size[part] > 1)
            open_, tie = open_[left], part[left]
        return group

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of windows, for comparison with other blocks."""
        pos = self.at[at]
        return _window_names(self.h, pos), _mixed(_mixed(self.h[128][pos]) + _mixed(self.h[256][pos + 144]) * np.uint64(5))


def _cut_runs(batches):
    """Texts with their requested runs to the runs' bytes."""
    for batch in batches:
        out = {k: [] for k in ("key", "block", "blocks", "offset", "single", "uid", "start", "run")}
        for uid, raw, wanted in zip(batch.column("uid").to_pylist(), batch.column("raw").to_pylist(),
                                    batch.column("wanted").to_pylist()):
            for w in wanted:
                for k in ("key", "block", "blocks", "offset", "single", "start"):
                    out[k].append(w[k])
                out["uid"].append(uid)
                out["run"].append(raw[w["start"]:w["start"] + w["n"] + WINDOW - 1])
                if len(out["run"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=RUN_SCHEMA)
                    out = {k: [] for k in out}
        if out["run"]:
            yield pa.RecordBatch.from_pydict(out, schema=RUN_SCHEMA)


RUN_SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("blocks", pa.int64()), ("offset", pa.int64()),
                        ("single", pa.bool_()), ("uid", pa.int64()), ("start", pa.int64()), ("run", pa.binary())])
#: Places found to repeat; or a part of a large bucket's window names, which other blocks may hold as well.
FOUND = "uid long, start long, stop long, key long, part long, names binary"
NAMED = np.dtype([("one", np.uint64), ("two", np.uint64), ("uid", np.int64), ("start", np.int64), ("single", np.bool_)])


def _sort_blocks(batches):
    """Runs sorted by (key, block) to the intervals of single runs that repeat, and to the names of the distinct windows
    of buckets with several blocks, packed by parts."""
    def emit(uid, start, stop):
        none = pa.nulls(len(uid), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(start), pa.array(stop), none, none, pa.nulls(len(uid), pa.binary())],
                                          ["uid", "start", "stop", "key", "part", "names"])

    def packed(key, part, names):
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array(names, pa.binary())],
                                          ["uid", "start", "stop", "key", "part", "names"])

    def solve(rows):
        cols = {k: np.concatenate([r[k] for r in rows]) for k in ("key", "block", "blocks", "offset", "single", "uid", "start")}
        runs = [x for r in rows for x in r["run"]]
        fresh = np.r_[True, (cols["key"][1:] != cols["key"][:-1]) | (cols["block"][1:] != cols["block"][:-1])]
        bucket = np.cumsum(fresh) - 1
        block = Block(runs, bucket, cols["offset"])
        group = block.equal_groups()
        again = (np.bincount(group)[group] > 1) & cols["single"][block.run]
        edge = np.diff(np.r_[0, again.astype(np.int8), 0])
        new_run = np.r_[True, block.run[1:] != block.run[:-1]]
        start = again & (new_run | (edge[:-1] == 1))
        stop = again & (np.r_[new_run[1:], True] | (edge[1:] == -1))
        a, b = np.flatnonzero(start), np.flatnonzero(stop)
        run = block.run[a]
        yield emit(cols["uid"][run], cols["start"][run] + block.within[a],
                   cols["start"][run] + block.within[b] + WINDOW)
        many = (cols["blocks"] > 1)[block.run]
        if many.any():
            at = np.flatnonzero(many)
            at = at[np.unique(group[at], return_index=True)[1]]
            run = block.run[at]
            names = np.empty(len(at), NAMED)
            names["one"], names["two"] = block.names(at)
            names["uid"], names["start"] = cols["uid"][run], cols["start"][run] + block.within[at]
            names["single"] = (np.bincount(group)[group[at]] == 1) & cols["single"][run]
            part = (_mixed(names["two"]) % cols["blocks"][run].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, cols["key"][run]))
            key, part, names = cols["key"][run][order], part[order], names[order]
            heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            for i in range(0, len(heads), 64):
                some = heads[i:i + 64]
                ends = np.r_[heads, len(names)][i + 1:i + 1 + len(some)]
                yield packed(key[some], part[some], [names[x:z].tobytes() for x, z in zip(some, ends)])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        got = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "block", "blocks", "offset", "single", "uid", "start")}
        got["run"] = batch.column("run").to_pylist()
        fresh = np.flatnonzero(np.r_[True, (got["key"][1:] != got["key"][:-1]) | (got["block"][1:] != got["block"][:-1])])
        for a, b in zip(fresh, np.r_[fresh[1:], batch.num_rows]):
            part = {k: v[a:b] for k, v in got.items()}
            joins = held and held[-1]["key"][-1] == part["key"][0] and held[-1]["block"][-1] == part["block"][0]
            if held and size > BLOCK_BYTES and not joins:
                yield from solve(held)
                held, size = [], 0
            held.append(part)
            size += sum(map(len, part["run"]))
    if held:
        yield from solve(held)


def _shared_names(table: pa.Table) -> pa.Table:
    """One part of a bucket's names, from all its blocks, to the intervals of windows that several blocks hold and that
    are not known to repeat within their own."""
    names = np.concatenate([np.frombuffer(x, NAMED) for x in table.column("names").to_pylist()])
    names = names[np.lexsort((names["two"], names["one"]))]
    same = (names["one"][1:] == names["one"][:-1]) & (names["two"][1:] == names["two"][:-1])
    names = names[(np.r_[False, same] | np.r_[same, False]) & names["single"]]
    names = names[np.lexsort((names["start"], names["uid"]))]
    apart = (names["uid"][1:] != names["uid"][:-1]) | (names["start"][1:] > names["start"][:-1] + WINDOW)
    first, last = np.flatnonzero(np.r_[len(names) > 0, apart]), np.flatnonzero(np.r_[apart, len(names) > 0])
    return pa.table({"uid": names["uid"][first], "start": names["start"][first], "stop": names["start"][last] + WINDOW})


def repeated(docs: DataFrame) -> DataFrame:
    """(uid, raw) to (uid, start, stop): byte intervals that repeated windows cover, as they were found."""
    runs = docs.mapInArrow(_find_runs, "key long, first long, last long, n long, offset long, "
                                       "places array<struct<uid:long,start:long>>")
    kinds = written(runs.repartition("key").sortWithinPartitions("key", "first", "last", "n").mapInArrow(
        _sort_runs, "uid long, start long, n long, key long, block long, offset long, single boolean"), "runs")
    whole = kinds.where("block < 0").select("uid", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("stop"))
    large = kinds.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    told = kinds.where("block >= 0").join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    wanted = told.groupBy("uid").agg(
        F.collect_list(F.struct("start", "n", "key", "block", "blocks", "offset", "single")).alias("wanted"))
    cut = docs.join(wanted, "uid").select("uid", "raw", "wanted").mapInArrow(
        _cut_runs, "key long, block long, blocks long, offset long, single boolean, uid long, start long, run binary")
    found = written(cut.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_sort_blocks, FOUND),
                    "repeats")
    across = found.where("names is not null").groupBy("key", "part").applyInArrow(
        _shared_names, "uid long, start long, stop long")
    return whole.unionAll(found.where("names is null").select("uid", "start", "stop")).unionAll(across)


def _cut_out(batches):
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
            merged = []
            for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = hashlib.sha256(), 0
            for a, b in merged:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    A byte goes if a 400-byte string that covers it also starts anywhere else in the input, be it in the same text;
    matches never cross texts. Null text counts as empty; texts under 400 bytes stay whole. Repeated rows repeat each
    other. An empty table gives an empty result.
    """
    src = numbered(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    spans = repeated(src.select("uid", "raw")).groupBy("uid").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    return src.join(spans, "uid", "left").select("doc_id", "raw", "spans").mapInArrow(
        _cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
