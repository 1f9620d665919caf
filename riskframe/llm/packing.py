"""Best-fit packing of tokenised documents into sequences, by a configuration linear program.

1. Each task tokenises its documents, cuts those over the capacity into pieces and numbers the pieces of equal
   length. The pieces (ids' checksums, not ids) are written once.
2. The histogram of piece lengths, at most ``capacity`` rows, goes to the driver. There a configuration (which
   lengths share a sequence) is a column of a covering program: minimise the sequences so that the configurations
   hold every piece. Multiplicative weights solve it: each round a knapsack over the current prices, by dynamic
   programming, gives the best configuration; its lengths then get cheaper the more of them are covered. Lengths
   count in units of ``UNIT`` tokens here, rounded up, so the program has the same size for any corpus.
3. The fractional solution is rounded: configurations are realised with exact lengths in order of their share, the
   last place of each by best fit, as often as pieces remain; what is left over is packed by best fit alone. A plan
   entry says which ranks of a length go to which sequences, so the plan is bounded by the lengths, not the pieces.
4. Pieces get their rank within their length from per-task counts and look up their place in the plan.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import written

CAPACITY = 4096
UNIT = 16
ROUNDS = 2000
STEP = 0.1
END_ID = 1
KEPT_GROUPS = 300_000
SLICE_BYTES = 8 << 20


_ABC = "a-z\u00df-\u00f6\u00f8-\u00ff\u0153"
_MARK = "!-/:-@\\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026"
#: Characters of which the tokenizer's groups are known, and those groups (in lower case).
_OTHER = re.compile(f"[^0-9{_ABC}{_MARK}]|<\\|")
_GROUP = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_ABC}]+|[0-9]|[{_MARK}]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the tokenizer's vocabulary: itself where it prints, else the next
    one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class TokenIds:
    """Texts to their ids as the tokenizer gives them, for the distinct words of a batch at a time.

    The tokenizer never joins what ASCII white space parts. It lower-cases a word, cuts it into groups (letters, a
    digit, marks) and encodes each group alone, so ids are kept by group. After ``keep`` groups the newer half of
    the store goes (frequent groups come early), which bounds it. Words with characters beyond Latin letters and
    common marks go through the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str, keep: int = KEPT_GROUPS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.keep = Tokenizer.from_file(tokenizer_file), keep
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def learn(self, group: str) -> bytes:
        if len(self.known) >= self.keep:
            self.known = dict(islice(self.known.items(), self.keep // 2))
        spelled = group if group.isascii() else "".join([self.letters[b] for b in group.encode()])
        ids = self.known[group] = np.array([t.id for t in self.tok.model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def word(self, word: str) -> bytes:
        lower = word.lower()
        if _OTHER.search(lower):
            return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        return b"".join([known[g] if g in known else self.learn(g) for g in _GROUP.findall(lower)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry than texts)."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        each = [self.word(w) for w in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in each], np.int64) // 4
        code = coded.indices.to_numpy()
        long = size[code]
        upto = np.r_[0, np.cumsum(long)]
        from_ = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(from_[code] - upto[:-1], long) + np.arange(upto[-1])]
        return ids, upto[words.offsets.to_numpy() - words.offsets[0].as_py()]


#: By tokenizer file: a Python worker keeps its store for the tasks to come.
_IDS: dict[str, TokenIds] = {}


def token_ids(tokenizer_file: str) -> TokenIds:
    if tokenizer_file not in _IDS:
        _IDS[tokenizer_file] = TokenIds(tokenizer_file)
    return _IDS[tokenizer_file]


def _slices(texts: pa.Array, most: int):
    """(first row, texts) in parts of about ``most`` bytes, a row at least."""
    part = np.cumsum(pc.binary_length(texts).to_numpy()) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [(a, texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]


def _pieces(tokenizer_file: str, capacity: int, end_id: int):
    """Documents to pieces; ``nth`` counts the task's pieces of one length."""
    def cut(batches):
        tokens, task = token_ids(tokenizer_file), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, texts in _slices(batch.column("text"), SLICE_BYTES):
                ids, upto = tokens(texts)
                ids = np.insert(ids, upto[1:], end_id)
                upto = upto + np.arange(len(upto))
                whole = np.diff(upto)
                pieces = -(-whole // capacity)
                row = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(whole[row] - start, capacity)
                first = upto[row] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
                order = np.argsort(length, kind="stable")
                run = length[order]
                new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                counts = np.diff(np.r_[new, len(run)])
                nth = np.empty(len(run), np.int64)
                nth[order] = np.arange(len(run)) - np.repeat(new, counts) + seen[run]
                seen[run[new]] += counts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at + row)), pa.array(piece, pa.int32()), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
    return cut


def best_configuration(sizes: np.ndarray, prices: np.ndarray, room: int) -> list[int]:
    """Unbounded knapsack: indices (with repeats) into ascending ``sizes`` of the dearest set that fits ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if upto[c]:
            worth = best[c - sizes[:upto[c]]] + prices[:upto[c]]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], pick[c] = worth[j], j
    out, c = [], room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(pick[c]))
            c -= int(sizes[pick[c]])
    return out


def configuration_program(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = ROUNDS,
                          step: float = STEP) -> dict[tuple[int, ...], float]:
    """Fractional covering of ``counts`` pieces of ``sizes`` by configurations: {sorted sizes: sequences}."""
    weight, covered = np.ones(len(sizes)), np.zeros(len(sizes))
    found: dict[tuple[int, ...], float] = {}
    for _ in range(rounds if len(sizes) else 0):
        chosen = best_configuration(sizes, weight / counts, room)
        per = np.bincount(chosen, minlength=len(sizes))
        used = per > 0
        times = float((counts[used] / per[used]).min())
        gain = np.where(used, per * times / counts, 0.0)
        covered += gain
        weight *= np.exp(-step * gain)
        weight /= weight.max()
        key = tuple(sorted((int(sizes[i]) for i in chosen), reverse=True))
        found[key] = found.get(key, 0.0) + times
    share = float((covered * sizes * counts).sum() / (sizes * counts).sum()) if len(sizes) else 1.0
    return {k: v / share for k, v in found.items()}


class _Stock:
    """Pieces still to be packed, by exact length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def fit(self, room: int, taken: dict[int, int], least: int = 1) -> int:
        """The longest length up to ``room`` (from ``least``) of which a piece is free beside ``taken``, or 0."""
        there = self.left[least:room + 1] > 0
        if taken:
            for length, n in taken.items():
                if least <= length <= room and self.left[length] <= n:
                    there[length - least] = False
        i = int(there[::-1].argmax()) if len(there) else 0
        return room - i if len(there) and there[len(there) - 1 - i] else 0

    def put(self, taken: dict[int, int], most: int) -> int:
        times = int(min(most, *(self.left[n] // k for n, k in taken.items())))
        at = 0
        for length in sorted(taken, reverse=True):
            k = taken[length]
            self.entries.append((length, int(self.used[length]), k, self.sequences, at))
            at += length * k
            self.used[length] += k * times
            self.left[length] -= k * times
        self.sequences += times
        return times

    def filled(self, taken: dict[int, int], room: int) -> dict[int, int]:
        while room and (n := self.fit(room, taken)):
            taken[n] = taken.get(n, 0) + 1
            room -= n
        return taken


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT,
                 rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Plan entries (length, first rank, pieces per sequence, first sequence, offset) and the number of sequences."""
    stock = _Stock(histogram, capacity)
    room = capacity // unit
    by_size: dict[int, int] = {}
    for length, n in histogram.items():
        s = min(room, -(-length // unit))
        by_size[s] = by_size.get(s, 0) + n
    sizes = np.array(sorted(by_size), np.int64)
    counts = np.array([by_size[s] for s in sizes], float)
    solution = configuration_program(sizes, counts, room, rounds)
    for config, share in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
        wanted = int(share)
        while wanted > 0:
            taken: dict[int, int] = {}
            space = capacity
            for size in config[:-1]:
                n = stock.fit(min(size * unit, space), taken, (size - 1) * unit + 1)
                if not n:
                    break
                taken[n] = taken.get(n, 0) + 1
                space -= n
            else:
                last = stock.fit(space, taken)
                if last:
                    taken[last] = taken.get(last, 0) + 1
                    wanted -= stock.put(stock.filled(taken, space - last), wanted)
                    continue
            break
    while stock.left.any():
        stock.put(stock.filled({}, capacity), 1 << 62)
    return np.array(sorted(stock.entries), np.int64).reshape(-1, 5), stock.sequences


def _places(plan: np.ndarray):
    """Look up each piece's (length, rank) in the plan."""
    keys = (plan[:, 0] << 48) + plan[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            entry = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            after = rank - entry[:, 1]
            cols = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols["sequence_id"] = pa.array(entry[:, 3] + after // entry[:, 2])
            cols["offset"] = pa.array(entry[:, 4] + after % entry[:, 2] * length)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return place


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of the input is a document of its own, also where ids or texts repeat; null and empty texts are the
    end id alone; an empty table packs into nothing. ``capacity`` must be a multiple of ``UNIT``. The tokenizer
    file must be at the same path on every executor.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = written(src.mapInArrow(_pieces(tokenizer_file, capacity, end_id), f"{out}, task long, nth long"), "pieces")
    per_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = packing_plan(histogram, capacity, rounds=rounds)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.mapInArrow(_places(plan), f"{out}, sequence_id long, offset long")
