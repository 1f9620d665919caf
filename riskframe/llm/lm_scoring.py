"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words and one end per text. The training texts' exact token counts are a distributed table. The end and
every token counted at least ``LEAST`` times, up to ``VOCABULARY`` of the most frequent, are the neural vocabulary, each
with a context and a target vector of its own; all others share one further class, within which a token has its
smoothed share of the counts, so the model gives every text a proper probability.

The output is factored. The ``HEAD`` most frequent tokens, groups of the further ones and the class of the others are
the outputs of one softmax, a group's tokens those of a second one within the group. Groups are runs of tokens in the
order of their counts, ``RUN`` times the root of their rank in size, so frequent tokens stand in small groups and a
token costs some hundred products. A vocabulary up to ``HEAD`` is one flat softmax.

The model predicts a token's vector as the sum of its two predecessors' vectors, each scaled by a weight per
dimension; a token's score is the product of the predicted and its own vector plus a bias. Input splits are joined
to about ``COPY_TOKENS`` tokens, and each trains a copy on all its training tokens, with noise drawn from the counts
instead of a sum over the outputs, and from a token's group instead of a sum over the group. The copies are averaged
by their tokens. Scoring multiplies the predictions of all distinct contexts of a batch with all output vectors, and
those of a group's tokens with the group's vectors, a group once for a context, which gives the exact normalisers, and
sums the normalised log-probabilities by text.

Counts beyond a bounded number of frequent tokens stay distributed: what a text has of rarer tokens is joined with
the count table. Texts are coded once, after the counts; training and scoring read the codes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import fold, with_uid, written

HELD_OUT = 1
VOCABULARY = 1 << 17
LEAST = 3
HEAD = 64
RUN = 3
FREQUENT = 200_000
DIMENSIONS = 24
NOISE = 64
GROUP_NOISE = 2
BATCH = 4096
CELLS = 1 << 16
RATE = 0.1
SEED = 5
SLICE_BYTES = 4 << 20
SLICE_TOKENS = 1 << 19
FAN_IN = 32
COPY_TOKENS = 8_000_000
PIECE = 1 << 16
NAMES = ("context", "target", "bias", "scale", "tail", "tail_bias")


def _slices(batch: pa.RecordBatch):
    """(first row, words in lower case as lists, their end) in parts of about ``SLICE_BYTES``."""
    texts = batch.column("text")
    part = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))


def _coded(words: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, every token's place among them with the end (the empty token) after each text, and where
    each text begins (one more entry than texts)."""
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code, upto = coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
    if "" in distinct:  # white space at a text's ends leaves empty words there
        real = code != distinct.index("")
        upto = np.r_[0, np.cumsum(real)][upto]
        code = code[real]
    return [*distinct, ""], np.insert(code, upto[1:], len(distinct)), upto + np.arange(len(upto))


def _counted(batches):
    for batch in batches:
        for _, words in _slices(batch):
            distinct, code, _ = _coded(words)
            n = np.bincount(code, minlength=len(distinct))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.string()).take(pa.array(seen)), pa.array(n[seen])],
                                             ["token", "n"])


class Outputs:
    """Which output and, beyond the head, which group's run of tail places each class has; ``classes`` counts the
    last, all tokens outside the vocabulary."""

    def __init__(self, classes: int):
        self.head = classes - 1 if classes - 1 <= HEAD else HEAD
        edges = [self.head]
        while edges[-1] < classes - 1:
            edges.append(min(classes - 1, edges[-1] + math.ceil(RUN * math.sqrt(edges[-1]))))
        self.edges = np.array(edges) - self.head
        self.width = np.diff(self.edges)
        self.group = np.repeat(np.arange(len(self.width)), self.width)
        self.of = np.r_[np.arange(self.head), self.head + self.group, self.head + len(self.width)]

    def counts(self, counts: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, counts)


@dataclass
class Model:
    """``context`` has a row per class (the last is all tokens outside the vocabulary), ``target`` and ``bias`` one per
    output, ``scale`` one per context place, nearest first, ``tail`` and ``tail_bias`` one per token beyond the head."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    tail: np.ndarray
    tail_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        """Before training: the unigram model of the classes' counts."""
        rng = np.random.default_rng(SEED)
        out = Outputs(len(counts))
        n = out.counts(counts + 0.5)
        vectors = lambda rows: rng.normal(0, 0.1, (rows, dimensions)).astype(np.float32)
        inside = (counts + 0.5)[out.head:-1]
        return cls(vectors(len(counts)), vectors(len(n)), np.log(n / n.sum()).astype(np.float32),
                   np.ones((2, dimensions), np.float32), vectors(len(inside)),
                   np.log(inside / n[out.head + out.group]).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, x) for x in NAMES]

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def unpacked(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([x.size for x in self.arrays()])[:-1]
        return Model(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cuts), self.arrays())))

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.scale[0] + self.context[two] * self.scale[1]

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials over all outputs, for each context."""
        return _log_totals(self.predicted(one, two), self.target, self.bias)

    def within(self, q: np.ndarray, place: np.ndarray, out: Outputs, row: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities within their groups of the tail places ``place`` after the predictions ``q``, of which each
        place has its own, or the one numbered in ``row``. A group is summed once for a prediction."""
        row = np.arange(len(q)) if row is None else row
        found = np.empty(len(place), np.float32)
        for i in range(0, len(place), CELLS):
            s = slice(i, i + CELLS)
            found[s] = np.einsum("ij,ij->i", q.take(row[s], axis=0), self.tail.take(place[s], axis=0))
        found += self.tail_bias.take(place)
        key = out.group[place] * len(q) + row
        order = np.argsort(key)
        new = np.r_[np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0]
        group, row = np.divmod(key[order[new]], max(1, len(q)))
        total, cuts = np.empty(len(group), np.float32), np.searchsorted(group, np.arange(len(out.width) + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            s, (a, b) = slice(cuts[g], cuts[g + 1]), out.edges[g:g + 2]
            total[s] = _log_totals(q.take(row[s], axis=0), self.tail[a:b], self.tail_bias[a:b])
        found[order] -= total[np.cumsum(new) - 1]
        return found


def _log_totals(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of the products of each row of ``q`` with all vectors plus their biases."""
    out = np.empty(len(q), np.float32)
    if not len(q):
        return out
    # no product is beyond that of the greatest lengths
    most = math.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", vectors, vectors).max()) + np.abs(bias).max()
    rows = max(16, CELLS // len(bias))
    aside, held = np.concatenate([vectors.T, bias[None]]), np.ones((rows, q.shape[1] + 1), np.float32)
    for i in range(0, len(q), rows):
        n = min(rows, len(q) - i)
        held[:n, :-1] = q[i:i + n]
        out[i:i + n] = _log_sums(held[:n] @ aside, most)
    return out


def _log_sums(s: np.ndarray, most: float = math.inf) -> np.ndarray:
    """Log of the summed exponentials of each row, which it overwrites; where any is beyond the range of exponentials,
    all are taken from their row's top. None is beyond ``most``."""
    top = np.float32(0)
    if not most < 70 and max(s.max(), -s.min()) > 70:
        top = s.max(axis=1)
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], s.dtype)) + top


def contexts(classes: np.ndarray, upto: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; before a text stands the end."""
    one, two = np.r_[end, classes[:-1]], np.r_[end, end, classes[:-2]][:len(classes)]
    first = upto[:-1]
    one[first] = end
    two[first] = end
    second = first + 1
    two[second[second < upto[1:]]] = end
    return one, two


class Trainer:
    """Noise-contrastive steps with AdaGrad on a copy of a model. The rows of its tables are read and written once a
    step, so each holds all a step needs: a vector, for outputs and the tail its bias (predictions have a one in that
    place), and then the sums of their squared gradients. The model's arrays are views of the tables."""

    def __init__(self, model: Model, counts: np.ndarray, seed: int):
        self.model = m = model.unpacked(model.packed())
        self.rng = np.random.default_rng((SEED, seed))
        self.out = Outputs(len(counts))
        n = self.out.counts(counts + 0.5)
        self.share = n / n.sum()
        self.upto = np.cumsum(self.share)
        self.log_noise = np.log(NOISE * self.share).astype(np.float32)
        self.log_group = np.log(GROUP_NOISE / self.out.width).astype(np.float32)
        self.size = size = m.context.shape[1]
        self.contexts = np.concatenate([m.context, np.ones_like(m.context)], axis=1)
        self.outputs, self.tails = self.table(m.target, m.bias), self.table(m.tail, m.tail_bias)
        m.context = self.contexts[:, :size]
        m.target, m.bias = self.outputs[:, :size], self.outputs[:, size]
        m.tail, m.tail_bias = self.tails[:, :size], self.tails[:, size]
        self.scale_sums = np.ones_like(m.scale)

    def table(self, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Vectors with their biases, in an even number of columns, and as many for the sums."""
        held = np.concatenate([vectors, bias[:, None], np.zeros((len(bias), (self.size + 1) % 2), np.float32)], axis=1)
        return np.concatenate([held, np.ones_like(held)], axis=1)

    def step(self, before: np.ndarray, aim: np.ndarray, first: np.ndarray, second: np.ndarray, end: int) -> None:
        """A step over the tokens ``aim``; ``before`` begins two places earlier, and at the places ``first`` and
        ``second`` stand the first and second tokens of texts."""
        m, size, wide = self.model, self.size, self.outputs.shape[1] // 2
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.share) - 1)
        contexts = Rows(self.contexts, np.r_[before, end])
        around = contexts.values()
        far = around[:-2].copy()
        around[first + 1] = far[first] = far[second] = around[-1]
        near = around[1:-1]
        q = np.zeros((len(aim), wide), np.float32)
        np.add(near * m.scale[0], far * m.scale[1], out=q[:, :size])
        q[:, size] = 1
        to = self.out.of[aim]
        vectors = np.ascontiguousarray(self.outputs[:, :wide])
        own, other = vectors.take(to, axis=0), vectors.take(noise, axis=0)
        wrong = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - self.log_noise[to]))
        # for each drawn output -1 / (1 + exp(x)) is half of tanh(x / 2) - 1, x being the log odds against it
        odds = -other
        odds[:, size] += self.log_noise[noise]
        taken = q @ (odds / 2).T
        np.tanh(taken, out=taken)
        taken -= 1
        dq = taken @ (other / 2)
        own *= wrong[:, None]
        dq += own
        self.inner(q, aim, dq)
        outputs = Rows(self.outputs, to)
        g = (noise == np.arange(len(vectors))[:, None]).astype(np.float32) @ (q.T @ taken).T / 2
        g[outputs.row] += outputs.summed(q.take(outputs.order, axis=0) * wrong[outputs.order, None])
        _moved(self.outputs, g)
        dq = np.ascontiguousarray(dq[:, :size])
        at_one, at_two = dq * m.scale[0], dq * m.scale[1]
        ends = at_one[first].sum(0) + at_two[first].sum(0) + at_two[second].sum(0)
        at_one[first] = at_two[first] = at_two[second] = 0
        g = np.concatenate([at_two, np.zeros_like(at_two[:1]), ends[None]])
        g[1:-1] += at_one
        contexts.move(g.take(contexts.order, axis=0))
        g = np.stack([(dq * near).sum(0), (dq * far).sum(0)])
        self.scale_sums += g * g
        m.scale += RATE * g / np.sqrt(self.scale_sums)

    def inner(self, q: np.ndarray, aim: np.ndarray, dq: np.ndarray) -> None:
        """The step within the groups, with noise evenly from each token's group; adds to ``dq``."""
        at = np.flatnonzero((aim >= self.out.head) & (aim < len(self.contexts) - 1))
        if not len(at):
            return
        q, place = q.take(at, axis=0), aim[at] - self.out.head
        group = self.out.group[place]
        width = self.out.width[group][:, None]
        noise = self.out.edges[group][:, None] + (self.rng.random((len(at), GROUP_NOISE)) * width).astype(np.int64)
        rows = Rows(self.tails, np.concatenate([place[:, None], noise], axis=1).ravel())
        vectors = rows.values().reshape(len(at), 1 + GROUP_NOISE, -1)
        s = np.einsum("ijk,ik->ij", vectors, q) - self.log_group[group][:, None]
        g = -1 / (1 + np.exp(-s))
        g[:, 0] += 1
        moved = dq.take(at, axis=0)
        moved += np.einsum("ij,ijk->ik", g, vectors)
        dq[at] = moved
        of_rows = q.take(rows.order // (1 + GROUP_NOISE), axis=0)
        of_rows *= g.ravel()[rows.order, None]
        rows.move(of_rows)

    def learn(self, classes: np.ndarray, upto: np.ndarray, end: int) -> None:
        before, first = np.r_[end, end, classes], upto[:-1]
        second = (first + 1)[first + 1 < upto[1:]]
        for i in range(0, len(classes), BATCH):
            here = [x[slice(*np.searchsorted(x, (i, i + BATCH)))] - i for x in (first, second)]
            aim = classes[i:i + BATCH]
            self.step(before[i:i + len(aim) + 1], aim, *here, end)


class Rows:
    """Rows of a table, some of them more than once: ``row`` are the distinct ones and ``order`` sorts all by row."""

    def __init__(self, table: np.ndarray, rows: np.ndarray):
        self.table = table
        few = len(table) < 1 << 15
        self.order = np.argsort(rows.astype(np.int16 if few else np.int32), kind="stable" if few else None)
        ordered = rows[self.order]
        self.new = np.r_[True, ordered[1:] != ordered[:-1]]
        self.first = np.flatnonzero(self.new)
        self.row = ordered[self.first]

    def values(self) -> np.ndarray:
        """The vectors of all rows, as they were asked for."""
        self.held = self.table.take(self.row, axis=0)
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.cumsum(self.new) - 1
        return np.ascontiguousarray(self.held[:, :self.table.shape[1] // 2]).take(place, axis=0)

    def summed(self, g: np.ndarray) -> np.ndarray:
        """The sums of sorted rows' gradients by row, two columns at once as a complex number."""
        count = np.diff(np.r_[self.first, len(g)])
        sums, many = g.take(self.first, axis=0), count > 1
        if many.any():
            again = g.take(np.flatnonzero(np.repeat(many, count)), axis=0)
            pairs = again.view(np.complex64) if g.shape[1] % 2 == 0 else again
            sums[many] = np.add.reduceat(pairs, np.cumsum(count[many]) - count[many], axis=0).view(np.float32)
        return sums

    def move(self, g: np.ndarray) -> None:
        """An AdaGrad step by the sorted rows' gradients."""
        _moved(self.held, self.summed(g))
        self.table[self.row] = self.held


def _moved(held: np.ndarray, g: np.ndarray) -> None:
    """An AdaGrad step of rows with their sums, by their gradients, which it overwrites."""
    size = g.shape[1]
    held[:, size:] += g * g
    g *= np.float32(RATE)
    g /= np.sqrt(held[:, size:])
    held[:, :size] += g


CODED = "uid long, doc_id {kind}, train boolean, spots binary, rest array<struct<token string, n long>>"


def _encoded(frequent: list[str]):
    """Texts to their tokens' places in ``frequent`` (32-bit, its length for a rarer token), the end after each text;
    the rarer tokens are listed with their number."""
    place = {w: i for i, w in enumerate(frequent)}

    def run(batches):
        for batch in batches:
            for at, words in _slices(batch):
                distinct, code, upto = _coded(words)
                spot = np.fromiter((place.get(w, len(frequent)) for w in distinct), np.int32, len(distinct))[code]
                rare = spot == len(frequent)
                row = np.repeat(np.arange(len(words)), np.diff(upto))
                pair, n = np.unique(row[rare] * len(distinct) + code[rare], return_counts=True)
                tokens = pa.array(distinct, pa.string()).take(pa.array(pair % len(distinct)))
                ends = np.searchsorted(pair // len(distinct), np.arange(len(words) + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [tokens, pa.array(n.astype(np.int64))], ["token", "n"]))
                spots = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((4 * upto).astype(np.int32)),
                                                                        pa.py_buffer(spot)])
                kept = [c for c in ("uid", "doc_id", "train") if c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(words)) for c in kept), spots, rest],
                                                 [*kept, "spots", "rest"])
    return run


def _decoded(batch: pa.RecordBatch):
    """(first row, rows, places of all their tokens, where each text begins) in parts of about ``SLICE_TOKENS``."""
    size = pc.binary_length(batch.column("spots")).to_numpy() // 4
    part = np.cumsum(size) // SLICE_TOKENS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            raw = b"".join(batch.column("spots").slice(a, b - a).to_pylist())
            yield a, b - a, np.frombuffer(raw, np.int32), np.r_[0, np.cumsum(size[a:b])]


def _trained(model: Model, counts: np.ndarray, vocabulary: dict[str, int]):
    """A split's coded training texts to its trained copy and how many tokens it saw."""
    def run(batches):
        trainer, seen = Trainer(model, counts, TaskContext.get().partitionId()), 0
        other = len(vocabulary)
        for batch in batches:
            for _, _, spot, upto in _decoded(batch):
                trainer.learn(np.minimum(spot, other), upto, vocabulary[""])
                seen += len(spot)
        if seen:
            flat = trainer.model.packed()
            for piece, i in enumerate(range(0, len(flat), PIECE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()]), pa.array([piece]), pa.array([seen]),
                     pa.array([flat[i:i + PIECE].tobytes()], pa.binary())], ["copy", "piece", "n", "mean"])
    return run


def _averaged(batches):
    """Copies of pieces to the mean of each piece by the copies' tokens."""
    sums = {}
    for batch in batches:
        for copy, piece, k, raw in zip(*(batch.column(c).to_pylist() for c in ("copy", "piece", "n", "mean"))):
            n, x = sums.get((copy, piece), (0, 0.0))
            sums[copy, piece] = n + k, x + k * np.frombuffer(raw, np.float32).astype(np.float64)
    for (copy, piece), (n, x) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([copy]), pa.array([piece]), pa.array([n]), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())],
            ["copy", "piece", "n", "mean"])


def train(coded: DataFrame, vocabulary: dict[str, int], counts: np.ndarray) -> Model:
    """One pass of every copy over its coded texts, averaged in steps of ``FAN_IN`` copies."""
    model, schema = Model.start(counts), "copy long, piece long, n long, mean binary"
    rows = max(1, -(-int(counts.sum()) // COPY_TOKENS))
    copies = written(coded.coalesce(rows).mapInArrow(_trained(model, counts, vocabulary), schema), "model-copies")
    pieces = -(-len(model.packed()) // PIECE)
    while rows > 1:
        rows = -(-rows // FAN_IN)
        joined = copies.withColumn("copy", (F.col("copy") % rows)).repartition(rows * pieces, "copy", "piece")
        copies = written(joined.mapInArrow(_averaged, schema), "model-means")
    parts = sorted((r["piece"], r["mean"]) for r in copies.select("piece", "mean").collect())
    if not parts:
        return model
    return model.unpacked(np.concatenate([np.frombuffer(x, np.float32) for _, x in parts]))


def _scored(model: Model, frequent: list[str], counts: np.ndarray, other: int):
    """Texts to sums over their tokens, in one go."""
    encode, add = _encoded(frequent), _summed(model, counts, other)
    return lambda batches: add(encode(batches))


def _summed(model: Model, counts: np.ndarray, other: int):
    """Coded texts to sums over their tokens. The end comes first in the codes, the neural vocabulary is their first
    ``other`` tokens."""
    log_count, seen = np.r_[np.log10(counts + 0.5), 0.0], np.r_[counts > 0, False]
    end, out = 0, Outputs(other + 1)

    def run(batches):
        near, far = model.context * model.scale[0], model.context * model.scale[1]
        for batch in batches:
            for at, rows, spot, upto in _decoded(batch):
                classes = np.minimum(spot, other)
                one, two = contexts(classes, upto, end)
                pairs, pair = np.unique(one.astype(np.int64) * (other + 1) + two, return_inverse=True)
                to, neural = out.of[classes], np.empty(len(spot), np.float32)
                told = near.take(pairs // (other + 1), axis=0)
                told += far.take(pairs % (other + 1), axis=0)
                known = _log_totals(told, model.target, model.bias)
                for i in range(0, len(spot), CELLS):
                    s = slice(i, i + CELLS)
                    neural[s] = np.einsum("ij,ij->i", told.take(pair[s], axis=0), model.target.take(to[s], axis=0))
                neural += model.bias[to] - known[pair]
                tail = np.flatnonzero((classes >= out.head) & (classes < other))
                neural[tail] += model.within(told, classes[tail] - out.head, out, pair[tail])
                outside = classes == other
                total = lambda x: np.add.reduceat(x.astype(np.float64), upto[:-1])
                whole = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), upto[:-1]))
                logs = log_count[spot]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(at, rows), batch.column("doc_id").slice(at, rows),
                     pa.array(np.diff(upto)), whole(seen[spot]), whole(outside), pa.array(total(logs)),
                     pa.array(total(logs * outside)), pa.array(total(neural) / math.log(10)),
                     batch.column("rest").slice(at, rows)],
                    ["uid", "doc_id", "n_tokens", "n_frequent", "n_outside", "logs", "logs_outside", "neural", "rest"])
    return run


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows (token, n), the largest counts, chosen by a threshold rather than a sort: counts fall in
    classes of a sixteenth of a power of two, whole classes are taken from the top, and of the class that no longer
    fits the tokens whose hash is below its share."""
    rank = F.floor(16 * F.log2("n")).cast("long")
    sizes = sorted(counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("tokens")).collect(), reverse=True)
    taken, least, cut, share = 0, None, -1, 0.0
    for r in sizes:
        if taken + r["tokens"] > most:
            cut, share = r["rank"], 0.99 * (most - taken) / r["tokens"]
            break
        taken, least = taken + r["tokens"], r["rank"]
    unit = F.xxhash64("token") / F.lit(2.0 ** 64) + 0.5
    whole = F.lit(False) if least is None else rank >= least
    return counts.where(whole | ((rank == cut) & (unit < share))).limit(most)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT,
           vocabulary: int = VOCABULARY, frequent: int = FREQUENT, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the smoothed unigram log10 probability of the text, ``score`` the model's. Null text counts as
    empty: its one token is the end. Repeated rows count and are scored each. An empty table gives an empty result;
    if no row is for training, all counts are zero and the model is uniform over its one class.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = texts.where(fold("doc_id") != held_out).select("text")
    counts = written(training.mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")),
                     "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    ends = counts.where("token = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    top = sorted(((r["n"], r["token"]) for r in most_frequent(counts.where("token <> ''"), frequent).collect()),
                 key=lambda x: (-x[0], x[1]))
    words, n = ["", *(w for _, w in top)], np.array([ends, *(c for c, _ in top)], np.int64)
    size = min(vocabulary, 1 + int((n[1:] >= least).sum()))
    outside = total - int(n[:size].sum())
    classes = np.r_[n[:size], outside]
    kind = texts.schema["doc_id"].dataType.simpleString()
    coded = written(with_uid(texts).withColumn("train", fold("doc_id") != held_out)
                    .mapInArrow(_encoded(words), CODED.format(kind=kind)), "coded-texts")
    model = train(coded.where("train").select("spots"), {w: i for i, w in enumerate(words[:size])}, classes)
    found = written(coded.mapInArrow(
        _summed(model, n, size),
        f"uid long, doc_id {kind}, n_tokens long, n_frequent long, n_outside long, logs double, logs_outside double, "
        "neural double, rest array<struct<token string, n long>>"), "text-sums")
    rest = found.select("uid", F.explode("rest").alias("r")).select("uid", "r.token", F.col("r.n").alias("times"))
    rest = rest.join(counts, "token", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    rare = F.coalesce("rare_logs", F.lit(0.0))
    all_tokens = math.log10(total + 0.5 * (distinct + 1))
    all_outside = math.log10(outside + 0.5 * (max(0, distinct - size) + 1))
    return found.drop("rest").join(rest, "uid", "left").select(
        "doc_id", (fold("doc_id") == held_out).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + rare - F.col("n_tokens") * all_tokens).alias("base_score"),
        (F.col("neural") + F.col("logs_outside") + rare - F.col("n_outside") * all_outside).alias("score"))
