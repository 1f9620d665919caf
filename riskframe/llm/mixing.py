"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes a weight in proportion to p^a. The exponent a in [0, 1] is bisected to the
smallest (the flattest mix) at which the weights' entropy does not exceed a target and no source is repeated more
often than a limit. A budget of tokens times a weight is a source's due: some whole passes over its documents and a
part of one more. The passes are block permutations: documents are dealt into blocks by a hash, blocks are ordered
by a hash of the pass, and the partial pass takes blocks in that order, then documents of the last block, as long
as they fit.

Only built-in functions run. Per-source figures stay in a table, and the bisection asks one aggregate of it for
several exponents at a time. Running sums go over chunks of blocks, then the blocks of a chunk, then the documents
of one block, so a source with a third of all rows is never one group in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import fresh, quoted, with_uid, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
BLOCK_TOKENS = 1 << 20
CHUNK_BLOCKS = 1024
SECTIONS = 8
ROUNDS = 10


@dataclass(frozen=True)
class Temperature:
    exponent: float
    entropy: float
    most_repeats: float


def _curve(sources: DataFrame, total: float, budget: float, exponents: list[float]) -> list[Temperature]:
    """Entropy of the weights and the largest number of passes, for each exponent, in one aggregate."""
    p = F.col("tokens") / F.lit(total)
    cols = []
    for i, a in enumerate(exponents):
        power = F.pow(p, F.lit(a))
        cols += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"e{i}"),
                 F.max(power / F.col("tokens")).alias(f"r{i}")]
    row = sources.agg(F.count("*").alias("n"), *cols).head()
    out = []
    for i, a in enumerate(exponents):
        z = row[f"z{i}"]
        out.append(Temperature(a, math.log(z) - a * row[f"e{i}"] / z, budget * row[f"r{i}"] / z))
    return out


def temperature(sources: DataFrame, total: float, budget: float, flatter: float, repeats: float) -> Temperature:
    """The smallest exponent whose entropy is at most ``flatter`` of the way from the shares' own to the greatest
    possible, and which repeats no source more than ``repeats`` times. If even the shares themselves exceed the
    limit (a budget above ``repeats`` passes), the exponent is 1."""
    flat, own = _curve(sources, total, budget, [0.0, 1.0])
    target = own.entropy + flatter * (flat.entropy - own.entropy)

    def meets(x: Temperature) -> bool:
        return x.entropy <= target + 1e-12 and x.most_repeats <= repeats + 1e-9

    if meets(flat):
        return flat
    low, best = 0.0, own
    for _ in range(ROUNDS):
        step = (best.exponent - low) / SECTIONS
        for x in _curve(sources, total, budget, [low + step * k for k in range(1, SECTIONS)]):
            if meets(x):
                best = x
                break
            low = x.exponent
    return best


def _unit(*cols):
    """A hash of the columns as a number from 0 to 1."""
    return F.xxhash64(F.lit(SEED), *cols) / F.lit(2.0 ** 64) + 0.5


def copies(docs: DataFrame, budget: float | None = None, flatter: float = 0.5, repeats: float = 4.0,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row that is used: uid, doc_id, source, n_tokens, passes (times it is used, at least 1),
    block, weight (its source's), due (its source's passes, with a fraction).

    Tokens are words; the budget is all tokens of the input if none is given, and what is used never exceeds it.
    Null text counts as empty, a null source as the source ''. Sources without tokens have no share and are left
    out, so an input without words gives an empty result, as does an empty table. Repeated rows are rows of their
    own. Rows of equal hash keep the order of the input. Of the block that a source's last pass no longer has room
    for, rows are used in the order of the hash while they fit, and then the shortest of the rest that still fit, so a
    long document never costs others their place.
    """
    rows = written(with_uid(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))), "tokens")
    sources = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).head()[0]
    if not total:
        return rows.select("uid", "doc_id", "source", "n_tokens", F.lit(1).cast("long").alias("passes"),
                           F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("weight"),
                           F.lit(0.0).alias("due")).where("false")
    budget = float(total if budget is None else budget)
    mix = temperature(sources, float(total), budget, flatter, repeats)
    power = F.pow(F.col("tokens") / float(total), F.lit(mix.exponent))
    z = sources.agg(F.sum(power)).head()[0]
    shares = written(sources.select(
        "source", (power / z).alias("weight"), (power / z * budget / F.col("tokens")).alias("due"),
        F.ceil(F.col("tokens") / block_tokens).alias("blocks"), "tokens"), "shares")
    dealt = written(rows.join(shares.select("source", "weight", "due", "blocks"), "source").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "uid"), F.col("blocks"))), "dealt")

    # the partial pass: tokens before each block, by chunks of blocks in the pass's order; where only whole passes
    # are due there is none, not even for rows without tokens
    blocks = dealt.groupBy("source", "block", "blocks", "due").agg(F.sum("n_tokens").alias("held"))
    blocks = written(blocks.withColumn("place", _unit(F.floor("due"), "source", "block")).withColumn(
        "chunk", F.floor(F.col("place") * F.ceil(F.col("blocks") / CHUNK_BLOCKS))), "blocks")
    chunks = blocks.groupBy("source", "chunk").agg(F.sum("held").alias("held")).select(
        "source", "chunk", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("chunk")
                                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("earlier"))
    within = Window.partitionBy("source", "chunk").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.col("due") - F.floor("due")) * F.col("tokens")
    placed = written(
        blocks.join(chunks, ["source", "chunk"]).join(shares.select("source", "tokens"), "source")
        .withColumn("before", F.col("earlier") + F.coalesce(F.sum("held").over(within), F.lit(0)))
        .select("source", "block", F.when(rest > 1e-6, rest + 1e-6 - F.col("before")).otherwise(-1.0).alias("room"), "held"),
        "placed")
    at = dealt.join(placed, ["source", "block"])
    whole = at.where("room >= held or room < 0").select(
        "uid", "doc_id", "source", "n_tokens", (F.floor("due") + (F.col("room") >= F.col("held")).cast("long"))
        .alias("passes"), "block", "weight", "due")
    # the cut block: rows that fit the room, in hash order while their sum does; then, of the rest, the shortest that
    # fit what is left, so that no row that still fits is left out for one that does not
    part = Window.partitionBy("source", "block")
    turn = F.xxhash64(F.lit(SEED), F.floor("due"), "doc_id", "uid")
    until = (Window.unboundedPreceding, 0)
    counted = F.when(F.col("n_tokens") <= F.col("room"), F.col("n_tokens")).otherwise(0)
    cut = at.where("room < held and room >= 0").withColumn("turn", turn)
    cut = cut.withColumn("upto", F.sum(counted).over(part.orderBy("turn", "uid").rowsBetween(*until)))
    cut = cut.withColumn("first", (F.col("n_tokens") <= F.col("room")) & (F.col("upto") <= F.col("room")))
    later = F.when(F.col("first"), 0).otherwise(F.col("n_tokens"))
    cut = cut.withColumns({
        "left": F.col("room") - F.sum(F.when(F.col("first"), F.col("n_tokens")).otherwise(0)).over(part),
        "upto": F.sum(later).over(part.orderBy("n_tokens", "turn", "uid").rowsBetween(*until))})
    used = F.col("first") | (F.col("upto") <= F.col("left"))
    cut = cut.select("uid", "doc_id", "source", "n_tokens", (F.floor("due") + used.cast("long")).alias("passes"), "block", "weight", "due")
    return whole.unionAll(cut).where("passes > 0")


def permuted(used: DataFrame) -> DataFrame:
    """Rows of ``copies`` to one row per use: pass (from 0) and turn, the point of its source's due, from 0 to 1, at
    which the pass's block permutation comes to it. Ordered by turn, every stretch has about the target weights."""
    each = used.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    block = _unit("pass", "source", "block")
    return each.select("uid", "doc_id", "source", "n_tokens", "pass", "block", "weight",
                       ((F.col("pass") + block) / F.ceil("due")).alias("turn"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as ``copies`` uses it; all columns stay as they are."""
    uid, passes, each = (fresh(docs, x) for x in ("uid", "passes", "pass"))
    used = copies(docs, **options).select(F.col("uid").alias(uid), F.col("passes").alias(passes))
    rows = docs.withColumn(uid, F.monotonically_increasing_id()).join(used, uid)
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(passes)))).select(
        *map(quoted, docs.columns))
