"""Exact de-duplication by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of fixed size. Equal blocks are brought together, sorted, and each
distinct block gets an integer name. Then neighbouring names of a document are paired, the pairs are sorted and
named in turn, and so on until each document has one name. No hash decides anything: two documents end with the
same (level, name) exactly if their bytes are equal, because every name stands for one distinct content.

Cost: the text is shuffled once, in blocks; every later level moves three integers per block and halves the rows.
Equal blocks of one Arrow batch are sent once with the list of their places, so a group of copies that holds a
third of all rows arrives as one row per batch, and never as its members' texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import numbered, without, written

BLOCK_BYTES = 4096


def _blocks(block_bytes: int):
    """Documents to (block, places): one row per distinct block of the batch."""
    def cut(batches):
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            uid, doc, pos, total, sha = [], [], [], [], []
            for u, d, raw in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "raw"))):
                n = max(1, -(-len(raw) // block_bytes))
                for i in range(n):
                    groups.setdefault(raw[i * block_bytes:(i + 1) * block_bytes], []).append(len(uid))
                    uid.append(u)
                    doc.append(d)
                    pos.append(i)
                    total.append(n)
                    sha.append(None if i else hashlib.sha256(raw).hexdigest())
            order = pa.array([i for g in groups.values() for i in g], pa.int64())
            places = pa.StructArray.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(doc, batch.schema.field("doc_id").type),
                 pa.array(pos, pa.int64()), pa.array(total, pa.int64()), pa.array(sha, pa.string())],
                ["uid", "doc_id", "pos", "n", "text_sha256"]).take(order)
            ends = np.cumsum([0, *(len(g) for g in groups.values())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(groups), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), places)],
                ["block", "places"])
    return cut


def _pairs(batches):
    """(uid, pos, n, first, second) to (first, second, places): one row per distinct pair of the batch."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("first", "second"))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][:len(a)])
        places = pa.StructArray.from_arrays(
            [batch.column(c).take(pa.array(order)) for c in ("uid", "pos", "n")], ["uid", "pos", "n"])
        ends = pa.array(np.r_[new, len(a)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[new]), pa.array(b[new]), pa.ListArray.from_arrays(ends, places)],
            ["first", "second", "places"])


def _names(keys: list[str]):
    """Sorted (keys, places) to one row per place with the name of its key: the key's rank in this partition, with
    the partition's number above it. Equal keys are in one partition, so a name stands for one key only."""
    def name(batches):
        rank, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            head = [c[0].as_py() for c in columns]
            new = np.zeros(batch.num_rows, bool)
            new[0] = head != last
            for c in columns:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), [c[-1].as_py() for c in columns]
            places = batch.column("places")
            rows = places.flatten()
            names = pa.array(ranks).take(pc.list_parent_indices(places))
            yield pa.RecordBatch.from_arrays([*rows.flatten(), names], [*(f.name for f in rows.type), "name"])
    return name


def _named(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_names(keys), schema)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, text_sha256, level, name): (level, name) is equal exactly for rows with equal text."""
    src = numbered(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    fields = {"uid": "long", "doc_id": kind, "pos": "long", "n": "long", "text_sha256": "string"}
    place = ", ".join(f"{k} {v}" for k, v in fields.items())
    cut = src.mapInArrow(_blocks(block_bytes), f"block binary, places array<struct<{place}>>")
    blocks = written(_named(cut, ["block"], f"{place}, name long"), "block-names")
    first = blocks.where("pos = 0").select("uid", "doc_id", "text_sha256")
    done = [blocks.where("n = 1").select("uid", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")]
    most = blocks.agg(F.max("n")).head()[0] or 1
    rows, later, level = blocks.where("n > 1").select("uid", "pos", "n", "name"), [], 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        pairs = rows.groupBy("uid", F.floor(F.col("pos") / 2).alias("pos"), F.ceil(F.col("n") / 2).alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"))
        pairs = pairs.mapInArrow(
            _pairs, "first long, second long, places array<struct<uid:long,pos:long,n:long>>")
        table = written(_named(pairs, ["first", "second"], "uid long, pos long, n long, name long"), "pair-names")
        later.append(table.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        rows = table.where("n > 1")
    if later:
        whole = later[0]
        for x in later[1:]:
            whole = whole.unionAll(x)
        done.append(first.join(whole, "uid").select("uid", "doc_id", "text_sha256", "level", "name"))
        return done[0].unionAll(done[1])
    return done[0]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the largest id stays (null ids rank lowest); of repeated rows with that
    id the last in the input. Null text counts as empty, so null and empty texts form one group. An empty table
    gives an empty result.
    """
    rows = written(identities(docs, id_col, text_col, block_bytes), "identities")
    # written first: then both sides of the join are plain shuffles, and adaptive execution splits a hot group's part
    groups = written(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("keep"),
                                                       F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "uid", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay as they are."""
    return without(docs, exact_groups(docs, id_col, text_col).where("not kept"))
