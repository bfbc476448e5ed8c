"""Sharding by vector bin packing: bytes, tokens and rows of every shard nearly equal, equal texts kept together.

A group (all documents of one text) is an item with three sizes. The item goes to the shard where
the dot product of its sizes with the residual capacities, all as shares of a shard, is highest;
large items first.

* A group larger than ``WHOLE`` of a shard in any size is dealt by doc_id into chunks that are items
  of their own (at most 3 * shards / WHOLE such groups exist); all other groups stay whole.
* Items of at least ``LARGE`` of a shard are placed first, in one task: at most 3 * shards / LARGE.
* All others are placed per partition of their digests. A partition fills its share of the capacity
  that the large items left, so the partitions' results add up to equal shards.

Slots number a shard's rows without gaps, from counts per partition and their running totals.

Nulls: a null text is the empty text; a null id is kept. Repeated rows are rows of their own in
one group. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import on_arrow, partitions_for, require, written

SIZES = ("bytes", "tokens", "rows")
WHOLE, LARGE, ITEMS = 1 / 4, 1 / 400, 500_000


def place(sizes: np.ndarray, room: np.ndarray, first: int = 0) -> np.ndarray:
    """Bin of each item, items in their order. sizes: (items, 3); room: (bins, 3), reduced in place. Ties go round from ``first``."""
    turn = np.roll(np.arange(len(room)), -first)
    left, out = room[turn], np.empty(len(sizes), np.int32)
    for i, item in enumerate(sizes):
        k = int((left @ item).argmax())
        left[k] -= item
        out[i] = turn[k]
    room[turn] = left
    return out


def _placed(items: DataFrame, room: np.ndarray, unit: np.ndarray, share_of: np.ndarray | None, shards: int) -> DataFrame:
    """digest, chunk, shard. share_of: sizes of all items, of which a partition fills its share of the room; None: one partition."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        import pyarrow as pa

        table = pa.Table.from_batches(got)
        sizes = np.stack([table.column(c).to_numpy() for c in SIZES], axis=1) / unit
        order = np.lexsort((table.column("chunk").to_numpy(), np.array(table.column("digest").to_pylist()), -sizes.max(axis=1)))
        own = room.copy()
        if share_of is not None:
            own *= sizes.sum(axis=0) / np.maximum(share_of / unit, 1e-300)
        out = np.empty(len(sizes), np.int32)
        out[order] = place(sizes[order], own, TaskContext.get().partitionId() % shards)
        yield (table.column("digest").combine_chunks(), table.column("chunk").combine_chunks(), out)

    return on_arrow(items.select("digest", "chunk", *SIZES), run, "digest string, chunk int, shard int")


def shard(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = require(documents, "doc_id", "text").select(
        "doc_id", F.md5(text).alias("digest"), (F.octet_length(text) + 8).cast("long").alias("bytes"), F.size(F.split(text, " ")).cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = written(base, "sizes")
    groups = written(base.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in SIZES], F.count("*")).first()
    unit = np.maximum(np.array(total[:3]) / shards, 1e-300)
    share = F.greatest(*[F.col(c) / float(u) for c, u in zip(SIZES, unit, strict=True)])
    over = groups.where(share > WHOLE).select("digest", F.ceil(share * 2 / WHOLE).cast("int").alias("deals"))  # 3 * shards / WHOLE rows at most
    over = F.broadcast(written(over, "dealt-groups"))
    rows = base.join(over, "digest", "left").withColumn("chunk", F.when(F.col("deals").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("deals"))).otherwise(0).cast("int")).drop("deals")
    chunks = rows.join(over, "digest", "left_semi").groupBy("digest", "chunk").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    items = written(groups.join(over, "digest", "left_anti").select("digest", F.lit(0).alias("chunk"), *SIZES).unionByName(chunks), "items")
    room = np.ones((shards, 3))
    large, small = items.where(share >= LARGE), items.where(share < LARGE)
    first = written(_placed(large.coalesce(1), room, unit, None, shards), "large-items")  # 3 * shards / LARGE rows at most
    for r in large.join(F.broadcast(first), ["digest", "chunk"]).groupBy("shard").agg(*[F.sum(c).alias(c) for c in SIZES]).collect():
        room[r["shard"]] -= np.array([float(r[c]) for c in SIZES]) / unit
    left = small.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double") for c in SIZES]).first()
    parts = partitions_for(total[3], ITEMS, 1)
    rest = _placed(small.repartition(parts, "digest"), room, unit, np.array(left[:]), shards).drop("chunk")
    done = rows.join(F.broadcast(first), ["digest", "chunk"], "left")
    done = done.where("shard IS NOT NULL").unionByName(done.where("shard IS NULL").drop("shard").join(rest, "digest"), allowMissingColumns=False)
    return _slots(done.select("doc_id", F.col("bytes").alias("size"), "text_crc32", "shard"), shards)


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Slots from places within (partition, shard) and the running counts over partitions."""

    def run(batches):
        count, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(3).to_numpy()
            order = np.argsort(own, kind="stable")
            n = np.bincount(own, minlength=shards)
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(count, n)
            count += n
            yield (*batch.columns, [part] * len(own), place)

    local = written(on_arrow(rows, run, "doc_id bigint, size bigint, text_crc32 bigint, shard int, part int, place bigint"), "slots")
    n = local.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = n.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    return local.join(base, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"))
