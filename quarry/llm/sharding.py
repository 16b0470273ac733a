"""Sharding by fixed virtual slots, with DataFrame operations only.

Every record falls by a hash into one of 4096 slots. The slots' bytes are summed, and a versioned
map says which shard holds each slot. The first version deals the slots, largest first, each to the
shard with the fewest bytes; rebalancing makes a new version that keeps a slot where it is unless
its shard is over its share. The map (at most 4096 rows, whatever the input) is stored as a table.

A record's place in its shard follows from the places of its slot: the rows of a slot are numbered
within the slot, and the running count of the shard's earlier slots is added, so no task sees more
than one slot's rows at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import scratch, table

SLOTS = 4096
#: Bytes that a record has besides its text.
OVERHEAD = 8
#: A shard may pass its even share by this before rebalancing moves a slot away.
TOLERANCE = 0.002


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, virtual_slot of every row.

    A null text has no bytes and the checksum of an empty one. The text takes part in the hash, so
    rows that repeat an id or have none don't share a slot for it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """virtual_slot, rows, bytes: summed before the shuffle, at most one row per slot after it."""
    return rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _dealt(order, loads, shard_of):
    """Fold of ``order`` (sorted structs) into (loads, placed): each slot goes to ``shard_of(loads, slot)``."""
    kind = "array<struct<virtual_slot:int,shard:int>>"
    start = F.struct(loads.alias("loads"), F.array().cast(kind).alias("placed"))

    def step(acc, x):
        to = shard_of(acc["loads"], x)
        put = F.struct(x["virtual_slot"].alias("virtual_slot"), to.cast("int").alias("shard"))
        grown = F.transform(acc["loads"], lambda load, i: F.when(i == to, load + x["bytes"]).otherwise(load))
        return F.struct(grown.alias("loads"), F.concat(acc["placed"], F.array(put)).alias("placed"))

    return F.aggregate(order, start, step)


def _lightest(loads, _):
    return F.array_position(loads, F.array_min(loads)) - 1


def slot_map(sizes: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, shard, version 1: the largest slot first, each to the lightest shard."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "bytes")))  # one entry per slot
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = sizes.agg(_dealt(order, loads, _lightest).alias("m"))
    return placed.select(F.explode("m.placed").alias("p")).select("p.virtual_slot", "p.shard", F.lit(1).alias("version"))


def rebalanced(mapped: DataFrame, sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of a map for new sizes or more shards; as few slots move as the balance needs.

    In every shard, slots stay, largest first, while their sum is within the even share; the others,
    slots without a shard and those of shards that are no more go, largest first, to the lightest.
    """
    version = mapped.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    now = sizes.join(mapped.select("virtual_slot", "shard"), "virtual_slot", "left").withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    share = sizes.agg((F.sum("bytes") / shards * (1 + tolerance)).alias("share"))
    run = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0))
    judged = now.withColumn("run", run).join(F.broadcast(share)).withColumn("stays", F.col("shard").isNotNull() & (F.col("run") <= F.col("share")))
    held = judged.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(held, "shard", "left")
    loads = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("held", F.lit(0)).cast("long").alias("held")))), lambda x: x["held"]).alias("loads"))
    moving = judged.where("not stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "bytes"))).alias("moving"))
    moved = moving.join(F.broadcast(loads)).select(F.explode(_dealt(F.col("moving"), F.col("loads"), _lightest)["placed"]).alias("p")).select("p.virtual_slot", "p.shard")
    return judged.where("stays").select("virtual_slot", "shard").unionByName(moved).join(F.broadcast(version))


def store_map(mapped: DataFrame, path: str) -> DataFrame:
    """Add a version to the stored map and return it as stored."""
    mapped.select("virtual_slot", "shard", "version").write.mode("append").partitionBy("version").parquet(path)
    return latest_map(mapped.sparkSession, path)


def latest_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    wanted = F.lit(version) if version else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == wanted)


def placed(rows: DataFrame, mapped: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with shard and slot (the place within the shard, gapless from 0). The map is at most SLOTS rows."""
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    starts = mapped.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("_n", number).join(F.broadcast(starts), "virtual_slot")
    return out.withColumn("slot", (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_before", "_n")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    rows = slotted(table(spark, sf_dir, "documents"))
    sizes = slot_bytes(rows)
    path = scratch(spark)
    mapped = store_map(slot_map(sizes, 24), path)
    return placed(rows, mapped, sizes).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
