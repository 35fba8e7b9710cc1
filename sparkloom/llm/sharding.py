"""Sharding by fixed virtual slots [native].

A record is hashed into one of ``n_slots`` virtual slots, whose number never changes. Bytes are summed per slot, and a
small table maps slots to shards: built longest-first onto the lightest shard, stored in versions, and *edited* when
shards are added, so that only as many slots move as balance needs. Everything runs as DataFrame functions: the map has
``n_slots`` rows whatever the corpus, so it is the one thing that is gathered and broadcast.

A stored map is a folder with a folder for each version. A version is written once: a second write of it is refused.

Defined cases: a null text has no bytes (size 16) and a CRC of 0; null ids hash like any other value; equal rows share a
slot; a very long text is a record like any other, and its slot is as heavy; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import scratch_path, stage, unsigned_crc32

N_SLOTS = 8192
OVERHEAD = 16


def slot_of(id_col: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The record's virtual slot. Id and text both count, so that a single id with many texts spreads over slots."""
    return F.pmod(F.xxhash64(id_col, text), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: 32 bytes a row stand for the text from here on."""
    text = docs["text"]
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.coalesce(unsigned_crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(docs["doc_id"], text, n_slots).alias("virtual_slot"),
    )


def slot_stats(recs: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows; summed map-side, so a hot slot costs one row a task."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int")


def _assign(slots: Column, loads: Column) -> Column:
    """Folds (bytes, virtual_slot) structs, largest first, each onto the lightest shard. Returns the shard of each."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(state: Column, slot: Column) -> Column:
        at = _lightest(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i + 1 == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["to"], F.array(at - 1)).alias("to"),
        )

    return F.aggregate(slots, start, put, lambda state: state["to"])


def build_map(stats: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """version, virtual_slot, shard, bytes, rows: the first map. At most ``n_slots`` rows are folded in one array."""
    return _fold(stats, F.array_repeat(F.lit(0).cast("long"), n_shards), version)


def _fold(stats: DataFrame, loads: Column, version: int) -> DataFrame:
    largest_first = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows")), asc=False)
    folded = stats.agg(largest_first.alias("slots")).withColumn("to", _assign(F.col("slots"), loads))
    return folded.select(F.explode(F.arrays_zip("slots", "to")).alias("z")).select(
        F.lit(version).alias("version"), F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.to").alias("shard"),
        F.col("z.slots.bytes").alias("bytes"), F.col("z.slots.rows").alias("rows"),
    )


def rebalance(current: DataFrame, n_shards: int, version: int) -> DataFrame:
    """The map of the next version. Slots leave a shard only for what it holds beyond the new mean, smallest slots first.

    Slots that stay keep their shard; those that leave, and those of shards that no longer exist, are folded onto the
    lightest shards. So adding a shard moves about one share of the bytes and nothing between old shards but excess.
    """
    mean = F.sum("bytes").over(W.partitionBy()) / n_shards
    keep_first = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    marked = current.select("virtual_slot", "shard", "bytes", "rows", mean.alias("mean")).withColumn(
        "stays", (F.col("shard") < n_shards) & (F.sum("bytes").over(keep_first) <= F.col("mean"))
    )
    held = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    held_map = held.agg(F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("held"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.coalesce(F.element_at(F.first("held"), s), F.lit(0).cast("long")))
    moving = marked.where(~F.col("stays"))
    largest_first = F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows")), asc=False)
    moved = (
        moving.crossJoin(F.broadcast(held_map)).agg(largest_first.alias("slots"), loads.alias("loads"))
        .withColumn("to", _assign(F.col("slots"), F.coalesce("loads", F.array_repeat(F.lit(0).cast("long"), n_shards))))
        .select(F.explode(F.arrays_zip("slots", "to")).alias("z"))
        .select(F.col("z.slots.virtual_slot").alias("virtual_slot"), F.col("z.to").alias("shard"), F.col("z.slots.bytes").alias("bytes"), F.col("z.slots.rows").alias("rows"))
    )
    return marked.where("stays").select("virtual_slot", "shard", "bytes", "rows").unionByName(moved).select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def save_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Writes the map as ``version`` of the stored one at ``path``, in a folder of its own, and returns what is stored."""
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    every = spark.read.parquet(path)
    version = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("version", "virtual_slot", "shard", "bytes", "rows")


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, map_version and ``position``, a gapless number within the shard.

    The map is stored as version 1 at ``map_path`` and read from there; ``rebalance`` makes later versions of it. Without a
    path it gets a folder of its own in the shared folder.

    The position is the slot's offset in its shard (a prefix sum over the map) plus the row's rank in its slot, so that
    no task ever orders more than one virtual slot.
    """
    recs = stage(records(docs, n_slots), "shard-records")
    slot_map = save_map(build_map(slot_stats(recs), n_shards), map_path or scratch_path(docs.sparkSession, "slot-map"), 1)
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = slot_map.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        recs.withColumn("rank", rank).join(F.broadcast(placed), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("rank") - 1).alias("position"), F.col("version").alias("map_version"))
    )
