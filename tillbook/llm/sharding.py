"""Sharding by fixed virtual slots.

Rows are hashed into ``virtual`` slots that never change. The bytes of each slot are summed, slots are
put into shards largest first (each into the shard with the fewest bytes so far), and the slot-to-shard
map is a stored table with a version. Rebalancing edits that map: only the slots that must move change
their shard, and rows follow their slot without being hashed anew.

All steps are DataFrame operations. The map has ``virtual`` rows whatever the input, so it may be
gathered in one row and broadcast.

Defined cases: a null text has no bytes and CRC 0; a null id is hashed like any other value; repeated
rows are placed one by one (equal rows share a virtual slot, at consecutive places); an empty table
gives no rows. Only the id and text columns are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import scratch_path
from .common import let

VIRTUAL_SLOTS = 4096
#: Each virtual slot is numbered in so many lanes, so that numbering uses VIRTUAL_SLOTS * LANES tasks at most.
LANES = 16


def with_slot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL_SLOTS,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, lane, *keep) of each row; size is the UTF-8 bytes of the text plus 8."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(c) for c in keep])
    key = F.xxhash64("doc_id", "text_crc32", "size")
    return rows.select("*", F.pmod(key, F.lit(virtual)).cast("int").alias("vslot"),
                       F.pmod(F.shiftrightunsigned(key, 40), F.lit(LANES)).cast("int").alias("lane"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, lane, n, bytes): partial sums in each task, then at most virtual * LANES rows."""
    return rows.groupBy("vslot", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _largest_first(items: Column, loads: Column) -> Column:
    """Place items (struct of bytes, vslot; largest first) one after another into the least loaded shard."""
    def place(state: Column, item: Column) -> Column:
        return let(F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1, lambda to: F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == to, load + item["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["placed"], F.array(F.struct(item["vslot"].alias("vslot"), to.alias("shard")))).alias("placed")))
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"))
    return F.aggregate(items, start, place)["placed"]


def _placed(sizes: DataFrame, loads: Column, version: Column) -> DataFrame:
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("vslot")))),
                        lambda x: F.struct((-x["less"]).alias("bytes"), x["vslot"].alias("vslot")))
    return (sizes.agg(order.alias("items"), F.first(loads).alias("loads"), F.first(version).alias("version"))
            .select("version", F.explode(_largest_first(F.col("items"), F.col("loads"))).alias("p"))
            .select("version", "p.vslot", "p.shard"))


def build_slot_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, shard) for slots that hold rows, with shard sizes as equal as largest-first makes them."""
    per_slot = sizes.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    return _placed(per_slot, F.array_repeat(F.lit(0).cast("long"), shards), F.lit(version))


def edit_slot_map(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new sizes or another number of shards.

    Each shard keeps its slots, smallest first, up to the mean size; slots beyond that, slots of shards
    that are gone, and new slots are placed largest first. All other slots stay where they are.
    """
    per_slot = sizes.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    now = per_slot.join(slot_map.select("version", "vslot", "shard"), "vslot", "left")
    everything = Window.partitionBy()
    mean = F.sum("bytes").over(everything) / F.lit(shards)
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot"))
    now = now.select("vslot", "bytes", "shard", (F.max("version").over(everything) + 1).alias("version"),
                     (F.col("shard").isNotNull() & (F.col("shard") < shards) & (so_far <= mean)).alias("stays"))
    loads = now.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = (now.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))),
                              lambda x: x["load"].cast("long")).alias("loads")))
    moving = now.where(~F.col("stays")).join(F.broadcast(loads))  # one row of `shards` numbers
    return now.where("stays").select("version", "vslot", "shard").unionByName(
        _placed(moving, F.col("loads"), F.col("version")))


def save_slot_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored map; a repeated save of the same version replaces it."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version of the map, the latest by default."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version)).select("version", "vslot", "shard")


def shard_rows(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its shard and its place in it, numbered 0, 1, ... without gaps.

    A place is the rows of the shard's earlier (slot, lane) pairs plus the number inside the pair, so no
    task ever numbers a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("vslot", "lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.join(F.broadcast(slot_map), "vslot")
              .select("vslot", "lane", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("vslot", "lane").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("inside", F.row_number().over(inside))
            .join(F.broadcast(starts), ["vslot", "lane"])  # virtual * LANES rows at most
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"), "vslot", *keep))


def shard_documents(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL_SLOTS, map_path: str | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, *keep) of every row under a newly built, stored map."""
    spark = docs.sparkSession
    rows = with_slot(docs, virtual=virtual, keep=keep)
    sizes_path = scratch_path(spark, "slot-sizes")
    slot_sizes(with_slot(docs, virtual=virtual)).write.parquet(sizes_path)
    sizes = spark.read.schema("vslot int, lane int, n long, bytes long").parquet(sizes_path)
    path = map_path or scratch_path(spark, "slot-map")
    save_slot_map(build_slot_map(sizes, shards), path)
    return shard_rows(rows, sizes, load_slot_map(spark, path, 1), keep)
