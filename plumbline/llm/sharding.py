"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes are summed per slot, and a versioned table maps slots to shards.
Rebalancing and growing edit that table: they write a new version in which only the slots that must move have another shard.
Everything here is DataFrame functions. The map has at most ``slots`` + ``PARTS_PER_SHARD`` x shards rows whatever the corpus holds, so
it may be broadcast and folded in one row.

Defined results: a null text has 8 bytes and a crc of null; a null doc_id is hashed like any other value; rows that repeat a record
share its slot, and a slot that such rows make heavy is split into parts dealt by row; an empty table has no rows. Columns of the
input are kept, except that names of the result replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable

SLOTS = 4096
# A slot heavier than 1 / PARTS_PER_SHARD of a shard is dealt by row into parts that are no heavier than that.
PARTS_PER_SHARD = 16


def record_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(8)


def virtual_slot(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(slots)).cast("int")


def slot_sizes(sized: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every (slot, part); ``sized`` has v_slot, row_salt and size. Slots without rows are there, too."""
    space = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("v_slot"))
    loads = sized.groupBy("v_slot").agg(F.sum("size").alias("bytes"))
    bytes_ = F.coalesce("bytes", F.lit(0))
    fair = F.greatest(F.sum(bytes_).over(Window.partitionBy(F.lit(0))) / F.lit(shards * PARTS_PER_SHARD), F.lit(1.0))
    parts = space.join(loads, "v_slot", "left").select("v_slot", F.ceil(F.greatest(bytes_ / fair, F.lit(1.0))).cast("int").alias("parts"))
    # Most slots stay whole. For the others, rows are dealt by their salt, and the parts are measured, not assumed equal.
    measured = (with_part(sized, parts).groupBy("v_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    every = parts.select("v_slot", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return every.join(measured, ["v_slot", "part"], "left").fillna(0, ["bytes", "rows"])


def with_part(sized: DataFrame, parts: DataFrame) -> DataFrame:
    """At most slots + PARTS_PER_SHARD x shards rows in ``parts``: broadcast."""
    part = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("row_salt"), F.col("parts"))).cast("int")
    return sized.join(F.broadcast(parts.select("v_slot", "parts").distinct()), "v_slot").withColumn("part", part)


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slot modulo shard count."""
    return sizes.select(F.lit(1).alias("version"), "v_slot", "part", "parts", "bytes", "rows",
                        F.pmod(F.col("v_slot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version: what a shard holds beyond its fair bytes goes to the shards with least bytes, heaviest slots first.

    A shard keeps its heaviest slots while they fit under the fair share, so the slots that move are small ones and fill gaps
    closely. The fold sees only the moved slots of a map of bounded length, in one row.
    """
    heavy_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "v_slot", "part")
    fair = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards)
    held = (slot_map.withColumn("fair", fair).withColumn("upto", F.sum("bytes").over(heavy_first.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("stays", F.col("upto") <= F.col("fair")))
    listed = held.agg(F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"),
                      F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "v_slot", "part")))).alias("movers"))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(
        F.filter("kept", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"]))

    def place(acc: Column, slot: Column) -> Column:
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(F.transform(acc["loads"], lambda x, i: F.when(i == to, x - slot["minus"]).otherwise(x)).alias("loads"),
                        F.concat(acc["to"], F.array(to)).alias("to"))

    begin = F.struct(start.alias("loads"), F.array().cast("array<int>").alias("to"))
    moved = (listed.select("movers", F.aggregate("movers", begin, place, lambda a: a["to"]).alias("to"))
             .select(F.explode(F.arrays_zip("movers", "to")).alias("m"))
             .select(F.col("m.movers.v_slot").alias("v_slot"), F.col("m.movers.part").alias("part"), F.col("m.to").alias("new_shard")))
    return (slot_map.join(F.broadcast(moved), ["v_slot", "part"], "left")
            .select((F.col("version") + 1).alias("version"), "v_slot", "part", "parts", "bytes", "rows",
                    F.coalesce("new_shard", "shard").alias("shard")))


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more (number ``shards``): each old shard gives slots, and only the new one takes any."""
    small_first = Window.partitionBy("shard").orderBy("bytes", "v_slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    fair = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards + 1)
    excess = F.sum("bytes").over(Window.partitionBy("shard")) - fair
    gives = F.sum("bytes").over(small_first) <= excess
    return (slot_map.withColumn("gives", F.coalesce(gives, F.lit(False)))
            .select((F.col("version") + 1).alias("version"), "v_slot", "part", "parts", "bytes", "rows",
                    F.when(F.col("gives"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard")))


def sized_rows(documents: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """The thin table that all later steps read: key, bytes, crc, virtual slot and a salt that tells repeated rows apart."""
    crc = F.crc32(F.col(text).cast("binary"))
    return documents.select(F.col(key).alias("key"), record_bytes(text).alias("size"), crc.alias("text_crc32"),
                            virtual_slot(F.col(key), crc, slots).alias("v_slot"), F.monotonically_increasing_id().alias("row_salt"))


def build_map(sized: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """All versions of the map so far, to be stored: version 1 by modulo, version 2 rebalanced by bytes."""
    one = durable(first_map(slot_sizes(sized, shards, slots), shards))
    return one.unionByName(rebalanced(one, shards))


def assign(sized: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of every row by the newest version of the map, and its place in the shard (gapless from 0).

    Places are numbered inside each (slot, part) and shifted by the rows of the slots before it in its shard, so no task ever
    sees a whole shard.
    """
    newest = (slot_map.withColumn("newest", F.max("version").over(Window.partitionBy(F.lit(0))))
              .filter("version = newest").drop("newest"))
    ahead = Window.partitionBy("shard").orderBy("v_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = newest.select("v_slot", "part", "parts", "shard", "version", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    placed = durable(placed)
    rows = with_part(sized, placed).drop("parts").join(F.broadcast(placed.drop("parts")), ["v_slot", "part"])
    inside = Window.partitionBy("v_slot", "part").orderBy("key", "text_crc32", "size", "row_salt")
    return rows.withColumn("slot", (F.col("ahead") + F.row_number().over(inside) - 1).cast("long"))


def shard_documents(documents: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, part and map_version of every row; shard bytes come out nearly equal."""
    sized = durable(sized_rows(documents, key, text, slots))
    rows = assign(sized, build_map(sized, shards, slots))
    return rows.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), F.col("v_slot").alias("virtual_slot"), "part",
                       F.col("version").alias("map_version"))
