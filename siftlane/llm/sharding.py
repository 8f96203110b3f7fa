"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed into a fixed number of virtual slots; the bytes of each slot are summed, and a
versioned map, kept as a table, gives each slot its shard. A new map places slots from the largest down,
each on the shard with the least bytes. Rebalancing edits a map: a shard keeps its largest slots up to
the target and gives up the others, which are placed anew; all other slots stay where they are. Each
edit is the next version; older versions stay readable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane.llm.common import stage

#: Virtual slots; parts of a slot at least, in which places are numbered; and rows that a part has on average at most.
SLOTS, PARTS, PART_ROWS = 4096, 16, 1 << 18


def _place(slots: Column, loads: Column) -> Column:
    """Array of (slot, shard) for slots, an array of (bytes, slot) in order, given the shards' loads."""
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<slot:int,shard:int>>)").alias("placed"))

    def step(state: Column, x: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        new = F.transform(state["loads"], lambda v, j: F.when(j == at, v + x["bytes"]).otherwise(v))
        return F.struct(new.alias("loads"), F.concat(state["placed"], F.array(F.struct(x["slot"].alias("slot"), at.cast("int").alias("shard")))).alias("placed"))

    return F.aggregate(slots, start, step, lambda state: state["placed"])


def _assigned(slots: DataFrame, loads: Column) -> DataFrame:
    """(slot, shard) of slots (slot, bytes): at most SLOTS rows, so one row may hold them all."""
    # Largest first, ties by slot: the negated bytes sort so.
    listed = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "slot"))).alias("x"))
    ordered = F.transform("x", lambda s: F.struct((-s["order"]).alias("bytes"), s["slot"].alias("slot")))
    return listed.select(F.inline(_place(ordered, loads)))


def new_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, slot, shard, bytes) for sizes (slot, bytes); at most SLOTS rows."""
    placed = _assigned(sizes.select("slot", "bytes"), F.array_repeat(F.lit(0).cast("long"), shards))
    return sizes.join(F.broadcast(placed), "slot").select(F.lit(version).alias("version"), "slot", "shard", "bytes")


def rebalance(old: DataFrame, sizes: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """The next version of a map for new sizes: only slots of shards over (1 + slack) of the mean move, and slots new to the map.

    Shards beyond those of the old map are empty and take what the others give up. The tables have at
    most SLOTS rows.
    """
    now = sizes.select("slot", "bytes").join(F.broadcast(old.select("slot", "shard", "version")), "slot", "left")
    target = now.agg((F.sum("bytes") * (1 + slack) / shards).alias("target"))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = now.crossJoin(F.broadcast(target)).withColumn("stays", F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.sum("bytes").over(run) <= F.col("target")))
    loads = kept.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load")).agg(F.collect_list(F.struct("shard", "load")).alias("held"))
    moving = kept.where(~F.col("stays"))
    listed = moving.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "slot"))).alias("x"))
    ordered = F.transform("x", lambda s: F.struct((-s["order"]).alias("bytes"), s["slot"].alias("slot")))
    held = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(F.filter("held", lambda h: h["shard"] == k), F.lit(0).cast("long"), lambda s, h: s + h["load"]))
    placed = listed.crossJoin(F.broadcast(loads)).select(F.inline(_place(ordered, held)))
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    both = kept.where("stays").select("slot", "shard", "bytes").unionByName(moving.select("slot", "bytes").join(F.broadcast(placed), "slot").select("slot", "shard", "bytes"))
    return both.crossJoin(F.broadcast(version)).select("version", "slot", "shard", "bytes")


def save_map(slot_map: DataFrame, path: str) -> int:
    """Add a map to the table of its versions at path; a version that is there already is an error."""
    version = slot_map.agg(F.max("version")).head()[0]
    if version is None:
        version = 0
    if version in map_versions(slot_map.sparkSession, path):
        raise ValueError(f"{path} has version {version}")
    slot_map.select("slot", "shard", "bytes").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions kept at path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, the newest by default."""
    version = max(map_versions(spark, path)) if version is None else version
    return spark.read.schema("slot int, shard int, bytes long").parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "slot", "shard", "bytes")


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32 and virtual_slot of each row, staged with a number of its own (row)."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), (F.crc32(own) % slots).cast("int").alias("virtual_slot"))
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "shard-sizes")


def slot_sizes(measured: DataFrame) -> DataFrame:
    """(slot, bytes) of the slots that hold rows."""
    return measured.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"))


def place(measured: DataFrame, slot_map: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """measured() with shard, place (gapless from 0 in each shard) and map_version, by a map of all its slots.

    Rows are numbered in parts of a slot, by hash of the key. A part that is crowded all the same, as by
    rows without a key or with one key, is dealt into pieces, by the row's number.
    """
    rows = measured.count()
    parts = max(parts, math.ceil(rows / (slots * PART_ROWS)))
    part = (F.crc32(F.concat(F.lit("part:"), F.coalesce(F.col("id").cast("string"), F.lit("")))) % parts).cast("int")
    own = measured.withColumn("part", part)
    crowded = own.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")).where(F.col("n") > 4 * PART_ROWS).select("virtual_slot", "part", F.ceil(F.col("n") / PART_ROWS).alias("pieces"))
    own = own.join(crowded, ["virtual_slot", "part"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int"))
    cell = ["virtual_slot", "part", "piece"]
    mapped = F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version")))  # at most `slots` rows
    cells = own.groupBy(*cell).agg(F.count("*").alias("n")).join(mapped, "virtual_slot")
    # A shard's cells: at most slots x parts, and one for each PART_ROWS rows.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select(*cell, "shard", "map_version", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("id", "text_crc32", "size"))
    return own.withColumn("number", number).join(offsets, cell).select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).alias("place"), "virtual_slot", "map_version")


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", slot_map: DataFrame | None = None, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """id, size, text_crc32, shard, place (gapless from 0 in each shard), virtual_slot and map_version of each row.

    The slot comes from the key alone (a null key counts as empty text), so rows that share a key share
    a shard; a null text has size 1 and the crc32 of no bytes. Without a map, one is made for the rows'
    own sizes. A shard's bytes differ from the mean by less than its smallest slots' bytes, unless one
    slot holds more than a shard's share. Places follow the slot, its part and the key, so they are the
    same in each run, but for rows that share a key. A text of any length counts whole; other columns are
    not read, whatever their names. An empty table gives an empty result.
    """
    measured = measure(df, key, text, slots)
    if slot_map is None:
        slot_map = stage(new_map(slot_sizes(measured), shards), "shard-map")
    return place(measured, slot_map, slots, parts)
