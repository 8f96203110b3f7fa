"""Genomes as tables of tiles, and windows cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane.functions.text import convert_bases, other_name

TILE = 4096


def read_fasta(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """Tiles (contig, tile_no, seq) of a plain or gzipped FASTA file: each of `tile` bases but a contig's last.

    The file's blocks are read by many tasks (a gzipped one by one); each numbers its pieces of sequence.
    A piece's contig and its place there follow from the lengths of the pieces before it, by where blocks
    begin in the file, so the order in which blocks are read doesn't matter. Lines ahead of the first
    header are left out; a contig's name ends at the first blank.
    """
    from collections.abc import Iterator

    import pandas as pd

    most = 64 * tile

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, number, name, held, size = None, 0, None, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, name, held, size
            if name is not None or size:
                out.append((block, number, name, "".join(held)))
                number += 1
            name, held, size = None, [], 0

        for part in parts:
            for start, line in zip(part["start"], part["value"], strict=True):
                if start != block:
                    close()
                    block, number = start, 0
                line = line.strip()
                if line.startswith(">"):
                    close()
                    name = line[1:].split()[0] if line[1:].split() else ""
                elif line:
                    held.append(line)
                    size += len(line)
                    if size >= most:
                        close()
            if out:
                yield pd.DataFrame(out, columns=["block", "number", "name", "seq"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["block", "number", "name", "seq"])

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("start"))
    pieces = lines.mapInPandas(cut, "block bigint, number bigint, name string, seq string")
    # One row for each header and each 64 tiles: a genome's are few.
    every = Window.orderBy("block", "number")
    of = pieces.select("block", "number", "name", F.length("seq").alias("n")).withColumn("run", F.count("name").over(every))
    own = Window.partitionBy("run").orderBy("block", "number")
    of = of.withColumn("contig", F.first("name").over(own)).withColumn("at", F.sum("n").over(own) - F.col("n")).where("run > 0 and n > 0").select("block", "number", "run", "contig", "at")
    placed = pieces.select("block", "number", "seq").join(of, ["block", "number"])
    first, last = F.floor(F.col("at") / tile), F.floor((F.col("at") + F.length("seq") - 1) / tile)
    spread = placed.select("run", "contig", "at", "seq", F.explode(F.sequence(first, last)).alias("tile_no"))
    begin = F.greatest(F.lit(0), F.col("tile_no") * tile - F.col("at"))
    size = F.least(F.col("tile_no") * tile + tile - F.col("at"), F.length("seq")) - begin
    bits = spread.select("run", "contig", "tile_no", F.struct(F.greatest(F.col("at"), F.col("tile_no") * tile).alias("at"), F.substring("seq", (begin + 1).cast("int"), size.cast("int")).alias("seq")).alias("x"))
    # A tile is of two pieces, three where blocks are short.
    return bits.groupBy("run", "contig", "tile_no").agg(F.array_sort(F.collect_list("x")).alias("x")).select("contig", "tile_no", F.array_join(F.transform("x", lambda e: e["seq"]), "").alias("seq"))


def convert_fasta(spark: SparkSession, path: str, out: str, kind: str) -> None:
    """Write a genome with C as T (CT) or G as A (GA): header lines as they are, all else in upper case, lines in their order."""
    start = F.col("_metadata.file_block_start")
    lines = spark.read.option("lineSep", "\n").text(path).select(start.alias("block"), F.monotonically_increasing_id().alias("line"), convert_bases("value", kind).alias("value"))
    lines.repartitionByRange("block", "line").sortWithinPartitions("block", "line").select("value").write.mode("errorifexists").text(out)


def contig_lengths(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("contig").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))


def with_fallback(asked: DataFrame, tiles: DataFrame) -> DataFrame:
    """asked with its contig named as the genome has it: the exact name, else with chr added or taken off."""
    names = tiles.select("contig").distinct()
    exact = names.select("contig", F.col("contig").alias("exact"))
    other = names.select(F.col("contig").alias("other"), F.col("contig").alias("fallback"))
    out = asked.withColumn("other", other_name("contig")).join(exact, "contig", "left").join(other, "other", "left")
    return out.withColumn("contig", F.coalesce("exact", "fallback", "contig")).drop("other", "exact", "fallback")


def fetch_windows(asked: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """asked (contig, start, length, ...) with window: the bases from start on; null if they leave the contig.

    Each distinct window is joined with the tiles that it touches, by equality of contig and tile, and put
    together once; a window is short, so its tiles are few. Of asked only these three columns take part.
    """
    place = ["contig", "start", "length"]
    last = F.floor((F.col("start") + F.col("length") - 1) / tile)
    want = asked.where("start >= 0 and length > 0").select(*place).distinct().withColumn("tile_no", F.explode(F.sequence(F.floor(F.col("start") / tile), last)))
    own = want.join(tiles, ["contig", "tile_no"]).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("tile_no", "seq"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda t: t["seq"]), "")
    first = F.element_at("x", 1)["tile_no"] * tile
    window = F.substring(joined, (F.col("start") - first + 1).cast("int"), F.col("length").cast("int"))
    complete = (F.element_at("x", 1)["tile_no"] == F.floor(F.col("start") / tile)) & (F.length(window) == F.col("length"))
    return asked.join(own.select(*place, F.when(complete, window).alias("window")), place, "left")
