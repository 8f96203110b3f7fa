"""Packing token ids into rows of fixed length by best-fit decreasing.

Whole rows of overlong documents are cut off as they are; the remainders are packed. Best-fit
decreasing depends on lengths alone, and bins with equal room are alike to it, so the driver runs it on
the histogram of lengths (at most one entry for each length below the row's) instead of on documents: a
segment tree over capacities finds the least room that fits, and all bins with that room are filled in
one step. Its outcome is a short table of runs: which ranks of a length go to which bins at which
offset. Each remainder's rank among those of its length comes from counts by cells of a hash, so
nothing is ordered globally and no group is hot.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks are counted in cells of the key's hash: so many at least, and so many rows of one length in a cell on average at most.
CELLS, CELL_ROWS = 256, 50_000


class CapacityTree:
    """Numbers of bins by room left, with a search for the least room that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at //= 2

    def least(self, need: int) -> int:
        """The least room of at least `need` that a bin has; -1 if none has."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def best_fit_decreasing(lengths: Iterable[tuple[int, int]], row: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank + 1, first bin, items in a bin, offset in the bin), and the number of bins, for (length, count).

    The bins are those of best-fit decreasing item by item, ties in favour of the bin that is open
    longest: a bin takes as many items of a length as fit, since after the first it has the least room.
    """
    tree, held = CapacityTree(row), {}
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            held.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length, count in sorted(lengths, reverse=True):
        rank = 0
        while rank < count:
            room = tree.least(length)
            if room < 0:
                room, first, n = row, bins, -(-(count - rank) // (row // length))
                bins += n
            else:
                first, n = held[room].pop()
                tree.add(room, -n)
            each = room // length
            take = min(n * each, count - rank)
            whole, part = divmod(take, each)
            runs.append((length, rank, rank + take, first, each, row - room))
            put(room - each * length, first, whole)
            if part:
                put(room - part * length, first + whole, 1)
            rest = whole + bool(part)
            put(room, first + rest, n - rest)
            rank += take
    return runs, bins


def pack(df: DataFrame, row: int = 8192, key: str = "doc_id", ids: str | Column = "ids", width: int = 1, pad: int = 0) -> DataFrame:
    """Packed rows: shared bins, and the whole rows cut from overlong documents.

    ids: binary, `width` bytes for each token, little-endian. Each result has input_ids (row x width
    bytes, the rest filled with bytes `pad`), n_tokens, cu_seqlens (0 and the end of each segment),
    position_resets (where a segment begins, so positions start from 0), and for each segment its row's
    id (doc_ids) and its first token's place in the document (starts), by which documents can be put
    together again exactly. bin numbers the shared bins from 0; whole rows have none (null).

    Null or empty ids have no tokens and are in no row. A null key counts as empty text in the hash.
    Repeated rows are packed each. An empty table gives an empty result.
    """
    raw = F.col(f"`{ids}`") if isinstance(ids, str) else ids
    base = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(raw, F.lit(b"")).alias("raw"))
    n = (F.octet_length("raw") / width).cast("int")
    base = base.select("id", "raw", n.alias("n"), (n % row).alias("rest"), F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("h"))
    histogram = [(r[0], r[1]) for r in base.where("rest > 0").groupBy("rest").count().collect()]
    runs, _ = best_fit_decreasing(histogram, row)
    cell = (F.col("h") % max(CELLS, -(-max((n for _, n in histogram), default=0) // CELL_ROWS))).cast("int")
    counted = base.where("rest > 0").groupBy(cell.alias("cell"), "rest").agg(F.count("*").alias("m"))
    spark = df.sparkSession
    table = spark.createDataFrame([tuple(map(int, r)) for r in runs], "rest int, low long, high long, first long, each long, at long")
    before = F.sum("m").over(Window.partitionBy("rest").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("cell", "rest", F.coalesce(before, F.lit(0)).alias("before"))
    cut = lambda first, tokens: F.substring("raw", first * width + 1, tokens * width)
    rests = base.where("rest > 0").select("id", cell.alias("cell"), "rest", (F.col("n") - F.col("rest")).alias("start"), cut(F.col("n") - F.col("rest"), F.col("rest")).alias("raw"))
    number = F.row_number().over(Window.partitionBy("cell", "rest").orderBy("id", "start", "raw"))
    ranked = rests.withColumn("number", number).join(offsets, ["cell", "rest"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    # A few runs for each length, whatever the number of documents.
    placed = ranked.join(F.broadcast(table), "rest").where("rank >= low and rank < high")
    k = F.col("rank") - F.col("low")
    placed = placed.select((F.col("first") + F.floor(k / F.col("each"))).alias("bin"), F.struct((F.col("at") + k % F.col("each") * F.col("rest")).cast("int").alias("at"), F.col("rest").alias("length"), "id", "start", "raw").alias("x"))
    shared = placed.groupBy("bin").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda s, e: F.concat(s, e["raw"]))
    ends = F.concat(F.transform("x", lambda e: e["at"]), F.transform(F.slice("x", -1, 1), lambda e: e["at"] + e["length"]))
    shared = shared.select("bin", joined.alias("input_ids"), F.element_at(ends, -1).alias("n_tokens"), ends.alias("cu_seqlens"), F.transform("x", lambda e: e["at"]).alias("position_resets"), F.transform("x", lambda e: e["id"]).alias("doc_ids"), F.transform("x", lambda e: e["start"]).alias("starts"))
    whole = base.where(F.col("n") >= row).select("id", "raw", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / row).cast("int") - 1)).alias("piece"))
    start = F.col("piece") * row
    whole = whole.select(F.lit(None).cast("long").alias("bin"), cut(start, F.lit(row)).alias("input_ids"), F.lit(row).alias("n_tokens"), F.array(F.lit(0), F.lit(row)).alias("cu_seqlens"), F.array(F.lit(0)).alias("position_resets"), F.array("id").alias("doc_ids"), F.array(start).alias("starts"))
    filled = F.rpad("input_ids", F.lit(row * width), F.lit(bytes([pad])))
    return shared.unionByName(whole).withColumn("input_ids", filled)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet: one row of the matrix in each record, so a shard is read as a matrix by one copy."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def matrix(rows: Iterable[bytes], width: int) -> np.ndarray:
    """The id matrix of some records' input_ids."""
    return np.stack([np.frombuffer(r, f"<u{width}") for r in rows])


def position_ids(cu_seqlens: Iterable[int], row: int) -> np.ndarray:
    """Positions within their segments of a row's tokens; those after the last segment are 0."""
    out = np.zeros(row, np.int32)
    ends = list(cu_seqlens)
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out
