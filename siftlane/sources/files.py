"""Tabular sources, checked on reading; and outputs that replace their place only when they are whole."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlane import schema


def read_table(spark: SparkSession, path: str, columns: str, exact: bool = True) -> DataFrame:
    """A TSV file (gzipped too) whose header has just these columns in order, or, not exact, these among others."""
    wanted = [c.strip().split()[0] for c in columns.split(",")]
    first = spark.read.text(path).limit(1).collect()
    found = first[0][0].split("\t") if first else []
    if (found != wanted) if exact else (set(wanted) - set(found)):
        raise ValueError(f"{path}: the header is {found}, wanted {wanted}")
    kinds = dict(c.strip().split(None, 1) for c in columns.split(","))
    full = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in found)
    return spark.read.csv(path, sep="\t", header=True, schema=full, mode="FAILFAST", quote="").select(*wanted)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a TSV file."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split("\t") if first else []


def numbered(df: DataFrame, path: str) -> DataFrame:
    """df with row_number, from 1, by the rows' places in the file that it was read from.

    Rows are counted by block of the file, and blocks added up: no global sort of the rows.
    """
    if os.path.isdir(path):
        raise ValueError(f"{path}: rows of a folder have no order")
    own = df.select("*", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    starts = own.groupBy("block").agg(F.count("*").alias("n"), F.min("line").alias("least"))  # one row for each block of the file
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(starts), "block").withColumn("row_number", F.col("before") + F.col("line") - F.col("least") + 1).select("row_number", *df.columns)


def write_names(names: DataFrame, path: str) -> None:
    """Names (qname), distinct and sorted, one on each line: a list that read_names reads."""
    names.select("qname").distinct().orderBy("qname").write.mode("errorifexists").text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """fragment_id and known_source; blank ids, unknown sources, repeated ids and no rows at all are errors."""
    df = read_table(spark, path, schema.TRUTH, exact=False)
    bad = F.coalesce(F.col("known_source").isin("human", "mouse"), F.lit(False))
    row = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("fragment_id"), F.lit("")) == "").alias("blank"), F.count_if(~bad).alias("odd")).head()
    twice = df.groupBy("fragment_id").count().where("count > 1").limit(1).collect()
    for wrong, what in ((row["n"] == 0, "no rows"), (row["blank"] > 0, "a blank fragment_id"), (row["odd"] > 0, "an unknown known_source"), (bool(twice), "a fragment_id twice")):
        if wrong:
            raise ValueError(f"{path}: {what}")
    return df


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """qname, distinct, of a list with a name on each line; an empty line or file is an error."""
    df = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("qname"))
    row = df.agg(F.count("*").alias("n"), F.count_if(F.col("qname") == "").alias("blank")).head()
    if row["n"] == 0 or row["blank"]:
        raise ValueError(f"{path}: {'no names' if row['n'] == 0 else 'an empty line'}")
    return df.distinct()


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a SAM file; a line with fewer than 11 fields is an error. pos is 0-based."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select("value", f.alias("f"))
    rows = rows.withColumn("f", F.when(F.size("f") >= 11, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a SAM line of fewer than 11 fields: "), "value"))))
    at = lambda i: F.col("f")[i]
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    tag = lambda start: F.try_element_at(F.transform(F.filter(tags, lambda x: x.startswith(start)), lambda x: F.substring(x, len(start) + 1, 1 << 30)), F.lit(1))
    return rows.select(at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("ref_name"), (at(3).cast("bigint") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), tag("NM:i:").cast("bigint").alias("nm"), tag("XG:Z:").alias("xg"))


def read_documents(spark: SparkSession, pattern: str, columns: str) -> DataFrame:
    """JSON documents, one in each file, with `cell`: the file's name up to its first dot."""
    return spark.read.schema(columns).json(pattern, multiLine=True).withColumn("cell", F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))


def write_tsv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def digest_check(spark: SparkSession, path: str, size: int, sha256: str) -> bool:
    """Whether a file has this size and SHA-256."""
    row = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("h")).head()
    return row is not None and (row["length"], row["h"]) == (size, sha256)


@contextlib.contextmanager
def output_lock(path: str) -> Iterator[None]:
    """<path>.lock, made by one process at a time and removed at the end."""
    lock = path + ".lock"
    f = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(f, f"{os.getpid()}\n".encode())
        os.close(f)
        yield
    finally:
        os.remove(lock)


def publish(staged: Sequence[str], places: Sequence[str], rename: Callable[[str, str], None] = os.replace) -> None:
    """Move staged files to their places, all or none: what was there before is kept aside and put back on failure."""
    aside: list[tuple[str, str]] = []
    moved: list[str] = []
    try:
        for place in places:
            if os.path.exists(place):
                backup = f"{place}.{uuid.uuid4().hex}.backup"
                os.replace(place, backup)
                aside.append((backup, place))
        for a, b in zip(staged, places, strict=True):
            rename(a, b)
            moved.append(b)
    except BaseException:
        for place in moved:
            os.remove(place)
        for backup, place in aside:
            os.replace(backup, place)
        raise
    for backup, _ in aside:
        os.remove(backup)
