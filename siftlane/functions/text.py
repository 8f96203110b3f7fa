"""Text functions: TSV escapes, base conversion, contig names, digests, deviation status."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.config import LEAST_MEMORY


def tsv_escape(column: Column | str) -> Column:
    """Tab, newline and carriage return as two characters each."""
    c = F.col(column) if isinstance(column, str) else column
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def convert_bases(line: Column | str, kind: str) -> Column:
    """A FASTA line in upper case with C as T (CT) or G as A (GA); header lines as they are."""
    c = F.col(line) if isinstance(line, str) else line
    old, new = {"CT": ("C", "T"), "GA": ("G", "A")}[kind]
    return F.when(c.startswith(">"), c).otherwise(F.translate(F.upper(c), old, new))


def other_name(contig: Column | str) -> Column:
    """The name with chr taken off, or put before it."""
    c = F.col(contig) if isinstance(contig, str) else contig
    return F.when(c.startswith("chr"), F.substring(c, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), c))


def deviation_status(deviation: Column, tolerance: float = 0.5, large: float = 2.0) -> Column:
    d = F.abs(deviation)
    return F.when(d > large, "large_deviation").when(d > tolerance, "deviation").when(d.isNotNull(), "within_range")


def names_digest(names: Column) -> Column:
    """SHA-256 of the sorted distinct names, a newline after each (an array of bounded size)."""
    text = F.array_join(F.array_sort(names), "\n")
    return F.sha2(F.when(F.size(names) > 0, F.concat(text, F.lit("\n"))).otherwise(""), 256)


def names_digest_all(names: DataFrame) -> DataFrame:
    """n and sha256 of all distinct names (qname), sorted by bytes, a newline after each: one row.

    One digest is one chain, so one task reads the names after a sort that spills; it holds a batch.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                digest.update(name.encode() + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["n", "sha256"])

    return names.where("qname is not null").select("qname").distinct().repartition(1).sortWithinPartitions("qname").mapInArrow(chain, "n bigint, sha256 string")


def identity_key(*columns: str) -> Column:
    """The values as one JSON array of strings, for looking records up across tools."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def memory_bytes(column: Column | str) -> Column:
    """Bytes of a size such as 512M, as config.parse_memory; null where that is an error."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    number, unit = F.regexp_extract(c, r"(?i)^(\d+)\s*([KMGT]?)B?$", 1), F.upper(F.regexp_extract(c, r"(?i)^(\d+)\s*([KMGT]?)B?$", 2))
    power = F.when(unit == "K", 10).when(unit == "M", 20).when(unit == "G", 30).when(unit == "T", 40).otherwise(0)
    size = F.when(number != "", number.cast("bigint")) * F.pow(F.lit(2), power).cast("bigint")
    return F.when(size >= LEAST_MEMORY, size)


def blake2b_key(seed: str):  # noqa: ANN201
    """A vectorised function: hex BLAKE2b-128 of seed, a zero byte and the text."""

    @F.pandas_udf("string")
    def key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        start = seed.encode() + b"\0"
        for part in parts:
            yield part.map(lambda x: None if x is None else hashlib.blake2b(start + x.encode(), digest_size=16).hexdigest())

    return key
