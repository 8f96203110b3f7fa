"""Alignment-shaped views over the star-schema test tables, in integer arithmetic that every engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.functions import score

#: side: (rows, distance, choice of CIGAR)
SIDES = {"graft": ("l_orderkey % 5 <> 0", "l_partkey % 6", "l_suppkey % 7"), "host": ("l_orderkey % 5 <> 1", "l_suppkey % 4", "l_partkey % 5")}
FLAG = (
    "1 + case l_linenumber when 1 then 64 when 2 then 128 when 3 then 2112 when 4 then 384 when 5 then 68 "
    "when 6 then case when l_partkey % 4 = 0 then 64 else 320 end else 2176 end + 16 * (l_suppkey % 2)"
)
CIGAR = "case {} when 0 then '1S49M' when 1 then '20M1I29M' when 2 then '30M2D20M' else '50M' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_of(column: str) -> str:
    return f"concat('F', lpad(cast({column} as string), 9, '0'))"


def alignments(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """qname, flag, ref_id, pos, nm, cigar and mapq, and the columns that they come from."""
    where, nm, choice = SIDES[side]
    return table(spark, sf_dir, "lineitem").where(where).selectExpr(
        f"{name_of('l_orderkey')} as qname", f"cast({FLAG} as int) as flag", "case when l_linenumber = 5 then -1 else cast(l_suppkey % 3 as int) end as ref_id", "cast(l_partkey * 10 as bigint) as pos",
        f"cast({nm} as bigint) as nm", f"{CIGAR.format(choice)} as cigar", "cast(l_suppkey % 61 as int) as mapq", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )


def scored(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Records with the plain score, read from their tag and their CIGAR."""
    return alignments(spark, sf_dir, side).withColumn("score", score.plain_score())


def single_end(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One unpaired record for each order."""
    where, value = {"graft": ("o_orderkey % 6 <> 0", "o_custkey % 7"), "host": ("o_orderkey % 6 <> 1", "(o_orderkey + o_custkey) % 5")}[side]
    return table(spark, sf_dir, "orders").where(where).selectExpr(f"{name_of('o_orderkey')} as qname", "0 as flag", "0 as ref_id", "cast(o_custkey as bigint) as pos", f"cast({value} as bigint) as score")


def reads(spark: SparkSession, sf_dir: str, base: str = "T") -> DataFrame:
    """Reads with a changed base, their windows of the reference, CIGARs, XG tags and flags, one for each part and supplier."""
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = keys.selectExpr("*", "substr(repeat('ACGTTGCACCGGATTA', 6), cast(1 + l_partkey % 16 as int), 60) as window", f"{CIGAR.format('l_suppkey % 7')} as cigar", "cast(1 + l_suppkey % 45 as int) as m", "case when l_partkey % 10 = 0 then null when l_suppkey % 3 = 0 then 'GA' else 'CT' end as xg", "cast(16 * (l_suppkey % 2) as int) as flag")
    rows = rows.selectExpr("*", "case l_suppkey % 7 when 0 then concat('N', substr(window, 1, 49)) when 1 then concat(substr(window, 1, 20), 'G', substr(window, 21, 29)) when 2 then concat(substr(window, 1, 30), substr(window, 33, 20)) else substr(window, 1, 50) end as s0")
    return rows.selectExpr("l_partkey", "l_suppkey", "window", "cigar", "xg", "flag", f"concat(substr(s0, 1, m - 1), '{base}', substr(s0, m + 1)) as seq")


def windowed(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Records with their read, the reference's bases and an XG tag, one for each line item: one or two bases are changed."""
    where, _, choice = SIDES[side]
    rows = table(spark, sf_dir, "lineitem").where(where).selectExpr(
        f"{name_of('l_orderkey')} as qname", f"cast({FLAG} as int) as flag", "case when l_linenumber = 5 then -1 else cast(l_suppkey % 3 as int) end as ref_id", "cast(l_partkey * 10 as bigint) as pos", f"{CIGAR.format(choice)} as cigar", f"{choice} as choice",
        "substr(repeat('ACGTTGCACCGGATTA', 6), cast(1 + l_partkey % 16 as int), 60) as window", "cast(2 + l_suppkey % 20 as int) as m", "cast(24 + l_partkey % 20 as int) as m2", "case when l_partkey % 10 = 0 then null when l_suppkey % 3 = 0 then 'GA' else 'CT' end as xg",
    )
    rows = rows.withColumn("s0", F.expr("case choice when 0 then concat('N', substr(window, 1, 49)) when 1 then concat(substr(window, 1, 20), 'G', substr(window, 21, 29)) when 2 then concat(substr(window, 1, 30), substr(window, 33, 20)) else substr(window, 1, 50) end"))
    return rows.selectExpr("qname", "flag", "ref_id", "pos", "cigar", "window", "xg", "concat(substr(s0, 1, m - 1), 'T', substr(s0, m + 1, m2 - m - 1), 'A', substr(s0, m2 + 1)) as seq", "cast(null as bigint) as nm", "cast(null as string) as nm_type")


def primary_only(df: DataFrame) -> DataFrame:
    return df.where(score.primary_mapped())
