"""Fragments: one row for each name, from the primary records of both sides with one shuffle; and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions.score import PAIRED, is_first, is_second, primary_mapped

KEY = ["sample_id", "qname"]
GRAFT_REASONS = ("graft_host_absent_any_mate_below_threshold", "graft_better_total", "graft_host_absent", "graft_better")
HOST_REASONS = ("host_graft_absent", "host_better_total", "host_better")


def union_sides(graft: DataFrame, host: DataFrame, *extra: str) -> DataFrame:
    """Both sides' primary records with the columns that grouping needs: the filter is ahead of the shuffle."""
    parts = []
    for side, df in (("graft", graft), ("host", host)):
        df = df if "sample_id" in df.columns else df.withColumn("sample_id", F.lit("sample"))
        error = F.col("score_error") if "score_error" in df.columns else F.lit(None).cast("string")
        parts.append(df.where(primary_mapped()).select(*KEY, F.lit(side).alias("side"), "flag", F.col("score").cast("bigint").alias("score"), error.alias("score_error"), *extra))
    return parts[0].unionByName(parts[1])


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def build_fragments(records: DataFrame) -> DataFrame:
    """One row for each (sample_id, qname) of union_sides' records.

    For each side x (g, h): n_x records, paired_x and mate counts first_x and second_x, odd_x (records
    with neither or both mate bits, or unpaired), scores s1_x and s2_x of the mates and s_x of any, and
    the mates' errors. Names without a primary record don't appear.
    """
    out = []
    for x, side in (("g", "graft"), ("h", "host")):
        own = F.col("side") == side
        paired = F.col("flag").bitwiseAND(PAIRED) != 0
        first, second = own & is_first(), own & is_second()
        out += [
            _count(own).alias(f"n_{x}"),
            _count(own & paired).alias(f"paired_{x}"),
            _count(first).alias(f"first_{x}"),
            _count(second).alias(f"second_{x}"),
            _count(own & ~(paired & (is_first() | is_second()))).alias(f"odd_{x}"),
            F.max(F.when(first, F.col("score"))).alias(f"s1_{x}"),
            F.max(F.when(second, F.col("score"))).alias(f"s2_{x}"),
            F.max(F.when(own, F.col("score"))).alias(f"s_{x}"),
            F.max(F.when(own, F.col("score_error"))).alias(f"error_{x}"),
        ]
    return records.groupBy(*KEY).agg(*out)


def pair_ambiguous(x: str) -> Column:
    """A record without just one mate bit, or a mate with two records."""
    return (F.col(f"odd_{x}") > 0) | (F.col(f"first_{x}") > 1) | (F.col(f"second_{x}") > 1)


def mate_score(x: str, mate: int, penalty: int) -> Column:
    """The mate's score; the penalty if it has no record. A record without a score is not absent."""
    n = F.col(f"{'first' if mate == 1 else 'second'}_{x}")
    return F.when(n == 0, F.lit(penalty).cast("bigint")).otherwise(F.col(f"s{mate}_{x}"))


def paired_reason(threshold: int, penalty: int, better: str = "total") -> Column:
    """Why a paired fragment is graft, host or discarded; the rules in their order.

    Ambiguous sides and absent grafts are settled without scores; a graft mate at the threshold
    discards before the host is looked at; without host records one good mate is enough.
    """
    g1, g2, h1, h2 = (mate_score(x, m, penalty) for x in "gh" for m in (1, 2))
    return (
        F.when(pair_ambiguous("g") | pair_ambiguous("h"), "discarded_ambiguous")
        .when((F.col("n_g") == 0) & (F.col("n_h") > 0), "host_graft_absent")
        .when(F.col("n_g") == 0, "discarded_absent")
        .when((F.col("n_h") == 0) & ((g1 < threshold) | (g2 < threshold)), "graft_host_absent_any_mate_below_threshold")
        .when(F.col("n_h") == 0, "discarded_host_absent_both_mates_at_or_above_threshold")
        .when((g1 >= threshold) | (g2 >= threshold), "discarded_threshold")
        .when(g1 + g2 < h1 + h2, f"graft_better_{better}")
        .when(g1 + g2 > h1 + h2, f"host_better_{better}")
        .otherwise("discarded_tie")
    )


def single_reason(threshold: int) -> Column:
    """The same for single-end fragments: more than one primary record on a side is ambiguous."""
    g, h = F.col("s_g"), F.col("s_h")
    return (
        F.when((F.col("n_g") > 1) | (F.col("n_h") > 1), "discarded_ambiguous")
        .when((F.col("n_g") == 0) & (F.col("n_h") > 0), "host_graft_absent")
        .when(F.col("n_g") == 0, "discarded_absent")
        .when(g >= threshold, "discarded_threshold")
        .when(F.col("n_h") == 0, "graft_host_absent")
        .when(g < h, "graft_better")
        .when(g > h, "host_better")
        .otherwise("discarded_tie")
    )


def classification(reason: str = "reason") -> Column:
    return F.when(F.col(reason).startswith("graft"), "graft").when(F.col(reason).startswith("host"), "host").otherwise("discarded")


def reached_error(threshold: int, penalty: int, paired: bool = True) -> Column:
    """The error of a score that the rules come to read, else null.

    Graft errors count if no side is ambiguous and the graft is present; host errors if the host is
    present too and no graft score reaches the threshold.
    """
    if paired:
        ambiguous = pair_ambiguous("g") | pair_ambiguous("h")
        low = (mate_score("g", 1, penalty) < threshold) & (mate_score("g", 2, penalty) < threshold)
    else:
        ambiguous, low = (F.col("n_g") > 1) | (F.col("n_h") > 1), F.col("s_g") < threshold
    graft = ~ambiguous & (F.col("n_g") > 0)
    return F.when(graft & F.col("error_g").isNotNull(), F.col("error_g")).when(graft & (F.col("n_h") > 0) & low & F.col("error_h").isNotNull(), F.col("error_h"))


def classify_paired(fragments: DataFrame, threshold: int = 4, penalty: int = 8) -> DataFrame:
    out = fragments.withColumn("reason", paired_reason(threshold, penalty)).withColumn("error", reached_error(threshold, penalty))
    return out.withColumn("classification", classification())


def classify_single(fragments: DataFrame, threshold: int = 4) -> DataFrame:
    out = fragments.withColumn("reason", single_reason(threshold)).withColumn("error", reached_error(threshold, 0, False))
    return out.withColumn("classification", classification())


def sample_modes(fragments: DataFrame) -> DataFrame:
    """For each sample: graft_mode and host_mode (paired-end, single-end, unknown), and mode_error or null.

    Errors: a fragment, or a side, mixes modes; the sides differ. Only primary records count.
    """

    def mode(x: str) -> Column:
        return F.when(F.sum(f"n_{x}") == 0, "unknown").when(F.sum(f"paired_{x}") == 0, "single-end").when(F.sum(f"paired_{x}") == F.sum(f"n_{x}"), "paired-end").otherwise("mixed")

    def mixed(x: str) -> Column:
        return F.coalesce(F.bool_or((F.col(f"paired_{x}") > 0) & (F.col(f"paired_{x}") < F.col(f"n_{x}"))), F.lit(False))

    out = fragments.groupBy("sample_id").agg(mode("g").alias("graft_mode"), mode("h").alias("host_mode"), mixed("g").alias("in_g"), mixed("h").alias("in_h"))
    error = (
        F.when(F.col("in_g"), "graft_fragment_mixes_modes")
        .when(F.col("in_h"), "host_fragment_mixes_modes")
        .when(F.col("graft_mode") == "mixed", "graft_mixes_modes")
        .when(F.col("host_mode") == "mixed", "host_mixes_modes")
        .when((F.col("graft_mode") != "unknown") & (F.col("host_mode") != "unknown") & (F.col("graft_mode") != F.col("host_mode")), "graft_and_host_differ")
    )
    return out.select("sample_id", "graft_mode", "host_mode", error.alias("mode_error"))


def summarize(classified: DataFrame) -> DataFrame:
    """One row for each sample: fragments by presence and class, percentages of the total, overlap and the first error."""

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1)).cast("bigint")

    g, h = F.col("n_g") > 0, F.col("n_h") > 0
    out = classified.groupBy("sample_id").agg(
        F.count("*").cast("bigint").alias("total"),
        n(g & ~h).alias("graft_only"),
        n(~g & h).alias("host_only"),
        n(g & h).alias("both_sides"),
        n(F.col("classification") == "graft").alias("graft"),
        n(F.col("classification") == "host").alias("host"),
        n(F.col("classification") == "discarded").alias("discarded"),
        F.min("error").alias("score_error"),
    )
    for name in ("graft", "host", "discarded"):
        out = out.withColumn(f"{name}_percent", F.col(name).cast("double") / F.col("total") * 100)
    return out.withColumn("total_graft_percent", F.col("graft_percent")).withColumn("overlap_found", F.col("both_sides") > 0)


def select_records(graft: DataFrame, classified: DataFrame) -> DataFrame:
    """All primary records of the graft's fragments that were found to be graft."""
    df = graft if "sample_id" in graft.columns else graft.withColumn("sample_id", F.lit("sample"))
    return df.where(primary_mapped()).join(classified.where("classification = 'graft'").select(*KEY), KEY, "left_semi")


def coordinate_sorted(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """By (ref_id, pos), then name and flag: ranges of positions in partitions, sorted within, so their order is global."""
    by = ["sample_id", "ref_id", "pos", "qname", "flag"]
    spread = records.repartitionByRange(partitions, *by) if partitions else records.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by)
