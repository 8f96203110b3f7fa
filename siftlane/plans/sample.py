"""A run over samples: records of both sides to summary rows and selected records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.config import Config
from siftlane.functions import score
from siftlane.operators import fragments as f


@dataclass
class Result:
    """fragments: classified, one row each; summary: one row for each sample, with its error; chosen: graft records in any order; selected: by coordinate."""

    fragments: DataFrame
    summary: DataFrame
    chosen: DataFrame

    @property
    def selected(self) -> DataFrame:
        return f.coordinate_sorted(self.chosen)


def with_score(records: DataFrame, config: Config) -> DataFrame:
    """Adds score and score_error: from the tag, or against the reference window (column window, see sources.fasta)."""
    tag = score.tag_error()
    if config.mode == "tag":
        parts = score.insertions() + score.soft_clips()
        return records.withColumn("score", F.when(tag.isNull(), F.col("nm") + parts)).withColumn("score_error", tag)
    converted = score.conversion() if config.mode == "bisulfite" else None
    facts = score.cigar_facts()
    error = score.reference_error(facts=facts)
    anew = F.when(error.isNull(), score.edit_distance("seq", "window", "cigar", converted))
    nm = anew
    if config.mode == "tag_or_recompute":
        there = F.col("nm_type").isNotNull() | F.col("nm").isNotNull()
        nm, error = F.when(there, F.when(tag.isNull(), F.col("nm"))).otherwise(anew), F.when(there, tag).otherwise(error)
    out = records.withColumns({"score_error": error, "computed_nm": nm, "parts": facts["insertions"] + facts["soft_clips"]})
    return out.withColumn("score", F.col("computed_nm") + F.col("parts")).drop("parts")


def run_samples(graft: DataFrame, host: DataFrame, config: Config) -> Result:
    """All samples in one job. The sequencing mode of each sample picks the paired or the single-end rules.

    A sample whose modes disagree, whose sides share no name, or for which the rules come to read a
    score that is an error, has that error in its summary and selects nothing; other samples go on.
    """
    graft, host = with_score(graft, config), with_score(host, config)
    built = f.build_fragments(f.union_sides(graft, host))
    modes = f.sample_modes(built)
    rows = built.join(F.broadcast(modes), "sample_id")  # one row for each sample of the run
    paired = F.coalesce(F.when(F.col("graft_mode") != "unknown", F.col("graft_mode")), F.col("host_mode")) == "paired-end"
    rows = rows.withColumn("reason", F.when(paired, f.paired_reason(config.threshold, config.unmapped_penalty)).otherwise(f.single_reason(config.threshold)))
    rows = rows.withColumn("error", F.when(paired, f.reached_error(config.threshold, config.unmapped_penalty)).otherwise(f.reached_error(config.threshold, 0, False)))
    rows = rows.withColumn("classification", f.classification())
    summary = f.summarize(rows).join(F.broadcast(modes), "sample_id")
    error = F.coalesce("mode_error", F.when(~F.col("overlap_found"), "no_shared_names"), "score_error")
    summary = summary.withColumn("error", error).drop("mode_error", "score_error")
    failed = summary.where("error is not null").select("sample_id")
    chosen = f.select_records(graft, rows).join(F.broadcast(failed), "sample_id", "left_anti")
    return Result(rows, summary, chosen)


def audited(records: DataFrame, names: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """The records that an audit scores: of the first `limit` that were read (0: all), those of the name list, and mapped."""
    out = records.where(F.col("ordinal") < limit) if limit else records
    if names is not None:
        out = out.join(names.select("qname").distinct(), "qname", "left_semi")
    return out.where(score.mapped())


def named_references(records: DataFrame, references: DataFrame) -> DataFrame:
    """records with ref_name by ref_id, and reference_error: unknown_reference where the header hasn't the id."""
    out = records.drop("ref_name").join(references.select("ref_id", "ref_name"), "ref_id", "left")
    return out.withColumn("reference_error", F.when(F.col("ref_name").isNull(), "unknown_reference"))


def score_audit(records: DataFrame, references: DataFrame | None = None, names: DataFrame | None = None, limit: int = 0, bisulfite: bool = False) -> DataFrame:
    """The audit of each mapped record, in eleven columns: records read from the first `limit` only (0: all), then the name list, then mapped ones.

    records need ordinal, qname, flag, ref_id, ref_name, pos, cigar, nm, seq, window.
    """
    out = audited(records, names, limit)
    if references is not None:
        out = named_references(out, references)
    facts = score.cigar_facts()
    nm = F.when(score.reference_error(facts=facts).isNull(), score.edit_distance("seq", "window", "cigar", score.conversion() if bisulfite else None))
    out = out.withColumns({"nm_found": nm, "i": facts["insertions"], "s": facts["soft_clips"]})
    return out.select(F.col("ordinal").alias("record_ordinal"), "qname", "flag", F.col("ref_name").alias("reference"), F.col("pos").alias("position_0_based"), "cigar", F.coalesce("nm", F.lit(-1)).alias("stored_nm"), F.col("nm_found").alias("nm"), F.col("i").alias("insertions"), F.col("s").alias("soft_clips"), (F.col("nm_found") + F.col("i") + F.col("s")).alias("classification_score"))
