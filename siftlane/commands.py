"""The evaluation commands: each reads tables or alignments, writes a JSON report, and returns an exit status."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane import schema
from siftlane.functions import score
from siftlane.functions.text import blake2b_key
from siftlane.operators import evaluate as e
from siftlane.operators import fragments as f
from siftlane.plans import reports as r
from siftlane.sources import bam, fasta, files


def alignments(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of a SAM or BAM file."""
    return files.read_sam(spark, path) if path.endswith(".sam") else bam.read_bam(spark, path, **options)


def labelled(values: list[str]) -> dict[str, str]:
    """LABEL=PATH items; a label may occur once."""
    out = {}
    for value in values:
        label, found, path = value.partition("=")
        if not (found and label and path) or label in out:
            raise ValueError(f"wanted LABEL=PATH, each label once: {value!r}")
        out[label] = path
    return out


def membership(spark: SparkSession, a: argparse.Namespace) -> int:
    tables = [alignments(spark, p, fields="core") for p in (a.original, a.modern, a.legacy)]
    r.write_report(r.membership_report(*tables) | {"original": a.original, "modern": a.modern, "legacy": a.legacy}, a.report)
    files.write_tsv(e.disagreements(e.membership(*tables)).orderBy("fragment_id"), a.disagreements, gzip=True)
    return 0


def stratify(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_table(spark, a.disagreements, schema.DISAGREEMENTS)
    inputs = {name: alignments(spark, getattr(a, name), fields="core") for name in ("original_graft", "original_host", "modern_filtered", "legacy_filtered")}
    shapes, report = r.stratify_report(rows, a.classification, a.size, blake2b_key(a.seed)("fragment_id"), inputs)
    files.write_tsv(r.sample_rows(shapes, *inputs), a.samples)
    r.write_report(report | {"seed": a.seed}, a.report)
    return 0 if report["all_modern_only"] else 1


def mate_scores(rows: DataFrame, sample: DataFrame, side: str) -> DataFrame:
    """Primary records of the sample's fragments as build_fragments wants them; rows: qname, flag, score."""
    own = rows.join(sample.select(F.col("fragment_id").alias("qname")), "qname", "left_semi").where(score.primary_mapped(ref_id=None))
    return own.select(F.lit("sample").alias("sample_id"), "qname", F.lit(side).alias("side"), "flag", F.col("score").cast("bigint").alias("score"), F.lit(None).cast("string").alias("score_error"))


def decisions(spark: SparkSession, a: argparse.Namespace) -> int:
    sample = files.read_table(spark, a.samples, "fragment_id string", exact=False).distinct()
    audit = lambda p: files.read_table(spark, p, "qname string, flag int, classification_score bigint", exact=False).withColumnRenamed("classification_score", "score")
    sam = lambda p: alignments(spark, p).withColumn("score", score.plain_score())
    tools = {}
    for tool, read, paths in (("modern", audit, (a.modern_graft, a.modern_host)), ("legacy", sam, (a.legacy_graft, a.legacy_host))):
        rows = mate_scores(read(paths[0]), sample, "graft").unionByName(mate_scores(read(paths[1]), sample, "host"))
        tools[tool] = f.build_fragments(rows)
        odd = tools[tool].where(f.pair_ambiguous("g") | f.pair_ambiguous("h")).select("qname").limit(1).collect()
        if odd:
            raise ValueError(f"{tool}: {odd[0][0]} has more than one primary record of a mate, or one of no mate")
    report = r.decision_evidence_report(sample, tools["modern"], tools["legacy"], a.threshold, a.penalty)
    r.write_report(report, a.report)
    if a.names:
        files.write_names(sample.select(F.col("fragment_id").alias("qname")), a.names)
    return 1 if report["missing_score_records"] else 0


def mixture(spark: SparkSession, a: argparse.Namespace) -> int:
    tools = {label: alignments(spark, path, fields="core") for label, path in labelled(a.tool).items()}
    report = r.mixture_report(files.read_truth(spark, a.truth), tools, a.graft_source)
    r.write_report(report, a.report)
    return 0 if r.passes(report, unknown=a.require_known) else 1


def grid(spark: SparkSession, a: argparse.Namespace) -> int:
    metrics = "accuracy double, sensitivity double, specificity double, `precision` double, npv double, balanced_accuracy double, f1 double"
    cells = files.read_documents(spark, os.path.join(a.directory, "*.metrics.json"), f"tools struct<`{a.tool}`: struct<{metrics.replace(' double', ': double')}>>").select("cell", F.col(f"tools.`{a.tool}`.*"))
    r.write_report(r.grid_report(cells, a.metric, a.assay), a.report)
    return 0


def gradient(spark: SparkSession, a: argparse.Namespace) -> int:
    wide = files.read_header(spark, a.expected)
    names = [c for c in wide if c != "cell"]
    expected = files.read_table(spark, a.expected, ", ".join(f"{c} string" for c in wide)).select("cell", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("text")) for n in names])).alias("x")).select("cell", "x.*")
    found = files.read_documents(spark, os.path.join(a.directory, "*.json"), f"tools struct<`{a.tool}`: struct<{', '.join(f'`{n}`: double' for n in names)}>>")
    observed = found.select("cell", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"tools.`{a.tool}`.`{n}`").alias("value")) for n in names])).alias("x")).select("cell", "x.*")
    report = r.gradient_report(observed, expected, a.tolerance, a.large)
    r.write_report(report, a.report)
    return 0 if r.passes(report, deviations=a.fail_on_deviation) else 1


def read_evidence(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Oracle and audit rows; the oracle's column of the distance free of conversions may have any name."""
    own = schema.ORACLE.replace("bisulfite_nm bigint", f"{a.bisulfite_column} bigint")
    return files.read_table(spark, a.oracle, own).withColumnRenamed(a.bisulfite_column, "bisulfite_nm"), files.read_table(spark, a.audit, schema.AUDIT)


def nm_scores(spark: SparkSession, a: argparse.Namespace) -> int:
    oracle, audit = (files.numbered(t, p) for t, p in zip(read_evidence(spark, a), (a.oracle, a.audit), strict=True))
    report = r.nm_score_report(oracle, audit, a.mode == "bisulfite")
    r.write_report(report, a.report)
    return 0 if report["equal"] else 1


def nm_reads(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.limit <= 0:
        raise ValueError("the limit must be positive")
    oracle, audit = read_evidence(spark, a)
    mapped = lambda p: bam.read_bam(spark, p, split="false", fields="core").where(score.mapped()).selectExpr("ordinal", "qname", "flag", "ref_name as reference", "pos as position_0_based", "cigar", "coalesce(nm, -1L) as stored_nm")
    original = mapped(a.original).where(F.col("ordinal") < a.limit).withColumnRenamed("ordinal", "record_ordinal").drop("stored_nm")
    tools = {label: mapped(path) for label, path in labelled(a.tool).items()}
    evidence = e.nm_evidence(original, oracle, audit, a.mode == "bisulfite", **tools)
    r.write_report(r.nm_read_report(evidence, a.mode == "bisulfite", *tools), a.report)
    e_rows = evidence.where(F.size("categories") > 0).withColumnsRenamed({"o": "oracle", "a": "audit"})
    e_rows.orderBy("record_ordinal").write.mode("errorifexists").json(a.differences)
    return 0


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    fasta.convert_fasta(spark, a.input, a.output, a.kind)
    return 0


def split(spark: SparkSession, a: argparse.Namespace) -> int:
    """Records with one XG tag; none at all is an error."""
    rows = bam.read_bam(spark, a.input).where(F.col("xg") == a.xg)
    staged = a.output + ".staged"
    try:
        bam.write_bam(rows, staged, bam.header_of(a.input).text)
        n = bam.read_bam(spark, staged, fields="core").count()
        if not n:
            raise ValueError(f"{a.input} has no records with XG {a.xg}")
        files.publish([staged], [a.output])
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    print(n)
    return 0


def sort(spark: SparkSession, a: argparse.Namespace) -> int:
    r.write_report(r.sort_benchmark(spark, a.input, a.output, bam.header_of(a.input).text, a.runs), a.report)
    return 0


def add_parsers(sub: argparse._SubParsersAction) -> None:
    def command(name: str, needed: str, **more: dict) -> None:
        p = sub.add_parser(name)
        for n in needed.split():
            p.add_argument(f"--{n}", required=True)
        for n, kind in more.items():
            p.add_argument(f"--{n.replace('_', '-')}", **kind)

    many = {"action": "append", "required": True, "metavar": "LABEL=PATH"}
    flag = {"action": "store_true"}
    evidence = {"bisulfite_column": {"default": "bisulfite_nm"}, "mode": {"choices": ("conventional", "bisulfite"), "required": True}}
    command("membership", "original modern legacy report disagreements")
    command("stratify", "disagreements original-graft original-host modern-filtered legacy-filtered samples report", classification={"default": "graft/discarded"}, size={"type": int, "default": 1000}, seed={"default": "seed"})
    command("decisions", "samples modern-graft modern-host legacy-graft legacy-host report", names={}, threshold={"type": int, "default": 4}, penalty={"type": int, "default": 8})
    command("mixture", "truth report", tool=many, graft_source={"choices": ("human", "mouse"), "default": "human"}, require_known=flag)
    command("grid", "directory report", tool={"default": "modern"}, metric={"default": "f1"}, assay={"default": "assay"})
    command("gradient", "directory expected report", tool={"default": "modern"}, tolerance={"type": float, "default": 0.5}, large={"type": float, "default": 2.0}, fail_on_deviation=flag)
    command("nm-scores", "oracle audit report", **evidence)
    command("nm-reads", "original oracle audit report differences", tool=many, limit={"type": int, "required": True}, **evidence)
    command("convert", "input output", kind={"choices": ("CT", "GA"), "required": True})
    command("split", "input output", xg={"choices": ("CT", "GA"), "required": True})
    command("sort", "input output report", runs={"type": int, "default": 1})


COMMANDS = {"membership": membership, "stratify": stratify, "decisions": decisions, "mixture": mixture, "grid": grid, "gradient": gradient, "nm-scores": nm_scores, "nm-reads": nm_reads, "convert": convert, "split": split, "sort": sort}
