"""The command line: run (classify and filter pairs of BAM files), audit (scores of each record) and the evaluation commands."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftlane import commands
from siftlane import config as c
from siftlane.functions import score
from siftlane.functions.text import tsv_escape
from siftlane.operators.fragments import coordinate_sorted
from siftlane.plans.sample import audited, run_samples, score_audit
from siftlane.sources import bam, fasta, files

VERSION = "0.1.0"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siftlane")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    many = {"action": "extend", "type": lambda x: x.split(","), "default": []}
    r.add_argument("--graft", "-g", required=True, **many)
    r.add_argument("--host", "-t", required=True, **many)
    r.add_argument("--output", "-o", default=".")
    r.add_argument("--mm-threshold", "-m", type=int, default=4)
    r.add_argument("--unmapped-penalty", "-u", type=int, default=8)
    r.add_argument("--nm-tag", "-n", default="NM")
    r.add_argument("--threads", "-j", type=int, default=1)
    r.add_argument("--sort-memory", default="256M")
    r.add_argument("--output-names", "-w", **many)
    r.add_argument("--graft-ref")
    r.add_argument("--host-ref")
    r.add_argument("--recalculate-nm", action="store_true")
    r.add_argument("--bisulfite", action="store_true")
    a = sub.add_parser("audit")
    a.add_argument("--bam", required=True)
    a.add_argument("--reference", required=True)
    a.add_argument("--report", required=True)
    a.add_argument("--names")
    a.add_argument("--limit", type=int, default=0)
    a.add_argument("--bisulfite", action="store_true")
    commands.add_parsers(sub)
    return p.parse_args(argv)


def with_windows(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """records with the bases of the reference that each one covers."""
    keyed = records.withColumn("contig", F.col("ref_name")).withColumn("start", F.col("pos")).withColumn("length", score.reference_span())
    return fasta.fetch_windows(fasta.with_fallback(keyed, tiles), tiles).drop("contig", "start", "length")


HEADINGS = ("Sample", "Total", "GraftOnly", "HostOnly", "Both", "Graft(%)", "Host(%)", "Discard(%)", "TotalGraft(%)", "Thresh")


def table_line(name: str, row: Row, threshold: int) -> str:
    counts = (str(row[c]) for c in ("total", "graft_only", "host_only", "both_sides"))
    rates = (f"{row[c]:.2f}%" for c in ("graft_percent", "host_percent", "discarded_percent", "total_graft_percent"))
    return "\t".join([name, *counts, *rates, str(threshold)])


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Classify all samples in one job. Selected records are staged once, by sample, and each output is sorted and indexed from there."""
    pairs = c.pair_samples(args.graft, args.host)
    if args.threads < 1:
        raise ValueError("threads must be 1 at least")
    c.workers_for(c.parse_memory(args.sort_memory), args.threads)
    if args.output_names and len(args.output_names) != len(pairs):
        raise ValueError(f"{len(args.output_names)} output names for {len(pairs)} samples")
    mode = "bisulfite" if args.bisulfite else "recompute" if args.recalculate_nm else "tag"
    settings = c.Config(args.mm_threshold, args.unmapped_penalty, args.nm_tag, mode, args.graft_ref, args.host_ref)
    names = args.output_names or [None] * len(pairs)
    places = c.check_outputs(args.output, [c.output_name(g, n) for (g, _), n in zip(pairs, names, strict=True)])
    sides = []
    for side, paths, ref in (("graft", [g for g, _ in pairs], args.graft_ref), ("host", [h for _, h in pairs], args.host_ref)):
        rows = None
        for k, path in enumerate(paths):
            own = bam.read_bam(spark, path, side, sampleid=str(k), nmtag=args.nm_tag).where(score.primary_mapped())
            rows = own if rows is None else rows.unionByName(own)
        sides.append(rows if mode == "tag" else with_windows(rows, fasta.read_fasta(spark, ref)))
    result = run_samples(*sides, settings)
    os.makedirs(args.output, exist_ok=True)
    staging = os.path.join(args.output, f".selected-{uuid.uuid4().hex}")
    failed, made = [], []
    try:
        result.chosen.write.partitionBy("sample_id").parquet(staging)
        selected = spark.read.parquet(staging) if any(d.startswith("sample_id=") for d in os.listdir(staging)) else result.chosen.where("false")
        summary = {r["sample_id"]: r for r in result.summary.collect()}  # one row for each pair of inputs
        print("\t".join(HEADINGS))
        for k, ((graft, _), place) in enumerate(zip(pairs, places, strict=True)):
            row = summary.get(str(k))
            if row is None or row["error"]:
                failed.append(f"{graft}: {row['error'] if row else 'no primary records'}")
                continue
            own = selected.where(F.col("sample_id").cast("string") == str(k)).withColumn("sample_id", F.lit(str(k)))
            publish_sorted(own, place, bam.header_of(graft).text)
            made.append((os.path.basename(graft), place))
            print(table_line(os.path.basename(graft), row, args.mm_threshold))
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    for name, place in made:
        print(f"{name} - Output: {place}")
    for x in failed:
        print(f"failed: {x}", file=sys.stderr)
    if failed:
        print(f"{len(failed)} of {len(pairs)} samples failed", file=sys.stderr)
    return 1 if failed else 0


def publish_sorted(rows: DataFrame, place: str, header: str) -> None:
    """A sorted BAM file and its index, both or neither; nothing staged stays behind."""
    os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
    with files.output_lock(place):
        staged = f"{place}.{uuid.uuid4().hex}.bam"
        try:
            bam.write_bam(coordinate_sorted(rows), staged, header)
            bam.build_bai(staged)
            files.publish([staged, staged + ".bai"], [place, place + ".bai"])
        finally:
            for p in (staged, staged + ".bai"):
                if os.path.exists(p):
                    os.remove(p)


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = audited(bam.read_bam(spark, args.bam, split="false"), files.read_names(spark, args.names) if args.names else None, args.limit)
    out = score_audit(with_windows(rows, fasta.read_fasta(spark, args.reference)), bisulfite=args.bisulfite)
    if out.where("nm is null").limit(1).collect():
        raise ValueError("a record can't be scored")
    out = out.withColumn("qname", tsv_escape("qname")).withColumn("reference", tsv_escape("reference"))
    files.write_tsv(out, args.report)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("siftlane").getOrCreate()
    try:
        return ({"run": run, "audit": audit} | commands.COMMANDS)[args.command](spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
