"""Reports of an evaluation as JSON documents, and the gates that decide an exit status."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.functions.text import names_digest_all
from siftlane.operators import evaluate as e
from siftlane.operators.fragments import coordinate_sorted, mate_score, paired_reason
from siftlane.sources import bam


def counts_of(df: DataFrame, key: str, n: str = "n") -> dict[str, int]:
    """A small table of counts as a dictionary, sorted by key."""
    return {r[0]: r[1] for r in df.select(key, n).orderBy(key).collect()}


def membership_report(original: DataFrame, modern: DataFrame, legacy: DataFrame) -> dict:
    """Number and digest of the names of each input, and counts of each pair of classes."""
    out = {"schema_version": "membership/v1", "categories": counts_of(e.membership_counts(original, modern, legacy), "category")}
    for name, df in (("original", original), ("modern", modern), ("legacy", legacy)):
        out[f"{name}_fragments"], out[f"{name}_sha256"] = names_digest_all(df).head()
    out["disagreements"] = sum(n for c, n in out["categories"].items() if c in ("graft/discarded", "discarded/graft"))
    return out


def stratify_report(disagreements: DataFrame, wanted: str, size: int, key: Column, inputs: dict[str, DataFrame]) -> tuple[DataFrame, dict]:
    """Shapes of a sample of disagreements in each input, and the report; a class without disagreements is an error.

    The sample is as small as its size says, so only its names' records are aggregated, once: its shapes are held as a local table.
    """
    matching = disagreements.where(F.concat_ws("/", "modern_classification", "legacy_classification") == wanted).count()
    if not matching:
        raise ValueError(f"no disagreement is {wanted}")
    sample = e.sample_disagreements(disagreements, wanted, size, key).select(F.col("fragment_id").alias("qname"))
    own = {name: df.join(F.broadcast(sample), "qname", "left_semi") for name, df in inputs.items()}
    shapes = e.stratify(sample, **own)
    shapes = sample.sparkSession.createDataFrame(shapes.collect(), shapes.schema)
    tables: dict[str, dict] = {}
    for row in e.crosstabs(shapes).orderBy("counter", "value").collect():  # shapes of a sample: some dozens
        tables.setdefault(row.counter, {})[row.value] = row.n
    odd = shapes.where("not (modern_filtered_primary_records > 0 and legacy_filtered_primary_records = 0)").limit(1).collect()
    return shapes, {"schema_version": "strata/v1", "classification": wanted, "matching_disagreements": matching, "sample_size": min(size, matching), "categories": tables, "all_modern_only": not odd}


def sample_rows(shapes: DataFrame, *inputs: str) -> DataFrame:
    """fragment_id, the category in each input and the number of primary records in each, by name."""
    return shapes.select(F.col("qname").alias("fragment_id"), *[f"{n}_category" for n in inputs], *[f"{n}_primary_records" for n in inputs]).orderBy("fragment_id")


def decision_evidence(sample: DataFrame, modern: DataFrame, legacy: DataFrame) -> DataFrame:
    """Each name of the sample (fragment_id) with its fragments of both tools (m, l; null where a tool has no record) and missing: the first tool without a graft record, or null."""
    out = sample.select(F.col("fragment_id").alias("qname"))
    for name, df in (("m", modern), ("l", legacy)):
        out = out.join(df.select("qname", F.struct(*[c for c in df.columns if c != "qname"]).alias(name)), "qname", "left")
    lacks = lambda x: F.coalesce(F.col(f"{x}.n_g"), F.lit(0)) == 0
    return out.withColumn("missing", F.when(lacks("m"), "modern_graft").when(lacks("l"), "legacy_graft"))


def decision_evidence_report(sample: DataFrame, modern: DataFrame, legacy: DataFrame, threshold: int, penalty: int) -> dict:
    """Decisions of both tools for the sample's fragments, score transitions of those without host records, and how many lack a graft record."""
    rows = decision_evidence(sample, modern, legacy)
    tool = lambda x: rows.where("missing is null").select("qname", f"{x}.*")
    m, l_ = tool("m"), tool("l")
    absent = lambda df: df.select("qname", mate_score("g", 1, penalty).alias("first"), mate_score("g", 2, penalty).alias("second"), (F.col("n_h") == 0).alias("host_absent"))
    report = decision_report(m.withColumn("reason", paired_reason(threshold, penalty)), l_.withColumn("reason", paired_reason(threshold, penalty, "mean")), e.host_absent_transitions(absent(m), absent(l_)), threshold, penalty)
    missing = rows.where("missing is not null").groupBy("missing").agg(F.count("*").alias("n"))
    return report | {"sample_size": sample.count(), "missing_score_records": counts_of(missing, "missing")}


def grid_report(cells: DataFrame, metric: str = "f1", assay: str = "assay") -> dict:
    """Cells (cell: t<threshold>-p<penalty>, and metrics) and the one with the largest metric, the first by name among equals."""
    named = cells.withColumn("threshold", F.regexp_extract("cell", r"^t(\d+)-p(\d+)$", 1).cast("int")).withColumn("penalty", F.regexp_extract("cell", r"^t(\d+)-p(\d+)$", 2).cast("int"))
    rows = [x.asDict() for x in named.orderBy("cell").collect()]  # one row for each file of the grid
    if not rows:
        raise ValueError("the grid has no cells")
    best = e.recommend(named, metric, "cell").head()
    return {"schema_version": "grid/v1", "assay": assay, "selection_metric": metric, "grid_size": len(rows), "cells": rows, "recommendation": {"threshold": best.threshold, "penalty": best.penalty, "selection_value": best[metric], "scope": f"for {assay} only"}}


def nm_score_report(oracle: DataFrame, audit: DataFrame, bisulfite: bool) -> dict:
    """Differences of two engines' rows by position, and the first of them whole."""
    counts = counts_of(e.positional_compare(oracle, audit, bisulfite), "category")
    first = e.first_difference(oracle, audit, bisulfite).head()
    n = oracle.join(audit, "row_number").count() if not first or first.category != "record_count" else first.row_number - 1
    return {"schema_version": "nm-scores/v1", "mode": "bisulfite" if bisulfite else "conventional", "equal": not counts, "records_compared": n, "difference_counts": counts, "first_difference": first.asDict(recursive=True) if first else None}


def nm_read_report(evidence: DataFrame, bisulfite: bool, *tools: str) -> dict:
    """Categories of difference, counts and deltas of each tool, and the first record that differs."""
    differ = evidence.where(F.size("categories") > 0)
    counts = counts_of(differ.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")), "category")
    both = evidence.where("o is not null and a is not null")
    total = both.agg(F.count("*").alias("n"), *[F.count_if(F.col("a.nm") != F.col(f"o.{k}_nm")).alias(k) for k in ("conventional", "bisulfite")], F.count_if(F.col("o.conventional_nm") != F.col("o.bisulfite_nm")).alias("between")).head()
    own: dict[str, dict] = {x.tool: x.asDict() | {"delta_counts": {}} for x in e.nm_tool_counts(evidence, *tools).collect()} if tools else {}
    if tools:
        for x in e.nm_deltas(evidence, *tools).orderBy("tool", "delta").collect():  # distances of short reads: some dozens
            own[x.tool]["delta_counts"][x.delta] = x.n
    first = differ.orderBy("record_ordinal").limit(1).collect()
    return {
        "schema_version": "nm-reads/v1", "mode": "bisulfite" if bisulfite else "conventional", "records_compared": evidence.count(), "difference_counts": counts,
        "audit_equals_selected": not counts.get("audit_vs_oracle_selected_nm"), "audit_equals_conventional": not total.conventional, "audit_equals_bisulfite": not total.bisulfite, "conversion_semantic_difference": total.between,
        "tools": own, "first_difference": first[0].asDict(recursive=True) if first else None,
    }


def mixture_report(truth: DataFrame, tools: dict[str, DataFrame], graft: str = "human") -> dict:
    """Metrics of each tool's selected records (qname) against the truth."""
    out = {}
    for name, records in tools.items():
        selected = records.select(F.col("qname").alias("fragment_id"))
        row = e.metrics(e.confusion(truth, selected, graft)).head()
        out[name] = (row.asDict() if row else {}) | e.record_counts(records).head().asDict() | {"unknown_selected_fragments": e.unknown_selected(truth, selected).count()}
    return {"schema_version": "mixture/v1", "graft_source": graft, "tools": out}


def decision_report(modern: DataFrame, legacy: DataFrame, transitions: DataFrame, threshold: int, penalty: int) -> dict:
    return {"schema_version": "decisions/v1", "threshold": threshold, "unmapped_penalty": penalty, "decision_pairs": counts_of(e.decision_pairs(modern, legacy), "decision_pair"), "host_absent_score_transitions": {r.transition: r.n for r in transitions.orderBy(F.desc("n"), "transition").collect()}}


def gradient_report(observed: DataFrame, expected: DataFrame, tolerance: float = 0.5, large: float = 2.0) -> dict:
    """Statuses of all cells; a cell without an expectation is an error."""
    unknown = sorted(r.cell for r in e.unknown_cells(observed, expected).limit(20).collect())
    if unknown:
        raise ValueError(f"cells without an expectation: {', '.join(unknown)}")
    rows = e.compare_cells(observed, expected, tolerance, large)
    return {"schema_version": "gradient/v1", "tolerance": tolerance, "large_deviation": large, "statuses": counts_of(rows.where("status is not null").groupBy("status").agg(F.count("*").alias("n")), "status"), "cells": [r.asDict() for r in rows.orderBy("cell", "metric").collect()]}


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
        f.write("\n")


def passes(report: dict, deviations: bool = False, unknown: bool = False) -> bool:
    """Whether a report holds: no large or small deviations, no unknown selections, where these are asked for."""
    bad = deviations and any(report.get("statuses", {}).get(s) for s in ("deviation", "large_deviation"))
    lost = unknown and any(t.get("unknown_selected_fragments") for t in report.get("tools", {}).values())
    return not (bad or lost)


def only_in_modern(members: DataFrame) -> bool:
    """Whether every disagreement is a fragment that only the modern tool selected."""
    return not e.disagreements(members).where("not (modern_classification = 'graft' and legacy_classification = 'discarded')").limit(1).collect()


def sort_if_needed(spark: SparkSession, path: str, out: str, header: str) -> bool:
    """Write the records in coordinate order unless the file has it already; whether it was written. Either way the result is indexed."""
    if bam.is_sorted(path):
        bam.build_bai(path)
        return False
    bam.write_bam(coordinate_sorted(bam.read_bam(spark, path)), out, header)
    bam.build_bai(out)
    return True


def verify_output(spark: SparkSession, path: str, records: int, header: str) -> None:
    """A file that hasn't this header, or so many records in coordinate order, is an error."""
    if not os.path.getsize(path):
        raise ValueError(f"{path} is empty")
    if bam.header_of(path).text != header:
        raise ValueError(f"{path} has another header")
    if bam.read_bam(spark, path, fields="core").count() != records or not bam.is_sorted(path):
        raise ValueError(f"{path} is not the sorted input")


def sort_benchmark(spark: SparkSession, path: str, out: str, header: str, runs: int = 1) -> dict:
    """Means over runs of the seconds, records and megabytes a second of a coordinate sort, each run checked for header, count and order."""
    n, size = bam.read_bam(spark, path, fields="core").count(), os.path.getsize(path)
    seconds = []
    for k in range(runs):
        place = f"{out}.{k}.bam"
        began = time.time()
        bam.write_bam(coordinate_sorted(bam.read_bam(spark, path)), place, header)
        seconds.append(time.time() - began)
        verify_output(spark, place, n, header)
    mean = statistics.fmean(seconds)
    rate = lambda x: x / mean if mean else None
    return {"schema_version": "sort/v1", "runs": runs, "records": n, "bytes": size, "mean_seconds": mean, "seconds": seconds, "records_per_second": rate(n), "megabytes_per_second": rate(size / 1e6)}
