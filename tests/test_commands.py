"""The evaluation commands end to end on small files."""

import gzip
import hashlib
import json
import os

import pytest

from siftlane import cli, schema
from siftlane.sources import bam, fasta, files

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n"
COLUMNS = "qname string, flag int, ref_id int, pos bigint, mapq int, cigar string, mate_ref_id int, mate_pos bigint, tlen int, seq string, qual binary, nm bigint, " + f"aux {schema.AUX}"


@pytest.fixture
def write(spark, tmp_path):
    def one(name, rows, **aux):
        full = [(q, flag, 0 if not flag & 4 else -1, pos, 60, cigar, -1, -1, 0, "ACGT", None, None, [("NM", "i", None, nm, None, None, None)] + ([("XG", "Z", None, None, None, aux[q], None)] if q in aux else [])) for q, flag, pos, cigar, nm in rows]
        path = str(tmp_path / name)
        bam.write_bam(spark.createDataFrame(full, COLUMNS).coalesce(1), path, HEADER)
        return path

    return one


def pair(q, nm=0, pos=5):
    return [(q, 65, pos, "4M", nm), (q, 129, pos + 10, "4M", nm)]


def text(path):
    names = sorted(os.path.join(path, n) for n in os.listdir(path) if n.startswith("part"))
    return "".join((gzip.open if n.endswith(".gz") else open)(n, "rt").read() for n in names)


def call(tmp_path, name, *args):
    report = str(tmp_path / f"{name}.json")
    status = cli.main([name, *args, "--report", report])
    return status, json.load(open(report)) if os.path.exists(report) else None


def test_membership_then_strata(spark, tmp_path, write):
    original = write("o.bam", [r for q in "abcde" for r in pair(q)] + [("e", 321, 7, "4M", 0)])
    host = write("h.bam", pair("a") + [("b", 65, 5, "4M", 0)])
    modern, legacy = write("m.bam", [r for q in "abc" for r in pair(q)] + pair("zz")), write("l.bam", pair("a") + pair("d"))
    differ = str(tmp_path / "differ")
    status, rep = call(tmp_path, "membership", "--original", original, "--modern", modern, "--legacy", legacy, "--disagreements", differ)
    assert status == 0 and rep["original_fragments"] == 5 and rep["original_sha256"] == hashlib.sha256(b"a\nb\nc\nd\ne\n").hexdigest()
    assert rep["categories"] == {"discarded/discarded": 1, "discarded/graft": 1, "graft/discarded": 2, "graft/graft": 1, "legacy_selected_not_in_original": 0, "modern_selected_not_in_original": 1} and rep["disagreements"] == 3
    assert text(differ) == "fragment_id\tmodern_classification\tlegacy_classification\nb\tgraft\tdiscarded\nc\tgraft\tdiscarded\nd\tdiscarded\tgraft\n"
    inputs = ["--disagreements", differ, "--original-graft", original, "--original-host", host, "--modern-filtered", modern, "--legacy-filtered", legacy, "--samples"]
    status, rep = call(tmp_path, "stratify", *inputs, str(tmp_path / "s1"), "--size", "9")
    assert status == 0 and rep["matching_disagreements"] == rep["sample_size"] == 2 and rep["categories"]["joint_original_alignment_shape"] == {"graft=complete_pair;host=first_mate_only": 1, "graft=complete_pair;host=none": 1}
    assert text(str(tmp_path / "s1")).splitlines()[1] == "b\tcomplete_pair\tfirst_mate_only\tcomplete_pair\tnone\t2\t1\t2\t0"
    status, rep = call(tmp_path, "stratify", *inputs, str(tmp_path / "s2"), "--classification", "discarded/graft", "--size", "1", "--seed", "x")
    assert status == 1 and rep["sample_size"] == 1 and rep["seed"] == "x"
    assert cli.main(["stratify", *inputs, str(tmp_path / "s3"), "--report", str(tmp_path / "none.json"), "--classification", "graft/graft"]) == 2


def test_decisions(spark, tmp_path):
    samples, graft, host, sam, none = (str(tmp_path / n) for n in ("samples.tsv", "g.tsv", "h.tsv", "g.sam", "h.sam"))
    open(samples, "w").write("fragment_id\tx\na\t1\nb\t1\nc\t1\n")
    open(graft, "w").write("qname\tflag\tclassification_score\na\t65\t1\na\t129\t2\nb\t65\t9\nb\t129\t0\nb\t321\t0\nq\t65\t1\n")
    open(host, "w").write("qname\tflag\tclassification_score\nb\t65\t1\n")
    line = lambda q, flag, cigar, nm: f"{q}\t{flag}\tchr1\t6\t60\t{cigar}\t*\t0\t0\tACGT\t*\tNM:i:{nm}\n"
    open(sam, "w").write("@HD\tVN:1.6\n" + line("a", 65, "4M", 0) + line("a", 129, "1S3M", 3) + line("b", 65, "4M", 0) + line("b", 129, "4M", 0))
    open(none, "w").write("@HD\tVN:1.6\n")
    names = str(tmp_path / "names")
    status, rep = call(tmp_path, "decisions", "--samples", samples, "--modern-graft", graft, "--modern-host", host, "--legacy-graft", sam, "--legacy-host", none, "--names", names)
    assert status == 1 and rep["missing_score_records"] == {"modern_graft": 1} and rep["sample_size"] == 3
    assert rep["decision_pairs"] == {"modern=discarded_threshold;legacy=graft_host_absent_any_mate_below_threshold": 1, "modern=graft_host_absent_any_mate_below_threshold;legacy=graft_host_absent_any_mate_below_threshold": 1}
    assert rep["host_absent_score_transitions"] == {"modern_scores=1,2;legacy_scores=0,4": 1}
    assert text(names) == "a\nb\nc\n" and {r.qname for r in files.read_names(spark, names).collect()} == set("abc")
    open(graft, "a").write("a\t65\t1\n")
    assert cli.main(["decisions", "--samples", samples, "--modern-graft", graft, "--modern-host", host, "--legacy-graft", sam, "--legacy-host", none, "--report", str(tmp_path / "x.json")]) == 2


def test_mixture_grid_and_gradient(spark, tmp_path, write):
    truth = str(tmp_path / "truth.tsv")
    open(truth, "w").write("fragment_id\tknown_source\na\thuman\nb\thuman\nc\tmouse\n")
    path = write("t.bam", pair("a") + pair("c") + pair("q"))
    status, rep = call(tmp_path, "mixture", "--truth", truth, "--tool", f"x={path}", "--require-known")
    assert status == 1 and rep["tools"]["x"]["unknown_selected_fragments"] == 1 and rep["tools"]["x"]["sensitivity"] == 0.5
    cells = tmp_path / "cells"
    cells.mkdir()
    for name, f1 in (("t10-p8", 0.9), ("t4-p8", 0.9), ("t5-p8", 0.5)):
        (cells / f"{name}.metrics.json").write_text(json.dumps({"tools": {"modern": {"f1": f1, "sensitivity": 0.8}}}))
    status, rep = call(tmp_path, "grid", "--directory", str(cells))
    assert status == 0 and rep["grid_size"] == 3 and (rep["recommendation"]["threshold"], rep["recommendation"]["penalty"]) == (10, 8)
    expected = str(tmp_path / "expected.tsv")
    open(expected, "w").write("cell\tf1\tsensitivity\nt10-p8\t90.2\t70\nt4-p8\t89\tN/A\nt5-p8\t50\t80\n")
    args = ["--directory", str(cells), "--expected", expected]
    status, rep = call(tmp_path, "gradient", *args)
    assert status == 0 and rep["statuses"] == {"deviation": 1, "large_deviation": 1, "within_range": 3}
    assert call(tmp_path, "gradient", *args, "--fail-on-deviation")[0] == 1
    open(expected, "w").write("cell\tf1\tsensitivity\nt10-p8\t90.2\t70\n")
    assert cli.main(["gradient", *args, "--report", str(tmp_path / "g.json")]) == 2


def test_distances_of_two_engines(spark, tmp_path, write):
    original = write("o.bam", [("a", 65, 5, "4M", 1), ("a", 65, 5, "4M", 2), ("u", 4, 0, "*", 0), ("b", 65, 9, "4M", 0)])
    other = write("p.bam", [("b", 65, 9, "4M", 3), ("zz", 65, 9, "4M", 3), ("a", 65, 5, "4M", 1)])
    heads = [[c.split()[0] for c in s.split(", ")] for s in (schema.ORACLE.replace("bisulfite_nm", "free_nm"), schema.AUDIT)]
    oracle_rows = [(0, "a", 65, "chr1", 5, "4M", 1, 1, 0, 0, 0, 0, 1), (1, "a", 65, "chr1", 5, "4M", 2, 1, 0, 0, 0, 1, 1), (3, "b", 65, "chr1", 9, "4M", 0, 0, 0, 0, 0, 0, 0)]
    audit_rows = [(0, "a", 65, "chr1", 5, "4M", 1, 1, 0, 0, 1), (1, "a", 65, "chr1", 5, "4M", 2, 2, 0, 0, 2), (3, "b", 65, "chr1", 9, "4M", 0, 0, 0, 0, 0)]
    paths = [str(tmp_path / n) for n in ("oracle.tsv", "audit.tsv")]
    for p, head, rows in zip(paths, heads, (oracle_rows, audit_rows)):
        open(p, "w").write("\n".join("\t".join(map(str, r)) for r in [head, *rows]) + "\n")
    both = ["--oracle", paths[0], "--audit", paths[1], "--bisulfite-column", "free_nm"]
    status, rep = call(tmp_path, "nm-scores", *both, "--mode", "bisulfite")
    assert status == 1 and rep["difference_counts"] == {"score:bisulfite_nm": 1, "score:classification_score": 1} and rep["records_compared"] == 3
    assert (rep["first_difference"]["row_number"], rep["first_difference"]["category"], rep["first_difference"]["a"]["nm"]) == (2, "score:bisulfite_nm", 2)
    assert call(tmp_path, "nm-scores", *both, "--mode", "conventional")[0] == 0
    differences = str(tmp_path / "d")
    status, rep = call(tmp_path, "nm-reads", "--original", original, "--tool", f"p={other}", *both, "--mode", "conventional", "--limit", "4", "--differences", differences)
    assert status == 0 and rep["records_compared"] == 3 and rep["difference_counts"] == {"p:missing": 1, "p:vs_audit_nm": 1, "p:vs_oracle_bisulfite_nm": 1, "p:vs_oracle_conventional_nm": 1}
    p = rep["tools"]["p"]
    assert (p["expected"], p["observed"], p["missing"], p["identity_equals_original"], p["conventional_nm_equal"]) == (3, 2, 1, False, 1)
    assert p["delta_counts"] == {"vs_oracle_bisulfite:0": 1, "vs_oracle_bisulfite:3": 1, "vs_oracle_conventional:0": 1, "vs_oracle_conventional:3": 1}
    assert rep["first_difference"]["record_ordinal"] == 1 and not rep["audit_equals_bisulfite"] and rep["conversion_semantic_difference"] == 1
    assert [json.loads(x)["record_ordinal"] for x in text(differences).splitlines()] == [1, 3]
    open(paths[1], "a").write("9\tz\t0\tchr1\t1\t4M\t0\t0\t0\t0\t0\n")
    status, rep = call(tmp_path, "nm-scores", *both, "--mode", "conventional")
    assert status == 1 and rep["difference_counts"] == {"record_count": 1} and rep["records_compared"] == 3


def test_convert_split_and_sort(spark, tmp_path, write):
    genome = str(tmp_path / "a.fa")
    open(genome, "w").write(">chr1 cool\nacgtN\nCCgg\n")
    assert cli.main(["convert", "--input", genome, "--output", str(tmp_path / "ct"), "--kind", "CT"]) == 0
    assert text(str(tmp_path / "ct")) == ">chr1 cool\nATGTN\nTTGG\n"
    path = write("x.bam", pair("a", pos=50) + pair("b"), a="CT")
    out = str(tmp_path / "ct.bam")
    assert cli.main(["split", "--input", path, "--output", out, "--xg", "CT"]) == 0 and bam.read_bam(spark, out).count() == 2
    assert cli.main(["split", "--input", path, "--output", str(tmp_path / "ga.bam"), "--xg", "GA"]) == 2 and not [n for n in os.listdir(tmp_path) if n.startswith("ga.bam")]
    status, rep = call(tmp_path, "sort", "--input", path, "--output", str(tmp_path / "sorted"))
    assert status == 0 and rep["records"] == 4 and rep["megabytes_per_second"] > 0


def test_fasta_in_many_blocks(spark, tmp_path):
    """Tiles don't depend on the blocks in which a genome is read."""
    import random

    r = random.Random(1)
    genome = {f"c{k}": "".join(r.choice("ACGT") for _ in range(n)) for k, n in enumerate((7000, 1, 30000, 0, 64 * 16, 999))}
    path = str(tmp_path / "g.fa")
    with open(path, "w") as f:
        f.write("lost\n")
        for name, seq in genome.items():
            f.write(f">{name} more\n" + "".join(seq[i : i + 61] + "\n" for i in range(0, len(seq), 61)) + "\n")
    with gzip.open(path + ".gz", "wt") as f:
        f.write(open(path).read())
    want = {(name, k): seq[16 * k : 16 * k + 16] for name, seq in genome.items() for k in range(-(-len(seq) // 16))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, p in (("900b", path), ("100k", path), ("900b", path + ".gz")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = fasta.read_fasta(spark, p, 16).collect()
        assert len(rows) == len(want) and {(x.contig, x.tile_no): x.seq for x in rows} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
