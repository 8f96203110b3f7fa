"""Edit distances, CIGARs, conversions, configuration and names."""

import pytest
from pyspark.sql import functions as F

from siftlane import config as c
from siftlane.functions import score, text

CASES = [
    ("ATGT", "ACGT", "4M", "CT", 0), ("T", "C", "1M", "CT", 0), ("A", "G", "1M", "CT", 1), ("A", "G", "1X", "GA", 0), ("T", "C", "1X", "GA", 1),
    ("TAACC", "AACCGGTT", "1S2M1I1M", None, 1), ("ACGT", "acgt", "4=", None, 0), ("ACGT", "ACGT", "5H4M", None, 0), ("ACGT", "ACTTGT", "2M2D2M", None, 2), ("ACGT", "ACTTGT", "2M2N2M", None, 0), ("NCGT", "ACGT", "4M", None, 1),
]


def test_edit_distances(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(CASES)], "i int, seq string, window string, cigar string, conv string, want int")
    df = df.withColumn("nm", F.when(F.col("conv").isNull(), score.edit_distance("seq", "window", score.parsed_cigar())).otherwise(score.edit_distance("seq", "window", score.parsed_cigar(), F.col("conv"))))
    bad = [r for r in df.collect() if r.nm != r.want]
    assert not bad


def test_spans_and_errors(spark):
    rows = [("1S2M1I1M", "TAACC", "AACC", None), ("4M", "ACG", "ACGT", "beyond_read"), ("4M", "ACGT", "AC", "beyond_reference"), ("2M", "ACGT", "ACGT", "unused_bases"), ("*", "A", "A", "empty_cigar"), ("3I", "AAA", "A", "no_reference_bases"), ("0M", "A", "A", "invalid_length"), ("2Q", "A", "A", "unsupported_operation"), ("4M", "", "ACGT", "empty_sequence"), ("4M", "ACGT", None, "reference_not_found")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cigar string, seq string, window string, want string").withColumns({"flag": F.lit(0), "ref_id": F.lit(0), "pos": F.lit(0)})
    got = df.select("i", "want", score.reference_error().alias("e"), score.insertions().alias("ins"), score.soft_clips().alias("soft"), score.reference_span().alias("span"), score.cigar_text(score.parsed_cigar()).alias("back")).orderBy("i").collect()
    assert [r.e for r in got] == [r.want for r in got]
    assert (got[0].ins, got[0].soft, got[0].span, got[0].back) == (1, 1, 3, "1S2M1I1M")


def test_conversion_context(spark):
    df = spark.createDataFrame([("CT", 16), ("GA", 0), (None, 0), (None, 16), ("XX", 16)], "xg string, flag int")
    assert [r[0] for r in df.select(score.conversion()).collect()] == ["CT", "GA", "CT", "GA", "GA"]


def test_text_functions(spark):
    row = spark.range(1).select(text.tsv_escape(F.lit("a\tb\nc\rd")).alias("t"), text.convert_bases(F.lit("acgN"), "CT").alias("ct"), text.convert_bases(F.lit(">acg"), "GA").alias("h"), text.other_name(F.lit("chr1")).alias("a"), text.other_name(F.lit("1")).alias("b"), text.deviation_status(F.lit(0.5)).alias("s"), text.deviation_status(F.lit(-2.1)).alias("l")).head()
    assert tuple(row) == ("a\\tb\\nc\\rd", "ATGN", ">acg", "1", "chr1", "within_range", "large_deviation")


def test_blake2b_key(spark):
    import hashlib

    got = spark.createDataFrame([("a",), (None,)], "x string").select(text.blake2b_key("seed")("x")).collect()
    assert [r[0] for r in got] == [hashlib.blake2b(b"seed\0a", digest_size=16).hexdigest(), None]


def test_config():
    for bad in ({"threshold": -1}, {"unmapped_penalty": -1}, {"nm_tag": ""}, {"mode": "recompute", "graft_reference": "a"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            c.Config(**bad)
    assert c.parse_memory("512m") == 512 << 20 and c.parse_memory("1G") == 1 << 30
    for bad in ("", "M", "-5G", "4M", "x"):
        with pytest.raises(ValueError):
            c.parse_memory(bad)
    assert [c.workers_for(256 << 20, n) for n in (0, 1, 4, 32, 1000)] == [(1, 256 << 20), (1, 256 << 20), (4, 64 << 20), (32, 8 << 20), (32, 8 << 20)]


def test_output_names(tmp_path):
    assert c.output_name("/x/a.bam") == "a_Filtered.bam" and c.output_name("a.bam", "b") == "b.bam"
    for bad in ("", "/abs.bam", "../up.bam"):
        with pytest.raises(ValueError):
            c.output_path(str(tmp_path), bad)
    with pytest.raises(ValueError):
        c.check_outputs(str(tmp_path), ["a.bam", "./a.bam"])
    with pytest.raises(ValueError):
        c.pair_samples(["a"], [])
