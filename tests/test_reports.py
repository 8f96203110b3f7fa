"""Reports and gates on small tables."""

import json

import pytest

from siftlane.plans import reports as r
from siftlane.sources import bam


def names(spark, *q):
    return spark.createDataFrame([(x,) for x in q], "qname string")


def test_membership_and_gate(spark):
    rep = r.membership_report(names(spark, "a", "b", "c", "c"), names(spark, "a", "b", "z"), names(spark, "a"))
    assert rep["original_fragments"] == 3
    assert rep["categories"] == {"discarded/discarded": 1, "graft/discarded": 1, "graft/graft": 1, "legacy_selected_not_in_original": 0, "modern_selected_not_in_original": 1}
    assert r.only_in_modern(r.e.membership(names(spark, "a", "b"), names(spark, "a"), names(spark))) and not r.only_in_modern(r.e.membership(names(spark, "a"), names(spark), names(spark, "a")))


def test_mixture(spark, tmp_path):
    truth = spark.createDataFrame([("a", "human"), ("b", "human"), ("c", "mouse"), ("d", "mouse")], "fragment_id string, known_source string")
    rep = r.mixture_report(truth, {"x": names(spark, "a", "a", "c", "q"), "none": names(spark)})
    x, none = rep["tools"]["x"], rep["tools"]["none"]
    assert (x["tp"], x["fn"], x["fp"], x["tn"], x["filtered_records"], x["filtered_fragments"], x["unknown_selected_fragments"]) == (1, 1, 1, 1, 4, 3, 1)
    assert none["precision"] is None and none["f1"] is None and none["accuracy"] == 0.5
    assert r.passes(rep) and not r.passes(rep, unknown=True)
    r.write_report(rep, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["graft_source"] == "human"


def test_gradient(spark):
    observed = spark.createDataFrame([("c1", "recall", 0.5), ("c1", "ppv", 0.9), ("c2", "recall", 0.51)], "cell string, metric string, value double")
    expected = spark.createDataFrame([("c1", "recall", "50.5"), ("c1", "ppv", "N/A"), ("c2", "recall", "48.9")], "cell string, metric string, text string")
    rep = r.gradient_report(observed, expected)
    assert rep["statuses"] == {"large_deviation": 1, "within_range": 1} and not r.passes(rep, deviations=True)
    with pytest.raises(ValueError, match="c2"):
        r.gradient_report(observed, expected.where("cell = 'c1'"))


def test_sort_benchmark(spark, tmp_path):
    head = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n"
    rows = spark.createDataFrame([(f"r{i}", 0, 0, (i * 37) % 500, "1M", "A") for i in range(300)], "qname string, flag int, ref_id int, pos bigint, cigar string, seq string")
    bam.write_bam(rows.coalesce(1), str(tmp_path / "u.bam"), head)
    assert not bam.is_sorted(str(tmp_path / "u.bam"))
    rep = r.sort_benchmark(spark, str(tmp_path / "u.bam"), str(tmp_path / "s"), head)
    assert rep["records"] == 300
