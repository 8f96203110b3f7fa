"""Classification rules, pairs, modes, errors and summaries on small inline records."""

import pytest

from siftlane.config import Config
from siftlane.operators import fragments as f
from siftlane.plans.sample import run_samples

SCHEMA = "sample_id string, qname string, flag int, ref_id int, pos bigint, cigar string, nm bigint, nm_type string, ordinal bigint"


def records(spark, rows, sample="s"):
    full = [(sample, q, flag, ref, pos, "1M", nm, "int" if nm is not None else None, i) for i, (q, flag, ref, pos, nm) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def pairs(spark, graft, host, threshold=4, penalty=8):
    """{name: reason} of paired mates' distances: name -> (first, second), None: no record."""
    rows = [[(n, flag, 0, 0, s) for n, mates in side.items() for flag, s in zip((65, 129), mates) if s is not None] for side in (graft, host)]
    res = run_samples(records(spark, rows[0]), records(spark, rows[1]), Config(threshold, penalty))
    return {r.qname: r.reason for r in res.fragments.collect()}


def test_single_end_golden(spark):
    graft = records(spark, [("shared-graft", 0, 0, 300, 1), ("graft-only", 0, 0, 100, 0), ("shared-host", 0, 0, 200, 3)])
    host = records(spark, [("host-only", 0, 0, 400, 0), ("shared-host", 0, 0, 200, 1), ("shared-graft", 0, 0, 300, 3)])
    res = run_samples(graft, host, Config())
    s = res.summary.head()
    assert (s.total, s.graft_only, s.host_only, s.both_sides, s.graft, s.host, s.discarded, s.error) == (4, 1, 1, 2, 2, 2, 0, None)
    assert [r.qname for r in res.selected.collect()] == ["graft-only", "shared-graft"]


def test_paired_rules(spark):
    got = pairs(
        spark,
        {"mean": (3, 3), "or1": (5, 6), "or2": (6, 5), "none": (6, 6), "cut": (6, 0), "tie": (1, 1), "host": (2, 2), "mate": (1, None)},
        {"mean": (3, 4), "cut": (99, 99), "tie": (2, 0), "host": (1, 1), "mate": (1, 1), "away": (0, 0)},
        threshold=6,
    )
    assert got == {
        "mean": "graft_better_total", "or1": "graft_host_absent_any_mate_below_threshold", "or2": "graft_host_absent_any_mate_below_threshold",
        "none": "discarded_host_absent_both_mates_at_or_above_threshold", "cut": "discarded_threshold", "tie": "discarded_tie", "host": "host_better_total",
        "mate": "discarded_threshold", "away": "host_graft_absent",
    }


def test_threshold_is_exclusive(spark):
    graft = records(spark, [("a", 0, 0, 0, 3), ("b", 0, 0, 0, 4), ("c", 0, 0, 0, 0)])
    host = records(spark, [("c", 0, 0, 0, 9)])
    got = {r.qname: r.classification for r in run_samples(graft, host, Config()).fragments.collect()}
    assert got == {"a": "graft", "b": "discarded", "c": "graft"}


def test_ambiguous_pairs_and_ignored_records(spark):
    graft = records(spark, [("ok", 65, 0, 0, 0), ("ok", 129, 0, 0, 0), ("ok", 65 | 2048, 0, 0, 0), ("dup", 65, 0, 0, 0), ("dup", 65, 0, 9, 0), ("dup", 129, 0, 0, 0), ("gone", 69, 0, 0, 0), ("away", 65, -1, 0, 0)])
    host = records(spark, [("ok", 65, 0, 0, 5)])
    got = {r.qname: r.reason for r in run_samples(graft, host, Config()).fragments.collect()}
    assert got == {"ok": "graft_better_total", "dup": "discarded_ambiguous"}


@pytest.mark.parametrize(
    ("graft", "host", "error"),
    [
        ([("x", 0, 0, 0, 0), ("y", 65, 0, 0, 0)], [("x", 0, 0, 0, 0)], "graft_mixes_modes"),
        ([("x", 0, 0, 0, 0), ("x", 65, 0, 0, 0)], [("x", 0, 0, 0, 0)], "graft_fragment_mixes_modes"),
        ([("x", 65, 0, 0, 0)], [("x", 0, 0, 0, 0)], "graft_and_host_differ"),
        ([("x", 0, 0, 0, 0)], [("y", 0, 0, 0, 0)], "no_shared_names"),
        ([("x", 0, 0, 0, None)], [("x", 0, 0, 0, 0)], "missing_nm"),
    ],
)
def test_sample_errors(spark, graft, host, error):
    res = run_samples(records(spark, graft), records(spark, host), Config())
    assert res.summary.head().error == error
    assert res.selected.count() == 0


def test_errors_are_lazy_and_stay_in_their_sample(spark):
    # the host's missing tag is never read, since the graft reaches the threshold; the other sample fails
    a = records(spark, [("x", 0, 0, 0, 7), ("y", 0, 0, 0, 0)], "fine"), records(spark, [("x", 0, 0, 0, None), ("y", 0, 0, 0, 1)], "fine")
    b = records(spark, [("x", 0, 0, 0, 0)], "bad"), records(spark, [("x", 0, 0, 0, None)], "bad")
    res = run_samples(a[0].union(b[0]), a[1].union(b[1]), Config())
    assert {r.sample_id: r.error for r in res.summary.collect()} == {"fine": None, "bad": "missing_nm"}
    assert [(r.sample_id, r.qname) for r in res.selected.collect()] == [("fine", "y")]


def test_partitions_and_order_do_not_matter(spark):
    rows = [(f"r{i:04d}", 0, 0, i % 900, 1 if i % 2 == 0 else 3) for i in range(511, -1, -1)]
    other = [(n, fl, r, p, 4 - s) for n, fl, r, p, s in rows]
    seen = set()
    for n in (1, 7):
        s = run_samples(records(spark, rows).repartition(n), records(spark, other[::-1]).repartition(n), Config()).summary.head()
        seen.add((s.total, s.graft, s.host))
    assert seen == {(512, 256, 256)}


def test_one_exchange_before_the_decision(spark):
    graft, host = records(spark, [("a", 0, 0, 0, 0)]).withColumn("score", f.F.col("nm")), records(spark, [("a", 0, 0, 0, 1)]).withColumn("score", f.F.col("nm"))
    plan = f.classify_paired(f.build_fragments(f.union_sides(graft, host)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_empty_inputs(spark):
    empty = records(spark, [])
    res = run_samples(empty, empty, Config())
    assert res.fragments.count() == res.summary.count() == res.selected.count() == 0
