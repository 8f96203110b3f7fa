"""Evaluation: membership of selections, shapes of alignments, decisions, metrics against truth, comparisons of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.functions.score import is_first, is_second, safe_ratio
from siftlane.functions.text import deviation_status


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("bigint")


def name_flags(original: DataFrame, modern: DataFrame, legacy: DataFrame) -> DataFrame:
    """One row for each name (qname) of three tables: is_original, is_modern, is_legacy."""
    names = ("is_original", "is_modern", "is_legacy")
    rows = None
    for own, df in zip(names, (original, modern, legacy), strict=True):
        part = df.select("qname", *[F.lit(n == own).alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    return merge_flags(rows)


def merge_flags(rows: DataFrame) -> DataFrame:
    """One row for each name: each flag that holds in one of its rows."""
    return rows.groupBy("qname").agg(*[F.bool_or(n).alias(n) for n in ("is_original", "is_modern", "is_legacy")])


def _class(flag: str) -> Column:
    return F.when(F.col(flag), "graft").otherwise("discarded")


def membership_of(flags: DataFrame) -> DataFrame:
    """fragment_id, modern_classification and legacy_classification (graft or discarded) of each original name of merge_flags()."""
    return flags.where("is_original").select(F.col("qname").alias("fragment_id"), *[_class(f"is_{t}").alias(f"{t}_classification") for t in ("modern", "legacy")])


def membership(original: DataFrame, modern: DataFrame, legacy: DataFrame) -> DataFrame:
    return membership_of(name_flags(original, modern, legacy))


def membership_counts_of(flags: DataFrame) -> DataFrame:
    """category and n: each pair of classes (modern/legacy), and each tool's selections that are not in the original (also where there are none)."""
    lost = {t: F.lit(f"{t}_selected_not_in_original") for t in ("modern", "legacy")}
    found = F.when(F.col("is_original"), F.array(F.concat_ws("/", _class("is_modern"), _class("is_legacy")))).otherwise(F.array_compact(F.array(*[F.when(F.col(f"is_{t}"), name) for t, name in lost.items()])))
    rows = flags.select(F.explode(found).alias("category"), F.lit(1).alias("n"))
    none = flags.sparkSession.range(1).select(F.explode(F.array(*lost.values())).alias("category"), F.lit(0).alias("n"))
    return rows.unionByName(none).groupBy("category").agg(F.sum("n").cast("bigint").alias("n"))


def membership_counts(original: DataFrame, modern: DataFrame, legacy: DataFrame) -> DataFrame:
    return membership_counts_of(name_flags(original, modern, legacy))


def disagreements(members: DataFrame) -> DataFrame:
    return members.where("modern_classification <> legacy_classification")


def sample_disagreements(rows: DataFrame, wanted: str, size: int, key: Column) -> DataFrame:
    """Of disagreements (fragment_id and both classifications) those of one kind, as modern/legacy; and of these the `size` with the smallest keys."""
    return deterministic_sample(rows.where(F.concat_ws("/", "modern_classification", "legacy_classification") == wanted), size, key, "fragment_id")


def deterministic_sample(df: DataFrame, size: int, key: Column, *ties: str) -> DataFrame:
    """The rows with the `size` smallest keys: kept by a bounded heap in each task."""
    if size <= 0:
        raise ValueError("a sample needs a positive size")
    return df.withColumn("sample_key", key).orderBy("sample_key", *ties).limit(size)


PROFILE = ("total_records", "paired_records", "unmapped_records", "secondary_records", "supplementary_records", "mapped_primary_records", "first_mate_primary_records", "second_mate_primary_records", "invalid_primary_mate_records")


def profile_counts(own: Column | None = None, prefix: str = "") -> list[Column]:
    """The nine counts of a group's records, or of those for which own holds."""
    flag = F.col("flag")
    bit = lambda b: flag.bitwiseAND(b) != 0
    primary = flag.bitwiseAND(0x904) == 0
    tests = (F.lit(True), bit(0x1), bit(0x4), bit(0x100), bit(0x800), primary, primary & is_first(), primary & is_second(), primary & ~is_first() & ~is_second())
    return [_n(t if own is None else own & t).alias(prefix + name) for name, t in zip(PROFILE, tests, strict=True)]


def alignment_profile(records: DataFrame, *by: str) -> DataFrame:
    """Nine counts for each fragment (and the columns in by), and the category of its shape."""
    return records.groupBy(*by, "qname").agg(*profile_counts()).withColumn("category", shape_category())


def shape_category(prefix: str = "") -> Column:
    c = lambda name: F.col(f"{prefix}{name}_records")
    first, second = c("first_mate_primary"), c("second_mate_primary")
    return (
        F.when(c("mapped_primary") == 0, "none")
        .when(c("invalid_primary_mate") > 0, "invalid_mate_flag")
        .when((first > 1) | (second > 1), "duplicate_primary_mate")
        .when((first == 1) & (second == 1), "complete_pair")
        .when(first == 1, "first_mate_only")
        .when(second == 1, "second_mate_only")
        .otherwise("unpaired_primary")
    )


def stratify(sample: DataFrame, **inputs: DataFrame) -> DataFrame:
    """For each name of sample (qname): <input>_category and <input>_primary_records in each input.

    Sample and inputs are put under one another and aggregated once by name.
    """
    rows = sample.select("qname", F.lit(None).cast("int").alias("flag"), F.lit(None).cast("string").alias("input"))
    for name, df in inputs.items():
        rows = rows.unionByName(df.select("qname", F.col("flag").cast("int").alias("flag"), F.lit(name).alias("input")))
    return shapes_of(rows, {name: F.col("input") == name for name in inputs}, F.bool_or(F.col("input").isNull()))


def shapes_of(rows: DataFrame, inputs: dict[str, Column], asked: Column | None = None) -> DataFrame:
    """For each name of rows (qname, flag): <input>_category and <input>_primary_records, where a condition tells an input's records; asked: an aggregate that holds for the names to keep."""
    counts = [c for name, own in inputs.items() for c in profile_counts(own, f"{name}_")]
    out = rows.groupBy("qname").agg((F.lit(True) if asked is None else asked).alias("asked"), *counts).where("asked")
    return out.select("qname", *[c for name in inputs for c in (shape_category(f"{name}_").alias(f"{name}_category"), F.col(f"{name}_mapped_primary_records").alias(f"{name}_primary_records"))])


def crosstabs(shapes: DataFrame) -> DataFrame:
    """counter, value and n of the six cross-tabs of stratify()'s four inputs, in one pass."""
    c = lambda n: F.col(f"{n}_category")
    pair = lambda a, b, x, y: F.concat(F.lit(f"{a}="), c(x), F.lit(f";{b}="), c(y))
    cells = [
        *((n, c(n)) for n in ("original_graft", "original_host", "modern_filtered", "legacy_filtered")),
        ("joint_original_alignment_shape", pair("graft", "host", "original_graft", "original_host")),
        ("output_membership", pair("modern", "legacy", "modern_filtered", "legacy_filtered")),
    ]
    rows = shapes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), v.alias("value")) for n, v in cells])).alias("x"))
    return rows.groupBy("x.counter", "x.value").agg(F.count("*").cast("bigint").alias("n"))


def decision_pairs(modern: DataFrame, legacy: DataFrame) -> DataFrame:
    """decision_pair and n for two classified tables of one sample (qname, reason)."""
    both = modern.select("qname", F.col("reason").alias("m")).join(legacy.select("qname", F.col("reason").alias("l")), "qname")
    return decision_counts(both, F.col("m"), F.col("l"))


def decision_counts(rows: DataFrame, modern: Column, legacy: Column) -> DataFrame:
    """decision_pair and n, where both reasons come from one row."""
    return rows.groupBy(F.concat(F.lit("modern="), modern, F.lit(";legacy="), legacy).alias("decision_pair")).agg(F.count("*").cast("bigint").alias("n"))


def host_absent_transitions(modern: DataFrame, legacy: DataFrame) -> DataFrame:
    """transition and n, for fragments without host scores: tables of (qname, first, second, host_absent). Reports list them by falling n, then name."""
    side = lambda df, t: df.where("host_absent").select("qname", F.struct("first", "second").alias(t))
    both = side(modern, "m").join(side(legacy, "l"), "qname")
    return transition_counts(both, (F.col("m.first"), F.col("m.second")), (F.col("l.first"), F.col("l.second")))


def transition_counts(rows: DataFrame, modern: tuple[Column, Column], legacy: tuple[Column, Column]) -> DataFrame:
    """transition and n, where the mates' scores of both tools come from one row."""
    text = lambda t, x: F.concat(F.lit(f"{t}_scores="), x[0].cast("string"), F.lit(","), x[1].cast("string"))
    return rows.groupBy(F.concat(text("modern", modern), F.lit(";"), text("legacy", legacy)).alias("transition")).agg(F.count("*").cast("bigint").alias("n"))


def confusion(truth: DataFrame, selected: DataFrame, graft: str = "human", *by: str) -> DataFrame:
    """tp, fn, fp, tn of selections (fragment_id) against truth (fragment_id, known_source), for each group in by."""
    hit = selected.select(*by, "fragment_id").distinct().withColumn("hit", F.lit(True))
    rows = truth.join(hit, [*by, "fragment_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    own = F.col("known_source") == graft
    return rows.groupBy(*by).agg(_n(own & F.col("hit")).alias("tp"), _n(own & ~F.col("hit")).alias("fn"), _n(~own & F.col("hit")).alias("fp"), _n(~own & ~F.col("hit")).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """The rates of a confusion; null where a denominator is 0."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = counts.select(
        "*",
        safe_ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        safe_ratio(tp, tp + fn).alias("sensitivity"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tn, tn + fn).alias("npv"),
        safe_ratio(fp, tn + fp).alias("fpr"),
        safe_ratio(fn, tp + fn).alias("fnr"),
    )
    p, r = F.col("precision"), F.col("sensitivity")
    return out.withColumn("balanced_accuracy", (r + F.col("specificity")) / 2).withColumn("f1", F.when(p + r != 0, F.try_divide(2 * p * r, p + r)))


def unknown_selected(truth: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.select("fragment_id").distinct().join(truth, "fragment_id", "left_anti")


def record_counts(selected: DataFrame) -> DataFrame:
    """filtered_records and filtered_fragments."""
    return selected.agg(F.count("*").cast("bigint").alias("filtered_records"), F.count_distinct("qname").cast("bigint").alias("filtered_fragments"))


def recommend(cells: DataFrame, metric: str = "f1", label: str = "label") -> DataFrame:
    """The cell with the largest metric, the first by label among equals."""
    return cells.orderBy(F.col(metric).desc_nulls_last(), label).limit(1)


def compare_cells(observed: DataFrame, expected: DataFrame, tolerance: float = 0.5, large: float = 2.0) -> DataFrame:
    """cell, metric, observed (per cent, 4 places), expected, deviation and status; expected 'N/A' compares with nothing.

    observed: cell, metric, value (a rate); expected: cell, metric, text.
    """
    out = observed.withColumn("observed", F.round(F.col("value") * 100, 4)).join(expected.withColumn("expected", F.expr("try_cast(text as double)")), ["cell", "metric"], "left")
    out = out.withColumn("deviation", F.round(F.col("observed") - F.col("expected"), 4))
    return out.select("cell", "metric", "observed", "expected", "deviation", deviation_status(F.col("deviation"), tolerance, large).alias("status"))


def unknown_cells(observed: DataFrame, expected: DataFrame) -> DataFrame:
    return observed.select("cell").distinct().join(expected, "cell", "left_anti")


def replicate_stats(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each value, over replicates."""
    return df.groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), *[f(v).alias(f"{v}_{s}") for v in values for s, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def decompose(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """fragments, selected, not_selected, selection_rate, and mean and median of mapq, by group; needs selected (boolean) and mapq."""
    return df.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("fragments"),
        _n(F.col("selected")).alias("selected_n"),
        _n(~F.col("selected")).alias("not_selected"),
        safe_ratio(_n(F.col("selected")), F.count("*")).alias("selection_rate"),
        F.avg("mapq").alias("mapq_mean"),
        F.median("mapq").alias("mapq_median"),
    )


def with_occurrence(df: DataFrame, identity: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """The number of each record among those of its identity, from 0."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*identity).orderBy(ordinal)) - 1)


def occurrence_join(left: DataFrame, right: DataFrame, identity: Sequence[str], values: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Each left record with the values of the right record of the same identity and occurrence; matched tells if there is one."""
    keys = [*identity, "occurrence"]
    r = with_occurrence(right, identity, ordinal).select(*keys, *values, F.lit(True).alias("matched"))
    return with_occurrence(left, identity, ordinal).join(r, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


IDENTITY = ("qname", "flag", "reference", "position_0_based", "cigar")


SCORES = ("nm", "insertions", "soft_clips")


def _differences(oracle: DataFrame, audit: DataFrame, bisulfite: bool, identity: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """row_number, categories in the order in which they are looked for, and both rows (o, a); each pair of rows of one number."""
    o = oracle.select("row_number", F.struct("*").alias("o"))
    a = audit.select("row_number", F.struct("*").alias("a"))
    both = o.join(a, "row_number", "full_outer")
    differs = lambda x, y: ~F.col(f"o.{x}").eqNullSafe(F.col(f"a.{y}"))
    fields = [F.when(differs(c, c), f"identity:{c}") for c in identity]
    own = {"nm": "bisulfite_nm" if bisulfite else "conventional_nm"}
    values = [F.when(differs(own.get(y, y), y), f"score:{own.get(y, y)}") for y in scores]
    expected = F.col("o.classification_score") + (F.lit(0) if bisulfite else F.col("o.bisulfite_conversions_ignored"))
    total = F.when(~expected.eqNullSafe(F.col("a.classification_score")), "score:classification_score")
    alone = F.col("o").isNull() | F.col("a").isNull()
    found = F.when(alone, F.array(F.lit("record_count"))).otherwise(F.array_compact(F.array(F.coalesce(*fields), F.coalesce(*values), total)))
    return both.select("row_number", found.alias("categories"), "o", "a")


def positional_compare(oracle: DataFrame, audit: DataFrame, bisulfite: bool = True, identity: Sequence[str] = ("record_ordinal", *IDENTITY), scores: Sequence[str] = SCORES) -> DataFrame:
    """category, n and first_row for two tables whose rows go together by row_number.

    Of a row's identity fields the first that differs counts, and so of its score fields; the score
    itself counts besides. Where one table ends, the first row without a partner is record_count, and
    nothing after it is compared. Rows that share a number are compared pair by pair.
    """
    nm = ["bisulfite_nm"] if bisulfite else ["conventional_nm", "bisulfite_conversions_ignored"]
    rest = [c for c in scores if c != "nm"]
    o, a = oracle.select("row_number", *identity, *nm, *rest, "classification_score"), audit.select("row_number", *identity, *scores, "classification_score")
    # The end is found from the numbers alone, so nothing else is computed or sent for it.
    side = lambda df, x: df.select("row_number", F.lit(x).alias("of_o"))
    ends = side(oracle, True).unionByName(side(audit, False)).groupBy("row_number").agg(F.bool_and("of_o").alias("x"), F.bool_or("of_o").alias("y"))
    end = ends.where("x or not y").agg(F.min("row_number").alias("end"))
    rows = _differences(o, a, bisulfite, identity, scores).where(F.size("categories") > 0).select("row_number", F.explode("categories").alias("category"))
    rows = rows.crossJoin(F.broadcast(end)).where("end is null or row_number <= end")
    return rows.groupBy("category").agg(F.count("*").cast("bigint").alias("n"), F.min("row_number").cast("bigint").alias("first_row"))


def first_difference(oracle: DataFrame, audit: DataFrame, bisulfite: bool = True, identity: Sequence[str] = ("record_ordinal", *IDENTITY), scores: Sequence[str] = SCORES) -> DataFrame:
    """row_number, category and both rows (o, a) of the first difference; no row if the tables are equal.

    Of what comes after the first row without a partner nothing is first, so the end needn't be known.
    """
    rows = _differences(oracle, audit, bisulfite, identity, scores).where(F.size("categories") > 0)
    return rows.agg(F.min_by(F.struct("row_number", F.col("categories")[0].alias("category"), "o", "a"), "row_number").alias("x")).where("x is not null").select("x.*")


def delta_histogram(joined: DataFrame, label: Column, value: str, against: dict[str, str]) -> DataFrame:
    """label, delta (name:difference) and n of value minus each column of against."""
    cells = F.array(*[F.concat(F.lit(f"{name}:"), (F.col(value) - F.col(c)).cast("string")) for name, c in against.items()])
    return joined.select(label.alias("label"), F.explode(cells).alias("delta")).groupBy("label", "delta").agg(F.count("*").cast("bigint").alias("n"))


def nm_evidence(original: DataFrame | None, oracle: DataFrame, audit: DataFrame | None, bisulfite: bool = True, audited: Sequence[str] = IDENTITY, **tools: DataFrame) -> DataFrame:
    """The original records with the evidence about each: o and a, <tool>_nm and <tool>_there, and the sorted categories in which they differ.

    original: record_ordinal and the identity, or None: the oracle's rows are the records, so none is
    looked up; oracle, audit: by record_ordinal (audit None: there is no a, and tools are compared with the
    oracle); audited: the identity's fields in which oracle and audit are compared; tools: identity, ordinal
    and stored_nm. Records are numbered within their identity before evidence is joined to them.
    """
    nm = "bisulfite_nm" if bisulfite else "conventional_nm"
    out = oracle.select("record_ordinal", *IDENTITY, F.struct("*").alias("o")) if original is None else original
    if tools:
        out = with_occurrence(out, IDENTITY, "record_ordinal")
    for label, df in tools.items():
        own = with_occurrence(df.select(*IDENTITY, "ordinal", F.col("stored_nm").alias(f"{label}_nm")), IDENTITY)
        out = out.join(own.select(*IDENTITY, "occurrence", f"{label}_nm", F.lit(True).alias(f"{label}_there")), [*IDENTITY, "occurrence"], "left").withColumn(f"{label}_there", F.coalesce(f"{label}_there", F.lit(False)))
    out = out.drop("occurrence")
    if original is not None:
        out = out.join(oracle.select("record_ordinal", F.struct("*").alias("o")), "record_ordinal", "left")
    if audit is not None:
        out = out.join(audit.select("record_ordinal", F.struct("*").alias("a")), "record_ordinal", "left")
    both, found = _evident(out), []
    if audit is not None:
        found.append(F.when(~both, "audit_record_missing"))
        found += [F.when(both & ~F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")), f"audit_oracle_identity:{c}") for c in audited]
        found.append(F.when(both & (F.col("a.nm") != F.col(f"o.{nm}")), "audit_vs_oracle_selected_nm"))
    against = [("vs_oracle_conventional_nm", "o.conventional_nm"), ("vs_oracle_bisulfite_nm", "o.bisulfite_nm"), *([("vs_audit_nm", "a.nm")] if audit is not None else [])]
    for label in tools:
        there, v = F.col(f"{label}_there"), F.col(f"{label}_nm")
        found.append(F.when(~there, f"{label}:missing"))
        found += [F.when(there & both & (v != F.col(c)), f"{label}:{n}") for n, c in against]
    return out.withColumn("categories", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))))


def _evident(evidence: DataFrame) -> Column:
    """A record that the oracle knows, and the audit where there is one."""
    return F.col("o").isNotNull() & F.col("a").isNotNull() if "a" in evidence.columns else F.col("o").isNotNull()


def nm_categories(original: DataFrame | None, oracle: DataFrame, audit: DataFrame | None, bisulfite: bool = True, audited: Sequence[str] = IDENTITY, **tools: DataFrame) -> DataFrame:
    """record_ordinal and categories of the original records that differ from the evidence."""
    return nm_evidence(original, oracle, audit, bisulfite, audited, **tools).where(F.size("categories") > 0).select("record_ordinal", "categories")


def nm_tool_counts(evidence: DataFrame, *tools: str) -> DataFrame:
    """tool, expected, observed and missing records, whether the tool has just as many (identity_equals_original), and how many distances are equal to each of the oracle's."""
    both = _evident(evidence)
    cells = [F.struct(F.lit(t).alias("tool"), F.col(f"{t}_there").alias("there"), F.when(both, F.col(f"{t}_nm")).alias("v")) for t in tools]
    rows = evidence.select("o", F.explode(F.array(*cells)).alias("x"))
    equal = lambda c: _n(F.col("x.v") == F.col(f"o.{c}")).alias(f"{c}_equal")
    out = rows.groupBy(F.col("x.tool").alias("tool")).agg(F.count("*").cast("bigint").alias("expected"), _n(F.col("x.there")).alias("observed"), equal("conventional_nm"), equal("bisulfite_nm"))
    return out.withColumn("missing", F.col("expected") - F.col("observed")).withColumn("identity_equals_original", F.col("missing") == 0)


def nm_deltas(evidence: DataFrame, *tools: str) -> DataFrame:
    """tool, delta (against:difference) and n of the tools' distances minus the oracle's."""
    both = _evident(evidence)
    cells = [F.when(both & F.col(f"{t}_there"), F.struct(F.lit(t).alias("tool"), F.concat(F.lit(f"vs_oracle_{k}:"), (F.col(f"{t}_nm") - F.col(f"o.{k}_nm")).cast("string")).alias("delta"))) for t in tools for k in ("conventional", "bisulfite")]
    return evidence.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.tool", "x.delta").agg(F.count("*").cast("bigint").alias("n"))


def same_selection(a: DataFrame, b: DataFrame, key: str = "qname") -> DataFrame:
    """One row: in_both, only_in_first and only_in_second names, and whether the selections are equal."""
    tag = lambda df, x, y: df.select(key, F.lit(x).alias("x"), F.lit(y).alias("y"))
    rows = tag(a, True, False).unionByName(tag(b, False, True)).groupBy(key).agg(F.bool_or("x").alias("x"), F.bool_or("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.agg(_n(x & y).alias("in_both"), _n(x & ~y).alias("only_in_first"), _n(~x & y).alias("only_in_second")).withColumn("equal", (F.col("only_in_first") == 0) & (F.col("only_in_second") == 0))


def status_tally(cells: DataFrame) -> DataFrame:
    """outcome and n of the three statuses, those that don't occur too."""
    rows = cells.where("status is not null").select(F.col("status").alias("outcome"), F.lit(1).alias("n"))
    none = cells.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("within_range", "deviation", "large_deviation")))).alias("outcome"), F.lit(0).alias("n"))
    return rows.unionByName(none).groupBy("outcome").agg(F.sum("n").cast("bigint").alias("n"))
