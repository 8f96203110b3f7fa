"""The two engines' records are compared over the whole table; missing ones are told by the operators."""

import os

import duckdb
import pytest

from siftlane.operators import evaluate as e
from siftlane.plans import catalog, oracle

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ["q27_positional_compare", "q41_audit_categories"])
def test_whole_tables_are_compared(spark, name):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    found = c.execute(oracle.SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(r) for r in found.fetchall())
    got = sorted(repr(tuple(r)) for r in getattr(catalog, name)(spark, SF).select(*names).collect())
    assert got == want and not any("record_" in x for x in got)


def test_missing_records(spark):
    """Rows 7 and 20 are missing: the first ends the comparison by position, both are told by category."""
    keys = [f"cast(id as {t}) as {n}" for t, n in (("bigint", "row_number"), ("bigint", "record_ordinal"), ("string", "qname"), ("int", "flag"), ("string", "reference"), ("bigint", "position_0_based"), ("string", "cigar"))]
    rows = spark.range(30)
    oracle_rows = rows.selectExpr(*keys, "1L as conventional_nm", "1L as bisulfite_nm", "0L as insertions", "0L as soft_clips", "0L as bisulfite_conversions_ignored", "1L as classification_score")
    audit = rows.where("id not in (7, 20)").selectExpr(*keys, "case when id in (3, 25) then 2L else 1L end as nm", "0L as insertions", "0L as soft_clips", "1L as classification_score")
    got = {tuple(r) for r in e.positional_compare(oracle_rows, audit).collect()}
    assert got == {("record_count", 1, 7), ("score:bisulfite_nm", 1, 3)}
    found = e.nm_categories(oracle_rows.select("record_ordinal", *e.IDENTITY), oracle_rows, audit)
    by = {r.record_ordinal: r.categories for r in found.collect()}
    assert by == {3: ["audit_vs_oracle_selected_nm"], 7: ["audit_record_missing"], 20: ["audit_record_missing"], 25: ["audit_vs_oracle_selected_nm"]}
