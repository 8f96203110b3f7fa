"""Larger tables give one number to several reads: the comparisons still say what their SQL says."""

import duckdb
import pytest

from siftlane.operators import evaluate as e
from siftlane.plans import catalog, oracle


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """Reads of 60 parts and 4 suppliers, three quarters of whose numbers belong to two reads."""
    sf = tmp_path_factory.mktemp("repeated")
    duckdb.connect().execute(f"copy (select p.i l_partkey, s.i * 1000 + 7 + (p.i + s.i) % 5 l_suppkey from range(60) p(i), range(4) s(i)) to '{sf}/lineitem.parquet' (format parquet)")
    return str(sf)


@pytest.mark.parametrize("name", ["q27_positional_compare", "q41_audit_categories", "q51_tool_counts", "q52_tool_deltas"])
def test_same_as_sql(spark, table, name):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{table}/lineitem.parquet'")
    numbers = c.execute("select count(*), count(distinct l_partkey * 1000 + l_suppkey) from lineitem").fetchone()
    assert numbers[0] > numbers[1]
    found = c.execute(oracle.SQL[name])
    names = [x[0] for x in found.description]
    want = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, table).select(*names).collect()) == want


def test_first_difference_in_one_pass(spark, table):
    """The tables are joined once, and nothing is computed for an end; distances aren't taken base by base."""
    plan = catalog.q53_first_difference(spark, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "sequence(" not in plan


def test_all_fields_are_compared_unless_told(spark):
    rows = spark.sql("select 1L row_number, 1L record_ordinal, 'a' qname, 0 flag, 'c' reference, 5L position_0_based, '4M' cigar, 0L bisulfite_nm, 0L nm, 0L insertions, 0L soft_clips, 0L classification_score")
    other = rows.selectExpr("* except (qname, soft_clips)", "'b' qname", "1L soft_clips")
    kinds = lambda **k: {r.category for r in e.positional_compare(rows, other, **k).collect()}
    assert kinds() == {"identity:qname", "score:soft_clips"} and kinds(**catalog.PLANTED) == set()


def test_tools_are_compared_without_an_audit(spark):
    """Two records of one number: each is one of the oracle's, and meets the tool's record of its own identity."""
    rows = spark.sql("select 1L record_ordinal, x.* from values ('a', 0, 'c', 5L, '4M', 1L, 1L), ('b', 0, 'c', 6L, '4M', 3L, 2L) x(qname, flag, reference, position_0_based, cigar, conventional_nm, bisulfite_nm)")
    tool = rows.selectExpr("record_ordinal as ordinal", *e.IDENTITY, "conventional_nm as stored_nm")
    found = e.nm_evidence(None, rows, None, tool=tool)
    assert {(r.delta, r.n) for r in e.nm_deltas(found, "tool").collect()} == {("vs_oracle_conventional:0", 2), ("vs_oracle_bisulfite:0", 1), ("vs_oracle_bisulfite:1", 1)}
    assert {tuple(r.categories) for r in found.collect()} == {(), ("tool:vs_oracle_bisulfite_nm",)}
