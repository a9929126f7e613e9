"""Registered queries beside their SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMED = [n for n in entry.oracle_sql() if n.startswith("op")]


@pytest.mark.parametrize("name", NAMED)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
