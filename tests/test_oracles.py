"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from marlstone.plans import queries as core
from tests.oracle import canonical, connection, kind


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, data, duck, name):
    df, relation = core.QUERIES[name](spark, data), duck.sql(core.SQL[name])
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema} == {c: kind(str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    ours, theirs = df.toPandas(), relation.df()
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.SQL.keys()))
def test_runs_without_sql(spark, data, name):
    df = core.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
