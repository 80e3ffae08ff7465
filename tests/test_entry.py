"""Every registered core query runs on the smallest tables with a stable schema."""

import pytest

from lexmill.plans import registry


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"classifier_report", "pagerank", "rank_full"}))
def test_query_runs(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()
