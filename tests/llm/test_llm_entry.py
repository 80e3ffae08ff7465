"""Every training-data query runs on the smallest tables with the columns asked for."""

import pytest

from lexmill.llm import queries

COLUMNS = {"p2_found": {"field", "term", "band"}, "p4_found": {"src_table", "row_key", "sent_start", "sent_end"}, "p5_found": {"kind", "name_a", "name_b"}, "p6_found": {"doc_id", "line_no"}, "p7_found": {"doc_id", "item_id"}, "p9_found": {"doc_id"}}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and len(rows) == len(set(map(tuple, rows)))
