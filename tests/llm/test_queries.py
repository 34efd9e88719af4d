"""The registered queries: against their SQL where there is some, else that they run."""

import pytest

from versloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["block_id", "group_run"], "p2_found": ["doc_id", "line_no", "kind", "word"], "p3_found": ["field", "term", "mark"], "p4_found": ["block_id_a", "block_id_b"],
    "p5_found": ["block_id"], "p6_found": ["block_id", "kind"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, folder, duck, same_rows):
    df = QUERIES[name](spark, folder)
    assert df.columns == COLUMNS.get(name, df.columns)
    same_rows(df, duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, folder):
    df = QUERIES[name](spark, folder)
    assert df.columns == COLUMNS.get(name, df.columns)
    df.count()
