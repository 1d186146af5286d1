import pytest

from checks.compare import database, rows_of
from govlens.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_spark_and_sql_agree(spark, name):
    df = QUERIES[name](spark, SMALL)
    cursor = database(SMALL).execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
