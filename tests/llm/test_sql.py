"""Registered queries against their SQL."""

import duckdb
import pytest

from upliftlens.llm.oracle import ORACLE
from upliftlens.llm.queries import QUERIES


def normal(names, records):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, cursor.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
