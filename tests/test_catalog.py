"""Every catalogue query against its SQL, or for its rows where it has none."""

import duckdb
import pytest

from oracle import compare
from tideline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, name):
    n, differences = compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
    assert n and not differences


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("s_rows", "n"), [(0, 3), (4999, 3), (5000, 0), (5600, 0)])
def test_too_few_neighbours_on_both_sides_of_k(spark, tmp_path, s_rows, n):
    ids = [0, 5, 10, *[i for i in range(1, 7500) if i % 5][:s_rows]]
    assert len(ids) == 3 + s_rows
    vectors = spark.createDataFrame([(i, [float((i * j) % 17) / 10 for j in range(1, 65)], i % 10) for i in ids], "vec_id bigint, embedding array<float>, label int")
    vectors.write.parquet(f"{tmp_path}/parts")
    duckdb.sql(f"COPY (SELECT * FROM '{tmp_path}/parts/*.parquet') TO '{tmp_path}/embeddings.parquet'")
    name = "knn_too_few_neighbours"
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], str(tmp_path)) == (n, [])
