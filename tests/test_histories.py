"""First and last change of files, from tables made here."""

import datetime

from lodebook.plans.catalogue import histories


def test_first_last_seen(spark, tmp_path):
    """Rows that stand twice and orders without an author count as before; tasks follow the lines, not a setting."""
    day = datetime.datetime(2020, 1, 1)
    orders = [(1, 7, day), (1, 7, day), (2, 7, day + datetime.timedelta(5)), (3, None, day + datetime.timedelta(2)), (4, 8, None), (None, 9, day)]
    lines = [(1, 100), (1, 100), (2, 100), (3, 100), (4, 200), (2, None), (None, 100), (9, 300), (1, 200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = histories.first_last_seen(spark, str(tmp_path))
    at = datetime.date(2020, 1, 1)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, [
        (100, 3, 1, at, at + datetime.timedelta(5)), (200, 2, 2, at, at), (None, 1, 1, at + datetime.timedelta(5), at + datetime.timedelta(5))]))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
