"""Reports on returns as they are, losses of everything included."""
import duckdb
import pytest
from pyspark.sql import functions as F
from test_registry import SF, load_compare

import __spark_entry__ as entry
from barloom.operators import economics as ec


@pytest.mark.parametrize("name", ["position_pnl", "performance_report", "kelly_summary"])
def test_unscaled_query_equals_sql(spark, name):
    tool = load_compare()
    con = duckdb.connect()
    for table in tool.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) and tool.compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_a_loss_of_everything_stays_lost(spark):
    rows = [("a", i, 1.0, r, 0.1) for i, r in enumerate([0.5, -1.5, 2.0])] + [("b", i, 1.0, r, 0.1) for i, r in enumerate([0.5, -0.5, 1.0])]
    series = spark.createDataFrame(rows, "asset string, pos bigint, position double, strat_ret double, ret_1d double")
    out = {r.asset: r for r in ec.performance_report(series, ["asset"], F.lit(365)).collect()}
    assert (out["a"].total_return, out["a"].max_drawdown) == (-1.0, -1.0)
    assert out["b"].total_return == pytest.approx(0.5) and out["b"].max_drawdown == pytest.approx(-0.5)
    assert out["b"].alpha == pytest.approx(0.5 - (1.1 ** 3 - 1))
