"""Registry contract, and a sample of queries against their SQL on the smallest tables."""
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.catalog import ENTRIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["feature_rsi", "signal_registry", "triple_barrier_labels", "book_backtest", "fifo_round_trips",
          "order_lifecycle", "merge_bars_report", "attach_as_of"]


def load_compare():
    spec = importlib.util.spec_from_file_location("compare_tool", os.path.join(ROOT, "tools", "compare.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The catalog's own queries; the training-data part, where present, states its tests itself.
    assert sum(e.sql is None for e in ENTRIES.values()) <= 8


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "asset" and rows.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    tool = load_compare()
    con = duckdb.connect()
    for table in tool.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert tool.compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""
