"""Queries over all of their data, next to SQL that leaves nothing out either."""
import duckdb
import pytest
from test_registry import SF, load_compare

import __spark_entry__ as entry
from barloom.operators import signals as sg

WHOLE = ["signal_registry", "attach_funding", "attach_imbalance_default", "triangle_edges",
         "triangle_summary"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_equals_sql(spark, name):
    tool = load_compare()
    con = duckdb.connect()
    for table in tool.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) and tool.compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_rule_fires(spark):
    rows = entry.queries()["signal_registry"](spark, "/root/testdata/sf0.01")
    assert {r.signal for r in rows.select("signal").distinct().collect()} == set(sg.RULES)


def test_no_charge_day_is_stale(spark):
    from barloom.sources import tables as t

    rows = entry.queries()["attach_funding"](spark, SF)
    charged = t.funding(spark, SF).withColumnRenamed("funding_rate", "charge")
    assert rows.join(charged, ["asset", "ts"]).filter("NOT funding_rate <=> charge").count() == 0


def test_every_event_type_is_a_leg(spark):
    from pyspark.sql import functions as F

    from barloom.catalog import pairs
    from barloom.sources import tables as t

    highest = t.table(spark, SF, "events").agg(F.max("value") + 1).first()[0]
    price = F.when(F.col("leg") == "ac", F.sqrt("price")).otherwise(F.col("price"))
    assert abs(pairs.all_legs(spark, SF).agg(F.max(price)).first()[0] - highest) < 1e-9
    hours = t.table(spark, SF, "events").select(F.date_trunc("hour", "ts")).distinct().count()
    assert pairs.all_legs(spark, SF).select("snapshot").distinct().count() == hours
