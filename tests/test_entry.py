"""Driver contract: entry(), queries() and oracle_sql() agree with each other."""

import sys
import os

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_mod  # noqa: E402

from .oracle import duck  # noqa: E402


def test_entry_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    q, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 30
    con = duck(entry_mod.SMOKE_SF)
    cols = [d[0] for d in con.execute(sql["avg_rents"]).description]
    assert sorted(cols) == sorted(df.columns)


def test_sessions_generate_no_method_too_long_to_compile(spark):
    from leasegrid.session import prepare_session

    limit, was = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    for given, wanted in (("65535", "8000"), ("4000", "4000")):
        spark.conf.set(limit, given)
        prepare_session(spark)
        assert spark.conf.get(limit) == wanted
    spark.conf.set(limit, was)
