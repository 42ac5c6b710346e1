import os
import sys
import tempfile

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, TOP)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tmp).config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def text(v):
    """A value as text that is the same for both engines."""
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(text(v) for v in r) for r in zip(*(table[n].to_pylist() for n in names)))


@pytest.fixture(scope="session")
def compare(spark):
    """Compares a registered query with its SQL at a scale."""
    import duckdb

    import __spark_entry__ as entry

    every, sql = entry.queries(), entry.oracle_sql()

    def check(name, sf="sf0.001"):
        c = duckdb.connect()
        for f in os.listdir(f"{DATA}/{sf}"):
            c.execute(f"create view {f[:-8]} as select * from '{DATA}/{sf}/{f}'")
        got, want = rows(every[name](spark, f"{DATA}/{sf}").toArrow()), rows(c.sql(sql[name]).to_arrow_table())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
