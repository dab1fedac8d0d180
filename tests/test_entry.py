"""The contract of __spark_entry__, in a process without a session."""

import subprocess
import sys


def test_queries_and_sql_load_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 250"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["level", "group_id", "yr", "q", "lag_28", "m7"] and df.count() > 0
