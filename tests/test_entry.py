import os
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from limnos.catalog import REGISTRY  # noqa: E402
from limnos.catalog.tables import TABLES  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402
from tools.check_oracles import digest  # noqa: E402

BAD_NODES = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["logger_sn", "date", "min", "mean", "max", "date_time"]
    assert df.count() > 0


def test_every_query_has_a_name_and_most_an_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(REGISTRY) <= set(q)
    assert len(set(o) & set(REGISTRY)) >= len(REGISTRY) - 3


def test_entry_works_without_the_optional_operators():
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('limnos.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.parametrize("name", ["station_master", "logger_status", "landcover_shares",
                                  "station_watersheds", "tp_final", "baseline_final"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sp = entry.queries()[name](spark, SF_SMALL)
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert not any(b in plan for b in BAD_NODES), name
    got = sp.toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got)[1] == digest(want)[1]


def test_no_forbidden_plan_nodes_in_any_query(spark):
    # whole plans: no intermediate table hides what stands before it
    spark.conf.set("spark.limnos.materialize", "false")
    bad, scans = [], 0
    try:
        for name, (fn, _) in REGISTRY.items():
            plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            bad += [f"{name}: {b}" for b in BAD_NODES if b in plan]
            scans += "FileScan" in plan or "Scan parquet" in plan
    finally:
        spark.conf.unset("spark.limnos.materialize")
    assert not bad, bad
    assert scans > 0.9 * len(REGISTRY)
