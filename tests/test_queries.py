"""The registered queries: contract, plan shape, and equality with their SQL on the smallest tables."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import ROOT
from thermofleet.harness import load
from tools.check_oracle import TABLES, rows_of

# the package's own queries; those of the training-data operators have tests beside them
OWN = set(load().QUERIES)
QUERIES = {n: q for n, q in entry.queries().items() if n in OWN}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in OWN}
# These write tables, run streams or fit trees while they are built, and what they return is a scan of the result; the whole
# fit is a plan too long to be laid out without its checkpoints.
EAGER = {n for n in QUERIES if n.startswith(("stream_", "daily_"))} | {"gbt_errors", "fit_health", "effector_costs", "column_catalog", "params_taus", "params_betas", "params_gains", "run_files", "upsert_batches", "sketched_stats"}


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(SQL) == {"fit_health", "gbt_errors"}


def test_workers_import_the_package_from_anywhere(tmp_path, sf):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        f"print('rows', e.queries()['ridge_two'](spark, {sf!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 5" in out.stdout, out.stderr[-2_000:]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["horizon", "mae", "bias", "n"] and df.count() == 4


@pytest.fixture
def uncut(monkeypatch):
    """Without checkpoints a plan shows everything down to the scans, and building it starts no job."""
    for name, module in list(sys.modules.items()):
        if name.startswith("thermofleet.") and hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df: df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, sf, name, uncut):
    """No window over a whole table in one task, no product of tables, no row-at-a-time Python."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for spec in re.findall(r"windowspecdefinition\(([^,]*),", plan):
        assert " ASC" not in spec and " DESC" not in spec, f"window without partition: {spec}"
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_rank_limits_are_applied_before_the_shuffle(spark, sf):
    for name in ("topk_plans", "tail_history", "around_k", "cheapest_plan"):
        assert "WindowGroupLimit" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_reaches_the_scan(spark, sf):
    plan = QUERIES["status"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


CHECKED = """fill_accuracy round5_dedup change_only asof_backward nearest_tol grid_ffill interp_limit lag_bins gap_sessions
state_spans schedule_join comfort_stats comfort_cost plan_expansion regulating_options additive_score baseline_vs_change
outcome_backfill comfort_report health_alerts cooldown_scan override_class ridge_two tau_grid_fit envelope stream_change_only
stream_sessions bootstrap_cv sketched_stats site_bundles upsert_batches effector_costs""".split()


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
