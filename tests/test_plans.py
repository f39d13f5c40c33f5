"""Physical plans: what must not and what must be in them."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from gridledger import specs
from gridledger.operators import agents, delta
from gridledger.sources import star, tables
from workload import registry

# Queries that load stores run jobs while they are built; their plans are those of the reads.
LAZY = [
    n for n, q in registry.QUERIES.items() if q.__module__ not in ("workload.jobs", "workload.feeds")
]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, sf_dir, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "ExistingRDD"):
        assert node not in plan or (node == "ExistingRDD" and name == "resolve_feed"), node


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(entry.queries()["nop_summary"](spark, sf_dir))
    line = next(p for p in plan.split("\n") if "lineitem.parquet" in p)
    assert "l_tax" not in line and "l_extendedprice" in line


def test_rank_limits_run_before_the_shuffle(spark, sf_dir):
    plan = plan_of(
        agents.recent_logs(star.question_logs(spark, sf_dir), star.agents(spark, sf_dir))
    )
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_cube_scans_once(spark, sf_dir):
    plan = plan_of(entry.queries()["build_cube"](spark, sf_dir))
    assert plan.count("lineitem.parquet") == 1 and "Expand" in plan


def test_known_dates_prune_and_scan_once(spark, sf_dir, tmp_path):
    path = str(tmp_path / "store" / "positions")
    rows = star.power_positions(spark, sf_dir).limit(500)
    tables.append_raw(rows.selectExpr("*", "'f.csv' AS file_name"), "PW", path)
    stored = tables.read_raw(spark, path, specs.PW)
    dates = tables.report_dates(spark, path, "PW")
    assert all(isinstance(d, dt.date) for d in dates)
    plan = plan_of(delta.delta_inner(stored, ["SEGMENT"], "VOLUME_BL", dates))
    scans = [p for p in plan.split("\n") if "FileScan parquet" in p and "VOLUME_BL" in p]
    assert len(scans) == 1 and "REPORT_DATE" in scans[0].split("PartitionFilters: [", 1)[1].split("]")[0]
