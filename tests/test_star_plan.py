"""Positions: how often lines are moved."""

import re

from gridledger.sources import star


def _below(plan: str, pattern: str) -> str:
    """The part of a plan's tree below the only line that matches."""
    lines = plan.split("\n")
    depth = [len(re.match(r"[ :+\-]*", line).group()) for line in lines]
    (at,) = [i for i, line in enumerate(lines) if re.search(pattern, line)]
    end = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
    return "\n".join(lines[at + 1 : end])


def test_orders_meet_customers_before_lines(spark, sf_dir):
    for build in (star.power_positions, star.gas_positions, star.carbon_positions):
        plan = build(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in _below(plan, r"Join Inner, \(o_custkey#\d+L? = c_custkey")


def test_regions_thin_lines_out_before_they_meet_orders(spark, sf_dir):
    rows = star.power_positions(spark, sf_dir).filter("BOOK_ATTR6 = 'ASIA'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ASIA" in _below(plan, r"Join Inner, \(l_orderkey#\d+L? = o_orderkey")
