"""Ad-hoc SQL over the raw position tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions.text import resolve_feed
from gridledger.specs import FEEDS

# Fixed value: shown with an empty result.
EMPTY_WARNING = "Query returned no results. Please check your filters or criteria."


def register_feeds(positions: dict[str, DataFrame]) -> None:
    """Make positions queryable as `CO2_raw_data`, `NG_raw_data`, `PW_raw_data`."""
    for category, frame in positions.items():
        frame.createOrReplaceTempView(FEEDS[category].table)


class RefusedQuery(ValueError):
    """A statement that is not a query over the registered tables."""


# Functions that run code of the host, not of the query.
HOST_FUNCTIONS = ("reflect", "try_reflect", "java_method")


def check_query(spark: SparkSession, text: str, allowed: Iterable[str]) -> None:
    """Refuse what is not one SELECT over the allowed tables. Nothing is run or looked up.

    Spark's own parser reads the text; its unresolved plan shows the kinds of statements and, also in
    subqueries and common table expressions, all relations that are asked for.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise RefusedQuery(f"not a SQL query: {str(error).strip().splitlines()[0]}") from error
    kinds = [
        spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
        for name in ("Command", "ParsedStatement")
    ]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(kind.isInstance(node) for kind in kinds):
            raise RefusedQuery(f"only queries are run, not {node.nodeName()}")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    shown = plan.toString()
    if "PlanWithUnresolvedIdentifier" in shown:
        raise RefusedQuery("tables have to be named plainly")
    for name in re.findall(r"UnresolvedTableValuedFunction \[([^\]]*)\]", shown):
        raise RefusedQuery(f"table function {name} is not allowed")
    for name in re.findall(rf"\b({'|'.join(HOST_FUNCTIONS)})\(", shown, re.IGNORECASE):
        raise RefusedQuery(f"function {name} is not allowed")
    own = {n.strip().lower() for names in re.findall(r"^[ :|+-]*CTE \[([^\]]*)\]", shown, re.MULTILINE) for n in names.split(",")}
    known = own | {n.lower() for n in allowed}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shown):
        if name.lower() not in known:
            raise RefusedQuery(f"table {name.replace(', ', '.')} is not among those registered")


def estimated_bytes(query: DataFrame) -> int:
    """Size of the result as the optimised plan estimates it, from file sizes; nothing is run."""
    return int(str(query._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def run_sql(
    spark: SparkSession, text: str, allowed: Iterable[str] | None = None, most_bytes: int | None = None
) -> DataFrame:
    """Result of a query over the registered tables (`allowed`: the feeds', unless given).

    Raises `RefusedQuery` for anything else, and for results estimated above `most_bytes`.
    """
    check_query(spark, text, allowed or [spec.table for spec in FEEDS.values()])
    result = spark.sql(text)
    if most_bytes is not None and (size := estimated_bytes(result)) > most_bytes:
        raise RefusedQuery(f"the result is estimated at {size} bytes, above {most_bytes}")
    return result


def result_warning(result: DataFrame) -> str | None:
    """Warning for an empty result; reads at most one row."""
    return EMPTY_WARNING if result.isEmpty() else None


def with_feed_table(frame: DataFrame, category: str = "category") -> DataFrame:
    """Adds the commodity and raw table a user's category name stands for."""
    feed = resolve_feed(category)
    name = F
    for spec in FEEDS.values():
        name = name.when(F.col("feed") == spec.category, F.lit(spec.table))
    return frame.withColumn("feed", feed).withColumn("table_name", name)
