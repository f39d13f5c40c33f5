"""Agents, their question logs and usage figures.

Logs are aggregated per agent before they meet the agent table, so one agent that
produced a third of the logs is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.functions.numbers import mean, percent, rounded, total, total_or_0
from gridledger.functions.text import status_label


def agent_file_counts(agents: DataFrame, files: DataFrame) -> DataFrame:
    """Processed and unprocessed files in each agent's folder; 0 for an agent without files."""
    per_folder = files.groupBy(F.col("category").alias("s3_folder")).agg(
        F.count_if(F.col("is_processed") == 1).alias("processed_count"),
        F.count_if(F.col("is_processed") == 0).alias("unprocessed_count"),
    )
    joined = agents.join(per_folder, "s3_folder", "left").fillna(
        0, ["processed_count", "unprocessed_count"]
    )
    return joined.withColumn(
        "total_count", F.col("processed_count") + F.col("unprocessed_count")
    )


def agent_listing(agents: DataFrame) -> DataFrame:
    """Agent table as it is shown."""
    return agents.select(
        F.col("agent_id").alias("id"),
        F.col("name").alias("agent_name"),
        "s3_folder",
        status_label("is_active").alias("status"),
    )


def query_logs(logs: DataFrame, agents: DataFrame) -> DataFrame:
    """Logs with the agent's name, newest first."""
    names = agents.select("agent_id", F.col("name").alias("agent_name"))
    return (
        logs.join(names, "agent_id")
        .select("log_id", "agent_id", "agent_name", "query", "answer", "created_at", "latency")
        .orderBy(F.desc("created_at"), "log_id")
    )


def queries_today(logs: DataFrame, today) -> DataFrame:
    """Questions per agent on one day."""
    return (
        logs.filter(F.to_date("created_at") == F.lit(today).cast("date"))
        .groupBy("agent_id")
        .agg(F.count("*").alias("queries_today"))
    )


def log_summary(logs: DataFrame) -> DataFrame:
    """Mean latency and last use per agent."""
    return logs.groupBy("agent_id").agg(
        mean("latency").alias("avg_latency"), F.max("created_at").alias("last_used")
    )


def agent_metrics(agents: DataFrame, logs: DataFrame, today) -> DataFrame:
    """Agent overview. Figures are looked up by agent name, so agents of one name share them."""
    day = F.lit(today).cast("date")
    per_id = logs.groupBy("agent_id").agg(
        F.count_if(F.to_date("created_at") == day).alias("today"),
        total_or_0("latency").alias("latency_sum"),
        F.count("latency").alias("latency_n"),
        F.max("created_at").alias("last_used"),
    )
    per_name = (
        per_id.join(agents.select("agent_id", "name"), "agent_id")
        .groupBy("name")
        .agg(
            F.sum("today").alias("today"),
            total("latency_sum").alias("latency_sum"),
            F.sum("latency_n").alias("latency_n"),
            F.max("last_used").alias("last_used"),
        )
    )
    has_logs = F.col("latency_n").isNotNull()
    average = F.when(F.col("latency_n") > 0, F.col("latency_sum") / F.col("latency_n"))
    return agents.join(per_name, "name", "left").select(
        "agent_id",
        F.col("name").alias("agent_name"),
        status_label("is_active").alias("status"),
        F.coalesce("today", F.lit(0)).alias("queries_today"),
        F.when(has_logs, rounded(average)).otherwise(0.0).alias("avg_latency"),
        "last_used",
    )


def agent_kpis(metrics: DataFrame) -> DataFrame:
    """Headline figures; the latency is the mean of the agents' means."""
    return metrics.agg(
        F.count("*").alias("total_agents"),
        F.count_if(F.col("status") == "Active").alias("active_agents"),
        F.coalesce(F.sum("queries_today"), F.lit(0)).alias("queries_today"),
        rounded(mean("avg_latency")).alias("avg_latency"),
    )


def daily_queries(logs: DataFrame, agents: DataFrame) -> DataFrame:
    """Questions per day and agent name."""
    per_id = logs.groupBy(F.to_date("created_at").alias("date"), "agent_id").agg(
        F.count("*").alias("n")
    )
    return (
        per_id.join(agents.select("agent_id", F.col("name").alias("agent_name")), "agent_id")
        .groupBy("date", "agent_name")
        .agg(F.sum("n").alias("queries"))
    )


def query_share(metrics: DataFrame) -> DataFrame:
    """Each agent's share of today's questions in percent."""
    everything = metrics.agg(F.sum("queries_today")).scalar()
    return metrics.select(
        "agent_name", "queries_today", percent("queries_today", everything).alias("share_pct")
    )


def recent_logs(logs: DataFrame, agents: DataFrame, k: int = 5) -> DataFrame:
    """The `k` newest logs of each agent.

    The rank limit is applied inside each map task first, so at most `k` rows per agent and
    task are shuffled.
    """
    newest = W.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("log_id"))
    top = (
        logs.select("agent_id", "log_id", "query", "answer", "created_at")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= k)
    )
    return top.join(agents.select("agent_id", F.col("name").alias("agent_name")), "agent_id")


def usage_report(records: DataFrame, operation: str, tokens: str) -> DataFrame:
    """Tokens per operation and their share of all tokens in percent, one decimal."""
    per_operation = records.groupBy(F.col(operation).alias("operation")).agg(
        F.sum(F.col(tokens).cast("bigint")).alias("tokens")
    )
    everything = records.agg(F.sum(F.col(tokens).cast("bigint"))).scalar()
    return per_operation.select(
        "operation", "tokens", percent("tokens", everything, 1).alias("share_pct")
    )


def trim_conversation(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    longest: int = 6,
    tail: int = 4,
) -> DataFrame:
    """Conversations of more than `longest` turns keep their first and last `tail` turns.

    Only the first and the last `longest` turns can be kept, and both selections are limited
    per map task before the shuffle; a conversation of any length stays cheap.
    """
    sizes = turns.groupBy(conversation).agg(F.count("*").alias("n_turns"))
    tie_break = [c for c in turns.columns if c not in (conversation, turn)]
    first = W.partitionBy(conversation).orderBy(F.asc(turn), *tie_break)
    last = W.partitionBy(conversation).orderBy(
        F.desc(turn), *[F.desc(c) for c in tie_break]
    )
    heads = (
        turns.withColumn("pos", F.row_number().over(first))
        .filter(F.col("pos") <= 1)
        .withColumn("side", F.lit("head"))
    )
    tails = (
        turns.withColumn("pos", F.row_number().over(last))
        .filter(F.col("pos") <= longest)
        .withColumn("side", F.lit("tail"))
    )
    is_long = F.col("n_turns") > longest
    keep = F.when(is_long, (F.col("side") == "head") | (F.col("pos") <= tail)).otherwise(
        F.col("side") == "tail"
    )
    return heads.unionByName(tails).join(sizes, conversation).filter(keep).select(*turns.columns)
