"""User feedback: counts, trends, corrections and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.functions.numbers import confidence

# Headings of the feedback grid.
GRID = {
    "log_id": "ID",
    "query": "User Query",
    "answer": "Bot Answer",
    "category": "Category",
    "user_feedback": "User Feedback",
    "feedback_comment": "Feedback Comment",
    "latency": "Latency",
    "created_at": "Query Timestamp",
}
AGENT_FIELDS = ("name", "description", "model", "temperature", "prompt", "s3_folder", "is_active")


def negative_feedback(logs: DataFrame) -> DataFrame:
    """Rejected answers with a comment that is not blank."""
    return logs.filter((F.col("user_feedback") == 0) & (F.trim("feedback_comment") != ""))


def feedback_grid(logs: DataFrame) -> DataFrame:
    return logs.select([F.col(c).alias(title) for c, title in GRID.items()])


def feedback_counts(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count_if(F.col("user_feedback") == 1).alias("positives"),
        F.count_if(F.col("user_feedback") == 0).alias("negatives"),
    )


def feedback_trend(logs: DataFrame) -> DataFrame:
    """Uses of each comment per day."""
    return (
        logs.filter(F.col("feedback_comment").isNotNull())
        .groupBy(F.to_date("created_at").alias("day"), "feedback_comment")
        .agg(F.count("*").alias("n"))
    )


def feedback_trend_wide(trend: DataFrame, comments: list[str]) -> DataFrame:
    """One column per given comment, 0 where it was not used that day.

    The columns of a result have to be known before it runs. For comments that are not known, or many, there
    are the long form (`feedback_trend`), maps (`trend_maps`) and blocks of columns (`trend_blocks`).
    """
    return (
        trend.groupBy("day").pivot("feedback_comment", comments).agg(F.sum("n")).fillna(0)
    )


def trend_domain(trend: DataFrame, width: int = 64) -> DataFrame:
    """Column place of every comment: (feedback_comment, block, position).

    Comments are dealt to blocks by hash, about `width` to a block, and numbered within; so the domain may grow
    without any list on the driver or one task that sorts it.
    """
    comments = trend.select("feedback_comment").distinct()
    n_blocks = F.greatest(F.lit(1), F.ceil(comments.agg(F.count("*")).scalar() / width))
    dealt = comments.withColumn("block", F.pmod(F.xxhash64("feedback_comment"), n_blocks))
    place = W.partitionBy("block").orderBy("feedback_comment")
    return dealt.withColumn("position", F.row_number().over(place))


def trend_blocks(trend: DataFrame, domain: DataFrame) -> DataFrame:
    """(day, block, counts): the wide form for any number of comments, a block of columns per row.

    `counts` holds one number per comment of the block, 0 where it was not used that day. Blocks without any
    use on a day are left out.
    """
    sizes = domain.groupBy("block").agg(F.max("position").alias("size"))
    cells = trend.join(domain, "feedback_comment").groupBy("day", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "n"))).alias("used")
    )
    filled = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.coalesce(F.col("used")[i], F.lit(0)))
    return cells.join(sizes, "block").select("day", "block", filled.alias("counts"))


def trend_of_blocks(blocks: DataFrame, domain: DataFrame) -> DataFrame:
    """The long form again: (day, feedback_comment, n) of the comments that were used."""
    cells = blocks.select("day", "block", F.posexplode("counts").alias("at", "n")).filter("n > 0")
    return cells.withColumn("position", F.col("at") + 1).join(domain, ["block", "position"]).select(
        "day", "feedback_comment", "n"
    )


def trend_maps(trend: DataFrame, domain: DataFrame) -> DataFrame:
    """(day, block, uses): per day and block of comments a map comment -> uses."""
    return trend.join(domain, "feedback_comment").groupBy("day", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("feedback_comment", "n"))).alias("uses")
    )


def training_pairs(logs: DataFrame) -> DataFrame:
    """(query, incorrect_answer, correction) from commented negative feedback."""
    return negative_feedback(logs).select(
        "query",
        F.col("answer").alias("incorrect_answer"),
        F.col("feedback_comment").alias("correction"),
    )


def current_feedback(logs: DataFrame, updates: DataFrame) -> DataFrame:
    """Logs with the newest feedback update applied.

    `updates`: (update_id, log_id, user_feedback, feedback_comment). The log itself is append
    only; many updates of one log are reduced before the join.
    """
    newest = updates.groupBy("log_id").agg(
        F.max(F.struct("update_id", "user_feedback", "feedback_comment")).alias("u")
    )
    changed = F.col("u").isNotNull()
    return logs.join(newest, "log_id", "left").withColumns(
        {
            c: F.when(changed, F.col(f"u.{c}")).otherwise(F.col(c))
            for c in ("user_feedback", "feedback_comment")
        }
    ).drop("u")


def agent_states(changes: DataFrame) -> DataFrame:
    """One row per agent of a change log (change_id, agent_id, action, fields, `cleared`): the newest
    change, the newest delete, and per field the newest change that carries it.

    All of these are maxima, so states of parts of a log, in any order and even repeated, join to the
    state of the whole (`join_agent_states`); the aggregation runs on streams as well.
    """
    fields = [f for f in AGENT_FIELDS if f in changes.columns]

    def carried(f: str):
        given = F.col(f).isNotNull()
        return given | F.coalesce(F.array_contains("cleared", f), F.lit(False)) if "cleared" in changes.columns else given

    return changes.groupBy("agent_id").agg(
        F.max(F.struct("change_id", "action")).alias("newest"),
        F.max(F.when(F.col("action") == "delete", F.col("change_id"))).alias("deleted"),
        *[F.max(F.when(carried(f), F.struct("change_id", F.col(f).alias("value")))).alias(f) for f in fields],
    )


def join_agent_states(states: DataFrame) -> DataFrame:
    """States of parts of a change log, put together."""
    return states.groupBy("agent_id").agg(*[F.max(c).alias(c) for c in states.columns if c != "agent_id"])


def agents_of_states(states: DataFrame) -> DataFrame:
    """Agents that are not deleted; a delete is a barrier that no earlier value passes."""
    fields = [f for f in AGENT_FIELDS if f in states.columns]
    live = states.filter(F.col("newest.action") != "delete")
    since = F.col("deleted").isNull()
    return live.select(
        "agent_id",
        *[F.when(since | (F.col(f"{f}.change_id") > F.col("deleted")), F.col(f"{f}.value")).alias(f) for f in fields],
    )


def current_agents(changes: DataFrame) -> DataFrame:
    """Agent table from its change log (change_id, agent_id, action, fields).

    `action` is insert, update, status or delete. A change sets the fields it carries, that is those
    that are not null and those that the optional array `cleared` names, which become null. Agents
    whose last change is a delete are gone; one that comes back starts blank.
    """
    return agents_of_states(agent_states(changes))


def answer_confidence(
    insights: DataFrame, questions: DataFrame, documents: DataFrame, base: float = 0.7
) -> DataFrame:
    """Confidence per question from the complaints found for it and the documents behind it.

    `documents` has (question_id, n_docs): how many files the answer was drawn from.
    """
    found = insights.groupBy("question_id").agg(F.count("*").alias("n_feedback"))
    counted = (
        questions.select("question_id")
        .join(found, "question_id", "left")
        .join(documents.select("question_id", "n_docs"), "question_id", "left")
        .fillna(0, ["n_feedback", "n_docs"])
    )
    return counted.withColumn("confidence", F.round(confidence(base, "n_feedback", "n_docs"), 4))
