"""Answers to chart and position questions, from the question's text to the numbers, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import mean, total_or_0
from gridledger.operators.prompts import read_prompts, select_metrics
from gridledger.operators.stats import present_dims, to_long
from gridledger.specs import FeedSpec


def _dated_and_open(asked: DataFrame, values: DataFrame, on: list[Column], day: str) -> DataFrame:
    """Questions with a date meet that date's values, those without one meet the whole series."""
    dated = asked.filter(F.col(day).isNotNull()).join(values, [*on, F.col(day) == F.col("Date")])
    open_ended = asked.filter(F.col(day).isNull()).join(values, on)
    return dated.unionByName(open_ended)


def chart_answers(
    prompts: DataFrame, stats: DataFrame, spec: FeedSpec, key: str = "prompt_id"
) -> DataFrame:
    """(key, ord, Metric, Date, kind, Value) for each metric a question names.

    A question with a date gets bars: the total of the metric over all groups of that date. One without
    gets a series: the mean over the groups of each date. The statistics are summed up once per
    date, before any question is looked at.
    """
    metrics = present_dims(stats, list(spec.metric_catalog.values()))
    figures = {("bar", m): total_or_0(m) for m in metrics} | {("series", m): mean(m) for m in metrics}
    per_date = stats.groupBy(F.col("REPORT_DATE").alias("Date")).agg(
        *[figure.alias(f"{kind}_{m}") for (kind, m), figure in figures.items()]
    )
    cells = [
        F.struct(F.lit(m).alias("Metric"), F.lit(kind).alias("kind"), F.col(f"{kind}_{m}").alias("Value"))
        for kind, m in figures
    ]
    values = per_date.select("Date", F.inline(F.array(*cells)))
    named = select_metrics(read_prompts(prompts), spec, metrics)
    asked = named.select(
        key,
        "ord",
        F.col("metric").alias("_metric"),
        F.col("asked_date").alias("_day"),
        F.when(F.col("asked_date").isNull(), "series").otherwise("bar").alias("_kind"),
    )
    on = [F.col("_metric") == F.col("Metric"), F.col("_kind") == F.col("kind")]
    return _dated_and_open(asked, values, on, "_day").select(
        key, "ord", "Metric", "Date", "kind", "Value"
    )


def position_answers(prompts: DataFrame, positions: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, Measure, Date, Value): the net open position asked for, on its date or on all dates."""
    measures = ["VOLUME_BL", "MKT_VAL_BL"]
    sums = positions.groupBy(F.col("REPORT_DATE").alias("Date")).agg(
        *[total_or_0(m).alias(m) for m in measures]
    )
    values = to_long(sums, measures, "Date").withColumnRenamed("Metric", "Measure")
    asked = (
        read_prompts(prompts)
        .filter("is_nop")
        .select(key, F.col("nop_measure").alias("_measure"), F.col("asked_date_loose").alias("_day"))
    )
    on = [F.col("_measure") == F.col("Measure")]
    return _dated_and_open(asked, values, on, "_day").select(key, "Measure", "Date", "Value")
