"""Queries that answer questions from their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions.dates import iso_date
from gridledger.plans import questions
from gridledger.sources import star
from workload.positions import _stored_sql, _stored_stats
from workload.registry import SQL, dsum, dsum_null, query

_CATALOG = list(specs.CO2.metric_catalog.items())
_VALUES = ", ".join(f"({i}, '{name}', '{metric}')" for i, (name, metric) in enumerate(_CATALOG))
_SUMS = ", ".join(f"{dsum(m)} AS b_{m}, {dsum_null(m)} / COUNT({m}) AS s_{m}" for _, m in _CATALOG)
_LONG = " UNION ALL ".join(
    f"SELECT REPORT_DATE AS d, '{m}' AS metric, '{kind}' AS kind, {kind[0]}_{m} AS v FROM per"
    for _, m in _CATALOG
    for kind in ("bar", "series")
)
# Only dates written out as dd-mm-yyyy or dd/mm/yyyy count for charts.
_CHART_DAY = (
    r"CAST(try_strptime(replace(regexp_extract(prompt, '(\d{2}[-/]\d{2}[-/]\d{4})', 1), '/', '-'), '%d-%m-%Y') AS DATE)"
)


@query(
    "chart_question",
    f"""WITH s AS MATERIALIZED ({_stored_sql(specs.CO2)}),
        per AS MATERIALIZED (SELECT REPORT_DATE, {_SUMS} FROM s GROUP BY REPORT_DATE),
        v AS ({_LONG}),
        c(ord, name, metric) AS (VALUES {_VALUES}),
        q AS (SELECT prompt_id, replace(replace(lower(prompt), ' ', ''), '_', '') AS t, {_CHART_DAY} AS day FROM fx_prompts),
        a AS (SELECT prompt_id, day, CAST(ord AS INT) AS ord, metric, CASE WHEN day IS NULL THEN 'series' ELSE 'bar' END AS kind
              FROM q JOIN c ON contains(t, replace(lower(name), '_', '')) OR ord = 0)
        SELECT a.prompt_id, a.ord, a.metric AS Metric, a.kind, CAST(COUNT(*) AS BIGINT) AS n_points,
               CAST(MIN(v.d) AS VARCHAR) AS first_date, CAST(MAX(v.d) AS VARCHAR) AS last_date,
               MIN(v.v) AS lowest, MAX(v.v) AS highest, arg_max(v.v, v.d) AS last_value
        FROM a JOIN v ON v.metric = a.metric AND v.kind = a.kind AND (a.day IS NULL OR a.day = v.d) GROUP BY ALL""",
)
def chart_question(spark, sf):
    """Every chart by its number of points, its dates, and its lowest, highest and last value."""
    asked = star.prompts(spark, sf)
    answers = questions.chart_answers(asked, _stored_stats(spark, sf, specs.CO2), specs.CO2)
    return answers.groupBy("prompt_id", "ord", "Metric", "kind").agg(
        F.count("*").alias("n_points"),
        iso_date(F.min("Date")).alias("first_date"),
        iso_date(F.max("Date")).alias("last_date"),
        F.min("Value").alias("lowest"),
        F.max("Value").alias("highest"),
        F.max_by("Value", "Date").alias("last_value"),
    )


@query(
    "position_question",
    f"""WITH r AS ({SQL['read_prompts']}),
        per AS (SELECT REPORT_DATE AS d, {dsum('VOLUME_BL')} AS VOLUME_BL, {dsum('MKT_VAL_BL')} AS MKT_VAL_BL FROM fx_pw GROUP BY 1)
        SELECT r.prompt_id, r.nop_measure AS Measure, CAST(per.d AS VARCHAR) AS Date,
               CASE WHEN r.nop_measure = 'VOLUME_BL' THEN per.VOLUME_BL ELSE per.MKT_VAL_BL END AS Value
        FROM r JOIN per ON r.asked_date_loose IS NULL OR CAST(r.asked_date_loose AS DATE) = per.d WHERE r.is_nop""",
)
def position_question(spark, sf):
    answers = questions.position_answers(star.prompts(spark, sf), star.power_positions(spark, sf))
    return answers.withColumn("Date", iso_date("Date"))
