"""Descriptive statistics per report date and group, and series built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import (
    amount_sums,
    mean,
    parse_number_fill0,
    rounded,
    summed,
    summed_or_0,
    total_or_0,
    value,
    with_amounts,
)
from gridledger.specs import FeedSpec

# Preference order for the axis of a by-dimension chart.
CHART_DIMENSIONS = ("BOOK", "TGROUP1", "SEGMENT", "BUCKET")

_STATISTIC = {"MIN": F.min, "MAX": F.max, "STD": F.stddev_samp}


def present_dims(frame: DataFrame, wanted: tuple[str, ...] | list[str]) -> list[str]:
    """The wanted columns the frame has, in the wanted order."""
    have = {c.upper() for c in frame.columns}
    return [c for c in wanted if c.upper() in have]


def fill_measures(frame: DataFrame, spec: FeedSpec) -> DataFrame:
    """Measures as numbers, with null and junk counted as 0."""
    kinds = dict(frame.dtypes)
    filled = {}
    for m in present_dims(frame, spec.measures):
        filled[m] = (
            F.coalesce(F.nanvl(F.col(m), F.lit(None)), F.lit(0.0))
            if kinds[m] == "double"
            else parse_number_fill0(m)
        )
    return frame.withColumns(filled)


def newest_reports(frame: DataFrame, by: str = "file_name", date: str = "REPORT_DATE") -> DataFrame:
    return frame.groupBy(by).agg(F.max(date).alias(date))


def keep_latest_report(
    frame: DataFrame,
    by: str | None = "file_name",
    date: str = "REPORT_DATE",
    newest: DataFrame | None = None,
) -> DataFrame:
    """Rows of the newest report date of each file (of the whole frame when `by` is None).

    The newest dates are aggregated first and joined back: a file holding much of the data is
    split by the skew handling of the join, which a window over the file could not be. With `newest`
    (`newest_reports`, written and read back) Spark knows how few they are and does not move the rows.
    """
    if by is None:
        return frame.filter(F.col(date) == frame.agg(F.max(date)).scalar())
    newest = newest_reports(frame, by, date) if newest is None else newest
    return frame.join(newest, [by, date], "left_semi")


def daily_stats(
    positions: DataFrame, spec: FeedSpec, extra_keys: tuple[str, ...] = ()
) -> DataFrame:
    """Sum, mean, min, max (and sample deviation) of each measure per date and group.

    Groups only by the dimensions the feed has; rows with a null key are left out.
    """
    frame = fill_measures(positions, spec)
    keys = [*extra_keys, "REPORT_DATE", *present_dims(frame, spec.stat_dims)]
    for key in keys:
        frame = frame.filter(F.col(key).isNotNull())
    measures = present_dims(frame, spec.measures)
    sums = []
    for m in measures:
        # Filled measures have no nulls, so that the rows of a group are the values of each.
        sums += amount_sums(m)
        sums += [_STATISTIC[stat](m).alias(f"{stat}_{m}") for stat in spec.statistics if stat in _STATISTIC]
    grouped = with_amounts(frame, measures).groupBy(*keys).agg(F.count("*").alias("_n"), *sums)

    def figure(stat: str, m: str):
        if stat in _STATISTIC:
            return F.col(f"{stat}_{m}")
        whole = value(summed(m))
        return (whole if stat == "TOTAL" else whole / F.col("_n")).alias(f"{stat}_{m}")

    return grouped.select(*keys, *[figure(stat, m) for m in measures for stat in spec.statistics])


# --- states: statistics that add up over files and dates -------------------------------


def state_columns(spec: FeedSpec) -> list[str]:
    kinds = ("high", "low", "units", "wild", "m2", "min", "max")
    return ["n", *(f"_{kind}_{m}" for m in spec.measures for kind in kinds)]


def statistics_states(positions: DataFrame, spec: FeedSpec, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """What `merge_statistics` needs of each date and group: count, exact sums, sum of squared
    deviations (M2), least and greatest value of each measure.

    Rows as in `daily_stats`. A dimension that the feed lacks is null.
    """
    frame = fill_measures(positions, spec)
    keys = [*extra_keys, "REPORT_DATE", *present_dims(frame, spec.stat_dims)]
    for key in keys:
        frame = frame.filter(F.col(key).isNotNull())
    measures = present_dims(frame, spec.measures)
    columns = [F.count("*").alias("n")]
    for m in measures:
        columns += amount_sums(m)
        columns += [
            (F.var_pop(m) * F.count("*")).alias(f"_m2_{m}"), F.min(m).alias(f"_min_{m}"), F.max(m).alias(f"_max_{m}"),
        ]
    grouped = with_amounts(frame, measures).groupBy(*keys).agg(*columns)
    lacking = [c for c in (*spec.stat_dims, *state_columns(spec)) if c not in grouped.columns]
    kinds = {c: "string" if c in spec.stat_dims else "double" for c in lacking}
    filled = grouped.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})
    return filled.select(*extra_keys, "REPORT_DATE", *spec.stat_dims, *state_columns(spec))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join by keys, of which null is one."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, on).drop(*[f"_right_{k}" for k in keys])


def merge_statistics(states: DataFrame, spec: FeedSpec, keys: list[str], merged: bool = False) -> DataFrame:
    """Statistics of `daily_stats` (STD for all feeds) by any keys, from states alone.

    The variance follows from the parts' own M2 and the distances of their means from the common mean: both
    are sums of squares, so nothing cancels. That mean is known after a first aggregation, and is joined back
    to the states, which are far fewer than positions; a key with most states is split by adaptive
    execution. With `merged`, states by the keys come back, which can be merged again.
    """
    if not keys:
        return merge_statistics(states.withColumn("_all", F.lit(1)), spec, ["_all"], merged).drop("_all")
    sums = ("high", "low", "units", "wild")
    whole = states.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(f"_{kind}_{m}").alias(f"_{kind}_{m}") for m in spec.measures for kind in sums],
        *[F.min(f"_min_{m}").alias(f"_min_{m}") for m in spec.measures],
        *[F.max(f"_max_{m}").alias(f"_max_{m}") for m in spec.measures],
    )
    means = whole.select(*keys, *[(value(summed(m)) / F.col("n")).alias(f"mean_{m}") for m in spec.measures])
    parts = states.select(
        *keys, "n", *[f"_m2_{m}" for m in spec.measures],
        *[(value(summed(m)) / F.col("n")).alias(f"own_{m}") for m in spec.measures],
    )
    spread = _same(parts, means, keys).groupBy(*keys).agg(
        *[
            F.sum(F.col(f"_m2_{m}") + F.col("n") * F.pow(F.col(f"own_{m}") - F.col(f"mean_{m}"), 2)).alias(f"_m2_{m}")
            for m in spec.measures
        ]
    )
    state = _same(whole, spread, keys).select(*keys, *state_columns(spec))
    if merged:
        return state
    figures = []
    for m in spec.measures:
        total = value(summed(m))
        figures += [
            total.alias(f"TOTAL_{m}"), (total / F.col("n")).alias(f"AVG_{m}"),
            F.col(f"_min_{m}").alias(f"MIN_{m}"), F.col(f"_max_{m}").alias(f"MAX_{m}"),
            F.when(F.col("n") > 1, F.sqrt(F.col(f"_m2_{m}") / (F.col("n") - 1))).alias(f"STD_{m}"),
        ]
    return state.select(*keys, "n", *figures)


def round_record(frame: DataFrame, places: int = 2) -> DataFrame:
    """All floating-point columns rounded; other columns untouched."""
    return frame.withColumns(
        {n: rounded(n, places) for n, kind in frame.dtypes if kind in ("double", "float")}
    )


def available_metrics(frame: DataFrame, wanted: list[str]) -> list[str]:
    return present_dims(frame, wanted)


def combined_totals(stats: DataFrame, spec: FeedSpec) -> DataFrame:
    """Stored group totals added up per report date, for the metrics that are present."""
    metrics = available_metrics(stats, spec.total_metrics)
    sums = [s for m in metrics for s in amount_sums(m)]
    rolled = with_amounts(stats, metrics).groupBy("REPORT_DATE").agg(*sums)
    return rolled.select("REPORT_DATE", *[summed_or_0(m).alias(m) for m in metrics])


def to_long(frame: DataFrame, metrics: list[str], date: str = "REPORT_DATE") -> DataFrame:
    """(Date, Metric, Value) rows."""
    return frame.select(F.col(date).alias("Date"), *metrics).unpivot(
        "Date", metrics, "Metric", "Value"
    )


def metric_series(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean over groups of each metric per report date, in long form."""
    chosen = available_metrics(stats, metrics)
    return to_long(stats.groupBy("REPORT_DATE").agg(*[mean(m).alias(m) for m in chosen]), chosen)


def metrics_on_date(stats: DataFrame, spec: FeedSpec, metrics: list[str], day) -> DataFrame:
    """(Metric, first_value, total_value) on one date; `first` follows the group keys."""
    chosen = available_metrics(stats, metrics)
    keys = present_dims(stats, spec.stat_dims)
    one_day = stats.filter(F.col("REPORT_DATE") == day)
    sides = one_day.agg(
        *[
            F.coalesce(F.min_by(F.struct(m), F.struct(*keys))[m], F.lit(0.0)).alias(f"first_{m}")
            for m in chosen
        ],
        *[total_or_0(m).alias(f"total_{m}") for m in chosen],
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("Metric"),
                    F.col(f"first_{m}").alias("first_value"),
                    F.col(f"total_{m}").alias("total_value"),
                )
                for m in chosen
            ]
        )
    )
    return sides.select(cells.alias("cell")).select("cell.*")


def is_single_date(frame: DataFrame, date: str = "REPORT_DATE") -> DataFrame:
    """One row: number of dates and whether there is exactly one."""
    return frame.agg(F.count_distinct(date).alias("n_dates")).withColumn(
        "single_date", F.col("n_dates") == 1
    )


def dimension_view(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """Chosen metrics per member of the first chart dimension present, largest first."""
    axis = next(iter(present_dims(stats, CHART_DIMENSIONS)), None)
    if axis is None:
        raise ValueError("no chart dimension in the data")
    chosen = available_metrics(stats, metrics)
    summed = stats.groupBy(axis).agg(*[total_or_0(m).alias(m) for m in chosen])
    return summed.orderBy(F.desc(chosen[0]), axis)


def stats_documents(stats: DataFrame, file_name: str | None = None) -> DataFrame:
    """Storage form: one JSON record per group of a file, numbers as text with two decimals.

    `stats` carries `file_name` unless one name is given for all of it. Records of a file stay
    separate rows, so a file with many groups never becomes one oversized document.
    """
    texts = [
        (
            F.col(n).cast("string")
            if kind not in ("double", "float")
            else F.regexp_replace(
                F.round(F.col(n).cast("decimal(28,6)"), 2).cast("string"), "0$", ""
            )
        ).alias(n)
        for n, kind in stats.dtypes
        if n != "file_name"
    ]
    return stats.select(
        F.col("file_name") if file_name is None else F.lit(file_name).alias("file_name"),
        F.col("REPORT_DATE").alias("date_processed"),
        F.to_json(F.struct(*texts)).alias("json_record"),
        F.lit(1).alias("is_processed"),
    )


def explode_stats(documents: DataFrame, spec: FeedSpec) -> tuple[DataFrame, DataFrame]:
    """Typed records of stored documents, and the documents that could not be read.

    Accepts one record per row (`json_record`) or a whole document (`json_contents` with a
    `daily_totals` array).
    """
    metrics = list(dict.fromkeys(spec.metric_catalog.values()))
    fields = ", ".join(f"{c}: string" for c in ["REPORT_DATE", *spec.stat_dims, *metrics])
    if "json_contents" in documents.columns:
        parsed = documents.withColumn(
            "doc",
            F.from_json("json_contents", f"daily_totals array<struct<{fields}>>, _bad string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
        )
        bad = F.col("doc").isNull() | F.col("doc._bad").isNotNull() | F.col("doc.daily_totals").isNull()
        records = parsed.filter(~bad).select("file_name", F.explode("doc.daily_totals").alias("r"))
    else:
        schema = ", ".join(f"{c} string" for c in ["REPORT_DATE", *spec.stat_dims, *metrics])
        parsed = documents.withColumn(
            "doc",
            F.from_json("json_record", f"{schema}, _bad string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
        )
        bad = F.col("doc").isNull() | F.col("doc._bad").isNotNull() | F.col("doc.REPORT_DATE").isNull()
        records = parsed.filter(~bad).select("file_name", F.col("doc").alias("r"))
    typed = records.select(
        "file_name",
        F.col("r.REPORT_DATE").try_cast("date").alias("REPORT_DATE"),
        *[F.col(f"r.{d}") for d in spec.stat_dims],
        *[F.col(f"r.{m}").try_cast("double").alias(m) for m in metrics],
    )
    return typed, parsed.filter(bad).drop("doc")
