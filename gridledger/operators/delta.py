"""Comparison of the last two report dates.

The two dates come from a one-row subquery, so the position scan reads only their
partitions. Both dates are then compared inside one aggregation; no self-join is made, and
`in_latest` / `in_previous` tell which side of the classic inner, left or full join a key
belongs to.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.functions.numbers import (
    amount_sums,
    difference,
    grouped_digits,
    rounded,
    sign_label,
    signed_text,
    summed,
    summed_or_0,
    value,
    with_amounts,
)

# Dimensions shown in the summary of drivers and their headings.
DRIVER_VIEWS = {"Segment": "SEGMENT", "Book": "BOOK_ATTR8", "Tgroup1": "TGROUP1"}
TOP_K = 5

#: (latest, previous) report date, or None to look them up in the input.
ReportDates = tuple[datetime.date | None, datetime.date | None] | None


def report_pair(frame: DataFrame, date: str = "REPORT_DATE") -> DataFrame:
    """One row (latest, previous): the two newest dates; `previous` is null if there is one date."""
    newest = (
        frame.filter(F.col(date).isNotNull())
        .select(F.col(date).alias("d"))
        .distinct()
        .orderBy(F.desc("d"))
        .limit(2)
    )
    return newest.agg(
        F.max("d").alias("latest"), F.nullif(F.min("d"), F.max("d")).alias("previous")
    )


def last_two(
    frame: DataFrame, date: str = "REPORT_DATE", dates: ReportDates = None
) -> tuple[DataFrame, Column, Column]:
    """Rows of the two newest dates, with the conditions `is latest` and `is previous`.

    `dates` gives the pair (latest, previous) where it is known, as from the ingest log
    (`tables.report_dates`): the rows are then read once, and only those dates' partitions. Without
    it the dates are found by a pass over the input. No row is returned while there is only one
    date to look at.
    """
    if dates is not None:
        latest, previous = dates
        if latest is None or previous is None:
            return frame.filter(F.lit(False)), F.lit(False), F.lit(False)
        is_latest, is_previous = F.col(date) == F.lit(latest), F.col(date) == F.lit(previous)
        return frame.filter(is_latest | is_previous), is_latest, is_previous
    # One struct, so that both dates come out of a single subquery.
    pair = report_pair(frame, date).select(F.struct("latest", "previous")).scalar()
    rows = frame.filter(F.col(date) >= pair["previous"])
    return rows, F.col(date) == pair["latest"], F.col(date) < pair["latest"]


def latest_reports(
    frame: DataFrame, n: int = 2, by: str = "category", date: str = "REPORT_DATE"
) -> DataFrame:
    """The `n` newest report dates of each category, oldest first within the category.

    Works on distinct (category, date) pairs, a few per calendar day.
    """
    newest = W.partitionBy(by).orderBy(F.desc(date))
    return (
        frame.filter(F.col(date).isNotNull())
        .select(by, date)
        .distinct()
        .withColumn("age", F.row_number().over(newest))
        .filter(F.col("age") <= n)
        .select(by, date, (F.col("age") - 1).alias("reports_back"))
        .orderBy(by, date)
    )


def _side_sums(measures: list[str], is_latest: Column, is_previous: Column) -> list[Column]:
    """Sums of each prepared measure on both dates, to be read by `summed`."""
    return [
        column
        for m in measures
        for side, on_side in (("latest", is_latest), ("previous", is_previous))
        for column in amount_sums(m, f"{m}_{side}", on_side)
    ]


def _delta(measure: str) -> Column:
    """Change between the two sums of `_side_sums`, exact."""
    return difference(summed(f"{measure}_latest"), summed(f"{measure}_previous"))


def compare_reports(
    frame: DataFrame,
    keys: list[str],
    measures: list[str],
    date: str = "REPORT_DATE",
    dates: ReportDates = None,
) -> DataFrame:
    """Per key: both values of each measure, its change, and the dates the key occurs on.

    `frame` may hold positions or a stored cube. Columns: keys, `<m>_latest`, `<m>_previous`
    (null where the key is absent), `<m>_delta`, `in_latest`, `in_previous`.
    """
    rows, is_latest, is_previous = last_two(frame, date, dates)
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    sums = with_amounts(rows, measures).groupBy(*keys).agg(
        *_side_sums(measures, is_latest, is_previous),
        (F.count_if(is_latest) > 0).alias("in_latest"),
        (F.count_if(is_previous) > 0).alias("in_previous"),
    )
    figures = [
        column
        for m in measures
        for column in (
            value(summed(f"{m}_latest")).alias(f"{m}_latest"),
            value(summed(f"{m}_previous")).alias(f"{m}_previous"),
            _delta(m).alias(f"{m}_delta"),
        )
    ]
    return sums.select(*keys, *figures, "in_latest", "in_previous")


def delta_inner(
    frame: DataFrame, keys: list[str], measure: str, dates: ReportDates = None
) -> DataFrame:
    """Change of one measure for keys present on both dates."""
    return (
        compare_reports(frame, keys, [measure], dates=dates)
        .filter(F.col("in_latest") & F.col("in_previous"))
        .select(*keys, F.col(f"{measure}_delta").alias("delta"))
    )


def delta_left(
    frame: DataFrame,
    keys: list[str],
    volume: str = "VOLUME_BL",
    market: str = "MKT_VAL_BL",
    dates: ReportDates = None,
) -> DataFrame:
    """Changes for keys of the latest date; a key new on that date changes by its full value.

    Keys without any change are left out; rounding comes after that test.
    """
    changes = (
        compare_reports(frame, keys, [volume, market], dates=dates)
        .filter("in_latest")
        .select(*keys, F.col(f"{volume}_delta").alias("dv"), F.col(f"{market}_delta").alias("dm"))
        .filter((F.col("dv") != 0) | (F.col("dm") != 0))
    )
    return changes.select(
        *keys, rounded("dv").alias("delta_volume_bl"), rounded("dm").alias("delta_market_val_bl")
    )


def delta_either(
    frame: DataFrame, keys: list[str], measure: str, dates: ReportDates = None
) -> DataFrame:
    """Change of one measure for keys present on either date."""
    changes = compare_reports(frame, keys, [measure], dates=dates)
    return changes.select(*keys, F.col(f"{measure}_delta").alias("delta"))


def delta_full(
    frame: DataFrame, row: str, column: str, measure: str, dates: ReportDates = None
) -> DataFrame:
    """Every (row label, member) pair of the heat map in long form, absent pairs 0.

    The result is the product of both label sets by definition. Each row label meets the distinct
    members, which come as one array from a subquery; the changes are then added in.
    """
    changes = delta_either(frame, [row, column], measure, dates)
    members = changes.agg(F.collect_set(column)).scalar()
    blank = (
        changes.select(row)
        .distinct()
        .select(row, F.explode(members).alias(column), F.lit(0.0).alias("delta"))
    )
    # One change per pair at most: the sum only fills it in.
    return changes.unionByName(blank).groupBy(row, column).agg(F.sum("delta").alias("delta"))


def delta_matrix(
    frame: DataFrame,
    row: str,
    column: str,
    measure: str,
    columns: list[str],
    dates: ReportDates = None,
) -> DataFrame:
    """Heat-map numbers, one column per member: a layout of `delta_full` for given members."""
    changes = delta_either(frame, [row, column], measure, dates)
    wide = changes.groupBy(row).pivot(column, columns).agg(F.first("delta"))
    return wide.select(row, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in columns])


def delta_text(cells: DataFrame) -> DataFrame:
    """Cells of `delta_full` as signed text."""
    return cells.withColumn("delta", signed_text("delta"))


def delta_series(frame: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Change of each key against its own previous report, over the whole history.

    The window runs over one row per (key, report date), never over positions.
    """
    sums = [s for m in measures for s in amount_sums(m)]
    per_date = with_amounts(frame, measures).groupBy(*keys, "REPORT_DATE").agg(*sums)
    per_date = per_date.select(*keys, "REPORT_DATE", *[summed(m).alias(m) for m in measures])
    for key in [*keys, "REPORT_DATE"]:
        per_date = per_date.filter(F.col(key).isNotNull())
    history = W.partitionBy(*keys).orderBy("REPORT_DATE")
    return per_date.select(
        *keys,
        "REPORT_DATE",
        *[_or_0(value(F.col(m))).alias(m) for m in measures],
        *[
            F.when(
                F.lag(m).over(history).isNotNull(),
                difference(F.col(m), F.lag(m).over(history)),
            ).alias(f"delta_{m}")
            for m in measures
        ],
    )


def _or_0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def nop_card(positions: DataFrame, dates: ReportDates = None) -> DataFrame:
    """Headline figures of the latest report: value, change, sign and display text."""
    rows, is_latest, is_previous = last_two(positions, dates=dates)
    sums = with_amounts(rows, ["VOLUME_BL", "MKT_VAL_BL"]).agg(
        F.max("REPORT_DATE").alias("as_of"),
        *_side_sums(["VOLUME_BL", "MKT_VAL_BL"], is_latest, is_previous),
    ).filter(F.col("as_of").isNotNull())
    cards = sums.select("as_of", summed_or_0("VOLUME_BL_latest").alias("volume"),
                        _delta("VOLUME_BL").alias("delta_volume"),
                        summed_or_0("MKT_VAL_BL_latest").alias("market"),
                        _delta("MKT_VAL_BL").alias("delta_market"))
    return cards.select(
        "*",
        sign_label("delta_volume").alias("volume_sign"),
        sign_label("delta_market").alias("market_sign"),
        F.concat(grouped_digits("volume"), F.lit("MW")).alias("volume_text"),
        grouped_digits("market").alias("market_text"),
        F.concat(
            sign_label("delta_volume"), grouped_digits(F.abs("delta_volume")), F.lit("MW")
        ).alias("delta_volume_text"),
        F.concat(sign_label("delta_market"), grouped_digits(F.abs("delta_market"))).alias(
            "delta_market_text"
        ),
    )


def top_movers(
    positions: DataFrame,
    member: str,
    horizon: str,
    measure: str,
    k: int = TOP_K,
    dates: ReportDates = None,
) -> DataFrame:
    """The `k` members whose value at one horizon changed most between the two reports.

    A member must occur in both reports, at any horizon; where it has nothing at the chosen
    horizon its value there is 0.
    """
    rows, is_latest, is_previous = last_two(positions, dates=dates)
    at_horizon = F.col("HORIZON") == horizon
    per_member = (
        with_amounts(rows.filter(F.col(member).isNotNull() & F.col("HORIZON").isNotNull()), [measure])
        .groupBy(member)
        .agg(
            *_side_sums([measure], is_latest & at_horizon, is_previous & at_horizon),
            F.count_if(is_latest).alias("n_latest"),
            F.count_if(is_previous).alias("n_previous"),
        )
        .filter((F.col("n_latest") > 0) & (F.col("n_previous") > 0))
    )
    return (
        per_member.select(member, _delta(measure).alias("delta"))
        .orderBy(F.desc(F.abs("delta")), member)
        .limit(k)
    )


def top_movers_all(
    positions: DataFrame, member: str, measure: str, k: int = TOP_K, dates: ReportDates = None
) -> DataFrame:
    """`top_movers` for every horizon of the two reports: (HORIZON, rank, member, delta).

    A member without positions at a horizon moves by 0 there and can still rank when fewer
    than `k` others moved. Only the first `2k` member names can take such a place, so those
    are added to each horizon instead of all member-horizon pairs.
    """
    keys = [member, "HORIZON"]
    cells = compare_reports(positions, keys, [measure], dates=dates).select(
        *keys, F.col(f"{measure}_delta").alias("delta"), "in_latest", "in_previous"
    )
    # One row per (member, horizon): a member's reports are read off its few cells.
    own = W.partitionBy(member)
    cells = cells.withColumn(
        "in_both", F.max("in_latest").over(own) & F.max("in_previous").over(own)
    )
    in_both = cells.filter("in_both").select(member).distinct()
    fillers = (
        in_both.orderBy(member).limit(2 * k).agg(F.collect_list(member).alias("names"))
    )
    observed = cells.filter("in_both").select("HORIZON", member, "delta")
    filled = (
        cells.select("HORIZON")
        .distinct()
        .select("HORIZON", F.explode(fillers.scalar()).alias(member), F.lit(0.0).alias("delta"))
    )
    merged = (
        observed.unionByName(filled)
        .groupBy("HORIZON", member)
        .agg(F.sum("delta").alias("delta"))
    )
    order = W.partitionBy("HORIZON").orderBy(F.desc(F.abs("delta")), F.asc(member))
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("HORIZON", "rank", member, "delta")
    )


def top_drivers(
    positions: DataFrame,
    views: dict[str, str] | None = None,
    k: int = TOP_K,
    dates: ReportDates = None,
) -> DataFrame:
    """Largest market-value changes per dimension: (view, rank, member, horizon, changes).

    All dimensions are compared in one pass with grouping sets.
    """
    views = views or DRIVER_VIEWS
    rows, is_latest, is_previous = last_two(positions, dates=dates)
    dims = list(views.values())
    ids = {
        name: sum(1 << (len(dims) - i) for i, d in enumerate(dims) if d != dim)
        for name, dim in views.items()
    }
    sums = (
        with_amounts(rows.filter(F.col("HORIZON").isNotNull()), ["VOLUME_BL", "MKT_VAL_BL"])
        .groupingSets([[d, "HORIZON"] for d in dims], *dims, "HORIZON")
        .agg(
            F.grouping_id().alias("gid"),
            *_side_sums(["VOLUME_BL", "MKT_VAL_BL"], is_latest, is_previous),
            F.count_if(is_latest).alias("n_latest"),
        )
    )
    view, who = F, F
    for name, dim in views.items():
        view = view.when(F.col("gid") == ids[name], F.lit(name))
        who = who.when(F.col("gid") == ids[name], F.col(dim))
    changes = (
        sums.filter(F.col("n_latest") > 0)
        .select(
            view.alias("view"),
            who.alias("member"),
            F.col("HORIZON").alias("horizon"),
            _delta("VOLUME_BL").alias("dv"),
            _delta("MKT_VAL_BL").alias("dm"),
        )
        .filter(F.col("member").isNotNull() & ((F.col("dv") != 0) | (F.col("dm") != 0)))
        .select(
            "view",
            "member",
            "horizon",
            rounded("dv").alias("delta_volume_bl"),
            rounded("dm").alias("delta_market_val_bl"),
        )
    )
    order = W.partitionBy("view").orderBy(
        F.desc(F.abs("delta_market_val_bl")), "member", "horizon"
    )
    return changes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
