"""Per-report-date aggregates of power positions.

Every aggregate has a map-side half, so one book, segment or report date holding a
large share of the rows costs one partial row per task, not one oversized task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import (
    amount_sums,
    joined,
    summed_or_0,
    total_or_0,
    value,
    with_amounts,
)
from gridledger.specs import PW_MEASURES

# The views a daily snapshot holds, as (member, label, measures).
VIEWS = {
    "by_segment_horizon": ("SEGMENT", "HORIZON", PW_MEASURES),
    "by_tgroup1_horizon": ("TGROUP1", "HORIZON", PW_MEASURES),
    "by_book_attr8_horizon": ("BOOK_ATTR8", "HORIZON", PW_MEASURES),
    "by_segment_bucket": ("SEGMENT", "BUCKET", ("MKT_VAL_BL",)),
}

DIMENSIONS = ("SEGMENT", "TGROUP1", "BOOK_ATTR8", "HORIZON", "BUCKET")


def nop_summary(positions: DataFrame) -> DataFrame:
    """Net open volume and market value per report date."""
    return (
        positions.filter(F.col("REPORT_DATE").isNotNull())
        .groupBy("REPORT_DATE")
        .agg(
            total_or_0("VOLUME_BL").alias("total_volume_bl"),
            total_or_0("MKT_VAL_BL").alias("total_market_bl"),
        )
    )


def cube_by(
    positions: DataFrame, member: str, label: str, measures: tuple[str, ...] = PW_MEASURES
) -> DataFrame:
    """Sums per (report date, member, label); rows without a key are left out."""
    keys = ["REPORT_DATE", member, label]
    present = positions
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    sums = [s for m in measures for s in amount_sums(m)]
    rolled = with_amounts(present, measures).groupBy(*keys).agg(*sums)
    return rolled.select(*keys, *[summed_or_0(m).alias(m.lower()) for m in measures])


def build_cube(positions: DataFrame) -> DataFrame:
    """All views of a snapshot as one long frame.

    Columns: REPORT_DATE, view, member, label and nine sums (null where the view does not
    carry the measure). One scan serves all views: each row is expanded into the grouping
    sets and combined before the shuffle, which then carries groups, not positions.
    """
    rolled = _rolled(positions, (), [s for m in PW_MEASURES for s in amount_sums(m)])
    figures = {m: summed_or_0(m) for m in PW_MEASURES}
    # Figures first: a view then picks finished columns.
    rolled = rolled.select(
        "REPORT_DATE", *DIMENSIONS, "gid", *[c.alias(m.lower()) for m, c in figures.items()]
    )
    kept = [
        _by_view(
            lambda _, __, ___, kept, m=m: F.col(m.lower()) if m in kept else F.lit(None)
        ).alias(m.lower())
        for m in PW_MEASURES
    ]
    return _as_views(rolled, (), kept)


def _rolled(positions: DataFrame, extra: tuple[str, ...], sums: list[Column]) -> DataFrame:
    """All groupings of a snapshot in one pass, with their `gid`; also by the extra keys."""
    sets = [["REPORT_DATE", *extra, member, label] for member, label, _ in VIEWS.values()]
    return (
        with_amounts(positions.filter(F.col("REPORT_DATE").isNotNull()), PW_MEASURES)
        .groupingSets(sets, "REPORT_DATE", *extra, *DIMENSIONS)
        .agg(F.grouping_id().alias("gid"), *sums)
    )


def _by_view(pick) -> Column:
    # grouping_id sets a bit for each column that is rolled up.
    width = len(DIMENSIONS)
    out = F
    for name, (member, label, measures) in VIEWS.items():
        gid = sum(
            1 << (width - 1 - i) for i, d in enumerate(DIMENSIONS) if d not in (member, label)
        )
        out = out.when(F.col("gid") == gid, pick(name, member, label, measures))
    return out


def _as_views(rolled: DataFrame, extra: tuple[str, ...], figures: list[Column]) -> DataFrame:
    long = rolled.select(
        "REPORT_DATE",
        *extra,
        _by_view(lambda name, *_: F.lit(name)).alias("view"),
        _by_view(lambda _, member, *__: F.col(member)).alias("member"),
        _by_view(lambda _, __, label, ___: F.col(label)).alias("label"),
        *figures,
    )
    return long.filter(F.col("member").isNotNull() & F.col("label").isNotNull())


# --- states: what a snapshot can be put together from, and taken apart into ------------


def cube_states(positions: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The cells of `build_cube` as additive states: n_rows and, per measure, plain sums and counts.

    States of different files add up to the state of their union, and a file's state can be
    subtracted again: the sums are whole numbers. Only wild amounts (infinite, or beyond 4e18)
    are doubles, which cannot be subtracted; their number says which cells hold any.
    """
    sums = [F.count("*").alias("n_rows")]
    for m in PW_MEASURES:
        sums += [*amount_sums(m), F.count(F.when(F.col(f"_whole_{m}").isNull(), F.col(m))).alias(f"_n_wild_{m}")]
        sums.append(F.count(m).alias(f"_n_{m}"))
    states = _as_views(_rolled(positions, extra, sums), extra, [F.col(c) for c in STATE_COLUMNS])
    return states.select(*extra, *CELL, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in STATE_COLUMNS])


CELL = ("REPORT_DATE", "view", "member", "label")
STATE_COLUMNS = (
    "n_rows",
    *(f"_{kind}_{m}" for m in PW_MEASURES for kind in ("high", "low", "units", "wild", "n_wild", "n")),
)


def add_states(states: DataFrame) -> DataFrame:
    """One state per cell; cells that no row is left of are gone."""
    whole = states.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in STATE_COLUMNS])
    return whole.filter("n_rows > 0")


def cube_of_states(states: DataFrame) -> DataFrame:
    """The rows of `build_cube` from one state per cell."""

    def figure(m: str) -> Column:
        sums = {kind: F.col(f"_{kind}_{m}") for kind in ("high", "low", "units")}
        wild = F.when(F.col(f"_n_wild_{m}") > 0, F.col(f"_wild_{m}"))
        shown = F.when(F.col(f"_n_{m}") > 0, value(joined({**sums, "wild": wild}))).otherwise(F.lit(0.0))
        views = [name for name, (_, _, measures) in VIEWS.items() if m in measures]
        return F.when(F.col("view").isin(views), shown).alias(m.lower())

    return states.select(*CELL, *[figure(m) for m in PW_MEASURES])


def build_cube_by_union(positions: DataFrame) -> DataFrame:
    """The same frame from one aggregation per view."""
    parts = []
    for name, (member, label, measures) in VIEWS.items():
        part = cube_by(positions, member, label, measures)
        parts.append(
            part.select(
                "REPORT_DATE",
                F.lit(name).alias("view"),
                F.col(member).alias("member"),
                F.col(label).alias("label"),
                *[
                    F.col(m.lower())
                    if m in measures
                    else F.lit(None).cast("double").alias(m.lower())
                    for m in PW_MEASURES
                ],
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nest_cube(cube: DataFrame) -> DataFrame:
    """Document form: one row per (report date, view, member) with a map label -> measures.

    The input is aggregated already, so a map holds one entry per label of a member.
    """
    measures = [m.lower() for m in PW_MEASURES]
    return cube.groupBy("REPORT_DATE", "view", "member").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("label", F.struct(*measures).alias("values"))))
        ).alias("labels")
    )


def cube_documents(cube: DataFrame) -> DataFrame:
    """`nest_cube` with the map as JSON text, ready to be stored."""
    return nest_cube(cube).withColumn("labels", F.to_json("labels"))


def explode_cube(documents: DataFrame) -> DataFrame:
    """Flat cube from `cube_documents`; a missing measure reads 0."""
    measures = [m.lower() for m in PW_MEASURES]
    values = ", ".join(f"{m}: double" for m in measures)
    parsed = documents.withColumn(
        "labels", F.from_json("labels", f"map<string, struct<{values}>>")
    )
    return parsed.select(
        "REPORT_DATE", "view", "member", F.explode("labels").alias("label", "values")
    ).select(
        "REPORT_DATE",
        "view",
        "member",
        "label",
        *[F.coalesce(F.col(f"values.{m}"), F.lit(0.0)).alias(m) for m in measures],
    )
