"""Queries over power, gas and carbon positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions.dates import iso_date
from gridledger.functions.numbers import total_or_0
from gridledger.operators import cube, delta, reshape, stats, trend
from gridledger.plans import adhoc
from gridledger.sources import star
from workload.registry import as_double, dsum, dsum_null, exact_sum, query, round2

M9 = [m.lower() for m in specs.PW_MEASURES]


def _iso(df, *names):
    return df.withColumns({n: iso_date(n) for n in names})


# --- snapshot aggregates -------------------------------------------------------------


@query(
    "nop_summary",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {dsum('VOLUME_BL')} AS total_volume_bl,
               {dsum('MKT_VAL_BL')} AS total_market_bl FROM fx_pw GROUP BY REPORT_DATE""",
)
def nop_summary(spark, sf):
    return _iso(cube.nop_summary(star.power_positions(spark, sf)), "REPORT_DATE")


def _cube_sql(member: str, label: str, measures) -> str:
    sums = ", ".join(f"{dsum(m)} AS {m.lower()}" for m in measures)
    return f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {member}, {label}, {sums} FROM fx_pw
               WHERE {member} IS NOT NULL AND {label} IS NOT NULL GROUP BY REPORT_DATE, {member}, {label}"""


def _register_cube(name: str, view: str) -> None:
    member, label, measures = cube.VIEWS[view]

    @query(name, _cube_sql(member, label, measures))
    def run(spark, sf):
        positions = star.power_positions(spark, sf)
        return _iso(cube.cube_by(positions, member, label, measures), "REPORT_DATE")


for _name, _view in {
    "cube_segment_horizon": "by_segment_horizon",
    "cube_tgroup1_horizon": "by_tgroup1_horizon",
    "cube_book_attr8_horizon": "by_book_attr8_horizon",
    "cube_segment_bucket": "by_segment_bucket",
}.items():
    _register_cube(_name, _view)


def _build_cube_sql() -> str:
    parts = []
    for view, (member, label, measures) in cube.VIEWS.items():
        cells = ", ".join(
            f"{dsum(m) if m in measures else 'CAST(NULL AS DOUBLE)'} AS {m.lower()}"
            for m in specs.PW_MEASURES
        )
        parts.append(
            f"SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, '{view}' AS view, "
            f"{member} AS member, {label} AS label, {cells} FROM fx_pw "
            f"GROUP BY REPORT_DATE, {member}, {label}"
        )
    return " UNION ALL ".join(parts)


@query("build_cube", _build_cube_sql())
def build_cube(spark, sf):
    return _iso(cube.build_cube(star.power_positions(spark, sf)), "REPORT_DATE")


@query(
    "cube_documents_round_trip",
    "SELECT REPORT_DATE, view, member, label, "
    + ", ".join(f"COALESCE({m}, 0) AS {m}" for m in M9)
    + f" FROM ({_build_cube_sql()})",
)
def cube_documents_round_trip(spark, sf):
    stored = cube.cube_documents(cube.build_cube(star.power_positions(spark, sf)))
    return _iso(cube.explode_cube(stored), "REPORT_DATE")


# --- comparison of the last two reports ----------------------------------------------

_LAST_TWO = """d AS (SELECT DISTINCT REPORT_DATE AS dt FROM fx_pw ORDER BY dt DESC LIMIT 2),
p AS (SELECT MAX(dt) AS latest, MIN(dt) AS previous FROM d)"""


def _sides(keys: str, measures: list[str]) -> str:
    """CTEs `cur` and `prev`: sums per key on the latest and the previous date."""
    sums = ", ".join(f"{exact_sum(m)} AS {m}" for m in measures)
    return (
        f"WITH {_LAST_TWO}, "
        f"cur AS (SELECT {keys}, {sums} FROM fx_pw, p WHERE REPORT_DATE = latest GROUP BY {keys}), "
        f"prev AS (SELECT {keys}, {sums} FROM fx_pw, p WHERE REPORT_DATE = previous GROUP BY {keys})"
    )


def _exact_diff(a: str, b: str) -> str:
    """Difference of two exact sums as a double."""
    return as_double(f"(COALESCE({a}, 0) - COALESCE({b}, 0))")


def _register_deltas(suffix: str, keys: list[str]) -> None:
    k, using = ", ".join(keys), ", ".join(keys)

    @query(
        f"delta_inner_{suffix}",
        f"{_sides(k, ['VOLUME_BL'])} SELECT {k}, {_exact_diff('cur.VOLUME_BL', 'prev.VOLUME_BL')} AS delta "
        f"FROM cur JOIN prev USING ({using})",
    )
    def inner(spark, sf):
        return delta.delta_inner(star.power_positions(spark, sf), keys, "VOLUME_BL")

    @query(
        f"delta_left_{suffix}",
        f"""{_sides(k, ['VOLUME_BL', 'MKT_VAL_BL'])}, j AS (
            SELECT {k}, {_exact_diff('cur.VOLUME_BL', 'prev.VOLUME_BL')} AS dv,
                   {_exact_diff('cur.MKT_VAL_BL', 'prev.MKT_VAL_BL')} AS dm
            FROM cur LEFT JOIN prev USING ({using}))
            SELECT {k}, {round2('dv')} AS delta_volume_bl, {round2('dm')} AS delta_market_val_bl
            FROM j WHERE dv <> 0 OR dm <> 0""",
    )
    def left(spark, sf):
        return delta.delta_left(star.power_positions(spark, sf), keys)

    @query(
        f"delta_either_{suffix}",
        f"{_sides(k, ['MKT_VAL_BL'])} SELECT {k}, {_exact_diff('cur.MKT_VAL_BL', 'prev.MKT_VAL_BL')} AS delta "
        f"FROM cur FULL JOIN prev USING ({using})",
    )
    def either(spark, sf):
        return delta.delta_either(star.power_positions(spark, sf), keys, "MKT_VAL_BL")


for _suffix, _keys in {
    "segment_horizon": ["SEGMENT", "HORIZON"],
    "tgroup1_horizon": ["TGROUP1", "HORIZON"],
    "book_attr8_horizon": ["BOOK_ATTR8", "HORIZON"],
    "segment_bucket": ["SEGMENT", "BUCKET"],
    "book_by_class": ["BOOK", "BOOK_ATTR8"],
}.items():
    _register_deltas(_suffix, _keys)


def _full_sql(row: str, column: str) -> str:
    return f"""{_sides(f'{row}, {column}', ['MKT_VAL_BL'])},
        both_sides AS (SELECT {row}, {column} FROM cur UNION SELECT {row}, {column} FROM prev),
        r AS (SELECT DISTINCT {row} FROM both_sides), c AS (SELECT DISTINCT {column} FROM both_sides)
        SELECT r.{row}, c.{column}, {_exact_diff('cur.MKT_VAL_BL', 'prev.MKT_VAL_BL')} AS delta
        FROM r CROSS JOIN c
        LEFT JOIN cur ON cur.{row} = r.{row} AND cur.{column} = c.{column}
        LEFT JOIN prev ON prev.{row} = r.{row} AND prev.{column} = c.{column}"""


def _register_full(name: str, row: str, column: str) -> None:
    @query(name, _full_sql(row, column))
    def run(spark, sf):
        return delta.delta_full(star.power_positions(spark, sf), row, column, "MKT_VAL_BL")


_register_full("delta_full_horizon", "HORIZON", "SEGMENT")
_register_full("delta_full_bucket", "BUCKET", "SEGMENT")
_register_full("delta_full_book_by_class", "BOOK", "BOOK_ATTR8")

_SIGNED_CELL = (
    "concat(CASE WHEN delta > 0 THEN '+' ELSE '' END, "
    "regexp_replace(CAST(CAST(ROUND(CAST(delta AS DECIMAL(28,6)), 2) AS DECIMAL(28,2)) AS VARCHAR), '0$', ''))"
)


# Heat maps over all members of both reports.
@query("delta_matrix_horizon", _full_sql("HORIZON", "SEGMENT"))
def delta_matrix_horizon(spark, sf):
    return delta.delta_full(star.power_positions(spark, sf), "HORIZON", "SEGMENT", "MKT_VAL_BL")


@query("delta_matrix_bucket", _full_sql("BUCKET", "BOOK_ATTR8"))
def delta_matrix_bucket(spark, sf):
    return delta.delta_full(star.power_positions(spark, sf), "BUCKET", "BOOK_ATTR8", "MKT_VAL_BL")


@query(
    "delta_matrix_text",
    f"SELECT HORIZON, SEGMENT, {_SIGNED_CELL} AS delta FROM ({_full_sql('HORIZON', 'SEGMENT')})",
)
def delta_matrix_text(spark, sf):
    return delta.delta_text(delta_matrix_horizon(spark, sf))


@query(
    "delta_series",
    f"""WITH s AS (SELECT SEGMENT, HORIZON, REPORT_DATE, {exact_sum('VOLUME_BL')} AS v, {exact_sum('MKT_VAL_BL')} AS m
                   FROM fx_pw GROUP BY SEGMENT, HORIZON, REPORT_DATE),
        w AS (SELECT *, LAG(v) OVER (PARTITION BY SEGMENT, HORIZON ORDER BY REPORT_DATE) AS pv,
                     LAG(m) OVER (PARTITION BY SEGMENT, HORIZON ORDER BY REPORT_DATE) AS pm FROM s)
        SELECT SEGMENT, HORIZON, CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {as_double('v')} AS VOLUME_BL, {as_double('m')} AS MKT_VAL_BL,
               {as_double('(v - pv)')} AS delta_VOLUME_BL, {as_double('(m - pm)')} AS delta_MKT_VAL_BL FROM w""",
)
def delta_series(spark, sf):
    series = delta.delta_series(
        star.power_positions(spark, sf), ["SEGMENT", "HORIZON"], ["VOLUME_BL", "MKT_VAL_BL"]
    )
    return _iso(series, "REPORT_DATE")


@query(
    "latest_reports",
    """WITH d AS (SELECT DISTINCT category, report_date FROM fx_files),
       r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY report_date DESC) AS age FROM d)
       SELECT category, CAST(report_date AS VARCHAR) AS report_date, CAST(age - 1 AS INT) AS reports_back
       FROM r WHERE age <= 2""",
)
def latest_reports(spark, sf):
    newest = delta.latest_reports(star.data_files(spark, sf), 2, date="report_date")
    return _iso(newest, "report_date")


def _grouped(v: str) -> str:
    return f"format('{{:,}}', CAST(ROUND(CAST({v} AS DECIMAL(28,6)), 0) AS BIGINT))"


@query(
    "nop_card",
    f"""WITH {_LAST_TWO},
        s AS (SELECT CAST(MAX(latest) AS VARCHAR) AS as_of,
            {exact_sum('CASE WHEN REPORT_DATE = latest THEN VOLUME_BL END')} AS v1,
            {exact_sum('CASE WHEN REPORT_DATE = previous THEN VOLUME_BL END')} AS v0,
            {exact_sum('CASE WHEN REPORT_DATE = latest THEN MKT_VAL_BL END')} AS m1,
            {exact_sum('CASE WHEN REPORT_DATE = previous THEN MKT_VAL_BL END')} AS m0 FROM fx_pw, p),
        t AS (SELECT as_of, {as_double('v1')} AS volume, {_exact_diff('v1', 'v0')} AS delta_volume, {as_double('m1')} AS market,
                     {_exact_diff('m1', 'm0')} AS delta_market FROM s),
        u AS (SELECT *, CASE WHEN delta_volume > 0 THEN '+' WHEN delta_volume < 0 THEN '-' ELSE '' END AS volume_sign,
                     CASE WHEN delta_market > 0 THEN '+' WHEN delta_market < 0 THEN '-' ELSE '' END AS market_sign FROM t)
        SELECT *, concat({_grouped('volume')}, 'MW') AS volume_text, {_grouped('market')} AS market_text,
               concat(volume_sign, {_grouped('abs(delta_volume)')}, 'MW') AS delta_volume_text,
               concat(market_sign, {_grouped('abs(delta_market)')}) AS delta_market_text FROM u""",
)
def nop_card(spark, sf):
    return _iso(delta.nop_card(star.power_positions(spark, sf)), "as_of")


def _movers_sql(member: str, measure: str, horizon: str | None) -> str:
    cells = f"{member}, HORIZON"
    picked = f"WHERE h.HORIZON = '{horizon}'" if horizon else ""
    ranked = f"""{_sides(cells, [measure])},
        both_dates AS (SELECT DISTINCT {member} FROM cur INTERSECT SELECT DISTINCT {member} FROM prev),
        h AS (SELECT HORIZON FROM cur UNION SELECT HORIZON FROM prev),
        g AS (SELECT h.HORIZON, b.{member}, {_exact_diff(f'cur.{measure}', f'prev.{measure}')} AS delta
              FROM both_dates b CROSS JOIN h
              LEFT JOIN cur ON cur.{member} = b.{member} AND cur.HORIZON = h.HORIZON
              LEFT JOIN prev ON prev.{member} = b.{member} AND prev.HORIZON = h.HORIZON {picked}),
        k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY HORIZON ORDER BY abs(delta) DESC, {member}) AS INT) AS rank FROM g)"""
    columns = f"{member}, delta" if horizon else f"HORIZON, rank, {member}, delta"
    return f"{ranked} SELECT {columns} FROM k WHERE rank <= 5"


@query("top_movers_segment", _movers_sql("SEGMENT", "VOLUME_BL", "M+1"))
def top_movers_segment(spark, sf):
    return delta.top_movers(star.power_positions(spark, sf), "SEGMENT", "M+1", "VOLUME_BL")


def _register_movers(name: str, member: str, measure: str) -> None:
    @query(name, _movers_sql(member, measure, None))
    def run(spark, sf):
        return delta.top_movers_all(star.power_positions(spark, sf), member, measure)


_register_movers("top_movers_all_segment", "SEGMENT", "MKT_VAL_BL")
_register_movers("top_movers_all_book_attr8", "BOOK_ATTR8", "VOLUME_BL")
_register_movers("top_movers_all_tgroup1", "TGROUP1", "MKT_VAL_BL")
_register_movers("top_movers_all_book", "BOOK", "MKT_VAL_BL")


def _drivers_sql() -> str:
    sums = f"{exact_sum('VOLUME_BL')} AS v, {exact_sum('MKT_VAL_BL')} AS m"
    cur, prev = [], []
    for view, dim in delta.DRIVER_VIEWS.items():
        for out, side in ((cur, "latest"), (prev, "previous")):
            out.append(
                f"SELECT '{view}' AS view, {dim} AS member, HORIZON AS horizon, {sums} "
                f"FROM fx_pw, p WHERE REPORT_DATE = {side} GROUP BY {dim}, HORIZON"
            )
    return f"""WITH {_LAST_TWO}, cur AS ({' UNION ALL '.join(cur)}), prev AS ({' UNION ALL '.join(prev)}),
        j AS (SELECT view, member, horizon, {_exact_diff('cur.v', 'prev.v')} AS dv, {_exact_diff('cur.m', 'prev.m')} AS dm
              FROM cur LEFT JOIN prev USING (view, member, horizon)),
        n AS (SELECT view, member, horizon, {round2('dv')} AS delta_volume_bl, {round2('dm')} AS delta_market_val_bl
              FROM j WHERE dv <> 0 OR dm <> 0),
        r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY view
                ORDER BY abs(delta_market_val_bl) DESC, member, horizon) AS INT) AS rank FROM n)
        SELECT * FROM r WHERE rank <= 5"""


@query("top_drivers", _drivers_sql())
def top_drivers(spark, sf):
    return delta.top_drivers(star.power_positions(spark, sf))


# --- trends --------------------------------------------------------------------------

_BY_BOOK_DATE = f"""WITH s AS (SELECT BOOK, REPORT_DATE, {dsum('VOLUME_BL')} AS VOLUME_BL FROM fx_pw GROUP BY BOOK, REPORT_DATE),
    r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY BOOK ORDER BY REPORT_DATE DESC) AS INT) AS age FROM s)"""


@query(
    "latest_n_per_group",
    f"""{_BY_BOOK_DATE} SELECT BOOK, CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, VOLUME_BL, age
        FROM r WHERE age <= 4""",
)
def latest_n_per_group(spark, sf):
    return _iso(trend.latest_n_per_group(star.power_positions(spark, sf), "BOOK", 3), "REPORT_DATE")


def _trend_sql(n: int, sign: str) -> str:
    return f"""{_BY_BOOK_DATE},
        k AS (SELECT *, LAG(VOLUME_BL) OVER (PARTITION BY BOOK ORDER BY REPORT_DATE) AS before FROM r WHERE age <= {n + 1})
        SELECT BOOK, CAST(MAX(REPORT_DATE) AS VARCHAR) AS last_date, arg_min(VOLUME_BL, REPORT_DATE) AS first_value,
               arg_max(VOLUME_BL, REPORT_DATE) AS last_value
        FROM k GROUP BY BOOK
        HAVING COUNT(before) = {n} AND COUNT(CASE WHEN VOLUME_BL {sign} before THEN 1 END) = {n}"""


@query("consecutive_fall", _trend_sql(2, "<"))
def consecutive_fall(spark, sf):
    return _iso(trend.consecutive_trend(star.power_positions(spark, sf), 2, "down"), "last_date")


@query("consecutive_rise", _trend_sql(1, ">"))
def consecutive_rise(spark, sf):
    return _iso(trend.consecutive_trend(star.power_positions(spark, sf), 1, "up"), "last_date")


@query(
    "nop_by_date",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {dsum('VOLUME_BL')} AS NATION_3_VOLUME_BL
        FROM fx_pw WHERE BOOK = 'NATION_3' GROUP BY REPORT_DATE ORDER BY 1 DESC""",
)
def nop_by_date(spark, sf):
    rows = trend.nop_by_date(star.power_positions(spark, sf), "BOOK", "NATION_3")
    return _iso(rows, "REPORT_DATE")


@query(
    "nop_by_date_monetary",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {dsum('MKT_VAL_BL')} AS MKT_VAL_BL
        FROM fx_pw GROUP BY REPORT_DATE ORDER BY 1 DESC""",
)
def nop_by_date_monetary(spark, sf):
    return _iso(trend.nop_by_date(star.power_positions(spark, sf), monetary=True), "REPORT_DATE")


@query(
    "last_period",
    f"""SELECT BOOK, CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {dsum('VOLUME_BL')} AS volume_bl FROM fx_pw
        WHERE REPORT_DATE > (SELECT MAX(REPORT_DATE) - INTERVAL 6 MONTH FROM fx_pw) GROUP BY BOOK, REPORT_DATE""",
)
def last_period(spark, sf):
    recent = trend.last_period(star.power_positions(spark, sf), 6)
    return _iso(
        recent.groupBy("BOOK", "REPORT_DATE").agg(total_or_0("VOLUME_BL").alias("volume_bl")),
        "REPORT_DATE",
    )


# --- descriptive statistics ----------------------------------------------------------


def _stat_sql(spec: specs.FeedSpec, source: str, deviation: str = "STDDEV_SAMP({v})") -> str:
    keys = ", ".join(spec.stat_dims)
    outputs = []
    for m in spec.measures:
        v = f"COALESCE({m}, 0)"
        forms = {
            "TOTAL": dsum_null(v),
            "AVG": f"{dsum_null(v)} / COUNT({v})",
            "MIN": f"MIN({v})",
            "MAX": f"MAX({v})",
            "STD": deviation.format(v=v),
        }
        outputs += [f"{forms[s]} AS {s}_{m}" for s in spec.statistics]
    return (
        f"SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {keys}, {', '.join(outputs)} "
        f"FROM {source} GROUP BY REPORT_DATE, {keys}"
    )


FEED_SOURCES = {
    "CO2": (star.carbon_positions, "fx_co2"),
    "NG": (star.gas_positions, "fx_ng"),
    "PW": (star.power_positions, "fx_pw"),
}


def _stored_stats(spark, sf, spec):
    """Statistics as they are stored: rounded to two decimals."""
    read, _ = FEED_SOURCES[spec.category]
    return stats.round_record(stats.daily_stats(read(spark, sf), spec))


def _stored_sql(spec: specs.FeedSpec) -> str:
    _, view = FEED_SOURCES[spec.category]
    metrics = list(spec.metric_catalog.values())
    cells = ", ".join(f"{round2(m)} AS {m}" for m in metrics)
    keys = ", ".join(spec.stat_dims)
    return f"SELECT REPORT_DATE, {keys}, {cells} FROM ({_stat_sql(spec, view)})"


def _register_stats(spec: specs.FeedSpec) -> None:
    read, view = FEED_SOURCES[spec.category]
    low = spec.category.lower()

    @query(f"daily_stats_{low}", _stat_sql(spec, view, "ROUND(STDDEV_SAMP({v}), 4)"))
    def daily(spark, sf):
        out = stats.daily_stats(read(spark, sf), spec)
        deviations = [c for c in out.columns if c.startswith("STD_")]
        return _iso(out.withColumns({c: F.round(c, 4) for c in deviations}), "REPORT_DATE")

    @query(
        f"combined_totals_{low}",
        f"SELECT REPORT_DATE, {', '.join(f'{dsum(t)} AS {t}' for t in spec.total_metrics)} "
        f"FROM ({_stored_sql(spec)}) GROUP BY REPORT_DATE",
    )
    def totals(spark, sf):
        return _iso(stats.combined_totals(_stored_stats(spark, sf, spec), spec), "REPORT_DATE")


for _spec in specs.FEEDS.values():
    _register_stats(_spec)


@query("round_record", _stored_sql(specs.CO2))
def round_record(spark, sf):
    return _iso(_stored_stats(spark, sf, specs.CO2), "REPORT_DATE")


@query(
    "stats_documents_round_trip",
    f"SELECT 'NOP_CO2_all.csv' AS file_name, s.* FROM ({_stored_sql(specs.CO2)}) s",
)
def stats_documents_round_trip(spark, sf):
    daily = stats.daily_stats(star.carbon_positions(spark, sf), specs.CO2)
    documents = stats.stats_documents(daily, "NOP_CO2_all.csv")
    records, _ = stats.explode_stats(documents, specs.CO2)
    return _iso(records, "REPORT_DATE")


@query(
    "stats_all_feeds",
    "SELECT category, REPORT_DATE, CAST(COUNT(*) AS BIGINT) AS n_groups, "
    f"{dsum('TOTAL_VOLUME')} AS TOTAL_VOLUME, {dsum('TOTAL_MKT_VAL')} AS TOTAL_MKT_VAL FROM ("
    f"SELECT 'CO2' AS category, REPORT_DATE, TOTAL_VOLUME, CAST(NULL AS DOUBLE) AS TOTAL_MKT_VAL FROM ({_stored_sql(specs.CO2)}) "
    f"UNION ALL SELECT 'NG', REPORT_DATE, TOTAL_VOLUME, TOTAL_MKT_VAL FROM ({_stored_sql(specs.NG)})) "
    "GROUP BY category, REPORT_DATE",
)
def stats_all_feeds(spark, sf):
    parts = [
        _stored_stats(spark, sf, spec).withColumn("category", F.lit(spec.category))
        for spec in (specs.CO2, specs.NG)
    ]
    together = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _iso(
        together.groupBy("category", "REPORT_DATE").agg(
            F.count("*").alias("n_groups"),
            total_or_0("TOTAL_VOLUME").alias("TOTAL_VOLUME"),
            total_or_0("TOTAL_MKT_VAL").alias("TOTAL_MKT_VAL"),
        ),
        "REPORT_DATE",
    )


_SERIES = ["TOTAL_VOLUME_BL", "TOTAL_MKT_VAL_BL", "MAX_TRD_VAL_BL"]


@query(
    "metric_series",
    " UNION ALL ".join(
        f"SELECT REPORT_DATE AS Date, '{m}' AS Metric, {dsum_null(m)} / COUNT({m}) AS Value "
        f"FROM ({_stored_sql(specs.PW)}) GROUP BY REPORT_DATE"
        for m in _SERIES
    ),
)
def metric_series(spark, sf):
    return _iso(stats.metric_series(_stored_stats(spark, sf, specs.PW), _SERIES), "Date")


@query(
    "totals_long",
    " UNION ALL ".join(
        f"SELECT REPORT_DATE AS Date, '{m}' AS Metric, {dsum(m)} AS Value "
        f"FROM ({_stored_sql(specs.NG)}) GROUP BY REPORT_DATE"
        for m in specs.NG.total_metrics
    ),
)
def totals_long(spark, sf):
    totals = stats.combined_totals(_stored_stats(spark, sf, specs.NG), specs.NG)
    return _iso(stats.to_long(totals, specs.NG.total_metrics), "Date")


_ON_DATE = ["TOTAL_VOLUME", "AVG_MKTVAL"]


@query(
    "metrics_on_date",
    f"WITH s AS ({_stored_sql(specs.CO2)}), x AS (SELECT * FROM s WHERE REPORT_DATE = (SELECT MAX(REPORT_DATE) FROM s)), "
    "f AS (SELECT * FROM x ORDER BY BOOK, SEGMENT, TGROUP1 LIMIT 1) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS Metric, (SELECT COALESCE({m}, 0) FROM f) AS first_value, {dsum(m)} AS total_value FROM x"
        for m in _ON_DATE
    ),
)
def metrics_on_date(spark, sf):
    stored = _stored_stats(spark, sf, specs.CO2)
    newest = star.carbon_positions(spark, sf).agg(F.max("REPORT_DATE")).scalar()
    return stats.metrics_on_date(stored, specs.CO2, _ON_DATE, newest)


@query(
    "is_single_date",
    """SELECT CAST(COUNT(DISTINCT REPORT_DATE) AS BIGINT) AS n_dates, COUNT(DISTINCT REPORT_DATE) = 1 AS single_date FROM fx_pw""",
)
def is_single_date(spark, sf):
    return stats.is_single_date(star.power_positions(spark, sf))


@query(
    "dimension_view",
    f"SELECT BOOK, {dsum('TOTAL_VOLUME')} AS TOTAL_VOLUME, {dsum('TOTAL_MKTVAL')} AS TOTAL_MKTVAL "
    f"FROM ({_stored_sql(specs.CO2)}) GROUP BY BOOK ORDER BY 2 DESC, 1",
)
def dimension_view(spark, sf):
    stored = _stored_stats(spark, sf, specs.CO2)
    return stats.dimension_view(stored, ["TOTAL_VOLUME", "TOTAL_MKTVAL"])


@query(
    "keep_latest_report",
    f"""WITH n AS (SELECT BOOK, MAX(REPORT_DATE) AS REPORT_DATE FROM fx_pw GROUP BY BOOK)
        SELECT BOOK, CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, CAST(COUNT(*) AS BIGINT) AS n_rows,
               {dsum('VOLUME_BL')} AS volume_bl
        FROM fx_pw JOIN n USING (BOOK, REPORT_DATE) GROUP BY BOOK, REPORT_DATE""",
)
def keep_latest_report(spark, sf):
    newest = stats.keep_latest_report(star.power_positions(spark, sf), by="BOOK")
    return _iso(
        newest.groupBy("BOOK", "REPORT_DATE").agg(
            F.count("*").alias("n_rows"), total_or_0("VOLUME_BL").alias("volume_bl")
        ),
        "REPORT_DATE",
    )


@query(
    "filter_report_date",
    f"SELECT SEGMENT, {dsum('VOLUME_BL')} AS volume_bl, CAST(COUNT(*) AS BIGINT) AS n_rows FROM fx_pw "
    "WHERE REPORT_DATE = DATE '1998-03-01' GROUP BY SEGMENT",
)
def filter_report_date(spark, sf):
    rows = trend.filter_report_date(star.power_positions(spark, sf), "1998-03-01")
    return rows.groupBy("SEGMENT").agg(
        total_or_0("VOLUME_BL").alias("volume_bl"), F.count("*").alias("n_rows")
    )


# --- charts over stored delta records ------------------------------------------------


@query(
    "legacy_horizon_sums",
    f"""WITH s AS (SELECT SEGMENT, HORIZON, REPORT_DATE, {dsum('VOLUME_BL')} AS v FROM fx_pw GROUP BY SEGMENT, HORIZON, REPORT_DATE),
        w AS (SELECT *, v - LAG(v) OVER (PARTITION BY SEGMENT, HORIZON ORDER BY REPORT_DATE) AS d FROM s)
        SELECT HORIZON, {dsum('d')} AS delta_volume_bl FROM w WHERE SEGMENT = 'BUILDING' GROUP BY HORIZON ORDER BY HORIZON""",
)
def legacy_horizon_sums(spark, sf):
    series = delta.delta_series(star.power_positions(spark, sf), ["SEGMENT", "HORIZON"], ["VOLUME_BL"])
    records = series.withColumnRenamed("delta_VOLUME_BL", "delta_volume_bl")
    return reshape.horizon_sums(records, "SEGMENT", "BUILDING", "delta_volume_bl")


# --- ad-hoc SQL ----------------------------------------------------------------------

_ADHOC = """SELECT SEGMENT, COUNT(*) AS n_rows, MIN(VOLUME_BL) AS smallest, MAX(MKT_VAL_BL) AS largest
FROM {table} WHERE TGROUP1 = '1-URGENT' AND VOLUME_BL < 0 GROUP BY SEGMENT ORDER BY SEGMENT"""


@query("run_sql", _ADHOC.format(table="fx_pw"))
def run_sql(spark, sf):
    adhoc.register_feeds({"PW": star.power_positions(spark, sf)})
    return adhoc.run_sql(spark, _ADHOC.format(table="PW_raw_data"))


_ADHOC_WINDOW = """SELECT BOOK, n_rows, volume FROM (
  SELECT BOOK, COUNT(*) AS n_rows, CAST(SUM(CAST(VOLUME AS DECIMAL(18,4))) AS DOUBLE) AS volume,
         RANK() OVER (ORDER BY COUNT(*) DESC, BOOK) AS pos
  FROM {table} WHERE REPORT_DATE >= DATE '1999-01-01' GROUP BY BOOK HAVING COUNT(*) > 1) ranked WHERE pos <= 10"""


@query("run_sql_ranked", _ADHOC_WINDOW.format(table="fx_ng"))
def run_sql_ranked(spark, sf):
    adhoc.register_feeds({"NG": star.gas_positions(spark, sf)})
    return adhoc.run_sql(spark, _ADHOC_WINDOW.format(table="NG_raw_data"))


_TEXT_COLUMNS = ["SEGMENT", "HORIZON", "BOOK", "BUCKET"]


@query(
    "result_text",
    "WITH t AS (SELECT DISTINCT SEGMENT, HORIZON, BOOK, BUCKET FROM fx_pw) "
    "SELECT concat_ws(' | ', SEGMENT, HORIZON, BOOK, BUCKET) AS line FROM t",
)
def result_text(spark, sf):
    rows = star.power_positions(spark, sf).select(*_TEXT_COLUMNS).distinct()
    return reshape.result_text(rows)


def _guard_sql(limit: int) -> str:
    return f"""WITH t AS (SELECT DISTINCT SEGMENT, HORIZON, BOOK, BUCKET FROM fx_pw),
      w AS (SELECT CAST(COALESCE(SUM(len(string_split_regex(concat_ws(' | ', SEGMENT, HORIZON, BOOK, BUCKET), '\\s+'))), 0) + 7 AS BIGINT) AS n_words FROM t)
      SELECT n_words, n_words <= {limit} AS fits, CASE WHEN n_words > {limit} THEN '{reshape.SIZE_ADVICE}' END AS advice FROM w"""


@query("size_guard", _guard_sql(reshape.SIZE_LIMIT))
def size_guard(spark, sf):
    rows = star.power_positions(spark, sf).select(*_TEXT_COLUMNS).distinct()
    return reshape.size_guard(rows)


@query(
    "translate_codes",
    """WITH c AS (SELECT BOOK AS code, CAST(COUNT(*) AS BIGINT) AS n_rows FROM fx_pw GROUP BY 1
               UNION ALL SELECT SEGMENT, CAST(COUNT(*) AS BIGINT) FROM fx_pw GROUP BY 1)
       SELECT code, n_rows, COALESCE('Country ' || n.n_nationkey, code) AS label
       FROM c LEFT JOIN nation n ON code = n.n_name""",
)
def translate_codes(spark, sf):
    # Books are nations and have an entry; segments have none and keep their code.
    positions = star.power_positions(spark, sf)
    codes = [
        positions.groupBy(F.col(c).alias("code")).agg(F.count("*").alias("n_rows"))
        for c in ("BOOK", "SEGMENT")
    ]
    both = codes[0].unionByName(codes[1])
    return reshape.translate_codes(both, _glossary(spark, sf), "code", "label")


def _glossary(spark, sf):
    return star.table(spark, sf, "nation").select(
        F.col("n_name").alias("context_name"),
        F.concat(F.lit("Country "), F.col("n_nationkey").cast("string")).alias("description"),
    )


@query(
    "glossary_text",
    "SELECT concat(n_name, ': ', 'Country ', n_nationkey) AS line FROM nation",
)
def glossary_text(spark, sf):
    return reshape.glossary_text(_glossary(spark, sf))


@query(
    "records_json_round_trip",
    f"SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, {dsum('VOLUME_BL')} AS total_volume_bl, "
    f"{dsum('MKT_VAL_BL')} AS total_market_bl FROM fx_pw GROUP BY REPORT_DATE",
)
def records_json_round_trip(spark, sf):
    records = reshape.records_json(cube.nop_summary(star.power_positions(spark, sf)))
    parsed = reshape.records_from_json(
        records, "REPORT_DATE date, total_volume_bl double, total_market_bl double"
    )
    return _iso(parsed, "REPORT_DATE")
