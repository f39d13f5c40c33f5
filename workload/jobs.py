"""Queries that go through stored tables, dirty cells and streams.

Tables are written below the shared folder of the session and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions import dates, numbers
from gridledger.functions.dates import iso_date
from gridledger.operators import cube, delta, quality, stats
from gridledger.plans.ingest import Store, rebuild_snapshots
from gridledger.session import new_table_dir
from gridledger.sources import star, tables
from gridledger.streaming import jobs
from workload.operations import validate_schema
from workload.positions import _build_cube_sql, _exact_diff, _sides, _stat_sql
from workload.registry import SQL, as_double, dsum, query

# --- dirty cells ---------------------------------------------------------------------

_AMOUNTS = """SELECT o_orderkey AS cell_id, CASE CAST(o_orderkey % 5 AS INT)
    WHEN 0 THEN format('{:,.2f}', o_totalprice) WHEN 1 THEN concat(' -', format('{:,.2f}', o_totalprice), ' ')
    WHEN 2 THEN 'n/a' WHEN 3 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS cell FROM orders"""


def _amount_cells(spark, sf):
    """Order totals written the way feeds write them: separators, signs, blanks, junk."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    grouped = F.format_number(price.cast("decimal(18,2)"), 2)
    cell = (
        F.when(key % 5 == 0, grouped)
        .when(key % 5 == 1, F.concat(F.lit(" -"), grouped, F.lit(" ")))
        .when(key % 5 == 2, "n/a")
        .when(key % 5 == 3, "")
        .otherwise(price.cast("decimal(18,2)").cast("string"))
    )
    return star.table(spark, sf, "orders").select(key.alias("cell_id"), cell.alias("cell"))


@query(
    "parse_amounts",
    f"""WITH c AS ({_AMOUNTS}), n AS (SELECT *, TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE) AS amount FROM c)
        SELECT cell_id, amount, COALESCE(amount, 0) AS amount_or_0, amount IS NULL AND trim(cell) <> '' AS is_junk FROM n""",
)
def parse_amounts(spark, sf):
    return _amount_cells(spark, sf).select(
        "cell_id",
        numbers.parse_number("cell").alias("amount"),
        numbers.parse_number_fill0("cell").alias("amount_or_0"),
        numbers.is_junk_number("cell").alias("is_junk"),
    )


_ODD_CELLS = """SELECT l_orderkey, l_linenumber, l_returnflag,
    CASE CAST(l_orderkey % 8 AS INT)
      WHEN 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,6)) / 1000000 + 0.000001 AS VARCHAR)
      WHEN 1 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'e15')
      WHEN 2 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'D')
      WHEN 3 THEN CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'Infinity' ELSE '-0.000040' END
      WHEN 4 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'f')
      WHEN 5 THEN concat('-', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '.123456')
      ELSE concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '000000.000001') END AS cell
  FROM lineitem"""


def _odd_cells(spark, sf):
    """Quantities as cells with many decimals, huge exponents, infinities and type suffixes."""
    key, amount = F.col("l_orderkey"), F.col("l_quantity")
    whole = amount.cast("bigint").cast("string")
    kind = key % 8
    small = (amount.cast("decimal(18,6)") / F.lit(1000000) + F.lit("0.000001").cast("decimal(7,6)"))
    endless = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7)
    cell = (
        F.when(kind == 0, small.cast("decimal(18,12)").cast("string"))
        .when(kind == 1, F.concat(whole, F.lit("e15")))
        .when(kind == 2, F.concat(whole, F.lit("D")))
        .when(kind == 3, F.when(endless, "Infinity").otherwise("-0.000040"))
        .when(kind == 4, F.concat(whole, F.lit("f")))
        .when(kind == 5, F.concat(F.lit("-"), whole, F.lit(".123456")))
        .otherwise(F.concat(whole, F.lit("000000.000001")))
    )
    return star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", cell.alias("cell")
    )


@query(
    "exact_totals",
    f"""WITH c AS ({_ODD_CELLS}),
        n AS (SELECT *, CASE WHEN regexp_matches(cell, '[Df]$') THEN NULL ELSE TRY_CAST(cell AS DOUBLE) END AS v FROM c)
        SELECT l_returnflag, CAST(l_linenumber AS INT) AS l_linenumber,
               CAST(COUNT(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_junk,
               CASE WHEN bool_or(isinf(v)) THEN 'Infinity'::DOUBLE
                    ELSE {as_double("SUM(CASE WHEN isfinite(v) THEN TRY_CAST(cell AS DECIMAL(28,8)) END)")} END AS amount
        FROM n GROUP BY ALL""",
)
def exact_totals(spark, sf):
    cells = _odd_cells(spark, sf).withColumn("v", numbers.parse_number("cell"))
    return cells.groupBy("l_returnflag", F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(
        F.count_if(numbers.is_junk_number("cell")).alias("n_junk"), numbers.total("v").alias("amount")
    )


_DAY_STYLES = [
    ("%d%b%y", "ddMMMyy"),
    ("%d-%m-%Y", "dd-MM-yyyy"),
    ("%Y-%m-%d", "yyyy-MM-dd"),
    ("%d/%m/%Y", "dd/MM/yyyy"),
    ("%d–%m–%Y", "dd–MM–yyyy"),
]


@query(
    "parse_report_dates",
    """WITH c AS (SELECT o_orderkey AS cell_id, o_orderdate AS d, CAST(o_orderkey % 6 AS INT) AS style FROM orders)
       SELECT cell_id, CASE WHEN style < 5 THEN CAST(CAST(d AS DATE) AS VARCHAR) END AS report_date FROM c""",
)
def parse_report_dates(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    cell = F
    for i, (_, style) in enumerate(_DAY_STYLES):
        cell = cell.when(key % 6 == i, F.date_format(day, style))
    cells = star.table(spark, sf, "orders").select(
        key.alias("cell_id"), cell.otherwise(F.lit("32-13-2024")).alias("cell")
    )
    return cells.select(
        "cell_id", iso_date(dates.parse_report_date("cell")).alias("report_date")
    )


@query(
    "strict_load",
    f"""WITH f AS (SELECT c.n_name AS file_name, l.l_quantity AS v, l.l_extendedprice AS m, l.l_shipdate AS d,
                         CASE WHEN l.l_quantity = 50 AND l.l_discount = 0.1 AND l.l_tax = 0.08 AND l.l_linenumber = 7 THEN 1 ELSE 0 END AS junk
                  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation c ON s.s_nationkey = c.n_nationkey),
        b AS (SELECT file_name, MAX(junk) AS junk FROM f GROUP BY 1)
        SELECT f.file_name, CASE WHEN b.junk = 1 THEN 'rejected' ELSE 'loaded' END AS outcome, CAST(COUNT(*) AS BIGINT) AS n_rows,
               CASE WHEN b.junk = 0 THEN {dsum('v')} END AS volume
        FROM f JOIN b USING (file_name) GROUP BY f.file_name, b.junk""",
)
def strict_load(spark, sf):
    line, supplier = star.table(spark, sf, "lineitem"), star.table(spark, sf, "supplier")
    nation = star.table(spark, sf, "nation")
    junk = (
        (F.col("l_quantity") == 50)
        & (F.col("l_discount") == 0.1)
        & (F.col("l_tax") == 0.08)
        & (F.col("l_linenumber") == 7)
    )
    rows = (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("file_name"),
            F.date_format("l_shipdate", "dd-MM-yyyy").alias("REPORT_DATE"),
            F.when(junk, "n/a").otherwise(F.format_number("l_quantity", 2)).alias("VOLUME_BL"),
            F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2).alias("MKT_VAL_BL"),
        )
    )
    clean, rejected = quality.strict_load(rows, specs.PW)
    loaded = clean.groupBy("file_name").agg(
        F.lit("loaded").alias("outcome"),
        F.count("*").alias("n_rows"),
        numbers.total_or_0("VOLUME_BL").alias("volume"),
    )
    turned_away = rejected.groupBy("file_name").agg(
        F.lit("rejected").alias("outcome"),
        F.count("*").alias("n_rows"),
        F.lit(None).cast("double").alias("volume"),
    )
    return loaded.unionByName(turned_away)


@query(
    "alias_map",
    """WITH r AS (SELECT lower(trim(p_name)) AS description, trim(p_brand) AS column_name, p_partkey AS row_no FROM part)
       SELECT description, arg_max(column_name, row_no) AS column_name FROM r
       WHERE description <> '' AND column_name <> '' GROUP BY description""",
)
def alias_map(spark, sf):
    schema_rows = star.table(spark, sf, "part").select(
        F.col("p_name").alias("Description"),
        F.col("p_brand").alias("Column"),
        F.col("p_partkey").alias("row_no"),
    )
    return quality.alias_map(schema_rows)


@query(
    "split_valid_rejected",
    f"""WITH v AS ({SQL['validate_schema']}),
        f AS (SELECT concat('NOP_', CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'CO2' WHEN 1 THEN 'NG' WHEN 2 THEN 'PW' ELSE 'XX' END,
                     '_', CAST(o_orderkey AS VARCHAR), '.csv') AS file_name, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
        SELECT CASE WHEN v.is_valid THEN 'valid' ELSE 'rejected' END AS sink, CAST(COUNT(*) AS BIGINT) AS n_rows,
               CAST(COUNT(DISTINCT f.file_name) AS BIGINT) AS n_files, {dsum('l_quantity')} AS volume
        FROM f LEFT JOIN v USING (file_name) GROUP BY 1""",
)
def split_valid_rejected(spark, sf):
    names = star.data_files(spark, sf).select("file_id", "file_name")
    line = star.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    rows = line.join(names, F.col("l_orderkey") == F.col("file_id"))
    valid, rejected = quality.split_valid_rejected(rows, validate_schema(spark, sf))

    def figures(frame, sink):
        return frame.agg(
            F.lit(sink).alias("sink"),
            F.count("*").alias("n_rows"),
            F.count_distinct("file_name").alias("n_files"),
            numbers.total_or_0("l_quantity").alias("volume"),
        )

    return figures(valid, "valid").unionByName(figures(rejected, "rejected"))


# --- stored tables -------------------------------------------------------------------


def _store_with_positions(spark, sf) -> Store:
    store = Store(new_table_dir(spark, "store"))
    positions = star.power_positions(spark, sf).withColumn(
        "file_name", F.concat(F.lit("NOP_PW_"), F.col("BOOK_ATTR6"), F.lit(".csv"))
    )
    tables.append_raw(positions, specs.PW.category, store.path("positions"))
    return store


@query(
    "append_raw",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, concat('NOP_PW_', BOOK_ATTR6, '.csv') AS file_name,
               CAST(COUNT(*) AS BIGINT) AS n_rows, {dsum('VOLUME_BL')} AS volume FROM fx_pw GROUP BY 1, 2""",
)
def append_raw(spark, sf):
    store = _store_with_positions(spark, sf)
    stored = tables.read_raw(spark, store.path("positions"), specs.PW)
    counted = stored.groupBy("REPORT_DATE", "file_name").agg(
        F.count("*").alias("n_rows"), numbers.total_or_0("VOLUME_BL").alias("volume")
    )
    return counted.withColumn("REPORT_DATE", iso_date("REPORT_DATE"))


@query("rebuild_snapshots", _build_cube_sql())
def rebuild_all_snapshots(spark, sf):
    store = _store_with_positions(spark, sf)
    rebuild_snapshots(spark, store)
    stored = spark.read.parquet(store.path("snapshots")).drop("category")
    return stored.withColumn("REPORT_DATE", iso_date("REPORT_DATE"))


@query(
    "delta_from_snapshots",
    f"""{_sides('SEGMENT, HORIZON', ['VOLUME_BL', 'MKT_VAL_BL'])}
        SELECT SEGMENT AS member, HORIZON AS label, {_exact_diff('cur.VOLUME_BL', 'prev.VOLUME_BL')} AS delta
        FROM cur JOIN prev USING (SEGMENT, HORIZON)""",
)
def delta_from_snapshots(spark, sf):
    path = new_table_dir(spark, "snapshots")
    built = cube.build_cube(star.power_positions(spark, sf))
    tables.upsert_snapshot(built, specs.PW.category, path)
    view = spark.read.parquet(path).filter(
        (F.col("category") == specs.PW.category) & (F.col("view") == "by_segment_horizon")
    )
    return delta.delta_inner(view, ["member", "label"], "volume_bl")


@query(
    "file_stats_table",
    f"SELECT file_name, CAST(COUNT(*) AS BIGINT) AS n_records, {dsum('TOTAL_VOLUME')} AS total_volume FROM ("
    f"SELECT concat('NOP_NG_', BOOK, '.csv') AS file_name, * FROM ({_stat_sql(specs.NG, 'fx_ng')})) GROUP BY 1",
)
def file_stats_table(spark, sf):
    path = new_table_dir(spark, "file-stats")
    gas = star.gas_positions(spark, sf).withColumn(
        "file_name", F.concat(F.lit("NOP_NG_"), "BOOK", F.lit(".csv"))
    )
    daily = stats.daily_stats(gas, specs.NG, extra_keys=("file_name",))
    tables.write_file_stats(stats.stats_documents(daily), path)
    records, _ = stats.explode_stats(spark.read.parquet(path), specs.NG)
    return records.groupBy("file_name").agg(
        F.count("*").alias("n_records"), numbers.total_or_0("TOTAL_VOLUME").alias("total_volume")
    )


# --- streams -------------------------------------------------------------------------


@query(
    "stream_timeline",
    """SELECT CAST(CAST(uploaded_at AS DATE) AS VARCHAR) AS upload_day, split_part(file_name, '_', 2) AS feed,
              CAST(COUNT(*) AS BIGINT) AS n_files FROM fx_files
       WHERE CAST(uploaded_at AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(uploaded_at) - INTERVAL 1 DAY FROM fx_files)
       GROUP BY 1, 2""",
)
def stream_timeline(spark, sf):
    """Days the watermark has closed; the newest days are still open."""
    orders = (
        spark.readStream.schema(star.SCHEMAS["orders"])
        .option("pathGlobFilter", "orders.parquet")
        .parquet(sf)
    )
    uploads = star.as_data_files(orders).select("file_name", "uploaded_at")
    out = new_table_dir(spark, "timeline")
    running = (
        jobs.stream_timeline(uploads)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-checkpoint")
        .outputMode("append")
        .format("parquet")
        .start(out)
    )
    running.awaitTermination()
    closed = spark.read.schema("upload_day date, feed string, n_files bigint").parquet(out)
    return closed.withColumn("upload_day", iso_date("upload_day"))


@query("stream_snapshots", _build_cube_sql())
def stream_snapshots(spark, sf):
    store = _store_with_positions(spark, sf)
    jobs.stream_snapshots(spark, store).awaitTermination()
    stored = spark.read.parquet(store.path("snapshots")).drop("category")
    return stored.withColumn("REPORT_DATE", iso_date("REPORT_DATE"))
