"""Queries over feed files: the test tables are written as CSV files, ingested, and compared.

Files lie below the shared folder of the session; they are written, named and read by Spark's own
file systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions import dates, numbers
from gridledger.functions.dates import iso_date
from gridledger.operators import delta, feedback
from gridledger.plans import ingest
from gridledger.plans.ingest import Store
from gridledger.session import drop_folder, lean_writes, new_table_dir
from gridledger.sources import feeds, star, tables
from gridledger.streaming import jobs
from workload.positions import _LAST_TWO
from workload.registry import as_double, dsum, exact_sum, query


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_feed(rows: DataFrame, key: str, mark: str, folder: str) -> None:
    """Rows as compressed CSV files `<mark>_<key>.csv`, one per value of `key`, below a folder.

    Every task writes its piece of each file into a folder of its own, so that no file passes through one
    task, and rows are neither moved nor sorted for it. `pieces` names the folders.
    """
    spark = rows.sparkSession
    raw = f"{folder.rstrip('/')}-parts"
    dated = rows.withColumn("REPORT_DATE", F.date_format("REPORT_DATE", "dd-MM-yyyy"))
    keyed = dated.withColumn("_key", F.regexp_replace(F.col(key), "[^A-Za-z0-9]", ""))
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "64")
    try:
        with lean_writes(spark):
            keyed.write.partitionBy("_key").option("header", True).option("compression", "gzip").csv(raw)
    finally:
        spark.conf.set(WRITERS, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(raw).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{folder}/none"))  # a pattern that matches no folder would fail
    for at in sorted({p.getPath().getName().split(".")[0] for p in fs.globStatus(hadoop(f"{raw}/_key=*/part-*"))}):
        fs.mkdirs(hadoop(f"{folder}/{at}"))
    for part in fs.globStatus(hadoop(f"{raw}/_key=*/part-*")):
        value = part.getPath().getParent().getName().split("=", 1)[1]
        at = part.getPath().getName().split(".")[0]
        if not fs.rename(part.getPath(), hadoop(f"{folder}/{at}/{mark}_{value}.csv.gz")):
            raise OSError(f"cannot name {part.getPath()}")
    drop_folder(spark, raw)


def pieces(folder: str) -> str:
    """Pattern of the folders that `write_feed` filled."""
    return f"{folder.rstrip('/')}/*"


def _files(folder: str, spark: SparkSession) -> list[str]:
    return sorted(r["file_path"] for r in feeds.list_files(spark, pieces(folder)).collect())


def _swapped(rows: DataFrame, first: str, second: str) -> DataFrame:
    """The same rows with two columns in each other's place, header included."""
    order = {first: second, second: first}
    return rows.select(*(order.get(c, c) for c in rows.columns))


_CORRECTED = "ASIA"  # the region whose power file comes again, a month later


def _power(spark: SparkSession, sf: str) -> DataFrame:
    return star.power_positions(spark, sf)


_STORES: dict[tuple[str, str, str], Store] = {}


def _once(build):
    """Stores are built once per session and input; several queries look at the same one."""

    def made(spark: SparkSession, sf: str) -> Store:
        key = (build.__name__, spark.sparkContext.applicationId, sf)
        if key not in _STORES:
            _STORES[key] = build(spark, sf)
        return _STORES[key]

    return made


@_once
def _ingest_all(spark: SparkSession, sf: str) -> Store:
    """Three commodities into one store; then one power file again, corrected."""
    store, inbox = Store(new_table_dir(spark, "store")), new_table_dir(spark, "inbox")
    written = (
        (specs.PW, star.power_positions, "BOOK_ATTR6"),
        (specs.NG, star.gas_positions, "SEGMENT"),
        (specs.CO2, star.carbon_positions, "SEGMENT"),
    )
    # A feed is dropped once it is loaded, before the next one is written.
    slices = star.line_slices(spark, sf)
    for spec, positions, key in written:
        folder = f"{inbox}/{spec.category}"
        for lines in slices:
            rows = positions(spark, sf, lines)
            write_feed(rows.drop("BOOK_ATTR7") if spec is specs.PW else rows, key, spec.file_mark, folder)
        ingest.ingest_folder(spark, pieces(folder), spec, store)
        drop_folder(spark, folder)
    for lines in slices:
        again = star.power_positions(spark, sf, lines).filter(F.col("BOOK_ATTR6") == _CORRECTED)
        later = again.withColumn("REPORT_DATE", F.add_months("REPORT_DATE", 1))
        write_feed(later, "BOOK_ATTR6", "NOP_PW", f"{inbox}/corrected")
    ingest.ingest_paths(spark, _files(f"{inbox}/corrected", spark), specs.PW, store)
    drop_folder(spark, inbox)
    return store


_PW_FILES = f"""SELECT 'PW' AS category, concat('NOP_PW_', regexp_replace(BOOK_ATTR6, '[^A-Za-z0-9]', '', 'g'), '.csv') AS file_name,
    CAST(CASE WHEN BOOK_ATTR6 = '{_CORRECTED}' THEN REPORT_DATE + INTERVAL 1 MONTH ELSE REPORT_DATE END AS DATE) AS REPORT_DATE,
    VOLUME_BL AS v, MKT_VAL_BL AS m, SEGMENT, HORIZON FROM fx_pw"""
_NG_FILES = "SELECT 'NG' AS category, concat('NOP_NG_', SEGMENT, '.csv') AS file_name, REPORT_DATE, VOLUME AS v, MKT_VAL AS m FROM fx_ng"
_CO2_FILES = "SELECT 'CO2' AS category, concat('NOP_CO2_', SEGMENT, '.csv') AS file_name, REPORT_DATE, VOLUME AS v, MKTVAL AS m FROM fx_co2"


@query(
    "multi_feed_store",
    f"""WITH f AS (SELECT category, file_name, REPORT_DATE, v, m FROM ({_PW_FILES}) UNION ALL {_NG_FILES} UNION ALL {_CO2_FILES})
        SELECT category, file_name, CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, CAST(COUNT(*) AS BIGINT) AS n_rows,
               {dsum('v')} AS volume, {dsum('m')} AS market FROM f GROUP BY ALL""",
)
def multi_feed_store(spark, sf):
    """Raw rows of all commodities after a correction."""
    store = _ingest_all(spark, sf)
    out = None
    for spec in (specs.PW, specs.NG, specs.CO2):
        volume, market = spec.load_measures
        part = (
            tables.read_raw(spark, store.path("positions"), spec)
            .groupBy("category", "file_name", "REPORT_DATE")
            .agg(
                F.count("*").alias("n_rows"),
                numbers.total_or_0(volume).alias("volume"),
                numbers.total_or_0(market).alias("market"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("REPORT_DATE", iso_date("REPORT_DATE"))


@query(
    "corrected_snapshots",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, SEGMENT AS member, HORIZON AS label, {dsum('v')} AS volume_bl,
               {dsum('m')} AS mkt_val_bl FROM ({_PW_FILES}) GROUP BY ALL""",
)
def corrected_snapshots(spark, sf):
    """Snapshots follow a corrected file, also on the dates that it left."""
    store = _ingest_all(spark, sf)
    rows = tables.read_snapshots(spark, store.path("snapshots"), specs.PW.category)
    return rows.filter("view = 'by_segment_horizon'").select(
        iso_date("REPORT_DATE").alias("REPORT_DATE"), "member", "label", "volume_bl", "mkt_val_bl"
    )


def _junk(cell: Column, day: Column) -> Column:
    """A cell that rejects its file: on the first day of 1995, where there is one."""
    return F.when(day == F.lit("1995-01-01").cast("date"), "n/a").otherwise(cell.cast("string"))


@query(
    "ingest_log",
    """WITH f AS (SELECT concat('NOP_PW_', regexp_replace(BOOK, '[^A-Za-z0-9]', '', 'g'), '.csv') AS file_name, REPORT_DATE,
                         CASE WHEN BOOK < 'G' AND REPORT_DATE = DATE '1995-01-01' THEN 1 ELSE 0 END AS junk FROM fx_pw)
       SELECT file_name, 'PW' AS category, CASE WHEN MAX(junk) = 0 THEN CAST(MIN(REPORT_DATE) AS VARCHAR) END AS report_date,
              CASE WHEN MAX(junk) = 0 THEN CAST(COUNT(*) AS BIGINT) ELSE 0 END AS n_rows,
              CASE WHEN MAX(junk) = 0 THEN 1 ELSE 0 END AS is_processed FROM f GROUP BY file_name""",
)
def ingest_log(spark, sf):
    """One log entry per file, rejected ones unprocessed; by the stream, with a swapped column."""
    store = _stream_store(spark, sf)
    return tables.read_log(spark, store.path("data_files")).select(
        "file_name", "category", iso_date("report_date").alias("report_date"), "n_rows", "is_processed"
    )


@_once
def _stream_store(spark: SparkSession, sf: str) -> Store:
    store, inbox = Store(new_table_dir(spark, "store")), new_table_dir(spark, "inbox")
    _stream_inbox(spark, sf, inbox)
    jobs.stream_ingest(spark, pieces(inbox), specs.PW, store).awaitTermination()
    drop_folder(spark, inbox)
    return store


def _stream_inbox(spark, sf, inbox: str) -> None:
    """Power files by book: the later books with two columns swapped, some early ones with junk."""
    # Task folders have names of their own, so that what is written later lies beside the rest.
    for lines in star.line_slices(spark, sf):
        power = star.power_positions(spark, sf, lines)
        early = power.filter("BOOK < 'G'").withColumn(
            "VOLUME_BL", _junk(F.col("VOLUME_BL"), F.col("REPORT_DATE"))
        )
        write_feed(early, "BOOK", "NOP_PW", inbox)
        write_feed(_swapped(power.filter("BOOK >= 'G'"), "SEGMENT", "TGROUP1"), "BOOK", "NOP_PW", inbox)


@query(
    "stream_ingest",
    f"""WITH f AS (SELECT *, BOOK < 'G' AND MAX(CASE WHEN REPORT_DATE = DATE '1995-01-01' THEN 1 ELSE 0 END) OVER (PARTITION BY BOOK) = 1 AS bad FROM fx_pw)
        SELECT CASE WHEN bad THEN 'rejected' ELSE 'loaded' END AS sink, SEGMENT, TGROUP1, CAST(COUNT(*) AS BIGINT) AS n_rows,
               {dsum('MKT_VAL_BL')} AS market FROM f GROUP BY ALL""",
)
def stream_ingest(spark, sf):
    """Loaded and rejected rows of a stream; columns are found by header, not by place."""
    store = _stream_store(spark, sf)
    loaded = tables.read_raw(spark, store.path("positions"), specs.PW)
    rejected = tables.read_rejected(spark, store.path("rejected"), specs.PW)

    def figures(rows: DataFrame, sink: str) -> DataFrame:
        return rows.groupBy(F.lit(sink).alias("sink"), "SEGMENT", "TGROUP1").agg(
            F.count("*").alias("n_rows"),
            numbers.total_or_0(numbers.parse_number("MKT_VAL_BL")).alias("market"),
        )

    return figures(loaded, "loaded").unionByName(figures(rejected, "rejected"))


@query(
    "delta_known_dates",
    f"""WITH {_LAST_TWO},
        cur AS (SELECT BOOK, {exact_sum('VOLUME_BL')} AS v FROM fx_pw, p WHERE REPORT_DATE = latest GROUP BY BOOK),
        prev AS (SELECT BOOK, {exact_sum('VOLUME_BL')} AS v FROM fx_pw, p WHERE REPORT_DATE = previous GROUP BY BOOK)
        SELECT BOOK, {as_double('(cur.v - prev.v)')} AS delta FROM cur JOIN prev USING (BOOK)""",
)
def delta_known_dates(spark, sf):
    """The date pair comes from the partitions of the stored table."""
    path = f"{new_table_dir(spark, 'store')}/positions"
    tables.append_raw(_power(spark, sf).withColumn("file_name", F.lit("NOP_PW_all.csv")), "PW", path)
    stored = tables.read_raw(spark, path, specs.PW)
    return delta.delta_inner(stored, ["BOOK"], "VOLUME_BL", tables.report_dates(spark, path, "PW"))


@query(
    "read_feed_folder",
    f"""SELECT concat('NOP_NG_', SEGMENT, '.csv') AS file_name, TGROUP1, CAST(COUNT(*) AS BIGINT) AS n_rows,
               {dsum('VOLUME')} AS volume, CAST(MIN(REPORT_DATE) AS VARCHAR) AS first_date FROM fx_ng GROUP BY ALL""",
)
def read_feed_folder(spark, sf):
    inbox = new_table_dir(spark, "inbox")
    write_feed(star.gas_positions(spark, sf), "SEGMENT", "NOP_NG", inbox)
    rows = feeds.read_feed_folder(spark, pieces(inbox), specs.NG)
    return rows.groupBy("file_name", "TGROUP1").agg(
        F.count("*").alias("n_rows"),
        numbers.total_or_0(numbers.parse_number("VOLUME")).alias("volume"),
        iso_date(F.min(dates.parse_date_dayfirst("REPORT_DATE"))).alias("first_date"),
    )


@query(
    "glossary",
    """WITH e AS (SELECT p_brand AS context_name, p_type AS description, p_partkey AS k FROM part WHERE p_partkey % 2 = 0
                  UNION ALL SELECT p_type, p_brand, 1000000000 + p_partkey FROM part WHERE p_partkey % 2 = 1)
       SELECT context_name, arg_max(description, k) AS description FROM e GROUP BY 1""",
)
def glossary(spark, sf):
    """Two dictionary sheets read from CSV, appended and read back; the last entry of a code wins."""
    folder, path = new_table_dir(spark, "sheets"), new_table_dir(spark, "glossary")
    part = star.table(spark, sf, "part")
    sheets = {
        "Brands": part.filter("p_partkey % 2 = 0").select("p_brand", "p_type", "p_partkey"),
        "Types": part.filter("p_partkey % 2 = 1").select("p_type", "p_brand", "p_partkey"),
    }
    for name, rows in sheets.items():
        # The order of a sheet decides, so each is one file.
        ordered = rows.orderBy("p_partkey").drop("p_partkey").coalesce(1)
        ordered.write.option("header", True).csv(f"{folder}/{name}")
        entries = feeds.read_dictionary(spark, {name: f"{folder}/{name}"})
        tables.append_glossary(entries, f"{name}.xlsx", path)
    return tables.read_glossary(spark, path)


@query(
    "append_log",
    """SELECT category, CAST(2 * COUNT(*) AS BIGINT) AS n, CAST(2 * COUNT(*) AS BIGINT) AS n_keys,
              CAST(2 * COUNT(*) FILTER (WHERE user_feedback = 0) AS BIGINT) AS n_bad FROM fx_logs GROUP BY category""",
)
def append_log(spark, sf):
    """Question logs appended twice get keys of their own."""
    path = new_table_dir(spark, "log")
    logs = star.question_logs(spark, sf).drop("log_id", "created_at")
    tables.append_log(logs, path)
    tables.append_log(logs, path)
    return spark.read.parquet(path).groupBy("category").agg(
        F.count("*").alias("n"),
        F.count_distinct("log_id").alias("n_keys"),
        F.count_if(F.col("user_feedback") == 0).alias("n_bad"),
    )


@query(
    "save_metadata",
    """SELECT p_partkey AS row_key, 'schema_pw.csv' AS file_name, p_name AS name, p_type AS kind FROM part""",
)
def save_metadata(spark, sf):
    path = new_table_dir(spark, "metadata")
    rows = star.table(spark, sf, "part").select(
        "p_name", "p_type", F.col("p_partkey").alias("row_no")
    )
    tables.save_metadata(rows, "schema_pw.csv", "PW/metadata/schema_pw.csv", path)
    return spark.read.parquet(path).select(
        F.col("row_no").alias("row_key"),
        "file_name",
        F.get_json_object("json_record", "$.p_name").alias("name"),
        F.get_json_object("json_record", "$.p_type").alias("kind"),
    )


@query(
    "export_feedback",
    "SELECT feedback_comment, CAST(COUNT(*) AS BIGINT) AS n FROM fx_logs WHERE user_feedback = 0 AND trim(feedback_comment) <> '' GROUP BY 1",
)
def export_feedback(spark, sf):
    """Training pairs written as JSON and read back."""
    path = new_table_dir(spark, "pairs")
    tables.export_training_pairs(feedback.training_pairs(star.question_logs(spark, sf)), path)
    pairs = spark.read.schema("query string, incorrect_answer string, correction string").json(path)
    return pairs.groupBy(F.col("correction").alias("feedback_comment")).agg(F.count("*").alias("n"))
