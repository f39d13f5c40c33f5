"""Stored tables: positions, snapshots, logs and exports.

Positions and rejected rows are append-only Parquet tables. Every load writes its rows under a load
id of its own and then, as the last step, names the loaded files and that id in a small table of file
versions. Reading takes the newest version of each file, so a file that is loaded again replaces its
former rows wherever they lie, a rejected file that comes back mended leaves the rejected table, and
a load that failed half way is never seen. Snapshots and statistics are replaced by whole partitions.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gridledger.operators import cube, stats
from gridledger.operators.files import ingest_entries
from gridledger.session import drop_folder, lean_writes, n_slices, stored_bytes
from gridledger.specs import FeedSpec

VERSIONS = "category string, file_name string, load_id string"


def _replace_partitions(rows: DataFrame, keys: list[str], path: str) -> None:
    """Write rows, replacing exactly the partitions they belong to."""
    with lean_writes(rows.sparkSession):
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(path)
        )


def new_load_id() -> str:
    """Ids sort by the time they were drawn."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def versions_path(path: str) -> str:
    return f"{path.rstrip('/').rsplit('/', 1)[0]}/file_versions"


def _append_load(
    rows: DataFrame, category: str, path: str, load_id: str | None, keys: list[str]
) -> None:
    """Add rows under a load id. With an id of its own, the load is announced here and now."""
    own = load_id or new_load_id()
    marked = rows.withColumns({"category": F.lit(category), "load_id": F.lit(own)})
    with lean_writes(rows.sparkSession):
        marked.write.mode("append").option("compression", "zstd").partitionBy(*keys).parquet(path)
    if load_id is None:
        written = load_rows(rows.sparkSession, path, marked.schema, category, own)
        announce_versions(written.select("file_name").distinct(), category, path, own)


def announce_versions(files: DataFrame, category: str, path: str, load_id: str) -> None:
    """Make `load_id` the newest version of the files (file_name)."""
    files.select("file_name").distinct().select(
        F.lit(category).alias("category"), "file_name", F.lit(load_id).alias("load_id")
    ).write.mode("append").parquet(versions_path(path))


def load_rows(
    spark: SparkSession, path: str, schema: T.StructType, category: str, load_id: str
) -> DataFrame:
    """Rows of one load, read with a declared schema."""
    return (
        spark.read.schema(schema)
        .parquet(path)
        .filter((F.col("category") == category) & (F.col("load_id") == load_id))
    )


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """Newest load id of each file of the store that `path` lies in."""
    return (
        spark.read.schema(VERSIONS)
        .parquet(versions_path(path))
        .groupBy("category", "file_name")
        .agg(F.max("load_id").alias("load_id"))
    )


def append_raw(rows: DataFrame, category: str, path: str, load_id: str | None = None) -> None:
    """Add the files' positions to the raw table, partitioned by commodity and date.

    Rows are laid out by date before they are written: files grow with the data, not with
    tasks, feed files and dates, and an oversized date is still split. A caller that gives a
    `load_id` makes the files' versions known itself, once all parts of the load are written.
    """
    laid_out = rows.hint("rebalance", "REPORT_DATE")
    _append_load(laid_out, category, path, load_id, ["category", "REPORT_DATE"])


def write_rejected(rows: DataFrame, category: str, path: str, load_id: str | None = None) -> None:
    """Keep the raw rows of rejected files, by commodity."""
    laid_out = rows.hint("rebalance", "file_name")
    _append_load(laid_out, category, path, load_id, ["category"])


def raw_schema(spec: FeedSpec) -> T.StructType:
    """Declared columns of a commodity in the raw table; files without one read as null."""
    extra = [T.StructField(n, T.StringType()) for n in ("file_name", "load_id", "category")]
    return T.StructType([*spec.schema.fields, *extra])


def _live(rows: DataFrame, path: str) -> DataFrame:
    versions = live_versions(rows.sparkSession, path)
    return rows.join(versions, ["category", "file_name", "load_id"], "left_semi").drop("load_id")


def read_raw(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """Positions of one commodity, by its declared schema; filters prune commodities and dates."""
    rows = spark.read.schema(raw_schema(spec)).parquet(path)
    return _live(rows.filter(F.col("category") == spec.category), path)


def read_rejected(spark: SparkSession, path: str, spec: FeedSpec) -> DataFrame:
    """Rows of the commodity's files whose newest version was rejected, as text."""
    fields = [T.StructField(c, T.StringType()) for c in (*spec.columns, "file_name", "load_id", "category")]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    return _live(rows.filter(F.col("category") == spec.category), path)


def date_slices(rows: DataFrame, path: str) -> list[DataFrame]:
    """Rows of the raw table in slices of whole report dates, of which only the partitions are read."""
    n = n_slices(stored_bytes(rows.sparkSession, path))
    if n == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64("REPORT_DATE"), F.lit(n)) == i) for i in range(n)]


def report_dates(spark: SparkSession, path: str, category: str) -> tuple:
    """(latest, previous) report date of a stored snapshot or raw table, from its partitions.

    Only partition values are read: dates are few, and no position is opened.
    """
    dates = (
        spark.read.schema("category string, REPORT_DATE date")
        .parquet(path)
        .filter((F.col("category") == category) & F.col("REPORT_DATE").isNotNull())
        .select("REPORT_DATE")
        .distinct()
        .orderBy(F.desc("REPORT_DATE"))
        .limit(2)
        .collect()
    )
    found = [r["REPORT_DATE"] for r in dates]
    return (*found, None, None)[:2]


# --- compaction ------------------------------------------------------------------------

COMPACTED = "~"  # sorts a rewritten version right after the one it holds, before any newer load


def plain_id(load_id: str) -> Column:
    """Id of the load that a stored version came from."""
    return F.rtrim(F.col(load_id), F.lit(COMPACTED))


def compact(spark: SparkSession, path: str, spec: FeedSpec, least_dead: float = 0.0) -> int:
    """Rewrite the dates that hold dead rows, live rows only; returns the number of dates.

    Each file's rows come back under its own load id with a mark, and become its newest version in the last
    step. So the rows read are the same before, during and after: a load that is announced meanwhile has
    a later id and still wins, whether it began before the compaction or not. Only dates where more than
    `least_dead` of the rows are dead are rewritten; files on both kinds of dates keep their
    other rows by being rewritten as well. What is replaced stays on disk until `vacuum`.
    """
    rows = spark.read.schema(raw_schema(spec)).parquet(path).filter(F.col("category") == spec.category)
    versions = live_versions(spark, path).withColumn("live", F.lit(1))
    keys = ["category", "file_name", "load_id"]
    by_date = (
        rows.groupBy("REPORT_DATE", *keys).agg(F.count("*").alias("n"))
        .join(versions, keys, "left")
        .groupBy("REPORT_DATE")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("live").isNull(), F.col("n")).otherwise(0)).alias("dead"))
    )
    worn = by_date.filter(F.col("dead") > least_dead * F.col("n")).filter("dead > 0").select("REPORT_DATE")
    # All rows of the files that live on those dates: a version is whole or it is not announced.
    live = rows.join(versions.drop("live"), keys, "left_semi")
    on = live.join(worn, live["REPORT_DATE"].eqNullSafe(worn["REPORT_DATE"]), "left_semi")
    chosen = on.select(*keys).distinct()
    staged = f"{path.rstrip('/').rsplit('/', 1)[0]}/compacting-{uuid.uuid4().hex}"
    chosen.write.parquet(staged)
    chosen = spark.read.parquet(staged)
    n_dates = worn.count()
    marked = rows.join(chosen, keys, "left_semi").withColumn("load_id", F.concat("load_id", F.lit(COMPACTED)))
    laid_out = marked.hint("rebalance", "REPORT_DATE")
    laid_out.write.mode("append").partitionBy("category", "REPORT_DATE").parquet(path)
    chosen.withColumn("load_id", F.concat("load_id", F.lit(COMPACTED))).write.mode("append").parquet(versions_path(path))
    drop_folder(spark, staged)
    return n_dates


def vacuum(spark: SparkSession, path: str, spec: FeedSpec, older_than_s: float = 7 * 86400) -> int:
    """Remove data files that hold no live row; returns their number.

    Readers that began before see the files they listed for `older_than_s` seconds; a load that is not
    announced yet is as young as its files.
    """
    rows = spark.read.schema(raw_schema(spec)).parquet(path).filter(F.col("category") == spec.category)
    keys = ["category", "file_name", "load_id"]
    named = rows.select(*keys, F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_modification_time").alias("since"))
    held = named.join(live_versions(spark, path).withColumn("live", F.lit(True)), keys, "left")
    age = F.current_timestamp().cast("double") - F.col("since").cast("double")
    dead = held.groupBy("at").agg(F.max("live").alias("live"), F.min(age).alias("age"))
    gone = 0
    for row in dead.filter(F.col("live").isNull() & (F.col("age") >= older_than_s)).select("at").toLocalIterator():
        drop_folder(spark, row["at"])
        gone += 1
    return gone


RETIRED = "retired"  # view of the marker row of a report date that lost all its positions


def upsert_snapshot(cube: DataFrame, category: str, path: str) -> None:
    """Replace the snapshot of every (commodity, report date) found in the cube."""
    # Rebalancing gathers a date's rows into few files and still splits an oversized date.
    _replace_partitions(
        cube.withColumn("category", F.lit(category)).hint("rebalance", "REPORT_DATE"),
        ["category", "REPORT_DATE"],
        path,
    )


def read_snapshots(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Snapshot rows of one commodity, without marker rows."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col("category") == category) & (F.col("view") != RETIRED))


# --- states of snapshots ---------------------------------------------------------------

APPLIED = "applied"  # view of the rows that name a file (member) and its load (label)


def _state_schema(*extra: str) -> T.StructType:
    kinds = {"REPORT_DATE": T.DateType(), "view": T.StringType(), "member": T.StringType(), "label": T.StringType()}
    fields = [T.StructField(c, T.StringType()) for c in extra]
    fields += [T.StructField(c, kinds[c]) for c in cube.CELL]
    fields += [
        T.StructField(c, T.DoubleType() if c.startswith("_wild_") else T.LongType()) for c in cube.STATE_COLUMNS
    ]
    return T.StructType([*fields, T.StructField("category", T.StringType())])


def read_states(spark: SparkSession, path: str, *extra: str) -> DataFrame:
    """States below `path`, none if nothing was stored yet."""
    try:
        return spark.read.schema(_state_schema(*extra)).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _state_schema(*extra))


def append_contributions(states: DataFrame, loads: DataFrame, category: str, path: str) -> None:
    """Store states by file, load and date. They are written once per load and never changed.

    `loads` (load_id): all loads that are done with this, also those without any rows.
    """
    dates = states.select("file_name", "load_id", "REPORT_DATE").distinct()
    done = loads.select("load_id").withColumn("view", F.lit(APPLIED))
    markers = dates.withColumn("view", F.lit(APPLIED)).unionByName(done, allowMissingColumns=True)
    rows = states.unionByName(markers, allowMissingColumns=True).withColumn("category", F.lit(category))
    with lean_writes(rows.sparkSession):
        rows.hint("rebalance", "load_id").write.mode("append").partitionBy("category", "load_id").parquet(path)


def replace_states(states: DataFrame, category: str, path: str) -> None:
    """Replace the states of every report date among the rows."""
    _replace_partitions(
        states.withColumn("category", F.lit(category)).hint("rebalance", "REPORT_DATE"),
        ["category", "REPORT_DATE"],
        path,
    )


def log_unprocessed(files: DataFrame, category: str, path: str) -> None:
    """Append one log entry per file (file_name) that was rejected or held no rows."""
    files.select("file_name").distinct().select(
        "file_name",
        F.lit(category).alias("category"),
        F.lit(None).cast("date").alias("report_date"),
        F.lit(0).cast("bigint").alias("n_rows"),
        F.lit(0).alias("is_processed"),
        F.current_timestamp().alias("uploaded_at"),
    ).write.mode("append").parquet(path)


def log_ingest(rows: DataFrame, category: str, path: str) -> None:
    """Append one log entry per loaded file."""
    entries = ingest_entries(rows.withColumn("category", F.lit(category))).withColumns(
        {"is_processed": F.lit(1), "uploaded_at": F.current_timestamp()}
    )
    with lean_writes(rows.sparkSession):
        entries.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The ingest log, empty if nothing has been loaded yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame(
            [],
            "file_name string, category string, report_date date, n_rows bigint, "
            "is_processed int, uploaded_at timestamp",
        )


def append_statistics(states: DataFrame, category: str, load_id: str, path: str) -> None:
    """Store the statistics states of a load's files (`stats.statistics_states` by file_name)."""
    marked = states.withColumns({"category": F.lit(category), "load_id": F.lit(load_id)})
    with lean_writes(states.sparkSession):
        marked.write.mode("append").option("compression", "zstd").partitionBy("category", "load_id").parquet(path)


def read_statistics(spark: SparkSession, path: str, spec: FeedSpec, versions: DataFrame) -> DataFrame:
    """Statistics states of the files' newest loads (`live_versions`)."""
    kinds = {c: "double" if c.startswith(("_wild_", "_m2_", "_min_", "_max_")) else "bigint" for c in stats.state_columns(spec)}
    fields = ["file_name string", "REPORT_DATE date", *(f"{d} string" for d in spec.stat_dims)]
    fields += [f"{c} {kind}" for c, kind in kinds.items()]
    rows = spark.read.schema(", ".join([*fields, "category string", "load_id string"])).parquet(path)
    live = versions.filter(F.col("category") == spec.category)
    return rows.filter(F.col("category") == spec.category).join(
        live, ["category", "file_name", "load_id"], "left_semi"
    ).drop("category", "load_id")


def write_file_stats(documents: DataFrame, path: str) -> None:
    """Store statistics records of files (see `stats_documents`), replacing those of a rerun."""
    _replace_partitions(documents, ["file_name"], path)


def save_metadata(schema_rows: DataFrame, file_name: str, key: str, path: str) -> None:
    """Append the rows of a schema file as JSON records with its name and target key."""
    fields = [c for c in schema_rows.columns if c != "row_no"]
    schema_rows.select(
        F.lit(file_name).alias("file_name"),
        F.lit(key).alias("object_key"),
        "row_no",
        F.to_json(F.struct(*fields)).alias("json_record"),
        F.current_timestamp().alias("uploaded_at"),
    ).write.mode("append").parquet(path)


def append_glossary(entries: DataFrame, source_file: str, path: str) -> None:
    """Append dictionary entries as (id, context_name, description, source_file)."""
    entries.select(
        F.concat(
            F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS"),
            F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"),
        ).alias("id"),
        "context_name",
        "description",
        F.lit(source_file).alias("source_file"),
    ).write.mode("append").parquet(path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Code -> description; the entry added last wins."""
    return (
        spark.read.parquet(path)
        .groupBy("context_name")
        .agg(F.max_by("description", "id").alias("description"))
    )


def append_log(questions: DataFrame, path: str) -> None:
    """Append question logs under generated keys."""
    questions.withColumns(
        {"log_id": F.expr("uuid()"), "created_at": F.current_timestamp()}
    ).write.mode("append").parquet(path)


def export_training_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as JSON records."""
    pairs.write.mode("overwrite").json(path)


def export_feedback_csv(grid: DataFrame, path: str) -> None:
    """Feedback grid as CSV with a header."""
    grid.write.mode("overwrite").option("header", True).csv(path)
