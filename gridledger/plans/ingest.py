"""Batch ingest: folder -> validated rows -> raw table, snapshots, statistics, log."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.operators import cube, quality, stats
from gridledger.plans import snapshots
from gridledger.session import drop_folder, lean_writes
from gridledger.sources import feeds, tables
from gridledger.specs import PW, FeedSpec


@dataclass(frozen=True)
class Store:
    """Table folders under one root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def ingest_folder(
    spark: SparkSession,
    uri: str,
    spec: FeedSpec,
    store: Store,
    declared: list[str] | None = None,
) -> list[str]:
    """Load the new files of one commodity, refresh what depends on them, return their names.

    Files are validated before they are loaded: a file that lacks a declared column or holds a
    junk number in a load measure goes to the rejected table and leaves no rows behind. Later
    steps read the loaded rows back from the table, where they are columnar and pruned by file.
    """
    log = tables.read_log(spark, store.path("data_files"))
    paths = feeds.new_files(spark, uri, spec, log)
    if not paths:
        return []
    ingest_paths(spark, paths, spec, store, declared)
    return list(dict.fromkeys(re.sub(r"(?i)(\.csv)\.gz$", r"\1", p.rsplit("/", 1)[1]) for p in paths))


def ingest_paths(
    spark: SparkSession,
    paths: list[str],
    spec: FeedSpec,
    store: Store,
    declared: list[str] | None = None,
) -> None:
    """Load the given files of one commodity (see `ingest_folder`)."""
    # The headers are looked up once; everything after works on this small table.
    headers = stored_headers(spark, paths, store)
    good = headers
    load_id = tables.new_load_id()
    if declared is not None:
        expected = F.array(*[F.lit(c) for c in declared]).alias("columns")
        metadata = spark.range(1).select(F.lit(spec.category).alias("category"), expected)
        verdicts = quality.validate_schema(headers, metadata)
        # A piece that is wrong rejects its file.
        refused = verdicts.filter(~F.col("is_valid"))
        wrong = headers.join(refused, "file_name", "left_semi")
        good = headers.join(refused, "file_name", "left_anti")
        for files in feeds.file_slices(wrong):
            unread = feeds.read_by_header(files, spec)
            tables.write_rejected(unread, spec.category, store.path("rejected"), load_id)
    load_files(spark, good, spec, store, load_id)
    finish_load(spark, headers.select("file_name"), spec, store, load_id)


def stored_headers(spark: SparkSession, paths: list[str], store: Store) -> DataFrame:
    """Headers of new files, written to the store so that the text is scanned for them once."""
    path = store.path(f"headers/{tables.new_load_id()}")
    with lean_writes(spark):
        feeds.file_headers(spark, paths).write.parquet(path)
    return spark.read.parquet(path)


def load_files(
    spark: SparkSession, headers: DataFrame, spec: FeedSpec, store: Store, load_id: str
) -> None:
    """Write the clean files' rows and the rejected ones under a load id, not yet visible.

    A first pass over the load measures names the bad files. Then the clean files and the bad ones are read and laid out
    in slices, so that neither a copy of the text nor more than a slice's shuffle is on disk.
    """
    staging = store.path(f"staging/{load_id}")
    rows = feeds.read_by_header(headers, spec)
    with lean_writes(spark):
        quality.junk_files(rows, spec).write.parquet(staging)
    bad = spark.read.schema("file_name string").parquet(staging)
    columns = rows.columns

    def slices(files: DataFrame):
        for part in feeds.file_slices(files):
            read = feeds.read_by_header(part, spec)
            # A column that only other slices' files have is null here.
            lacking = {c: F.lit(None).cast("string") for c in columns if c not in read.columns}
            yield quality.strict_load(read.withColumns(lacking).select(*columns), spec, bad)

    for _, junk in slices(headers.join(bad, "file_name", "left_semi")):
        tables.write_rejected(junk, spec.category, store.path("rejected"), load_id)
    for clean, _ in slices(headers.join(bad, "file_name", "left_anti")):
        tables.append_raw(clean, spec.category, store.path("positions"), load_id)
    drop_folder(spark, staging)


def finish_load(
    spark: SparkSession, files: DataFrame, spec: FeedSpec, store: Store, load_id: str
) -> None:
    """Make a load visible and refresh what depends on it. `files` (file_name): all files tried.

    A run that dies before this point leaves no trace for readers; one that dies inside it is
    repaired by loading the files again.
    """
    positions = store.path("positions")
    tables.announce_versions(files, spec.category, positions, load_id)
    schema = tables.raw_schema(spec)
    loaded = tables.load_rows(spark, positions, schema, spec.category, load_id)
    if spec.category == PW.category:
        snapshots.refresh(spark, store)
    staging = store.path(f"staging/{load_id}-newest")
    with lean_writes(spark):
        stats.newest_reports(loaded).write.parquet(staging)
    newest = spark.read.schema("file_name string, REPORT_DATE date").parquet(staging)
    tables.write_file_stats(
        stats.stats_documents(file_statistics(loaded, spec, newest)), store.path("file_stats")
    )
    drop_folder(spark, staging)
    for part in tables.date_slices(loaded, positions):
        states = stats.statistics_states(quality.coerce_measures(part, spec), spec, ("file_name",))
        tables.append_statistics(states, spec.category, load_id, store.path("statistics"))
    log = store.path("data_files")
    tables.log_ingest(loaded, spec.category, log)
    done = loaded.select("file_name").distinct()
    tables.log_unprocessed(files.join(done, "file_name", "left_anti"), spec.category, log)


def file_statistics(
    rows: DataFrame, spec: FeedSpec, newest: DataFrame | None = None
) -> DataFrame:
    """Statistics of the newest report of each file (`newest`, if known: file_name, REPORT_DATE)."""
    typed = quality.coerce_measures(rows, spec)
    kept = stats.keep_latest_report(typed, "file_name", newest=newest)
    return stats.daily_stats(kept, spec, extra_keys=("file_name",))


def rebuild_snapshots(spark: SparkSession, store: Store) -> None:
    """Build all power snapshots anew from the raw table, without the states of `snapshots.refresh`."""
    positions = tables.read_raw(spark, store.path("positions"), PW)
    tables.upsert_snapshot(cube.build_cube(positions), PW.category, store.path("snapshots"))
