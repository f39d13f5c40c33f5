"""Tracking of uploaded files, their metadata and the processing log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.dates import iso_date
from gridledger.functions.numbers import percent
from gridledger.functions.text import feed_of_name, status_label
from gridledger.specs import CATEGORIES, FEEDS


def processed_only(files: DataFrame) -> DataFrame:
    return files.filter(F.col("is_processed") == 1)


def skip_processed(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose name is not logged as processed."""
    return files.join(processed_only(log), "file_name", "left_anti")


def filter_feed(files: DataFrame, category: str) -> DataFrame:
    """Processed files whose name starts with the mark of the commodity."""
    mark = FEEDS[category].file_mark
    return processed_only(files).filter(F.col("file_name").startswith(mark))


def latest_metadata(metadata: DataFrame, kinds: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Newest metadata row per kind: the file name contains the kind, in any case.

    A name may match several kinds. Ties on the upload time go to the higher file id.
    """
    matches = F.array_compact(
        F.array(*[F.when(F.col("file_name").ilike(f"%{k}%"), F.lit(k)) for k in kinds])
    )
    payload = [c for c in metadata.columns if c not in ("uploaded_at", "file_id")]
    newest = F.max(F.struct("uploaded_at", "file_id", *payload)).alias("m")
    return (
        metadata.withColumn("kind", F.explode(matches)).groupBy("kind").agg(newest)
    ).select("kind", "m.*")


def latest_per_key(frame: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row of each key; `order` lists the ordering columns, most significant first."""
    rest = [c for c in frame.columns if c not in order and c != key]
    newest = F.max(F.struct(*order, *rest)).alias("row")
    return frame.groupBy(key).agg(newest).select(key, "row.*")


def with_feed(files: DataFrame) -> DataFrame:
    return files.withColumn("feed", feed_of_name("file_name"))


def file_counts(files: DataFrame, expected: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Files per feed; the expected feeds are listed even when they have none."""
    zero = F.explode(F.array(*[F.lit(c) for c in expected]))
    spark = files.sparkSession
    base = spark.range(1).select(zero.alias("feed"), F.lit(0).cast("bigint").alias("n"))
    found = with_feed(files).groupBy("feed").agg(F.count("*").alias("n"))
    return found.unionByName(base).groupBy("feed").agg(F.sum("n").alias("n_files"))


def processed_pct(files: DataFrame) -> DataFrame:
    """Processed and waiting files and the processed share in percent."""
    counts = files.agg(
        F.coalesce(F.sum(F.col("is_processed").cast("bigint")), F.lit(0)).alias("processed"),
        F.count("*").alias("n"),
    )
    return counts.select(
        "processed",
        (F.col("n") - F.col("processed")).alias("not_processed"),
        percent("processed", "n").alias("processed_pct"),
    )


def file_timeline(files: DataFrame) -> DataFrame:
    """Files per upload day and feed, for the combinations that occur."""
    day = F.to_date("uploaded_at").alias("upload_day")
    return with_feed(files).groupBy(day, "feed").agg(F.count("*").alias("n_files"))


def file_listing(files: DataFrame) -> DataFrame:
    """Display form of the file table."""
    return files.select(
        F.col("file_name").alias("File Name"),
        iso_date("report_date").alias("Report Date"),
        iso_date("uploaded_at").alias("Date Uploaded"),
        status_label("is_processed", "Yes", "No").alias("Processed"),
    )


def distinct_sources(glossary: DataFrame) -> DataFrame:
    return glossary.select("source_file").distinct().orderBy("source_file")


def ingest_entries(rows: DataFrame) -> DataFrame:
    """Log entry per loaded file: (file_name, category, report_date, n_rows)."""
    return rows.groupBy("file_name", "category").agg(
        F.min("REPORT_DATE").alias("report_date"), F.count("*").alias("n_rows")
    )
