"""File arrival, snapshot refresh and timelines as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridledger.functions.text import feed_of_name, route_feed
from gridledger.operators import feedback
from gridledger.plans import ingest, snapshots
from gridledger.plans.ingest import Store
from gridledger.sources import tables
from gridledger.sources.feeds import CSV_FILES, plain_name
from gridledger.specs import PW, FeedSpec


def file_stream(spark: SparkSession, uri: str, spec: FeedSpec) -> DataFrame:
    """CSV files of one commodity as they arrive: (path, file_name), contents unread."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", CSV_FILES)
        .load(uri)
        .select("path", plain_name(F.element_at(F.split("path", "/"), -1)).alias("file_name"))
        .filter(route_feed("file_name") == spec.category)
    )


def stream_ingest(
    spark: SparkSession,
    uri: str,
    spec: FeedSpec,
    store: Store,
    declared: list[str] | None = None,
) -> StreamingQuery:
    """Load files that arrived since the last run, by the same steps as the batch ingest.

    The stream's checkpoint remembers the files seen, which replaces the processed flag. Each file is
    read by its own header, validated, logged and summed up; a replayed batch loads its files
    again, and their newest version counts. The pieces of a file have to arrive together.
    """

    def load(batch: DataFrame, _: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").toLocalIterator())
        if paths:
            ingest.ingest_paths(batch.sparkSession, paths, spec, store, declared)

    return (
        file_stream(spark, uri, spec)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", store.path(f"checkpoints/ingest_{spec.category}"))
        .foreachBatch(load)
        .start()
    )


def stream_snapshots(spark: SparkSession, store: Store) -> StreamingQuery:
    """Refresh the snapshots of the report dates whose files gained or lost versions.

    The stream follows the table of file versions, the last thing a load writes. A batch adds the
    new loads' contributions to their dates and subtracts replaced ones (`plans.snapshots`), so
    a replayed batch finds nothing left to do.
    """
    announced = spark.readStream.schema(tables.VERSIONS).parquet(tables.versions_path(store.path("positions")))

    def refresh(batch: DataFrame, _: int) -> None:
        snapshots.refresh(batch.sparkSession, store)

    return (
        announced.filter(F.col("category") == PW.category)
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", store.path("checkpoints/snapshots"))
        .foreachBatch(refresh)
        .start()
    )


def stream_timeline(files: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Files per day and feed over a stream of (file_name, uploaded_at).

    A day is emitted once the watermark has passed it; later rows for it are dropped.
    """
    # Stream windows are cut at midnight UTC. The clock time of the session's zone is moved onto
    # UTC and back, so that a day is the day the session shows.
    zone = F.current_timezone()
    clock = F.from_utc_timestamp(F.col("uploaded_at").cast("timestamp"), zone)
    return (
        files.select(feed_of_name("file_name").alias("feed"), clock.alias("clock"))
        .withWatermark("clock", watermark)
        .groupBy(F.window("clock", "1 day"), "feed")
        .agg(F.count("*").alias("n_files"))
        .select(
            F.to_date(F.to_utc_timestamp("window.start", zone)).alias("upload_day"),
            "feed",
            "n_files",
        )
    )


def stream_agents(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the agent table's states from a stream of its change log (see `feedback.agent_states`).

    Each batch is reduced to one state per agent and appended to `path`. States join by maxima, so batches
    may come out of order or twice; `read_agents` puts them together.
    """

    def keep(batch: DataFrame, _: int) -> None:
        feedback.agent_states(batch).write.mode("append").parquet(path)

    return (
        changes.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .start()
    )


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    """Current agents from the states that `stream_agents` keeps."""
    return feedback.agents_of_states(feedback.join_agent_states(spark.read.parquet(path)))
