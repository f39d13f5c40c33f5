"""Queries over stores that change: corrections, retirements, replays, merged statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions.dates import iso_date
from gridledger.functions.numbers import total_or_0
from gridledger.operators import prompts, retrieval, stats
from gridledger.plans import snapshots
from gridledger.plans.ingest import Store
from gridledger.session import new_table_dir
from gridledger.sources import star, tables
from gridledger.streaming import jobs
from workload.operations import AGENTS_SQL, NEAREST, agent_changes
from workload.positions import _build_cube_sql
from workload.registry import as_double, dsum, exact_sum, query

# --- snapshots by what files gained and lost -----------------------------------------

# Asia's file comes again without its nearest horizon and with one status only, Africa's without rows.
_CORRECTED = """(SELECT * FROM fx_pw WHERE BOOK_ATTR6 <> 'AFRICA'
    AND (BOOK_ATTR6 <> 'ASIA' OR (HORIZON <> 'M+1' AND TGROUP2 = 'F')))"""
_CORRECTED_CUBE = _build_cube_sql().replace("FROM fx_pw", f"FROM {_CORRECTED}")


def _files_by_region(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("NOP_PW_"), F.col("BOOK_ATTR6"), F.lit(".csv"))
    return star.power_positions(spark, sf).withColumn("file_name", name)


def _correct(spark: SparkSession, sf: str, store: Store) -> None:
    path = store.path("positions")
    asia = _files_by_region(spark, sf).filter("BOOK_ATTR6 = 'ASIA' AND HORIZON <> 'M+1' AND TGROUP2 = 'F'")
    tables.append_raw(asia, specs.PW.category, path)
    africa = spark.createDataFrame([("NOP_PW_AFRICA.csv",)], "file_name string")
    tables.announce_versions(africa, specs.PW.category, path, tables.new_load_id())


def _published(spark: SparkSession, store: Store) -> DataFrame:
    rows = tables.read_snapshots(spark, store.path("snapshots"), specs.PW.category).drop("category")
    return rows.withColumn("REPORT_DATE", iso_date("REPORT_DATE"))


@query("incremental_snapshots", _CORRECTED_CUBE)
def incremental_snapshots(spark, sf):
    """All regions loaded, two files corrected, the refresh repeated: as if built from what is left."""
    store = Store(new_table_dir(spark, "store"))
    tables.append_raw(_files_by_region(spark, sf), specs.PW.category, store.path("positions"))
    snapshots.refresh(spark, store)
    _correct(spark, sf, store)
    snapshots.refresh(spark, store)
    snapshots.refresh(spark, store)
    return _published(spark, store)


@query("stream_corrections", _CORRECTED_CUBE)
def stream_corrections(spark, sf):
    """The same by the stream of file versions, run before and after the corrections."""
    store = Store(new_table_dir(spark, "store"))
    tables.append_raw(_files_by_region(spark, sf), specs.PW.category, store.path("positions"))
    jobs.stream_snapshots(spark, store).awaitTermination()
    _correct(spark, sf, store)
    jobs.stream_snapshots(spark, store).awaitTermination()
    return _published(spark, store)


# --- statistics that add up -----------------------------------------------------------


def _merged_sql(spec: specs.FeedSpec, view: str, where: str) -> str:
    cells = []
    for m in spec.measures:
        total = as_double(exact_sum(m))
        cells += [
            f"{total} AS TOTAL_{m}", f"{total} / COUNT(*) AS AVG_{m}", f"MIN({m}) AS MIN_{m}", f"MAX({m}) AS MAX_{m}",
            f"ROUND(STDDEV_SAMP({m}), 4) AS STD_{m}",
        ]
    return f"SELECT SEGMENT, CAST(COUNT(*) AS BIGINT) AS n, {', '.join(cells)} FROM {view} WHERE {where} GROUP BY SEGMENT"


def _merged(positions: DataFrame, spec: specs.FeedSpec, wanted: str) -> DataFrame:
    """Statistics by segment over the wanted files and all dates, from stored states of file, date and group."""
    spark = positions.sparkSession
    store = Store(new_table_dir(spark, "store"))
    path, load_id = store.path("statistics"), tables.new_load_id()
    named = positions.withColumn("file_name", F.concat(F.lit(f"NOP_{spec.category}_"), "BOOK", F.lit(".csv")))
    tables.append_statistics(stats.statistics_states(named, spec, ("file_name",)), spec.category, load_id, path)
    files = spark.read.schema("file_name string").parquet(path).distinct()
    tables.announce_versions(files, spec.category, store.path("positions"), load_id)
    states = tables.read_statistics(spark, path, spec, tables.live_versions(spark, store.path("positions")))
    # Files to days first, then days to segments: states of states.
    daily = stats.merge_statistics(states.filter(wanted), spec, ["REPORT_DATE", "SEGMENT"], merged=True)
    merged = stats.merge_statistics(daily, spec, ["SEGMENT"])
    return merged.withColumns({f"STD_{m}": F.round(f"STD_{m}", 4) for m in spec.measures})


@query("merged_statistics_ng", _merged_sql(specs.NG, "fx_ng", "BOOK <> 'Brand#11'"))
def merged_statistics_ng(spark, sf):
    return _merged(star.gas_positions(spark, sf), specs.NG, "file_name <> 'NOP_NG_Brand#11.csv'")


@query("merged_statistics_co2", _merged_sql(specs.CO2, "fx_co2", "BOOK < 'Brand#4'"))
def merged_statistics_co2(spark, sf):
    return _merged(star.carbon_positions(spark, sf), specs.CO2, "file_name < 'NOP_CO2_Brand#4'")


# --- change logs, catalogues, pruned search ----------------------------------------------


@query("stream_agents", AGENTS_SQL)
def stream_agents(spark, sf):
    """The change log as a stream; the states that its batches leave are joined."""
    events = (
        spark.readStream.schema(star.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    path = new_table_dir(spark, "agents")
    jobs.stream_agents(agent_changes(events), path, f"{path}-checkpoint").awaitTermination()
    return jobs.read_agents(spark, path)


@query(
    "select_metrics_from",
    """WITH c AS (SELECT CAST(p_partkey AS INT) AS ord, p_name AS name, p_type AS metric FROM part UNION ALL SELECT 0, 'open_position', 'NOP'
                  UNION ALL SELECT -1, 'first one', 'FIRST' UNION ALL SELECT -2 - row_number() OVER (ORDER BY event_type), left(event_type, 2), event_type
                  FROM (SELECT DISTINCT event_type FROM events)),
        p AS (SELECT doc_id AS prompt_id, replace(replace(lower(text), ' ', ''), '_', '') AS t FROM documents)
        SELECT DISTINCT prompt_id, ord, name, metric FROM p JOIN c
        ON contains(t, replace(lower(name), '_', '')) OR ord = (SELECT MIN(ord) FROM c)""",
)
def select_metrics_from(spark, sf):
    """A catalogue table as long as the parts, named in whole documents."""
    part = star.table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("metric")
    )
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("event_type")))
    kinds = star.table(spark, sf, "events").select("event_type").distinct().select(
        (-2 - place).alias("ord"), F.left("event_type", F.lit(2)).alias("name"), F.col("event_type").alias("metric")
    )
    more = F.expr("inline(array(struct(0, 'open_position', 'NOP'), struct(-1, 'first one', 'FIRST')))")
    catalogue = part.unionByName(kinds).unionByName(spark.range(1).select(more.alias("ord", "name", "metric")))
    docs = star.table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return prompts.select_metrics_from(docs, catalogue, "prompt_id")


@query(
    "nearest_questions_pruned",
    f"{NEAREST} SELECT question_id, rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 3",
)
def nearest_questions_pruned(spark, sf):
    near = retrieval.nearest_pruned(star.questions(spark, sf), star.feedback_texts(spark, sf))
    return near.withColumn("distance", F.round("distance", 6))


# --- compaction -----------------------------------------------------------------------


@query(
    "compacted_store",
    f"""SELECT CAST(REPORT_DATE AS VARCHAR) AS REPORT_DATE, concat('NOP_PW_', BOOK_ATTR6, '.csv') AS file_name,
               CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) AS BIGINT) AS n_stored, {dsum('VOLUME_BL')} AS volume
        FROM {_CORRECTED} GROUP BY 1, 2""",
)
def compacted_store(spark, sf):
    """After corrections, compaction and vacuum the table holds live rows only."""
    store = Store(new_table_dir(spark, "store"))
    path = store.path("positions")
    tables.append_raw(_files_by_region(spark, sf), specs.PW.category, path)
    _correct(spark, sf, store)
    tables.compact(spark, path, specs.PW)
    tables.vacuum(spark, path, specs.PW, older_than_s=0)
    keys = ["REPORT_DATE", "file_name"]
    every = spark.read.schema(tables.raw_schema(specs.PW)).parquet(path)
    stored = every.groupBy(*keys).agg(F.count("*").alias("n_stored"))
    read = tables.read_raw(spark, path, specs.PW).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), total_or_0("VOLUME_BL").alias("volume")
    )
    return stored.join(read, keys, "full").withColumn("REPORT_DATE", iso_date("REPORT_DATE"))
