"""Queries over files, agents, question logs, feedback and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions import text
from gridledger.functions.dates import extract_date, iso_date
from gridledger.operators import agents, delta, feedback, files, prompts, quality, retrieval
from gridledger.plans import adhoc
from gridledger.sources import star
from workload.registry import dsum_null, query, round2

# The day the test logs cover; a live dashboard passes the current date.
TODAY = "2024-01-03"


def _text(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# --- files ---------------------------------------------------------------------------

_ROUTE = """CASE WHEN contains(upper(file_name), 'NOP_CO2') THEN 'CO2' WHEN contains(upper(file_name), 'NOP_NG') THEN 'NG'
                 WHEN contains(upper(file_name), 'NOP_PW') THEN 'PW' END"""


@query("route_feed", f"SELECT file_name, {_ROUTE} AS category FROM fx_files")
def route_feed(spark, sf):
    return star.data_files(spark, sf).select("file_name", text.route_feed("file_name").alias("category"))


@query(
    "route_object_key",
    f"""SELECT file_name, concat(COALESCE(({_ROUTE}) || '/', 'misc/'), file_name) AS data_key,
        concat(CASE WHEN contains(upper(file_name), 'CO2') THEN 'CO2/metadata/'
                    WHEN contains(upper(file_name), 'NG') THEN 'NG/metadata/'
                    WHEN contains(upper(file_name), 'PW') THEN 'PW/metadata/' ELSE 'misc/' END, file_name) AS metadata_key
        FROM fx_files""",
)
def route_object_key(spark, sf):
    return star.data_files(spark, sf).select(
        "file_name",
        text.route_object_key("file_name").alias("data_key"),
        text.route_object_key("file_name", "metadata").alias("metadata_key"),
    )


@query(
    "skip_processed",
    """SELECT file_id, file_name FROM fx_files f WHERE NOT EXISTS
       (SELECT 1 FROM fx_files g WHERE g.file_name = f.file_name AND g.is_processed = 1)""",
)
def skip_processed(spark, sf):
    known = star.data_files(spark, sf)
    return files.skip_processed(known, known.select("file_name", "is_processed")).select(
        "file_id", "file_name"
    )


@query(
    "log_ingest",
    """SELECT concat(BOOK, '.csv') AS file_name, 'PW' AS category, CAST(MIN(REPORT_DATE) AS VARCHAR) AS report_date,
              CAST(COUNT(*) AS BIGINT) AS n_rows FROM fx_pw GROUP BY BOOK""",
)
def log_ingest(spark, sf):
    rows = star.power_positions(spark, sf).select(
        F.concat("BOOK", F.lit(".csv")).alias("file_name"),
        F.lit("PW").alias("category"),
        "REPORT_DATE",
    )
    return _text(files.ingest_entries(rows), "report_date")


@query(
    "latest_metadata",
    """WITH k AS (SELECT 'CO2' AS kind UNION ALL SELECT 'NG' UNION ALL SELECT 'PW'),
       m AS (SELECT k.kind, f.*, ROW_NUMBER() OVER (PARTITION BY k.kind ORDER BY uploaded_at DESC, file_id DESC) AS pos
             FROM fx_files f JOIN k ON f.file_name ILIKE concat('%', k.kind, '%'))
       SELECT kind, file_id, file_name, CAST(uploaded_at AS DATE)::VARCHAR AS uploaded_at FROM m WHERE pos = 1""",
)
def latest_metadata(spark, sf):
    newest = files.latest_metadata(
        star.data_files(spark, sf).select("file_name", "uploaded_at", "file_id")
    )
    return newest.withColumn("uploaded_at", iso_date("uploaded_at"))


@query(
    "latest_per_key",
    """WITH r AS (SELECT category, uploaded_at, file_id, file_name,
              ROW_NUMBER() OVER (PARTITION BY category ORDER BY uploaded_at DESC, file_id DESC) AS pos FROM fx_files)
       SELECT category, file_id, file_name FROM r WHERE pos = 1""",
)
def latest_per_key(spark, sf):
    rows = star.data_files(spark, sf).select("category", "uploaded_at", "file_id", "file_name")
    return files.latest_per_key(rows, "category", ["uploaded_at", "file_id"]).drop("uploaded_at")


@query(
    "filter_feed",
    "SELECT file_id, file_name FROM fx_files WHERE starts_with(file_name, 'NOP_CO2') AND is_processed = 1",
)
def filter_feed(spark, sf):
    return files.filter_feed(star.data_files(spark, sf), "CO2").select("file_id", "file_name")


@query("processed_only", "SELECT file_id, file_name, category FROM fx_files WHERE is_processed = 1")
def processed_only(spark, sf):
    return files.processed_only(star.data_files(spark, sf)).select("file_id", "file_name", "category")


@query(
    "file_counts",
    """WITH e AS (SELECT 'CO2' AS feed UNION ALL SELECT 'PW' UNION ALL SELECT 'NG'),
       n AS (SELECT split_part(file_name, '_', 2) AS feed, COUNT(*) AS n FROM fx_files GROUP BY 1)
       SELECT feed, CAST(COALESCE(n, 0) AS BIGINT) AS n_files FROM e FULL JOIN n USING (feed)""",
)
def file_counts(spark, sf):
    return files.file_counts(star.data_files(spark, sf))


@query(
    "feed_of_name",
    """SELECT c_name AS file_name, CASE WHEN len(string_split(c_name, '_')) > 1 THEN string_split(c_name, '_')[2] ELSE 'OTHER' END AS feed FROM customer
       UNION ALL SELECT file_name, string_split(file_name, '_')[2] FROM fx_files""",
)
def feed_of_name(spark, sf):
    names = star.table(spark, sf, "customer").select(F.col("c_name").alias("file_name"))
    both = names.unionByName(star.data_files(spark, sf).select("file_name"))
    return files.with_feed(both)


@query(
    "processed_pct",
    """SELECT CAST(SUM(is_processed) AS BIGINT) AS processed, CAST(COUNT(*) - SUM(is_processed) AS BIGINT) AS not_processed,
              CASE WHEN COUNT(*) > 0 THEN 100.0::DOUBLE * CAST(SUM(is_processed) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) ELSE 0 END AS processed_pct FROM fx_files""",
)
def processed_pct(spark, sf):
    return files.processed_pct(star.data_files(spark, sf))


@query(
    "file_timeline",
    """SELECT CAST(CAST(uploaded_at AS DATE) AS VARCHAR) AS upload_day, split_part(file_name, '_', 2) AS feed,
              CAST(COUNT(*) AS BIGINT) AS n_files FROM fx_files GROUP BY 1, 2""",
)
def file_timeline(spark, sf):
    return _text(files.file_timeline(star.data_files(spark, sf)), "upload_day")


@query(
    "file_listing",
    """SELECT file_name AS "File Name", CAST(report_date AS VARCHAR) AS "Report Date",
              CAST(CAST(uploaded_at AS DATE) AS VARCHAR) AS "Date Uploaded",
              CASE WHEN is_processed = 1 THEN 'Yes' ELSE 'No' END AS "Processed" FROM fx_files""",
)
def file_listing(spark, sf):
    return files.file_listing(star.data_files(spark, sf))


@query(
    "distinct_sources",
    "SELECT DISTINCT category || '_dictionary' AS source_file FROM fx_files ORDER BY 1",
)
def distinct_sources(spark, sf):
    entries = star.data_files(spark, sf).select(
        F.concat("category", F.lit("_dictionary")).alias("source_file")
    )
    return files.distinct_sources(entries)


# --- data quality --------------------------------------------------------------------


def _file_columns(spark, sf):
    """(file_name, category, column_name): an order's columns are its line numbers."""
    line = star.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.concat(F.lit(" col_"), F.col("l_linenumber").cast("string")).alias("column_name"),
    )
    known = star.data_files(spark, sf).select("file_id", "file_name", "category")
    return known.join(line, "file_id").select("file_name", "category", "column_name")


def _headers(spark, sf):
    # A header has as many entries as there are line numbers, at most seven.
    return (
        _file_columns(spark, sf)
        .groupBy("file_name", "category")
        .agg(F.collect_set("column_name").alias("columns"))
    )


@query(
    "validate_schema",
    """WITH have AS (SELECT DISTINCT f.file_name, f.category, concat('COL_', l.l_linenumber) AS c
                     FROM fx_files f JOIN lineitem l ON l.l_orderkey = f.file_id),
       want AS (SELECT DISTINCT category, concat('COL_', l_linenumber) AS c FROM fx_files JOIN lineitem ON l_orderkey = file_id
                WHERE l_linenumber <= CASE category WHEN 'CO2' THEN 2 WHEN 'NG' THEN 3 ELSE 1 END AND category <> 'XX'),
       fs AS (SELECT DISTINCT file_name, category FROM have),
       miss AS (SELECT fs.file_name, string_agg(want.c, ',' ORDER BY want.c) AS missing FROM fs JOIN want USING (category)
                LEFT JOIN have ON have.file_name = fs.file_name AND have.c = want.c WHERE have.c IS NULL GROUP BY 1),
       ext AS (SELECT have.file_name, string_agg(have.c, ',' ORDER BY have.c) AS extra FROM have
               LEFT JOIN want ON want.category = have.category AND want.c = have.c
               WHERE want.c IS NULL AND have.category <> 'XX' GROUP BY 1)
       SELECT file_name, category, COALESCE(missing, '') AS missing, COALESCE(extra, '') AS extra, missing IS NULL AND category <> 'XX' AS is_valid
       FROM fs LEFT JOIN miss USING (file_name) LEFT JOIN ext USING (file_name)""",
)
def validate_schema(spark, sf):
    declared = {"CO2": 2, "NG": 3, "PW": 1}
    limit = F
    for category, n in declared.items():
        limit = limit.when(F.col("category") == category, n)
    columns = (
        _file_columns(spark, sf)
        .select("category", F.col("column_name").alias("c"))
        .distinct()
        .filter(F.substring_index("c", "_", -1).cast("int") <= limit)
    )
    metadata = columns.groupBy("category").agg(F.collect_set("c").alias("columns"))
    verdicts = quality.validate_schema(_headers(spark, sf), metadata)
    return verdicts.withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


@query(
    "column_differences",
    """WITH d AS (SELECT DISTINCT REPORT_DATE AS dt FROM fx_pw ORDER BY dt DESC LIMIT 2),
       p AS (SELECT MAX(dt) AS latest, MIN(dt) AS previous FROM d),
       cur AS (SELECT DISTINCT BOOK, BOOK_ATTR8 FROM fx_pw, p WHERE REPORT_DATE = latest),
       prev AS (SELECT DISTINCT BOOK, BOOK_ATTR8 FROM fx_pw, p WHERE REPORT_DATE = previous)
       SELECT 'only_latest' AS side, * FROM (SELECT * FROM cur EXCEPT SELECT * FROM prev)
       UNION ALL SELECT 'only_previous', * FROM (SELECT * FROM prev EXCEPT SELECT * FROM cur)""",
)
def column_differences(spark, sf):
    keys = ["BOOK", "BOOK_ATTR8"]
    rows, is_latest, is_previous = delta.last_two(star.power_positions(spark, sf))
    first, second = quality.column_differences(
        rows.filter(is_latest).select(*keys), rows.filter(is_previous).select(*keys)
    )
    return first.select(F.lit("only_latest").alias("side"), *keys).unionByName(
        second.select(F.lit("only_previous").alias("side"), *keys)
    )


# --- agents and logs -----------------------------------------------------------------


@query(
    "agent_file_counts",
    """SELECT a.agent_id, a.name, a.s3_folder,
              CAST(COALESCE(SUM(CASE WHEN f.is_processed = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS processed_count,
              CAST(COALESCE(SUM(CASE WHEN f.is_processed = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS unprocessed_count,
              CAST(COUNT(f.file_id) AS BIGINT) AS total_count
       FROM fx_agents a LEFT JOIN fx_files f ON a.s3_folder = f.category GROUP BY a.agent_id, a.name, a.s3_folder""",
)
def agent_file_counts(spark, sf):
    counted = agents.agent_file_counts(star.agents(spark, sf), star.data_files(spark, sf))
    return counted.select(
        "agent_id", "name", "s3_folder", "processed_count", "unprocessed_count", "total_count"
    )


@query(
    "agent_listing",
    """SELECT agent_id AS id, name AS agent_name, s3_folder, CASE WHEN is_active = 1 THEN 'Active' ELSE 'Inactive' END AS status
       FROM fx_agents""",
)
def agent_listing(spark, sf):
    return agents.agent_listing(star.agents(spark, sf))


@query(
    "query_logs",
    """SELECT l.log_id, l.agent_id, a.name AS agent_name, l.query, l.answer, CAST(l.created_at AS VARCHAR) AS created_at, l.latency
       FROM fx_logs l JOIN fx_agents a USING (agent_id) ORDER BY l.created_at DESC""",
)
def query_logs(spark, sf):
    return _text(
        agents.query_logs(star.question_logs(spark, sf), star.agents(spark, sf)), "created_at"
    )


_METRICS_SQL = f"""WITH l AS (SELECT g.*, a.name FROM fx_logs g JOIN fx_agents a USING (agent_id)),
    m AS (SELECT name, COUNT(CASE WHEN CAST(created_at AS DATE) = DATE '{TODAY}' THEN 1 END) AS today,
                 {dsum_null('latency')} / COUNT(latency) AS lat, MAX(created_at) AS last_used FROM l GROUP BY name),
    metrics AS (SELECT a.agent_id, a.name AS agent_name, CASE WHEN a.is_active = 1 THEN 'Active' ELSE 'Inactive' END AS status,
           CAST(COALESCE(m.today, 0) AS BIGINT) AS queries_today,
           CASE WHEN m.name IS NULL THEN 0.0::DOUBLE ELSE {round2('m.lat')} END AS avg_latency,
           CAST(m.last_used AS VARCHAR) AS last_used FROM fx_agents a LEFT JOIN m ON a.name = m.name)"""


def _metrics(spark, sf):
    return agents.agent_metrics(star.agents(spark, sf), star.question_logs(spark, sf), TODAY)


@query("agent_metrics", f"{_METRICS_SQL} SELECT * FROM metrics")
def agent_metrics(spark, sf):
    return _text(_metrics(spark, sf), "last_used")


@query(
    "agent_kpis",
    f"""{_METRICS_SQL} SELECT CAST(COUNT(*) AS BIGINT) AS total_agents, CAST(COUNT(CASE WHEN status = 'Active' THEN 1 END) AS BIGINT) AS active_agents,
        CAST(SUM(queries_today) AS BIGINT) AS queries_today, {round2(f"{dsum_null('avg_latency')} / COUNT(avg_latency)")} AS avg_latency FROM metrics""",
)
def agent_kpis(spark, sf):
    return agents.agent_kpis(_metrics(spark, sf))


@query(
    "query_share",
    f"""{_METRICS_SQL}, t AS (SELECT CAST(SUM(queries_today) AS DOUBLE) AS s FROM metrics)
        SELECT agent_name, queries_today, CASE WHEN s <> 0 THEN 100.0::DOUBLE * CAST(queries_today AS DOUBLE) / s ELSE 0 END AS share_pct FROM metrics, t""",
)
def query_share(spark, sf):
    return agents.query_share(_metrics(spark, sf))


@query(
    "queries_today",
    f"""SELECT agent_id, CAST(COUNT(*) AS BIGINT) AS queries_today FROM fx_logs
        WHERE CAST(created_at AS DATE) = DATE '{TODAY}' GROUP BY agent_id""",
)
def queries_today(spark, sf):
    return agents.queries_today(star.question_logs(spark, sf), TODAY)


@query(
    "log_summary",
    f"""SELECT agent_id, {dsum_null('latency')} / COUNT(latency) AS avg_latency, CAST(MAX(created_at) AS VARCHAR) AS last_used
        FROM fx_logs GROUP BY agent_id""",
)
def log_summary(spark, sf):
    return _text(agents.log_summary(star.question_logs(spark, sf)), "last_used")


@query(
    "daily_queries",
    """SELECT CAST(CAST(l.created_at AS DATE) AS VARCHAR) AS date, a.name AS agent_name, CAST(COUNT(*) AS BIGINT) AS queries
       FROM fx_logs l JOIN fx_agents a USING (agent_id) GROUP BY 1, 2""",
)
def daily_queries(spark, sf):
    return _text(
        agents.daily_queries(star.question_logs(spark, sf), star.agents(spark, sf)), "date"
    )


@query(
    "recent_logs",
    """WITH r AS (SELECT l.*, a.name AS agent_name, CAST(ROW_NUMBER() OVER (PARTITION BY agent_id ORDER BY created_at DESC, log_id DESC) AS INT) AS rank
                  FROM fx_logs l JOIN fx_agents a USING (agent_id))
       SELECT agent_id, agent_name, rank, log_id, query, answer, CAST(created_at AS VARCHAR) AS created_at FROM r WHERE rank <= 5""",
)
def recent_logs(spark, sf):
    return _text(
        agents.recent_logs(star.question_logs(spark, sf), star.agents(spark, sf)), "created_at"
    )


@query(
    "usage_report",
    f"""WITH u AS (SELECT query AS operation, CAST(SUM(len(answer)) AS BIGINT) AS tokens FROM fx_logs GROUP BY 1),
        t AS (SELECT CAST(SUM(tokens) AS DOUBLE) AS s FROM u)
        SELECT operation, tokens, {round2('CASE WHEN s <> 0 THEN 100.0::DOUBLE * CAST(tokens AS DOUBLE) / s ELSE 0 END', 1)} AS share_pct FROM u, t""",
)
def usage_report(spark, sf):
    records = star.question_logs(spark, sf).withColumn("n_chars", F.length("answer"))
    return agents.usage_report(records, "query", "n_chars")


@query(
    "trim_conversation",
    """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS up,
                         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS down,
                         COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
       SELECT conv_id, turn, role, text FROM r WHERE n <= 6 OR up = 1 OR down <= 4""",
)
def trim_conversation(spark, sf):
    return agents.trim_conversation(star.chat_turns(spark, sf))


@query(
    "resolve_feed",
    """SELECT category, CASE WHEN lower(category) = 'co2' THEN 'CO2' WHEN lower(category) IN ('natural gas', 'ng') THEN 'NG' ELSE 'PW' END AS feed,
              CASE WHEN lower(category) = 'co2' THEN 'CO2_raw_data' WHEN lower(category) IN ('natural gas', 'ng') THEN 'NG_raw_data' ELSE 'PW_raw_data' END AS table_name,
              CAST(COUNT(*) AS BIGINT) AS n_logs, CASE WHEN lower(category) = 'co2' THEN 21 WHEN lower(category) = 'ng' THEN 22 ELSE 23 END AS n_columns
       FROM fx_logs GROUP BY 1, 2, 3, 5""",
)
def resolve_feed(spark, sf):
    per_category = star.question_logs(spark, sf).groupBy("category").agg(F.count("*").alias("n_logs"))
    widths = (
        specs.column_catalog(spark)
        .groupBy("table_name")
        .agg(F.count("*").cast("int").alias("n_columns"))
    )
    return adhoc.with_feed_table(per_category).join(widths, "table_name")


# --- feedback ------------------------------------------------------------------------


@query(
    "feedback_counts",
    """SELECT CAST(COUNT(CASE WHEN user_feedback = 1 THEN 1 END) AS BIGINT) AS positives,
              CAST(COUNT(CASE WHEN user_feedback = 0 THEN 1 END) AS BIGINT) AS negatives FROM fx_logs""",
)
def feedback_counts(spark, sf):
    return feedback.feedback_counts(star.question_logs(spark, sf))


@query(
    "negative_feedback",
    """SELECT log_id, query, feedback_comment FROM fx_logs WHERE user_feedback = 0 AND trim(feedback_comment) <> ''""",
)
def negative_feedback(spark, sf):
    return feedback.negative_feedback(star.question_logs(spark, sf)).select(
        "log_id", "query", "feedback_comment"
    )


@query(
    "feedback_grid",
    """SELECT log_id AS "ID", query AS "User Query", answer AS "Bot Answer", category AS "Category", user_feedback AS "User Feedback",
              feedback_comment AS "Feedback Comment", latency AS "Latency", CAST(created_at AS VARCHAR) AS "Query Timestamp" FROM fx_logs""",
)
def feedback_grid(spark, sf):
    return _text(feedback.feedback_grid(star.question_logs(spark, sf)), "Query Timestamp")


_TREND_SQL = """SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, feedback_comment, CAST(COUNT(*) AS BIGINT) AS n
    FROM fx_logs WHERE feedback_comment IS NOT NULL GROUP BY 1, 2"""


@query("feedback_trend", _TREND_SQL)
def feedback_trend(spark, sf):
    return _text(feedback.feedback_trend(star.question_logs(spark, sf)), "day")


_COMMENTS = [f"issue_{i}" for i in range(4)]


@query(
    "feedback_trend_wide",
    "SELECT day, "
    + ", ".join(
        f"CAST(SUM(CASE WHEN feedback_comment = '{c}' THEN n ELSE 0 END) AS BIGINT) AS {c}" for c in _COMMENTS
    )
    + f" FROM ({_TREND_SQL}) GROUP BY day",
)
def feedback_trend_wide(spark, sf):
    trend = feedback.feedback_trend(star.question_logs(spark, sf))
    return _text(feedback.feedback_trend_wide(trend, _COMMENTS), "day")


_DAILY_PROPS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, props AS feedback_comment, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2"


def _daily_props(spark, sf):
    """As many comments as events have properties."""
    logs = star.table(spark, sf, "events").select(
        F.col("ts").alias("created_at"), F.col("props").alias("feedback_comment")
    )
    return feedback.feedback_trend(logs)


@query("feedback_trend_blocks", _DAILY_PROPS)
def feedback_trend_blocks(spark, sf):
    """An open-ended pivot: columns in blocks, read back as rows."""
    trend = _daily_props(spark, sf)
    domain = feedback.trend_domain(trend, 16)
    blocks = feedback.trend_blocks(trend, domain)
    return _text(feedback.trend_of_blocks(blocks, domain), "day")


@query("feedback_trend_maps", _DAILY_PROPS)
def feedback_trend_maps(spark, sf):
    trend = _daily_props(spark, sf)
    maps = feedback.trend_maps(trend, feedback.trend_domain(trend))
    return _text(maps.select("day", F.explode("uses").alias("feedback_comment", "n")), "day")


@query(
    "training_pairs",
    """SELECT query, answer AS incorrect_answer, feedback_comment AS correction FROM fx_logs
       WHERE user_feedback = 0 AND trim(feedback_comment) <> ''""",
)
def training_pairs(spark, sf):
    return feedback.training_pairs(star.question_logs(spark, sf))


@query(
    "current_feedback",
    """WITH u AS (SELECT event_id AS update_id, event_id - event_id % 3 AS log_id, CASE WHEN value > 5 THEN 1 ELSE 0 END AS fb,
                         concat('changed_', event_type) AS cm FROM events),
       n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY log_id ORDER BY update_id DESC) AS pos FROM u)
       SELECT l.log_id, l.query, CASE WHEN n.log_id IS NULL THEN l.user_feedback ELSE n.fb END AS user_feedback,
              CASE WHEN n.log_id IS NULL THEN l.feedback_comment ELSE n.cm END AS feedback_comment
       FROM fx_logs l LEFT JOIN n ON l.log_id = n.log_id AND n.pos = 1""",
)
def current_feedback(spark, sf):
    event_id = F.col("event_id")
    updates = star.table(spark, sf, "events").select(
        event_id.alias("update_id"),
        (event_id - event_id % 3).alias("log_id"),
        F.when(F.col("value") > 5, 1).otherwise(0).alias("user_feedback"),
        F.concat(F.lit("changed_"), "event_type").alias("feedback_comment"),
    )
    return feedback.current_feedback(star.question_logs(spark, sf), updates).select(
        "log_id", "query", "user_feedback", "feedback_comment"
    )


AGENTS_SQL = """WITH c AS (SELECT event_id AS change_id, user_id AS agent_id, event_type,
                         CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'status' ELSE 'update' END AS action,
                         CASE WHEN event_type NOT IN ('error', 'view') THEN concat('agent_', event_type) END AS name,
                         CASE WHEN event_type = 'view' THEN CAST(event_id % 2 AS INT) END AS is_active FROM events)
       SELECT agent_id, arg_max(name, change_id) FILTER (WHERE name IS NOT NULL AND change_id > since) AS name,
              arg_max(is_active, change_id) FILTER (WHERE is_active IS NOT NULL AND change_id > since) AS is_active
       FROM (SELECT *, COALESCE(MAX(CASE WHEN action = 'delete' THEN change_id END) OVER (PARTITION BY agent_id), -1) AS since FROM c)
       GROUP BY agent_id HAVING arg_max(action, change_id) <> 'delete'"""


@query("current_agents", AGENTS_SQL)
def current_agents(spark, sf):
    return feedback.current_agents(agent_changes(star.table(spark, sf, "events")))


def agent_changes(events):
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("change_id"),
        F.col("user_id").alias("agent_id"),
        F.when(kind == "error", "delete").when(kind == "view", "status").otherwise("update").alias("action"),
        F.when(~kind.isin("error", "view"), F.concat(F.lit("agent_"), kind)).alias("name"),
        F.when(kind == "view", (F.col("event_id") % 2).cast("int")).alias("is_active"),
    )


# --- prompts -------------------------------------------------------------------------


@query(
    "extract_date",
    r"""WITH x AS (SELECT prompt_id, regexp_extract(prompt, '(\d{2})[-/](\d{2})[-/](\d{4})', ['d', 'm', 'y']) AS r FROM fx_prompts)
        SELECT prompt_id, CAST(CAST(try_strptime(concat(r.d, '-', r.m, '-', r.y), '%d-%m-%Y') AS DATE) AS VARCHAR) AS asked_date FROM x""",
)
def extract_date_query(spark, sf):
    return star.prompts(spark, sf).select(
        "prompt_id", iso_date(extract_date("prompt")).alias("asked_date")
    )


@query(
    "read_prompts",
    r"""WITH x AS (SELECT prompt_id, prompt, regexp_extract(prompt, '(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})', ['d', 'm', 'y']) AS a,
                          regexp_extract(prompt, '(\d{1,2})([A-Za-z]{3})(\d{2,4})', ['d', 'm', 'y']) AS b FROM fx_prompts),
        y AS (SELECT *, CASE WHEN length(a.y) = 2 THEN concat(CASE WHEN TRY_CAST(a.y AS INT) < 50 THEN '20' ELSE '19' END, a.y) ELSE a.y END AS ay,
                        CASE WHEN length(b.y) = 2 THEN concat(CASE WHEN TRY_CAST(b.y AS INT) < 50 THEN '20' ELSE '19' END, b.y) ELSE b.y END AS byr FROM x)
        SELECT prompt_id, CAST(CAST(COALESCE(try_strptime(concat(a.d, '-', a.m, '-', ay), '%d-%m-%Y'),
                                        try_strptime(concat(b.d, b.m, byr), '%d%b%Y')) AS DATE) AS VARCHAR) AS asked_date_loose,
               contains(lower(prompt), 'open position') AS is_nop,
               CASE WHEN contains(lower(prompt), 'open position') THEN
                 CASE WHEN regexp_matches(lower(prompt), 'value|money|dollar|financial|price') THEN 'MKT_VAL_BL' ELSE 'VOLUME_BL' END END AS nop_measure
        FROM y""",
)
def read_prompts(spark, sf):
    read = prompts.read_prompts(star.prompts(spark, sf))
    return read.select(
        "prompt_id",
        iso_date("asked_date_loose").alias("asked_date_loose"),
        "is_nop",
        "nop_measure",
    )


def _metrics_values() -> str:
    rows = [
        f"({i}, '{key}', '{metric}')"
        for i, (key, metric) in enumerate(specs.PW.metric_catalog.items())
    ]
    return ", ".join(rows)


@query(
    "select_metrics",
    f"""WITH c(ord, name, metric) AS (VALUES {_metrics_values()}),
        p AS (SELECT prompt_id, replace(replace(lower(prompt), ' ', ''), '_', '') AS t FROM fx_prompts)
        SELECT prompt_id, CAST(ord AS INT) AS ord, name, metric FROM p JOIN c
        ON contains(t, replace(lower(name), '_', '')) OR ord = 0""",
)
def select_metrics(spark, sf):
    return prompts.select_metrics(star.prompts(spark, sf), specs.PW).drop("prompt")


# --- similar past questions ----------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(query), '[\p{L}\p{N}_]{2,}')"

_VECTORS = rf"""WITH docs AS (SELECT * FROM fx_feedback WHERE query IS NOT NULL AND query <> ''),
    tk AS (SELECT id, unnest({_TOKENS}) AS token FROM docs),
    tf AS (SELECT id, token, COUNT(*) AS tf FROM tk GROUP BY 1, 2),
    idf AS (SELECT token, ln((1 + (SELECT COUNT(*) FROM docs))::DOUBLE / (1 + COUNT(*))) + 1 AS idf FROM tf GROUP BY 1),
    w AS (SELECT id, token, tf * idf AS raw FROM tf JOIN idf USING (token)),
    nm AS (SELECT id, sqrt(SUM(raw * raw)) AS n FROM w GROUP BY 1),
    vec AS (SELECT id, token, raw / n AS weight FROM w JOIN nm USING (id))"""

NEAREST = rf"""{_VECTORS},
    qt AS (SELECT question_id, token, COUNT(*) AS tf FROM
             (SELECT item_id AS question_id, unnest({_TOKENS.replace('query', 'text')}) AS token FROM benchmark) GROUP BY 1, 2),
    qw AS (SELECT question_id, token, tf * idf AS raw FROM qt JOIN idf USING (token)),
    qn AS (SELECT question_id, sqrt(SUM(raw * raw)) AS n FROM qw GROUP BY 1),
    qv AS (SELECT question_id, token, raw / n AS weight FROM qw JOIN qn USING (question_id)),
    dots AS (SELECT question_id, id, SUM(qv.weight * vec.weight) AS dot FROM qv JOIN vec USING (token) GROUP BY 1, 2),
    al AS (SELECT qn.question_id, docs.id, round(CASE WHEN len({_TOKENS}) = 0 THEN 1.0 ELSE greatest(0.0, 2 - 2 * COALESCE(dot, 0)) END, 12) AS distance
           FROM qn CROSS JOIN docs LEFT JOIN dots ON dots.question_id = qn.question_id AND dots.id = docs.id),
    near AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY distance, id) AS INT) AS rank FROM al)"""


@query("tfidf", f"{_VECTORS} SELECT id, token, round(weight, 6) AS weight FROM vec")
def tfidf(spark, sf):
    vectors = retrieval.tfidf(star.feedback_texts(spark, sf))
    return vectors.withColumn("weight", F.round("weight", 6))


@query(
    "nearest_questions",
    f"{NEAREST} SELECT question_id, rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 3",
)
def nearest_questions(spark, sf):
    near = retrieval.nearest(star.questions(spark, sf), star.feedback_texts(spark, sf))
    return near.withColumn("distance", F.round("distance", 6))


_INSIGHTS = f"""{NEAREST}, ins AS (SELECT near.question_id, near.rank, near.id,
      concat('Previous issue: ', docs.query, ' - ', docs.feedback_comment) AS insight
      FROM near JOIN docs USING (id) WHERE rank <= 3 AND docs.user_feedback = 0 AND trim(docs.feedback_comment) <> '')"""


@query("feedback_insights", f"{_INSIGHTS} SELECT * FROM ins")
def feedback_insights(spark, sf):
    return retrieval.feedback_insights(star.questions(spark, sf), star.feedback_texts(spark, sf))


@query(
    "answer_confidence",
    f"""{_INSIGHTS}, c AS (SELECT question_id, COUNT(*) AS n FROM ins GROUP BY 1)
        SELECT b.item_id AS question_id, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_feedback,
               CAST(len(string_split(b.text, chr(10))) AS BIGINT) AS n_docs,
               round(greatest(0.1, least(0.99, 0.7::DOUBLE - 0.05::DOUBLE * COALESCE(c.n, 0)
                     + 0.1::DOUBLE * least(len(string_split(b.text, chr(10))), 3))), 4) AS confidence
        FROM benchmark b LEFT JOIN c ON b.item_id = c.question_id""",
)
def answer_confidence(spark, sf):
    asked = star.questions(spark, sf)
    insights = retrieval.feedback_insights(asked, star.feedback_texts(spark, sf))
    # Each line of a question's text stands for one file that its answer was drawn from.
    behind = asked.select("question_id", F.size(F.split("question", "\n")).cast("bigint").alias("n_docs"))
    return feedback.answer_confidence(insights, asked, behind)
