"""Feed-shaped and operational frames over a sales star schema.

The star tables stand in for the daily files: a shipped line is a position, its
ship month the report date, an order an uploaded file, an event a logged question.
Joins carry no hints. Spark broadcasts a dimension when its measured size allows and
shuffles otherwise. Lines meet the smallest dimensions first, so that a filter on a region thins them out before
they are moved, and orders meet their customers before, so that lines are moved once for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.session import n_slices, stored_bytes

# Declared layout of the star tables, so that reading needs no inference pass.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The lines in slices that hold whole orders; together they are the table.

    What is moved to make positions of a slice can be gone before the next one is begun. Orders are thinned
    out by the same condition, which Spark carries over the join.
    """
    lines = table(spark, sf_dir, "lineitem")
    n = n_slices(stored_bytes(spark, f"{sf_dir}/lineitem.parquet"))
    if n == 1:
        return [lines]
    return [lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(n)) == i) for i in range(n)]


def _report_month() -> Column:
    return F.trunc(F.col("l_shipdate").cast("date"), "MM")


def _lines(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    line = table(spark, sf_dir, "lineitem") if line is None else line
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    asked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return line.join(asked, F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def _when_status(status: str, value: Column) -> Column:
    return F.when(F.col("l_linestatus") == status, value).otherwise(F.lit(0.0))


def _horizon() -> Column:
    return F.concat(F.lit("M+"), F.col("l_linenumber").cast("string"))


def power_positions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """PW positions; of `lines`, if given, as of `line_slices`."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    traded = price * (1 - F.col("l_discount"))
    sold = F.col("l_returnflag") == "R"
    # One by one: of a join of small tables Spark cannot tell that it is small.
    placed = (
        (table(spark, sf_dir, "lineitem") if lines is None else lines)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        _lines(spark, sf_dir, placed)
        .select(
            _report_month().alias("REPORT_DATE"),
            F.col("n_name").alias("BOOK"),
            F.col("r_name").alias("BOOK_ATTR6"),
            F.col("l_linestatus").alias("BOOK_ATTR7"),
            F.col("p_brand").alias("BOOK_ATTR8"),
            F.col("l_returnflag").alias("USR_VAL4"),
            F.col("o_orderpriority").alias("TGROUP1"),
            F.col("o_orderstatus").alias("TGROUP2"),
            F.col("c_mktsegment").alias("SEGMENT"),
            F.col("p_type").alias("BUCKET"),
            _horizon().alias("HORIZON"),
            F.when(sold, -quantity).otherwise(quantity).alias("VOLUME_BL"),
            _when_status("F", quantity).alias("VOLUME_PK"),
            _when_status("O", quantity).alias("VOLUME_OFPK"),
            F.when(sold, -price).otherwise(price).alias("MKT_VAL_BL"),
            _when_status("F", price).alias("MKT_VAL_PK"),
            _when_status("O", price).alias("MKT_VAL_OFPK"),
            traded.alias("TRD_VAL_BL"),
            _when_status("F", traded).alias("TRD_VAL_PK"),
            _when_status("O", traded).alias("TRD_VAL_OFPK"),
        )
    )


def carbon_positions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """CO2 positions; of `lines`, if given."""
    price = F.col("l_extendedprice")
    return _lines(spark, sf_dir, lines).select(
        _report_month().alias("REPORT_DATE"),
        F.col("p_brand").alias("BOOK"),
        F.col("c_mktsegment").alias("SEGMENT"),
        F.col("o_orderpriority").alias("TGROUP1"),
        F.col("l_quantity").alias("VOLUME"),
        price.alias("MKTVAL"),
        (price * (1 - F.col("l_discount"))).alias("TRDVAL"),
        F.col("p_retailprice").alias("TRDPRC"),
    )


def gas_positions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """NG positions; of `lines`, if given."""
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    return _lines(spark, sf_dir, lines).select(
        _report_month().alias("REPORT_DATE"),
        F.col("p_brand").alias("BOOK"),
        F.col("c_mktsegment").alias("SEGMENT"),
        F.col("o_orderpriority").alias("TGROUP1"),
        _horizon().alias("HORIZON"),
        quantity.alias("VOLUME"),
        (quantity * F.col("l_linenumber")).alias("VOLUME_TOTAL"),
        _when_status("F", quantity).alias("QTY_PHY"),
        price.alias("MKT_VAL"),
        _when_status("O", quantity).alias("QTY_FIN"),
        (price * (1 - F.col("l_discount"))).alias("TRD_VAL"),
    )


def _spread(key: Column, labels: list[str]) -> Column:
    out = F
    for i, label in enumerate(labels[:-1]):
        out = out.when(key == i, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded data files with category and processing flag."""
    return as_data_files(table(spark, sf_dir, "orders"))


def as_data_files(orders: DataFrame) -> DataFrame:
    """Orders, batch or stream, seen as uploaded files."""
    feed = _spread(F.col("o_orderkey") % 4, ["CO2", "NG", "PW", "XX"])
    return orders.select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(
            F.lit("NOP_"), feed, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".csv")
        ).alias("file_name"),
        feed.alias("category"),
        F.col("o_orderdate").cast("date").alias("report_date"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_processed"),
        F.col("o_orderdate").alias("uploaded_at"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answering agents with their data folder."""
    key = F.col("n_nationkey")
    folder = F.when(key % 5 < 4, _spread(key % 5, ["CO2", "NG", "PW", "misc"]))
    return table(spark, sf_dir, "nation").select(
        key.cast("bigint").alias("agent_id"),
        F.col("n_name").alias("name"),
        folder.alias("s3_folder"),
        F.when(key % 3 == 0, 0).otherwise(1).alias("is_active"),
    )


def question_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged questions with feedback and latency."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        (F.col("user_id") % 20).alias("agent_id"),
        F.col("event_type").alias("query"),
        F.col("props").alias("answer"),
        _spread(F.col("user_id") % 3, ["CO2", "NG", "PW"]).alias("category"),
        F.when(failed, 0).otherwise(1).alias("user_feedback"),
        F.when(
            failed, F.concat(F.lit("issue_"), (F.col("user_id") % 4).cast("string"))
        ).alias("feedback_comment"),
        F.col("value").alias("latency"),
        F.col("ts").alias("created_at"),
    )


def feedback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past questions with a verdict and a comment on the bad ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bad = F.col("quality") == 0
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("query"),
        F.when(bad, 0).otherwise(1).alias("user_feedback"),
        F.when(bad, F.concat(F.lit("comment_"), F.col("doc_id").cast("string"))).alias(
            "feedback_comment"
        ),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New questions to be answered."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chart request per order, worded in several ways, with dates in several styles."""
    key = F.col("o_orderkey")
    wish = _spread(
        key % 6,
        [
            "Show volume bl", "plot AVG_MKT_VAL_BL", "What is the net open position",
            "open position value in dollar", "Compare trd val pk and max volume pk", "Any news",
        ],
    )
    day = F.col("o_orderdate").cast("date")
    written = F
    for i, fmt in enumerate(["dd-MM-yyyy", "dd/MM/yyyy", "d/M/yy", "dMMMyyyy"]):
        written = written.when(key % 5 == i, F.date_format(day, fmt))
    return table(spark, sf_dir, "orders").select(
        key.alias("prompt_id"),
        F.concat(wish, F.lit(" on "), written.otherwise(F.lit("99-99-2024 or 31/02/2024"))).alias(
            "prompt"
        ),
    )
