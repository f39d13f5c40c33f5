"""Text and record forms of results, glossary lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import total_or_0
from gridledger.functions.text import joined_cells

# The largest answer text handed on, and the advice beyond it.
SIZE_LIMIT = 7090
SIZE_ADVICE = (
    "The result is too large. Narrow the date range, add filters, ask for a sum, an average "
    "or a total, or name fewer metrics and dimensions."
)


def result_text(frame: DataFrame) -> DataFrame:
    """Each row as one line, cells joined with ` | `."""
    return frame.select(joined_cells(frame.columns).alias("line"))


def result_header(frame: DataFrame) -> str:
    return " | ".join(frame.columns)


def glossary_text(glossary: DataFrame) -> DataFrame:
    """`key: value` lines."""
    return glossary.select(F.concat_ws(": ", "context_name", "description").alias("line"))


def size_guard(frame: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """One row: words in the text form of the result, whether they fit, and advice if not."""
    words = F.size(F.split(F.trim("line"), r"\s+"))
    header = len(result_header(frame).split())
    counted = result_text(frame).agg(
        (F.coalesce(F.sum(words), F.lit(0)) + F.lit(header)).cast("bigint").alias("n_words")
    )
    fits = F.col("n_words") <= limit
    return counted.select(
        "n_words", fits.alias("fits"), F.when(~fits, F.lit(SIZE_ADVICE)).alias("advice")
    )


def records_json(frame: DataFrame, name: str = "json_record") -> DataFrame:
    """Each row as a JSON record."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias(name))


def records_from_json(records: DataFrame, schema: str, name: str = "json_record") -> DataFrame:
    return records.select(F.from_json(name, schema).alias("r")).select("r.*")


def translate_codes(frame: DataFrame, glossary: DataFrame, code: str, label: str) -> DataFrame:
    """Adds the business label of a code; a code without an entry stays as it is."""
    entries = glossary.select(F.col("context_name").alias(code), F.col("description").alias("_d"))
    return frame.join(entries, code, "left").withColumn(
        label, F.coalesce("_d", F.col(code))
    ).drop("_d")


def horizon_sums(records: DataFrame, member_column: str, member: str, field: str) -> DataFrame:
    """Chart of one member: stored delta records added up per horizon, in label order."""
    return (
        records.filter(F.col(member_column) == member)
        .groupBy("HORIZON")
        .agg(total_or_0(field).alias(field))
        .orderBy("HORIZON")
    )
