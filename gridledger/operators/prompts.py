"""Reading of chart and position questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import dates, text
from gridledger.specs import FeedSpec


def read_prompts(prompts: DataFrame, column: str = "prompt") -> DataFrame:
    """Dates and measure a question asks for."""
    return prompts.withColumns(
        {
            "asked_date": dates.extract_date(column),
            "asked_date_loose": dates.extract_date_loose(column),
            "is_nop": text.is_nop_question(column),
            "nop_measure": text.nop_measure(column),
        }
    )


def select_metrics(
    prompts: DataFrame, spec: FeedSpec, available: list[str] | None = None, column: str = "prompt"
) -> DataFrame:
    """Metrics named in each question, in catalog order: (keys, ord, name, metric).

    The first available metric is always kept. The catalog is a short constant list, so it is
    tested inside the projection; no join is needed.
    """
    offered = [
        (key, metric)
        for key, metric in spec.metric_catalog.items()
        if available is None or metric in available
    ]
    # A column of its own below the explode, so that it is worked out once per question.
    prepared = prompts.withColumn("_asked", text.squeezed(column))
    asked = F.col("_asked")

    def entry(i: int, key: str, metric: str):
        cell = F.struct(
            F.lit(i).alias("ord"), F.lit(key).alias("name"), F.lit(metric).alias("metric")
        )
        named = asked.contains(key.lower().replace("_", ""))
        return cell if i == 0 else F.when(named, cell)

    # A null question still gets the first metric; its other tests are null and drop out.
    tests = F.array(*[entry(i, *pair) for i, pair in enumerate(offered)])
    rows = prepared.withColumn("m", F.explode(tests)).filter(F.col("m").isNotNull())
    return rows.select(*prompts.columns, "m.ord", "m.name", "m.metric")


def catalogue_table(spark, spec: FeedSpec, available: list[str] | None = None) -> DataFrame:
    """The metric catalogue as a table (ord, name, metric)."""
    offered = [p for p in spec.metric_catalog.items() if available is None or p[1] in available]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(offered)], "ord int, name string, metric string")


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct runs of one to `GRAM` characters."""
    # Matches of no width step through the text once; group 1 is what follows.
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*runs))


def select_metrics_from(
    prompts: DataFrame, catalogue: DataFrame, key: str, column: str = "prompt"
) -> DataFrame:
    """(key, ord, name, metric): the entries of a catalogue table that each question names.

    A name is asked for where the question contains it, blanks and underscores aside. The theta join goes
    through an inverted index: every name waits under the one of its runs of three characters that the
    fewest questions hold (short names under themselves), so a question only meets names of which it
    has the rarest part, and only these are tested. The first entry is kept for every question.
    """
    asked = prompts.select(key, text.squeezed(column).alias("asked"))
    # Names and grams of a question once each; the text itself is joined back to the few that are left.
    held = asked.filter("asked IS NOT NULL").select(key, F.explode(_grams(F.col("asked"))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("n_questions"))
    squeezed = F.lower(F.replace(F.col("name"), F.lit("_"), F.lit("")))
    entries = catalogue.withColumn("wanted", squeezed)
    size = F.least(F.length("wanted"), F.lit(GRAM))
    names = entries.select("wanted").distinct().filter("wanted <> ''").select(
        "wanted", F.explode(_grams(F.col("wanted"))).alias("gram")
    ).filter(F.length("gram") == size)
    # A gram that no question holds rules its names out.
    counted = names.join(often, "gram", "left")
    rarest = counted.groupBy("wanted").agg(
        F.min(F.struct(F.coalesce("n_questions", F.lit(0)).alias("n_questions"), "gram")).alias("r")
    ).filter("r.n_questions > 0").select("wanted", "r.gram")
    met = held.join(rarest, "gram").select(key, "wanted").distinct()
    named = met.join(asked, key).filter(F.contains("asked", "wanted")).select(key, "wanted")
    found = named.join(entries, "wanted").select(key, "ord", "name", "metric")
    first = catalogue.agg(F.min(F.struct("ord", "name", "metric"))).scalar()
    always = prompts.select(key, first.alias("f")).select(key, "f.ord", "f.name", "f.metric")
    # Entries without a name are asked for by no question; the first entry may also be named.
    return found.unionByName(always.filter("ord IS NOT NULL")).distinct()
