"""Feed declarations: columns, types, groupings and metric names per commodity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, their descriptions and the grouping lists are the
# published layout of the three feeds and must be kept as they are.
# ---------------------------------------------------------------------------

PW_COLUMNS = {
    "REPORT_DATE": "As-of date of the report generation",
    "BOOK": "Trading book identifier",
    "BOOK_ATTR6": "Business area classification",
    "BOOK_ATTR7": "Cost Allocation Indicator",
    "BOOK_ATTR8": "Detailed business classification",
    "USR_VAL4": "Route to market mechanism",
    "TGROUP1": "Primary trading strategy",
    "TGROUP2": "Secondary trading strategy",
    "SEGMENT": "Business segment",
    "START_DATE": "Start of trade delivery",
    "END_DATE": "End of trade delivery",
    "BUCKET": "Product bucket label",
    "HORIZON": "Delivery term or horizon",
    "METHOD": "Valuation method used",
    "VOLUME_BL": "Base Load Volume",
    "VOLUME_PK": "Peak Load Volume",
    "VOLUME_OFPK": "Off-Peak Volume",
    "MKT_VAL_BL": "Base Load Market Value",
    "MKT_VAL_PK": "Peak Load Market Value",
    "MKT_VAL_OFPK": "Off-Peak Market Value",
    "TRD_VAL_BL": "Base Load Trade Value",
    "TRD_VAL_PK": "Peak Load Trade Value",
    "TRD_VAL_OFPK": "Off-Peak Trade Value",
}

CO2_COLUMNS = {
    "REPORT_DATE": "As-of date of the report generation",
    "BOOK": "Trading book identifier",
    "BOOK_ATTR3": "Business type or classification",
    "BOOK_ATTR5": "Hedging or Trading purpose marker",
    "BOOK_ATTR6": "Cost Allocation Indicator",
    "BOOK_ATTR7": "Allocation Type",
    "BOOK_ATTR8": "Detailed Business Classification",
    "USR_VAL4": "Route to market mechanism",
    "TGROUP1": "Primary trading strategy",
    "TGROUP2": "Secondary trading strategy",
    "MKT1": "Market type or instrument (e.g., CO2)",
    "COMP1": "Compliance or Forecast type",
    "SEGMENT": "Business segment",
    "BUCKET_START": "Bucket start date",
    "BUCKET_END": "Bucket end date",
    "BUCKET": "Product bucket label",
    "HORIZON": "Delivery year or term",
    "VOLUME": "Traded or delivered quantity",
    "MKTVAL": "Market Value",
    "TRDVAL": "Trade Value",
    "TRDPRC": "Trade Price",
}

NG_COLUMNS = {
    "REPORT_DATE": "As-of date of the report",
    "BOOK": "Trading book identifier",
    "BOOK_ATTR3": "Commodity type",
    "BOOK_ATTR5": "Business purpose",
    "BOOK_ATTR6": "Business segment or unit",
    "BOOK_ATTR7": "Allocation Type",
    "BOOK_ATTR8": "Business area classification",
    "USR_VAL4": "Route to market",
    "TGROUP1": "Primary strategy",
    "TGROUP2": "Secondary strategy",
    "SEGMENT": "Business segment",
    "START_DATE": "Start of delivery",
    "END_DATE": "End of delivery",
    "BUCKET": "Product bucket label",
    "HORIZON": "Delivery horizon",
    "METHOD": "Valuation Method",
    "VOLUME": "Volume",
    "VOLUME_TOTAL": "Total volume",
    "QTY_PHY": "Physical quantity",
    "MKT_VAL": "Market value",
    "QTY_FIN": "Financial quantity",
    "TRD_VAL": "Trade value",
}

PW_MEASURES = (
    "VOLUME_BL", "VOLUME_PK", "VOLUME_OFPK",
    "MKT_VAL_BL", "MKT_VAL_PK", "MKT_VAL_OFPK",
    "TRD_VAL_BL", "TRD_VAL_PK", "TRD_VAL_OFPK",
)
CO2_MEASURES = ("VOLUME", "TRDVAL", "MKTVAL", "TRDPRC")
NG_MEASURES = ("VOLUME", "VOLUME_TOTAL", "QTY_PHY", "MKT_VAL", "QTY_FIN", "TRD_VAL")

CATEGORIES = ("CO2", "NG", "PW")
OTHER_FOLDER = "misc/"

# ---------------------------------------------------------------------------

DATE_COLUMNS = ("REPORT_DATE", "START_DATE", "END_DATE", "BUCKET_START", "BUCKET_END")


@dataclass(frozen=True)
class FeedSpec:
    """One commodity feed."""

    category: str
    asked_as: tuple[str, ...]
    columns: dict[str, str]
    measures: tuple[str, ...]
    load_measures: tuple[str, ...]
    stat_dims: tuple[str, ...]
    statistics: tuple[str, ...]

    @property
    def file_mark(self) -> str:
        return f"NOP_{self.category}"

    @property
    def table(self) -> str:
        return f"{self.category}_raw_data"

    @property
    def schema(self) -> T.StructType:
        def kind(name: str) -> T.DataType:
            if name in DATE_COLUMNS:
                return T.DateType()
            return T.DoubleType() if name in self.measures else T.StringType()

        return T.StructType([T.StructField(n, kind(n)) for n in self.columns])

    @property
    def metric_catalog(self) -> dict[str, str]:
        """Name used in a question -> stored statistic, in display order."""
        names: dict[str, str] = {}
        for measure in self.measures:
            names[measure] = f"TOTAL_{measure}"
            for stat in self.statistics[1:]:
                names[f"{stat}_{measure}"] = f"{stat}_{measure}"
        return names

    @property
    def total_metrics(self) -> list[str]:
        return [f"TOTAL_{m}" for m in self.measures]


CO2 = FeedSpec(
    category="CO2",
    asked_as=("co2",),
    columns=CO2_COLUMNS,
    measures=CO2_MEASURES,
    load_measures=("VOLUME", "MKTVAL"),
    stat_dims=("BOOK", "SEGMENT", "TGROUP1"),
    statistics=("TOTAL", "AVG", "MIN", "MAX", "STD"),
)
NG = FeedSpec(
    category="NG",
    asked_as=("natural gas", "ng"),
    columns=NG_COLUMNS,
    measures=NG_MEASURES,
    load_measures=("VOLUME", "MKT_VAL"),
    stat_dims=("BOOK", "SEGMENT", "HORIZON", "TGROUP1"),
    statistics=("TOTAL", "AVG", "MIN", "MAX", "STD"),
)
PW = FeedSpec(
    category="PW",
    asked_as=("power",),
    columns=PW_COLUMNS,
    measures=PW_MEASURES,
    load_measures=("VOLUME_BL", "MKT_VAL_BL"),
    stat_dims=("BOOK", "SEGMENT", "HORIZON", "TGROUP1"),
    statistics=("TOTAL", "AVG", "MIN", "MAX"),
)

FEEDS = {spec.category: spec for spec in (CO2, NG, PW)}


def column_catalog(spark: SparkSession) -> DataFrame:
    """All declared columns as rows (category, table_name, ord, column_name, description)."""
    rows = [
        (spec.category, spec.table, i, name, text)
        for spec in FEEDS.values()
        for i, (name, text) in enumerate(spec.columns.items())
    ]
    return spark.createDataFrame(
        rows, "category string, table_name string, ord int, column_name string, description string"
    )
