"""Text column expressions: file routing, labels, question classification."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger import specs
from gridledger.functions.numbers import ColumnOrName, col

# Words that decide how a question about the open position is read.
NOP_PHRASES = ("net open position", "open position")
MONEY_WORDS = ("value", "money", "dollar", "financial", "price")


def column_name(raw: str) -> str:
    """Header cell -> column name: trimmed, upper case, spaces as underscores."""
    return re.sub(" ", "_", raw.strip().upper())


def route_feed(file_name: ColumnOrName) -> Column:
    """Commodity of a file, null when the name carries no known mark."""
    name = F.upper(col(file_name))
    routed = F
    for category in specs.CATEGORIES:
        routed = routed.when(name.contains(specs.FEEDS[category].file_mark), F.lit(category))
    return routed


def route_object_key(file_name: ColumnOrName, kind: str = "data") -> Column:
    """Target key of a file. `kind` is `data` or `metadata`; the first matching commodity wins."""
    name = F.upper(col(file_name))
    folder = F
    for category in specs.CATEGORIES:
        if kind == "metadata":
            folder = folder.when(name.contains(category), F.lit(f"{category}/metadata/"))
        else:
            folder = folder.when(
                name.contains(specs.FEEDS[category].file_mark), F.lit(f"{category}/")
            )
    return F.concat(folder.otherwise(F.lit(specs.OTHER_FOLDER)), col(file_name))


def feed_of_name(file_name: ColumnOrName) -> Column:
    """Second part of an underscore-separated file name, `OTHER` if there is none."""
    return F.coalesce(F.get(F.split(col(file_name), "_"), F.lit(1)), F.lit("OTHER"))


def status_label(flag: ColumnOrName, yes: str = "Active", no: str = "Inactive") -> Column:
    return F.when(col(flag) == 1, yes).otherwise(no)


def is_nop_question(text: ColumnOrName) -> Column:
    lowered = F.lower(col(text))
    asked = F.lit(False)
    for phrase in NOP_PHRASES:
        asked = asked | lowered.contains(phrase)
    return asked


def nop_measure(text: ColumnOrName) -> Column:
    """Measure a net-open-position question asks for; null for other questions."""
    money = F.lower(col(text)).rlike("|".join(MONEY_WORDS))
    return F.when(is_nop_question(text), F.when(money, "MKT_VAL_BL").otherwise("VOLUME_BL"))


def squeezed(text: ColumnOrName) -> Column:
    """Lower case without spaces and underscores, for matching metric names."""
    return F.translate(F.lower(col(text)), " _", "")


def resolve_feed(category: ColumnOrName) -> Column:
    """Commodity a user asked for; anything unknown means power."""
    asked = F.lower(col(category))
    found = F
    for spec in (specs.CO2, specs.NG):
        found = found.when(asked.isin(*spec.asked_as), F.lit(spec.category))
    return found.otherwise(F.lit(specs.PW.category))


def joined_cells(columns: list[ColumnOrName], sep: str = " | ") -> Column:
    """Cells of a row as one line of text; an empty cell reads `None`."""
    return F.concat_ws(
        sep, *[F.coalesce(col(c).cast("string"), F.lit("None")) for c in columns]
    )
