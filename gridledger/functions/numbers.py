"""Numeric column expressions: parsing, exact totals, rounding, number text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Amounts are added exactly, so a total does not depend on the order in which partitions are merged.
# Each amount is split into the high and low bits of its whole part and its fraction in units of
# 10 ** -PLACES; the three are summed apart as 64-bit integers, which overflow only beyond 9 * 10 ** 10
# rows of a group. An amount is read as the shortest decimal that names its double, to PLACES places.
PLACES = 8
LOW_BITS = 26
WHOLE_LIMIT = float(1 << 62)  # amounts beyond, infinities and NaN are added as plain doubles
ROUNDING = "decimal(28,6)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: ColumnOrName) -> Column:
    """Text with thousands separators -> double; junk and NaN -> null."""
    text = F.replace(F.trim(col(c).cast("string")), F.lit(","), F.lit(""))
    # The pattern keeps out what only some parsers take for numbers, such as `5D` or `3f`.
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def parse_number_fill0(c: ColumnOrName) -> Column:
    """As `parse_number`, with null and junk counted as 0."""
    return F.coalesce(parse_number(c), F.lit(0.0))


def is_junk_number(c: ColumnOrName) -> Column:
    """True where a non-empty cell does not hold a number."""
    text = F.trim(col(c).cast("string"))
    return text.isNotNull() & (text != "") & (F.lower(text) != "nan") & parse_number(text).isNull()


def _split(v: Column) -> tuple[Column, Column]:
    """Whole part, null for wild amounts, and fraction in units of 10 ** -PLACES, null from 1e7 on."""
    size = F.abs(v)
    # Up to 1e7 the eighth decimal lies within the first fifteen digits.
    near = F.rint((v - F.floor(v)) * 10.0**PLACES).cast("bigint")
    return F.when(size < WHOLE_LIMIT, F.floor(v)), F.when(size < 1e7, near)  # false for NaN


def _raw_sums(v: Column, whole: Column, units: Column, on: Column | None) -> dict[str, Column]:
    written = v.cast(f"decimal(38,{PLACES})") - whole
    far = F.when(whole.isNotNull(), (written * F.lit(10**PLACES)).cast("bigint"))
    columns = {
        "high": F.shiftright(whole, LOW_BITS),
        "low": whole.bitwiseAND(F.lit((1 << LOW_BITS) - 1)),
        "units": F.coalesce(units, far),
        "wild": F.when(whole.isNull(), v),
    }
    return {kind: F.sum(c if on is None else F.when(on, c)) for kind, c in columns.items()}


def joined(sums: dict[str, Column]) -> Column:
    """`parts` from the sums high, low, units and wild."""
    unit = F.lit(f"0.{'0' * (PLACES - 1)}1").cast(f"decimal({PLACES + 1},{PLACES})")
    exact = (
        sums["high"].cast("decimal(19,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)")
        + sums["low"].cast("decimal(19,0)")
        + sums["units"].cast("decimal(19,0)") * unit
    )
    return F.struct(exact.alias("exact"), sums["wild"].alias("wild"))


def parts(c: ColumnOrName) -> Column:
    """Order-independent sum as struct(exact decimal, wild double); both null without input."""
    v = col(c).cast("double")
    return joined(_raw_sums(v, *_split(v), None))


_KINDS = ("high", "low", "units", "wild")


def with_amounts(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    """Adds the split of each amount, to be summed by `amount_sums`.

    An aggregation over several measures, conditions or grouping sets then works each amount out
    once per row. Its sums are put together by `summed` in a step of its own: so the generated
    methods stay below the size from which the JVM no longer compiles them.
    """
    added = {}
    for name in names:
        added[f"_whole_{name}"], added[f"_units_{name}"] = _split(F.col(name).cast("double"))
    return frame.withColumns(added)


def amount_sums(name: str, alias: str | None = None, on: Column | None = None) -> list[Column]:
    """Plain sums of a measure prepared by `with_amounts`, of all rows or those where `on` holds."""
    raw = _raw_sums(F.col(name).cast("double"), F.col(f"_whole_{name}"), F.col(f"_units_{name}"), on)
    return [column.alias(f"_{kind}_{alias or name}") for kind, column in raw.items()]


def summed(alias: str) -> Column:
    """`parts` from the columns that `amount_sums` gave."""
    return joined({kind: F.col(f"_{kind}_{alias}") for kind in _KINDS})


def summed_or_0(alias: str) -> Column:
    return F.coalesce(value(summed(alias)), F.lit(0.0))


def value(sums: Column) -> Column:
    """The double next to a sum made by `parts`."""
    exact, wild = sums["exact"].cast("double"), sums["wild"]
    return F.when(wild.isNull(), exact).otherwise(wild + F.coalesce(exact, F.lit(0.0)))


def difference(left: Column, right: Column) -> Column:
    """left - right of two sums made by `parts`; a missing sum counts as 0. Nothing is rounded
    before the subtraction."""
    nought = F.lit(0).cast("decimal(38,8)")
    exact = F.coalesce(left["exact"], nought) - F.coalesce(right["exact"], nought)
    wild = F.coalesce(left["wild"], F.lit(0.0)) - F.coalesce(right["wild"], F.lit(0.0))
    tame = left["wild"].isNull() & right["wild"].isNull()
    return F.when(tame, exact.cast("double")).otherwise(exact.cast("double") + wild)


def total(c: ColumnOrName) -> Column:
    """Order-independent sum as double; null when every input is null. Infinities follow IEEE."""
    return value(parts(c))


def total_or_0(c: ColumnOrName) -> Column:
    return F.coalesce(total(c), F.lit(0.0))


def mean(c: ColumnOrName) -> Column:
    """Order-independent mean of the non-null values."""
    return total(c) / F.count(col(c))


def rounded(c: ColumnOrName, places: int = 2) -> Column:
    """Half-up rounding on the decimal value, so 0.125 -> 0.13 and 1234.565 -> 1234.57."""
    near = F.round(col(c).try_cast(ROUNDING), places).cast("double")
    return F.coalesce(near, col(c).cast("double"))


def sign_label(c: ColumnOrName) -> Column:
    return F.when(col(c) > 0, "+").when(col(c) < 0, "-").otherwise("")


def grouped_digits(c: ColumnOrName) -> Column:
    """Whole number with thousands separators."""
    return F.coalesce(
        F.format_number(col(c).try_cast(ROUNDING), 0), F.format_number(col(c).cast("double"), 0)
    )


def signed_text(c: ColumnOrName) -> Column:
    """Heat-map cell text: two decimals at most, `+` before gains."""
    near = F.round(col(c).try_cast(ROUNDING), 2).cast("string")
    plain = F.coalesce(F.regexp_replace(near, "0$", ""), col(c).cast("string"))
    return F.concat(F.when(col(c) > 0, "+").otherwise(""), plain)


def percent(part: ColumnOrName, whole: ColumnOrName, places: int | None = None) -> Column:
    """100 * part / whole; 0 when the whole is 0."""
    share = F.when(col(whole) != 0, 100.0 * col(part) / col(whole)).otherwise(0.0)
    return share if places is None else rounded(share, places)


def confidence(base: float, n_feedback: ColumnOrName, n_docs: ColumnOrName) -> Column:
    """Answer confidence, lowered by known complaints and raised by supporting documents."""
    score = base - 0.05 * col(n_feedback) + 0.1 * F.least(col(n_docs), F.lit(3))
    return F.greatest(F.lit(0.1), F.least(F.lit(0.99), score))
