"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells of source, language and topic. Raking multiplies the cells' token counts by one
factor per source, language and topic until the sums along each of the three margins agree with their
targets. The sampling probability of a document is its cell's weight times one scale for the whole
corpus, chosen so that the largest probability is 1 (or so that the expected tokens meet a budget, if
that is less): expected tokens then have exactly the raked margins. A document is drawn when a keyed hash
of its id and text falls below its probability, so a rerun draws the same documents and copies of a
text under different ids are drawn independently.

Cells are counted by one aggregation with partial sums. A sweep of raking aggregates the cells, not the
documents, and writes them below the shared folder; only the largest deviation of a sweep comes to the
driver.

Tokens are counted as words and marks: an estimate without a vocabulary, the same for all sources.
Defined results: null source, language or topic is the category `unknown`; null and empty texts have 0
tokens, count for nothing in the margins, and are drawn with their cell's probability; cells without
tokens are not drawn; categories without a target get the share they have, targets without
documents are left out, and the rest is scaled to 1; repeated rows are drawn alike; an empty table
stays empty. Additional columns are kept.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import stored

MARGINS = ("source", "lang", "topic")
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Settings:
    """`targets`: per margin, shares by category; or a power of the margin's own shares."""

    targets: dict[str, dict[str, float] | float] = field(default_factory=dict)
    budget: float | None = None  # expected tokens; None: as many as the margins allow
    tolerance: float = 1e-4  # largest relative deviation of a margin
    sweeps: int = 40
    strict: bool = False  # raise, instead of warn, if the sweeps end before the tolerance is met
    seed: int = 23


def token_estimate(text: str = "text") -> Column:
    """Number of blank-separated pieces."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def topic_of(text: str = "text") -> Column:
    """A coarse topic from the form of a text: license, table, markup, dialogue or prose."""
    value = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(value), F.lit(1))

    def share(mark: str) -> Column:
        return (n - F.length(F.replace(value, F.lit(mark), F.lit("")))) / (n * len(mark))

    return (
        F.when(F.contains(value, F.lit("License")), "license")
        .when(share(" | ") > 0.02, "table")
        .when((share("%%%") + share("&&&") + share("***") + share("###")) > 0.01, "markup")
        .when(share("!!") + share("??") > 0.005, "dialogue")
        .otherwise("prose")
    )


def _target_table(cells: DataFrame, margin: str, wanted: dict[str, float] | float) -> DataFrame:
    """category, target: shares that sum to 1 over the categories that hold tokens."""
    sums = cells.filter("tokens > 0").groupBy(F.col(margin).alias("category")).agg(F.sum("tokens").alias("tokens"))
    whole = sums.agg(F.sum("tokens")).scalar()
    share = F.col("tokens") / whole
    if isinstance(wanted, dict):
        choice = F.lit(None).cast("double")
        for category, value in wanted.items():
            choice = F.when(F.col("category") == category, F.lit(float(value))).otherwise(choice)
        raw = F.coalesce(choice, share)
    else:
        raw = F.pow(share, F.lit(float(wanted)))
    kept = sums.select("category", raw.alias("raw")).filter("raw > 0")
    return kept.select("category", (F.col("raw") / kept.agg(F.sum("raw")).scalar()).alias("target"))


def rake(cells: DataFrame, settings: Settings) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `weight`: raked share over tokens."""
    # Targets stand in the cells; a cell of a category whose target is 0 drops out.
    state = cells.filter("tokens > 0").withColumn("weight", F.lit(1.0))
    for m in MARGINS:
        target = _target_table(cells, m, settings.targets.get(m, 1.0))
        state = state.join(
            target.select(F.col("category").alias(m), F.col("target").alias(f"target_{m}")), m
        )
    state = stored(state, "cells")
    for _ in range(settings.sweeps):
        gap = F.lit(0.0)
        for m in MARGINS:
            sums = state.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = F.col(f"target_{m}") / F.col("now")
            state = state.join(sums, m).withColumns(
                {"weight": F.col("weight") * factor, f"moved_{m}": F.abs(factor - 1)}
            ).drop("now")
            gap = F.greatest(gap, f"moved_{m}")
        state = stored(state, "cells")
        moved = state.agg(F.max(gap)).first()[0] or 0.0
        state = state.drop(*(f"moved_{m}" for m in MARGINS))
        if moved <= settings.tolerance:
            break
    else:
        told = f"margins still off by {moved:.2g} after {settings.sweeps} sweeps: the targets may exclude each other"
        if settings.strict:
            raise RuntimeError(told)
        warnings.warn(told, stacklevel=2)
    return state.select(*MARGINS, "tokens", "weight")


def _prefix(columns: list[str]) -> str:
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def probabilities(
    docs: DataFrame, settings: Settings, prefix: str = "_mix_", carried: list[str] | None = None
) -> DataFrame:
    """`docs` with its cell, token estimate, `draw` (uniform in [0, 1)) and `probability`, under prefixed names.

    Texts are read once, into a written table of the marked rows; `carried` names the columns of `docs`
    that are needed further, all unless given.
    """
    marks = {
        f"{prefix}source": F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN)),
        f"{prefix}lang": F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)),
        f"{prefix}topic": topic_of(),
        f"{prefix}tokens": token_estimate(),
        f"{prefix}draw": uniform(settings.seed),
    }
    kept = docs.columns if carried is None else carried
    marked = stored(
        docs.select(*(F.col(f"`{c}`") for c in kept), *(v.alias(c) for c, v in marks.items())), "marked"
    )
    cells = stored(
        marked.groupBy(*(F.col(f"{prefix}{m}").alias(m) for m in MARGINS)).agg(
            F.sum(f"{prefix}tokens").alias("tokens")
        ),
        "cells",
    )
    raked = rake(cells, settings)
    scale = 1 / F.max("weight")
    if settings.budget is not None:
        scale = F.least(scale, F.lit(settings.budget) / F.sum(F.col("tokens") * F.col("weight")))
    scale = raked.agg(scale.alias("scale")).scalar()
    odds = raked.select(
        *(F.col(m).alias(f"{prefix}{m}") for m in MARGINS),
        F.least(F.lit(1.0), F.col("weight") * scale).alias(f"{prefix}probability"),
    )
    odds = stored(odds, "probabilities")
    return marked.join(odds, [f"{prefix}{m}" for m in MARGINS], "left").withColumn(
        f"{prefix}probability", F.coalesce(f"{prefix}probability", F.lit(0.0))
    )


def uniform(seed: int) -> Column:
    """A hash of id and text in [0, 1): the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))


def drawn(seed: int, probability: Column) -> Column:
    """Whether a document is in the sample."""
    return uniform(seed) < probability


def mix(docs: DataFrame, settings: Settings) -> DataFrame:
    """The drawn documents, with the columns of `docs`."""
    prefix = _prefix(docs.columns)
    odds = probabilities(docs, settings, prefix)
    return odds.filter(F.col(f"{prefix}draw") < F.col(f"{prefix}probability")).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
