"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Labelled pages give every host a count of pages and of bad pages. The bad rate of a host is shrunk
towards the rate of its registered domain, that towards its public suffix, that towards all pages.
How strongly is learned from the data: at each level the beta-binomial prior's strength comes from the
spread of the units around their parents (method of moments). A page is blocked when the lower
bound of the posterior of its host's bad rate exceeds a limit. Everything is DataFrame expressions;
only counts by host are shuffled, after partial aggregation, so a host with a third of all pages
costs one row per task.

Defined results: a null url, or one without `://`, has an empty host and path; such pages form the
host ''. Pages without labels count for nothing, hosts without labels have the rate of their
domain. Repeated rows are judged each; an empty table gives no rows. Additional columns are dropped.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import stored

# Suffixes of two labels under which names are registered; any other suffix is the last label.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
MAX_RULES = 1000  # rules become one expression; a longer list would have to be a joined table

Rule = tuple[str, str]  # verdict, "host/path"


def parse_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every page."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return pages.select(
        "page_id",
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def matching_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits: its host or a subdomain, and its path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes first
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(
            slash + rest
        )
        text = F.when(fits, F.lit(rule)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def name_levels(host: str = "host") -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; a port does not count."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    parts = F.split(name, r"\.")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*SECOND_LEVEL) & (F.size(parts) > 2)
    suffix = F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(two), suffix


def _strength(units: DataFrame, mean: str) -> Column:
    """Strength of the beta prior of units (n, bad) around their parents' means, as a scalar."""
    spread = F.col(mean) * (1 - F.col(mean))
    excess = F.sum(F.pow(F.col("bad") - F.col("n") * F.col(mean), 2) - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    share = F.when(room > 0, excess / room)
    # Within [0.001, 0.5]: a strength of 1 to 999 labelled pages.
    kept = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(share, F.lit(0.5))))
    return units.agg((1 / kept - 1).alias("strength")).scalar()


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior bad rate and its lower bound from host, domain, suffix, n, bad (one row a host)."""
    mean = "mean"
    # The small tables of each level are written, so that a level does not compute those above again.
    levels = stored(hosts, "url-hosts")
    total = levels.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias(mean)).scalar()
    levels = levels.withColumn(mean, F.coalesce(total, F.lit(0.5)))
    for unit in ("suffix", "domain"):
        sums = levels.groupBy(unit, mean).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        sums = stored(sums, f"url-{unit}")
        strength = _strength(sums, mean)
        shrunk = (strength * F.col(mean) + F.col("bad")) / (strength + F.col("n"))
        means = stored(
            sums.select(F.col(unit).alias("_unit"), shrunk.alias("_mean")), f"url-{unit}-means"
        )
        levels = (
            levels.join(means, F.col(unit) == F.col("_unit"))
            .withColumn(mean, F.col("_mean"))
            .drop("_unit", "_mean")
        )
    strength = _strength(levels, mean)
    a = strength * F.col(mean) + F.col("bad")
    b = strength * (1 - F.col(mean)) + F.col("n") - F.col("bad")
    return levels.select("host", a.alias("_a"), b.alias("_b")).select(
        "host",
        (F.col("_a") / (F.col("_a") + F.col("_b"))).alias("bad_rate"),
        (
            F.col("_a") / (F.col("_a") + F.col("_b"))
            - z
            * F.sqrt(
                F.col("_a") * F.col("_b")
                / (F.pow(F.col("_a") + F.col("_b"), 2) * (F.col("_a") + F.col("_b") + 1))
            )
        ).alias("bad_rate_low"),
    )


def judge(
    urls: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = 0.2, z: float = 1.645
) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior of every page.

    `urls` comes from `parse_urls`; `outcomes` (page_id, bad 0/1) labels some of the pages, at most
    once each.
    """
    labelled = outcomes.select(F.col("page_id").alias("_page"), F.col("bad").alias("_bad"))
    domain, suffix = name_levels()
    hosts = (
        urls.join(labelled, F.col("page_id") == F.col("_page"), "left")
        .groupBy("host")
        .agg(
            F.count("_bad").cast("double").alias("n"),
            F.coalesce(F.sum("_bad"), F.lit(0)).cast("double").alias("bad"),
        )
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    )
    known = host_reputation(hosts, z)
    text, verdict = matching_rule(rules)
    method = F.when(F.col("bad_rate_low") > limit, "block").otherwise("allow")
    return urls.join(known, "host").select(
        "page_id",
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
        "bad_rate",
        "bad_rate_low",
    )
