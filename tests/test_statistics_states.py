"""Statistics from states against statistics of all positions."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridledger.operators import stats
from gridledger.specs import CO2, PW


def positions(spark, n=300):
    rnd = random.Random(6)
    data = [
        (
            dt.date(2024, 1, rnd.randrange(1, 5)), rnd.choice("XY"), rnd.choice("ab"), rnd.choice("st"),
            *(rnd.choice([1e9 + rnd.random(), rnd.random(), None]) for _ in range(4)), f"f{rnd.randrange(7)}.csv",
        )
        for _ in range(n)
    ]
    schema = "REPORT_DATE date, BOOK string, SEGMENT string, TGROUP1 string, VOLUME double, TRDVAL double, MKTVAL double, TRDPRC double, file_name string"
    return spark.createDataFrame(data, schema), data


@pytest.mark.parametrize("keys", [[], ["SEGMENT"], ["REPORT_DATE", "BOOK"], ["file_name"]])
@pytest.mark.parametrize("wanted", [None, "file_name IN ('f1.csv', 'f4.csv', 'f5.csv')"])
def test_any_files_and_keys(spark, keys, wanted):
    frame, data = positions(spark)
    states = stats.statistics_states(frame, CO2, ("file_name",))
    if wanted:
        states = states.filter(wanted)
        data = [r for r in data if r[-1] in ("f1.csv", "f4.csv", "f5.csv")]
    names = ["REPORT_DATE", "BOOK", "SEGMENT", "TGROUP1", *CO2.measures, "file_name"]
    groups = {}
    for r in data:
        row = dict(zip(["REPORT_DATE", "BOOK", "SEGMENT", "TGROUP1", "VOLUME", "TRDVAL", "MKTVAL", "TRDPRC", "file_name"], r))
        groups.setdefault(tuple(row[k] for k in keys), []).append(row)
    assert set(keys) <= set(names)
    got = stats.merge_statistics(states, CO2, keys).collect()
    assert len(got) == len(groups)
    for row in got:
        own = groups[tuple(row[k] for k in keys)]
        assert row["n"] == len(own)
        for m in CO2.measures:
            values = [r[m] or 0.0 for r in own]
            assert row[f"TOTAL_{m}"] == pytest.approx(sum(values), rel=1e-12)
            assert row[f"AVG_{m}"] == pytest.approx(sum(values) / len(values), rel=1e-12)
            assert (row[f"MIN_{m}"], row[f"MAX_{m}"]) == (min(values), max(values))
            if len(own) > 1:
                assert row[f"STD_{m}"] == pytest.approx(statistics.stdev(values), rel=1e-9)
            else:
                assert row[f"STD_{m}"] is None


def test_nothing_cancels(spark):
    """Values a billion times larger than their spread, merged in two steps."""
    rows = [(dt.date(2024, 1, 1 + i % 3), "b", "s", "t", 1e9 + (i % 5) * 0.01, 0.0, 0.0, 0.0, f"f{i % 4}") for i in range(60)]
    schema = "REPORT_DATE date, BOOK string, SEGMENT string, TGROUP1 string, VOLUME double, TRDVAL double, MKTVAL double, TRDPRC double, file_name string"
    states = stats.statistics_states(spark.createDataFrame(rows, schema), CO2, ("file_name",))
    daily = stats.merge_statistics(states, CO2, ["REPORT_DATE"], merged=True)
    got = stats.merge_statistics(daily, CO2, []).first()
    assert got["STD_VOLUME"] == pytest.approx(statistics.stdev([r[4] for r in rows]), rel=1e-4)


def test_lacking_dimensions_and_no_rows(spark):
    frame, _ = positions(spark, 20)
    states = stats.statistics_states(frame.withColumn("VOLUME_BL", F.col("VOLUME")), PW)
    assert states.filter("HORIZON IS NOT NULL").count() == 0
    merged = stats.merge_statistics(states, PW, ["HORIZON"]).collect()
    assert len(merged) == 1 and merged[0]["n"] == 20 and merged[0]["TOTAL_MKT_VAL_BL"] is None
    assert stats.merge_statistics(states.limit(0), PW, ["SEGMENT"]).count() == 0
