"""Incremental snapshots against full rebuilds."""

import datetime as dt
import random

import pytest

from gridledger.operators import cube
from gridledger.plans import snapshots
from gridledger.plans.ingest import Store
from gridledger.sources import tables
from gridledger.specs import PW, PW_MEASURES

SCHEMA = (
    "REPORT_DATE date, SEGMENT string, TGROUP1 string, BOOK_ATTR8 string, HORIZON string, BUCKET string, "
    + ", ".join(f"{m} double" for m in PW_MEASURES)
    + ", file_name string"
)


def rows(file_name, days, seed, n=20, special=()):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        amounts = [rnd.choice([None, 0.1, -2.5, 1e6 + 0.01, 12345678.9]) for _ in PW_MEASURES]
        if i < len(special):
            amounts[0] = special[i]
        day = None if i == n - 1 else dt.date(2024, 1, rnd.choice(days))
        out.append((day, rnd.choice("AB"), rnd.choice(["x", None]), "b", rnd.choice(["M+1", "M+2"]), rnd.choice("pq"), *amounts, file_name))
    return out


@pytest.fixture
def store(spark, tmp_path):
    return Store(str(tmp_path / "store"))


def load(spark, store, data):
    tables.append_raw(spark.createDataFrame(data, SCHEMA), PW.category, store.path("positions"))


def retire(spark, store, file_name):
    files = spark.createDataFrame([(file_name,)], "file_name string")
    tables.announce_versions(files, PW.category, store.path("positions"), tables.new_load_id())


def published(spark, store):
    columns = [*cube.CELL, *[m.lower() for m in PW_MEASURES]]
    read = tables.read_snapshots(spark, store.path("snapshots"), PW.category).select(*columns)
    return sorted(map(repr, map(tuple, read.collect())))


def rebuilt(spark, store):
    raw = tables.read_raw(spark, store.path("positions"), PW)
    columns = [*cube.CELL, *[m.lower() for m in PW_MEASURES]]
    return sorted(map(repr, map(tuple, cube.build_cube(raw).select(*columns).collect())))


def test_corrections_retirements_and_replays(spark, store):
    load(spark, store, rows("a.csv", [1, 2], 1))
    load(spark, store, rows("b.csv", [2, 3], 2))
    assert snapshots.refresh(spark, store) == 3
    assert published(spark, store) == rebuilt(spark, store)
    assert snapshots.refresh(spark, store) == 0  # nothing to do

    load(spark, store, rows("b.csv", [3, 4], 3))  # leaves day 2, enters day 4
    assert snapshots.refresh(spark, store) == 3
    assert published(spark, store) == rebuilt(spark, store)

    retire(spark, store, "b.csv")
    load(spark, store, rows("c.csv", [1], 4))
    assert snapshots.refresh(spark, store) == 3
    assert published(spark, store) == rebuilt(spark, store)
    days = {r[0].day for r in tables.read_snapshots(spark, store.path("snapshots"), "PW").select("REPORT_DATE").collect()}
    assert days == {1, 2}

    load(spark, store, rows("b.csv", [4], 5))  # a retired file and date come back
    snapshots.refresh(spark, store)
    assert published(spark, store) == rebuilt(spark, store)


def test_wild_amounts_leave_without_a_trace(spark, store):
    inf, nan = float("inf"), float("nan")
    load(spark, store, rows("a.csv", [1], 1, special=[inf, 1e19]))
    load(spark, store, rows("b.csv", [1], 2, special=[nan, -inf]))
    snapshots.refresh(spark, store)
    assert published(spark, store) == rebuilt(spark, store)
    load(spark, store, rows("b.csv", [1], 3))
    snapshots.refresh(spark, store)
    assert published(spark, store) == rebuilt(spark, store)
    load(spark, store, rows("a.csv", [1], 4))
    snapshots.refresh(spark, store)
    assert published(spark, store) == rebuilt(spark, store)
    assert not any("inf" in r or "nan" in r for r in published(spark, store))


def test_broken_off_refresh_is_finished_by_the_next(spark, store, monkeypatch):
    load(spark, store, rows("a.csv", [1, 2], 1))
    snapshots.refresh(spark, store)
    load(spark, store, rows("a.csv", [2, 3], 2))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "replace_states", fail)
        with pytest.raises(RuntimeError):
            snapshots.refresh(spark, store)
    snapshots.refresh(spark, store)
    assert published(spark, store) == rebuilt(spark, store)


def test_other_files_are_not_read(spark, store):
    load(spark, store, rows("a.csv", [1, 2], 1))
    snapshots.refresh(spark, store)
    load(spark, store, rows("b.csv", [2], 2))
    live = tables.live_versions(spark, store.path("positions"))
    snapshots.contribute(spark, store, live)
    moved = snapshots.changes(spark, store)
    assert [(r["file_name"], r["sign"]) for r in moved.collect()] == [("b.csv", 1)]
    plan = snapshots._new_states(spark, store, moved, moved.select("REPORT_DATE").distinct())
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "VOLUME_BL" in text and f"{store.path('positions')}" not in "".join(plan.inputFiles())
