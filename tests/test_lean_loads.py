"""Loads that need little disk: shuffles that go when a write ends, rows that stay in place, slices."""

import pytest
from pyspark.sql import functions as F

from gridledger import session
from gridledger.operators import quality, stats
from gridledger.plans.ingest import Store, finish_load, ingest_folder, load_files
from gridledger.sources import feeds, star, tables
from gridledger.specs import PW

HEADER = "REPORT_DATE,BOOK,SEGMENT,VOLUME_BL,MKT_VAL_BL"


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    for at in "012":
        (folder / at).mkdir(parents=True)
        for name, cell in (("a", "1"), ("b", "n/a" if at == "1" else "2"), ("c", "3")):
            lines = [f"0{day}-11-2024,B,S,{cell},{day}" for day in (5, 6, 7)]
            (folder / at / f"NOP_PW_{name}.csv").write_text("\n".join([HEADER, *lines, ""]))
    # One file without a load measure: its cells are null, also where all of a slice lacks the column.
    (folder / "2" / "NOP_PW_d.csv").write_text("REPORT_DATE,BOOK,MKT_VAL_BL\n05-11-2024,B,4\n")
    return f"{folder}/*"


def test_a_load_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).select(
        F.lit("NOP_PW_a.csv").alias("file_name"),
        F.lit("2024-11-05").cast("date").alias("REPORT_DATE"),
        F.col("id").cast("double").alias("VOLUME_BL"),
    )
    before = shuffle_files(spark)
    tables.append_raw(rows, "PW", str(tmp_path / "store" / "positions"), "1")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session._CLEANUP) == "false"


def test_names_of_bad_files_do_not_move_rows(spark, tmp_path, inbox, monkeypatch):
    plans = []
    for name in ("append_raw", "write_rejected"):
        monkeypatch.setattr(tables, name, lambda rows, *_: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    headers = feeds.file_headers(spark, inbox)
    load_files(spark, headers, PW, Store(str(tmp_path / "store")), "1")
    assert len(plans) == 2 and not any("hashpartitioning(file_name" in p for p in plans)


def test_newest_reports_do_not_move_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), (None, 1, 4.0), ("c", None, 5.0)], "file_name string, REPORT_DATE int, v double"
    )
    rows.write.parquet(str(tmp_path / "rows"))
    stats.newest_reports(rows).write.parquet(str(tmp_path / "newest"))
    rows, newest = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "newest"))
    kept = stats.keep_latest_report(rows, newest=newest)
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, stats.keep_latest_report(rows).collect()))
    assert sorted(r["v"] for r in kept.collect()) == [2.0, 3.0]


def test_slices_load_the_same(spark, tmp_path, inbox, monkeypatch):
    def loaded(name):
        store = Store(str(tmp_path / name))
        ingest_folder(spark, inbox, PW, store)
        log = tables.read_log(spark, store.path("data_files")).drop("uploaded_at")
        shown = ["file_name", "REPORT_DATE", "SEGMENT", "VOLUME_BL", "MKT_VAL_BL"]
        frames = (
            log, tables.read_raw(spark, store.path("positions"), PW).select(shown),
            tables.read_rejected(spark, store.path("rejected"), PW).select(shown),
        )
        return [sorted(map(str, f.collect())) for f in frames]

    whole = loaded("whole")
    assert [len(x) for x in whole] == [4, 19, 9]
    monkeypatch.setattr(feeds, "n_slices", lambda _: 4)
    headers = feeds.file_headers(spark, inbox)
    assert sum(p.count() for p in feeds.file_slices(headers)) == headers.count() == 10
    assert loaded("sliced") == whole


def test_slices_of_dates_give_the_same_states(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 200, 1, 4).select(
        F.concat(F.lit("NOP_PW_"), F.col("id") % 2, F.lit(".csv")).alias("file_name"),
        F.when(F.col("id") % 9 > 0, F.expr("date'2024-11-01' + CAST(id % 5 AS INT)")).alias("REPORT_DATE"),
        *[F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in ("BOOK", "SEGMENT", "TGROUP1", "BOOK_ATTR8", "BUCKET", "HORIZON")],
        *[F.col("id").cast("double").alias(m) for m in PW.measures],
    )

    def made(name):
        store = Store(str(tmp_path / name))
        path = store.path("positions")
        tables.append_raw(rows, "PW", path, "1")
        finish_load(spark, rows.select("file_name"), PW, store, "1")
        live = tables.live_versions(spark, path)
        frames = (
            tables.read_states(spark, store.path("snapshot_parts"), "file_name", "load_id"),
            tables.read_snapshots(spark, store.path("snapshots"), "PW"),
            tables.read_statistics(spark, store.path("statistics"), PW, live),
            spark.read.parquet(store.path("file_stats")),
        )
        return [sorted(map(str, f.collect())) for f in frames]

    whole = made("whole")
    assert all(whole)
    seen = []
    one = tables.date_slices
    monkeypatch.setattr(tables, "n_slices", lambda _: 3)
    monkeypatch.setattr(tables, "date_slices", lambda *a: [x for x in one(*a) if not seen.append(x)])
    assert made("sliced") == whole
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 6 and "PartitionFilters: [" in plan and "xxhash64(REPORT_DATE" in plan.split("PartitionFilters: [")[1].split("\n")[0]


def test_a_junk_cell_rejects_its_file_in_every_slice(spark, tmp_path, inbox):
    headers = feeds.file_headers(spark, inbox)
    rows = feeds.read_by_header(headers, PW)
    names = quality.junk_files(rows, PW)
    assert [r["file_name"] for r in names.collect()] == ["NOP_PW_b.csv"]
    part = rows.filter("file_name = 'NOP_PW_b.csv' AND VOLUME_BL = '2'")
    clean, junk = quality.strict_load(part, PW, names)
    assert clean.count() == 0 and junk.count() == 6


def test_slices_of_lines_are_the_lines(spark, sf_dir, monkeypatch):
    size = session.stored_bytes(spark, f"{sf_dir}/lineitem.parquet")
    whole = [b(spark, sf_dir) for b in (star.power_positions, star.gas_positions, star.carbon_positions)]
    monkeypatch.setattr(session, "SLICE_BYTES", size // 3)
    slices = star.line_slices(spark, sf_dir)
    assert len(slices) > 2
    for build, rows in zip((star.power_positions, star.gas_positions, star.carbon_positions), whole):
        parts = [build(spark, sf_dir, lines) for lines in slices]
        assert all(not p.isEmpty() for p in parts)
        got = parts[0]
        for part in parts[1:]:
            got = got.unionAll(part)
        assert got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    # The orders of other slices stay where they are.
    assert "xxhash64(o_orderkey" in parts[0]._jdf.queryExecution().optimizedPlan().toString()
