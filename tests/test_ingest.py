"""Readers, tables and the batch ingest over generated files."""

import datetime as dt
import json

import pytest

from gridledger.operators import feedback, quality, stats
from gridledger.operators.delta import delta_inner
from gridledger.plans.ingest import Store, ingest_folder, rebuild_snapshots
from gridledger.sources import feeds, tables
from gridledger.specs import CO2, NG, PW

MEASURES = "VOLUME_BL,VOLUME_PK,VOLUME_OFPK,MKT_VAL_BL,MKT_VAL_PK,MKT_VAL_OFPK,TRD_VAL_BL,TRD_VAL_PK,TRD_VAL_OFPK"


def power_line(day, segment, volume, market):
    rest = "1,1,1,1,1,1"
    v, m = f'"{volume}"', f'"{market}"'
    return f"{day},B1,{segment},T,C,base,Y1,01/02/2025,{v},0,0,{m},0,0,{rest[:5]}"


def write(folder, name, header, lines):
    (folder / name).write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


POWER_HEADER = "Report_Date,Book,Segment,TGROUP1,BOOK_ATTR8,Bucket,Horizon,Start Date," + MEASURES


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    write(
        folder, "NOP_PW_a.csv", POWER_HEADER + ",",
        [power_line("05-11-2024", "S1", "1,234.5", "2,000") + ",x", power_line("05-11-2024", "S2", "", "7") + ","],
    )
    swapped = POWER_HEADER.replace("Report_Date,Book", "Book,Report_Date")
    write(
        folder, "nop_pw_b.CSV", swapped,
        [power_line("B1", "S1", "1,000", "1,500").replace("B1,B1", "B1,06-11-2024", 1)],
    )
    write(folder, "NOP_PW_junk.csv", POWER_HEADER, [power_line("06-11-2024", "S1", "n/a", "1")])
    write(folder, "NOP_PW_short.csv", "Report_Date,Volume_BL,MKT_VAL_BL", ["06-11-2024,1,1"])
    write(folder, "other_d.csv", POWER_HEADER, [power_line("06-11-2024", "S9", "1", "1")])
    return folder


def test_read_feed(spark, inbox):
    rows = feeds.read_feed(spark, str(inbox / "NOP_PW_a.csv"), PW)
    assert "START_DATE" in rows.columns and not any(c.startswith("_") for c in rows.columns)
    assert {r["file_name"] for r in rows.collect()} == {"NOP_PW_a.csv"}


def test_odd_file_names(spark, tmp_path):
    name = "NOP_PW a%20+b.csv"
    write(tmp_path, name, "Report_Date,Volume_BL,MKT_VAL_BL", ["06-11-2024,1,1"])
    assert [r["file_name"] for r in feeds.list_files(spark, str(tmp_path)).collect()] == [name]
    rows = feeds.read_feed_folder(spark, str(tmp_path), PW).collect()
    assert [r["file_name"] for r in rows] == [name]


def test_shared_header(spark, inbox):
    (inbox / "nop_pw_b.CSV").rename(inbox / "unrelated.txt")
    (inbox / "NOP_PW_short.csv").rename(inbox / "unrelated2.txt")
    (inbox / "NOP_PW_a.csv").rename(inbox / "unrelated3.txt")
    rows = feeds.read_feed_folder(spark, str(inbox), PW, shared_header=True)
    assert {r["file_name"] for r in rows.collect()} == {"NOP_PW_junk.csv"}


def test_headers(spark, inbox):
    found = {r["file_name"]: r for r in feeds.file_headers(spark, str(inbox)).collect()}
    assert found["other_d.csv"]["category"] is None
    assert found["nop_pw_b.CSV"]["columns"][:2] == ["BOOK", "REPORT_DATE"]
    assert "" not in found["NOP_PW_a.csv"]["columns"]


def test_quoted_commas_in_headers(spark, tmp_path):
    header = 'Report_Date,"Note, long","Volume_BL",MKT_VAL_BL,"Remark, ""so"" called"'
    write(tmp_path, "NOP_PW_q.csv", header, ['06-11-2024,"a, b",7,8,x'])
    found = feeds.file_headers(spark, str(tmp_path)).first()["columns"]
    assert found[:4] == ["REPORT_DATE", "NOTE,_LONG", "VOLUME_BL", "MKT_VAL_BL"] and len(found) == 5
    row = feeds.read_feed_folder(spark, str(tmp_path), PW).first()
    assert (row["VOLUME_BL"], row["MKT_VAL_BL"]) == ("7", "8")


def test_folder_with_different_column_order(spark, inbox):
    rows = feeds.read_feed_folder(spark, str(inbox), PW).collect()
    assert {r["BOOK"] for r in rows if r["file_name"] == "nop_pw_b.CSV"} == {"B1"}
    assert "other_d.csv" not in {r["file_name"] for r in rows}


def test_ingest(spark, inbox, tmp_path):
    store = Store(str(tmp_path / "store"))
    declared = ["REPORT_DATE", "BOOK", "SEGMENT", "START_DATE", "volume_bl "]
    ingest_folder(spark, str(inbox), PW, store, declared)

    positions = tables.read_raw(spark, store.path("positions"), PW)
    assert positions.count() == 3
    first = positions.filter("SEGMENT = 'S1' and file_name = 'NOP_PW_a.csv'").first()
    assert first["VOLUME_BL"] == 1234.5 and first["REPORT_DATE"] == dt.date(2024, 11, 5)
    assert first["START_DATE"] == dt.date(2025, 2, 1)
    rejected = spark.read.parquet(store.path("rejected"))
    assert {r["file_name"] for r in rejected.collect()} == {"NOP_PW_junk.csv", "NOP_PW_short.csv"}

    log = tables.read_log(spark, store.path("data_files"))
    done = log.filter("is_processed = 1").collect()
    assert {r["file_name"]: r["n_rows"] for r in done} == {"NOP_PW_a.csv": 2, "nop_pw_b.CSV": 1}
    undone = {r["file_name"] for r in log.filter("is_processed = 0").collect()}
    assert undone == {"NOP_PW_junk.csv", "NOP_PW_short.csv"}

    snapshots = spark.read.parquet(store.path("snapshots"))
    before = sorted(map(tuple, snapshots.collect()), key=repr)
    deltas = delta_inner(
        snapshots.filter("view = 'by_segment_horizon'"), ["member", "label"], "volume_bl"
    ).collect()
    assert [(r["member"], r["delta"]) for r in deltas] == [("S1", -234.5)]

    documents = spark.read.parquet(store.path("file_stats"))
    records, bad = stats.explode_stats(documents, PW)
    assert bad.count() == 0
    s2 = records.filter("SEGMENT = 'S2'").first()
    assert (s2["TOTAL_VOLUME_BL"], s2["AVG_MKT_VAL_BL"]) == (0.0, 7.0)

    # A second run finds the loaded files in the log; only rejected ones come up again.
    ingest_folder(spark, str(inbox), PW, store, declared)
    assert tables.read_raw(spark, store.path("positions"), PW).count() == 3
    rebuild_snapshots(spark, store)
    after = sorted(map(tuple, spark.read.parquet(store.path("snapshots")).collect()), key=repr)
    assert before == after


def test_loading_a_file_twice_replaces_it(spark, inbox, tmp_path):
    path = str(tmp_path / "positions")
    clean, _ = quality.strict_load(feeds.read_feed(spark, str(inbox / "NOP_PW_a.csv"), PW), PW)
    tables.append_raw(clean, "PW", path)
    tables.append_raw(clean, "PW", path)
    assert tables.read_raw(spark, path, PW).count() == 2


def test_partition_pruning(spark, inbox, tmp_path):
    path = str(tmp_path / "positions")
    rows = feeds.read_feed_folder(spark, str(inbox), PW)
    tables.append_raw(quality.strict_load(rows, PW)[0], "PW", path)
    stored = tables.read_raw(spark, path, PW)
    plan = delta_inner(stored, ["SEGMENT"], "VOLUME_BL")._jdf.queryExecution().executedPlan().toString()
    assert "REPORT_DATE" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_statistics_of_newest_report(spark, tmp_path):
    header = "REPORT_DATE,BOOK,SEGMENT,TGROUP1,VOLUME,MKTVAL,TRDVAL,TRDPRC"
    write(
        tmp_path, "NOP_CO2_b.csv", header,
        ["04Nov24,B,S,T,1,1,1,1", "05Nov24,B,S,T,n/a,2,1,1", "05–11–2024,B,S,T,4,4,1,1", "junk,B,S,T,9,9,9,9"],
    )
    from gridledger.plans.ingest import file_statistics

    rows = feeds.read_feed(spark, str(tmp_path / "NOP_CO2_b.csv"), CO2)
    got = file_statistics(rows, CO2).collect()
    assert len(got) == 1
    assert (got[0]["AVG_VOLUME"], got[0]["MIN_VOLUME"], got[0]["TOTAL_MKTVAL"]) == (2.0, 0.0, 6.0)
    assert round(got[0]["STD_VOLUME"], 4) == 2.8284


def test_absent_dimension(spark):
    frame = spark.createDataFrame([(dt.date(2024, 1, 1), "B", 2.0)], "REPORT_DATE date, BOOK string, VOLUME double")
    got = stats.daily_stats(frame, NG)
    assert got.columns == ["REPORT_DATE", "BOOK", "TOTAL_VOLUME", "AVG_VOLUME", "MIN_VOLUME", "MAX_VOLUME", "STD_VOLUME"]
    assert got.first()["STD_VOLUME"] is None


def test_whole_documents(spark):
    good = json.dumps({"daily_totals": [{"REPORT_DATE": "2024-01-02", "BOOK": "B", "TOTAL_VOLUME": "1.5", "STD_VOLUME": "nan"}]})
    documents = spark.createDataFrame([("a", good), ("b", "{broken"), ("c", "{}")], "file_name string, json_contents string")
    records, bad = stats.explode_stats(documents, CO2)
    row = records.collect()
    assert len(row) == 1 and row[0]["TOTAL_VOLUME"] == 1.5
    assert {r["file_name"] for r in bad.collect()} == {"b", "c"}


def test_schema_validation(spark):
    headers = spark.createDataFrame(
        [("f1", "PW", ["book", " Report_Date ", "x"]), ("f2", "PW", ["BOOK"])],
        "file_name string, category string, columns array<string>",
    )
    metadata = spark.createDataFrame([("PW", ["Report_Date", "Book "])], "category string, columns array<string>")
    got = {r["file_name"]: r for r in quality.validate_schema(headers, metadata).collect()}
    assert (got["f1"]["missing"], got["f1"]["extra"], got["f1"]["is_valid"]) == ([], ["X"], True)
    assert (got["f2"]["missing"], got["f2"]["is_valid"]) == (["REPORT_DATE"], False)


def test_alias_map(spark, tmp_path):
    write(tmp_path, "schema_pw.csv", "Field_Name,Column,Description",
          ["a,VOL, Volume ", "b,VOL2,volume", "c,,Empty", "d,MKT,"])
    rows = feeds.read_schema_file(spark, str(tmp_path / "schema_pw.csv"))
    got = {r["description"]: r["column_name"] for r in quality.alias_map(rows).collect()}
    assert got == {"volume": "VOL2"}
    tables.save_metadata(rows, "schema_pw.csv", "PW/metadata/schema_pw.csv", str(tmp_path / "meta"))
    stored = spark.read.parquet(str(tmp_path / "meta")).orderBy("row_no").collect()
    assert json.loads(stored[0]["json_record"])["Column"] == "VOL" and len(stored) == 4


def test_dictionary(spark, tmp_path):
    write(tmp_path, "one.csv", "Code", ["A", "B"])
    write(tmp_path, "two.csv", "Code,Label", ["A,first", ",", "A,second", "B,bee"])
    write(tmp_path, "three.csv", "Code,Label,Note", ["A,label,note"])
    write(tmp_path, "four.csv", "Code,x,Meaning,y", ["K,1,meaning,2"])
    names = ["one", "two", "three", "four"]
    entries = feeds.read_dictionary(spark, {f" {n} sheet": str(tmp_path / f"{n}.csv") for n in names})
    got = {(r["sheet"], r["context_name"]): r["description"] for r in entries.collect()}
    assert got == {
        ("ONE_SHEET", "A"): "", ("ONE_SHEET", "B"): "", ("TWO_SHEET", "A"): "second",
        ("TWO_SHEET", "B"): "bee", ("THREE_SHEET", "A"): "label", ("FOUR_SHEET", "K"): "meaning",
    }
    path = str(tmp_path / "glossary")
    tables.append_glossary(entries.filter("sheet = 'THREE_SHEET'"), "d1.xlsx", path)
    tables.append_glossary(entries.filter("sheet = 'TWO_SHEET'"), "d2.xlsx", path)
    glossary = {r[0]: r[1] for r in tables.read_glossary(spark, path).collect()}
    assert glossary == {"A": "second", "B": "bee"}


def test_exports_and_logs(spark, tmp_path):
    logs = spark.createDataFrame(
        [("1", "q", "a", "PW", 0, "bad", 1.0), ("2", "q2", "a2", "PW", 1, None, 2.0)],
        "log_id string, query string, answer string, category string, user_feedback int, feedback_comment string, latency double",
    ).selectExpr("*", "timestamp '2024-01-01 00:00:00' as created_at")
    tables.export_training_pairs(feedback.training_pairs(logs), str(tmp_path / "pairs"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "pairs")).collect()] == [("bad", "a", "q")]
    tables.export_feedback_csv(feedback.feedback_grid(logs), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[1] == "User Query" and back.count() == 2
    tables.append_log(logs.drop("log_id", "created_at"), str(tmp_path / "log"))
    tables.append_log(logs.drop("log_id", "created_at"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).select("log_id").distinct().count() == 4


def test_empty_pairs(spark, tmp_path):
    logs = spark.createDataFrame([], "query string, answer string, user_feedback int, feedback_comment string")
    assert feedback.training_pairs(logs).count() == 0


def test_current_feedback_and_agents(spark):
    logs = spark.createDataFrame([(1, 1, None), (2, 1, None)], "log_id int, user_feedback int, feedback_comment string")
    updates = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 0, None)], "update_id int, log_id int, user_feedback int, feedback_comment string")
    got = {r["log_id"]: (r["user_feedback"], r["feedback_comment"]) for r in feedback.current_feedback(logs, updates).collect()}
    assert got == {1: (0, None), 2: (1, None)}
    changes = spark.createDataFrame(
        [(1, 1, "insert", "A", 1), (2, 2, "insert", "B", 1), (3, 1, "status", None, 0), (4, 2, "delete", None, None)],
        "change_id int, agent_id int, action string, name string, is_active int",
    )
    assert [tuple(r) for r in feedback.current_agents(changes).collect()] == [(1, "A", 0)]
