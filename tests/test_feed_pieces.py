"""Feed files in compressed pieces: written without a shuffle, read and judged as one file."""

import gzip

from pyspark.sql import functions as F

from gridledger.plans.ingest import Store, ingest_folder
from gridledger.sources import feeds, tables
from gridledger.specs import PW
from gridledger.streaming import jobs
from workload.feeds import pieces, write_feed

HEADER = "REPORT_DATE,BOOK,SEGMENT,VOLUME_BL,MKT_VAL_BL"


def piece(folder, at, name, lines, header=HEADER):
    (folder / at).mkdir(parents=True, exist_ok=True)
    (folder / at / name).write_bytes(gzip.compress("\n".join([header, *lines, ""]).encode()))


def test_every_task_writes_its_own_piece(spark, tmp_path):
    rows = spark.range(0, 600, 1, 3).select(
        F.lit("2024-11-05").cast("date").alias("REPORT_DATE"),
        F.concat(F.lit("S "), (F.col("id") % 2).cast("string")).alias("SEGMENT"),
        F.col("id").cast("double").alias("VOLUME_BL"),
    )
    folder = str(tmp_path / "inbox")
    write_feed(rows, "SEGMENT", "NOP_PW", folder)
    files = feeds.list_files(spark, pieces(folder)).collect()
    assert len(files) == 6 and {r["file_name"] for r in files} == {"NOP_PW_S0.csv", "NOP_PW_S1.csv"}
    assert all(r["file_path"].endswith(".csv.gz") for r in files)
    read = feeds.read_feed_folder(spark, pieces(folder), PW)
    found = read.groupBy("file_name").agg(F.count("*"), F.sum(F.col("VOLUME_BL").cast("double"))).collect()
    assert sorted(map(tuple, found)) == [("NOP_PW_S0.csv", 300, 89700.0), ("NOP_PW_S1.csv", 300, 90000.0)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_no_rows_leave_an_empty_folder(spark, tmp_path):
    rows = spark.createDataFrame([], "REPORT_DATE date, SEGMENT string")
    write_feed(rows, "SEGMENT", "NOP_PW", str(tmp_path / "inbox"))
    assert feeds.list_files(spark, pieces(str(tmp_path / "inbox"))).count() == 0


def load(spark, tmp_path, declared=None):
    store = Store(str(tmp_path / "store"))
    names = ingest_folder(spark, f"{tmp_path}/inbox/*", PW, store, declared)
    log = sorted(map(tuple, tables.read_log(spark, store.path("data_files")).select("file_name", "n_rows", "is_processed").collect()))
    return names, log, tables.read_raw(spark, store.path("positions"), PW).count()


def test_a_junk_cell_rejects_all_pieces(spark, tmp_path):
    for at, cell in (("0", "1"), ("1", "n/a"), ("2", "3")):
        piece(tmp_path / "inbox", at, "NOP_PW_a.csv.gz", [f"06-11-2024,B,S,{cell},1"])
        piece(tmp_path / "inbox", at, "NOP_PW_b.csv.gz", ["06-11-2024,B,S,1,1"])
    names, log, n = load(spark, tmp_path)
    assert names == ["NOP_PW_a.csv", "NOP_PW_b.csv"]
    assert log == [("NOP_PW_a.csv", 0, 0), ("NOP_PW_b.csv", 3, 1)] and n == 3


def test_a_piece_without_a_column_rejects_all_pieces(spark, tmp_path):
    piece(tmp_path / "inbox", "0", "NOP_PW_a.csv.gz", ["06-11-2024,B,S,1,1"])
    piece(tmp_path / "inbox", "1", "NOP_PW_a.csv.gz", ["06-11-2024,1,1"], "REPORT_DATE,VOLUME_BL,MKT_VAL_BL")
    _, log, n = load(spark, tmp_path, HEADER.split(","))
    assert log == [("NOP_PW_a.csv", 0, 0)] and n == 0


def test_stream_of_pieces(spark, tmp_path):
    for at in "012":
        piece(tmp_path / "inbox", at, "NOP_PW_a.csv.gz", ["06-11-2024,B,S,1,1", "07-11-2024,B,S,2,1"])
    store = Store(str(tmp_path / "store"))
    jobs.stream_ingest(spark, f"{tmp_path}/inbox/*", PW, store).awaitTermination()
    assert tables.read_raw(spark, store.path("positions"), PW).count() == 6
