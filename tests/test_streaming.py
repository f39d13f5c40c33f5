"""Streams over generated files."""

import datetime as dt

from pyspark.sql import functions as F

from gridledger.operators import cube, files
from gridledger.plans.ingest import Store
from gridledger.sources import tables
from gridledger.specs import PW
from gridledger.streaming import jobs

HEADER = [
    "REPORT_DATE", "BOOK", "SEGMENT", "TGROUP1", "BOOK_ATTR8", "BUCKET", "HORIZON", *PW.measures,
]


def write(folder, name, days, volume="1,000.5"):
    lines = [",".join(HEADER)]
    for day in days:
        lines.append(f'{day},B,S,T,C,base,Y1,"{volume}",' + ",".join("2" for _ in range(8)))
    (folder / name).write_text("\n".join(lines) + "\n")


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_ingest_and_snapshots(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = Store(str(tmp_path / "store"))
    write(inbox, "NOP_PW_1.csv", ["05-11-2024", "05-11-2024"])
    write(inbox, "NOP_CO2_1.csv", ["05-11-2024"])
    run(jobs.stream_ingest(spark, str(inbox), PW, store))
    run(jobs.stream_snapshots(spark, store))
    positions = tables.read_raw(spark, store.path("positions"), PW)
    assert positions.count() == 2 and positions.first()["VOLUME_BL"] == 1000.5

    write(inbox, "NOP_PW_2.csv", ["05-11-2024", "06-11-2024"])
    write(inbox, "NOP_PW_bad.csv", ["06-11-2024"], volume="junk")
    run(jobs.stream_ingest(spark, str(inbox), PW, store))
    run(jobs.stream_snapshots(spark, store))
    positions = tables.read_raw(spark, store.path("positions"), PW)
    assert positions.count() == 4
    assert tables.read_rejected(spark, store.path("rejected"), PW).count() == 1
    log = {r["file_name"]: r["is_processed"] for r in tables.read_log(spark, store.path("data_files")).collect()}
    assert log == {"NOP_PW_1.csv": 1, "NOP_PW_2.csv": 1, "NOP_PW_bad.csv": 0}

    columns = ["REPORT_DATE", "view", "member", "label", "volume_bl", "market_val"]
    columns = [c for c in cube.build_cube(positions).columns]
    stored = spark.read.parquet(store.path("snapshots")).select(*columns)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(
        map(tuple, cube.build_cube(positions).collect()), key=repr
    )


def test_timeline(spark, tmp_path):
    rows = [("NOP_PW_1.csv", dt.datetime(2024, 1, d, h)) for d in (1, 2, 3) for h in (1, 5)]
    rows += [("plain.csv", dt.datetime(2024, 1, 1, 2))]
    batch = spark.createDataFrame(rows, "file_name string, uploaded_at timestamp")
    source = str(tmp_path / "files")
    batch.coalesce(1).write.parquet(source)

    def run_stream():
        stream = spark.readStream.schema(batch.schema).parquet(source)
        run(
            jobs.stream_timeline(stream)
            .writeStream.trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "ck"))
            .outputMode("append")
            .format("parquet")
            .start(str(tmp_path / "out"))
        )

    run_stream()
    # Moves the watermark past the first days; the late row of day 1 is dropped.
    late = [("NOP_PW_9.csv", dt.datetime(2024, 1, 6)), ("NOP_PW_late.csv", dt.datetime(2024, 1, 1, 3))]
    spark.createDataFrame(late, batch.schema).coalesce(1).write.mode("append").parquet(source)
    run_stream()
    closed = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(map(tuple, closed.collect()))
    expected = files.file_timeline(batch).filter(F.col("upload_day") <= dt.date(2024, 1, 3))
    assert got == sorted(map(tuple, expected.collect()))
