"""Change logs, compaction, guarded queries, catalogue tables, open-ended pivots."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from gridledger.operators import feedback, prompts
from gridledger.plans import adhoc, snapshots
from gridledger.plans.ingest import Store
from gridledger.sources import tables
from gridledger.specs import PW, PW_MEASURES
from gridledger.streaming import jobs

LOG = "change_id int, agent_id int, action string, name string, is_active int, cleared array<string>"


def replay(rows):
    """Plain fold in the order of the changes."""
    state = {}
    for _, agent, action, name, active, cleared in sorted(rows, key=lambda r: r[0]):
        if action == "delete":
            state[agent] = None
            continue
        own = state.get(agent) or {"name": None, "is_active": None}
        for field, value in (("name", name), ("is_active", active)):
            if value is not None or field in (cleared or []):
                own[field] = value
        state[agent] = own
    return sorted((a, s["name"], s["is_active"]) for a, s in state.items() if s is not None)


def random_log(n, seed):
    rnd = random.Random(seed)
    return [
        (
            i, rnd.randrange(6), rnd.choice(["insert", "update", "status", "delete"]), rnd.choice([None, f"n{i}"]),
            rnd.choice([None, 0, 1]), rnd.choice([None, [], ["name"], ["name", "is_active"]]),
        )
        for i in range(n)
    ]


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_agents_against_a_plain_fold(spark, seed):
    rows = [(i, a, x, None if x == "delete" else n, None if x == "delete" else v, c) for i, a, x, n, v, c in random_log(80, seed)]
    got = [tuple(r) for r in feedback.current_agents(spark.createDataFrame(rows, LOG)).collect()]
    assert key(got) == key(replay(rows))


def test_agent_comes_back_blank(spark):
    rows = [(1, 1, "insert", "old", 1, None), (2, 1, "delete", None, None, None), (3, 1, "insert", None, 0, None)]
    rows += [(4, 2, "insert", "x", 1, None), (5, 2, "update", None, None, ["name"])]
    got = {tuple(r) for r in feedback.current_agents(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(1, None, 0), (2, None, 1)}


def test_stream_out_of_order_and_repeated(spark, tmp_path):
    rows = random_log(60, 9)
    shuffled = random.Random(1).sample(rows, len(rows))
    source, out = str(tmp_path / "log"), str(tmp_path / "agents")
    for i in range(0, len(shuffled), 20):
        spark.createDataFrame(shuffled[i : i + 20], LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        jobs.stream_agents(stream, out, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame(shuffled[:20], LOG).transform(feedback.agent_states).write.mode("append").parquet(out)
    expected = [tuple(r) for r in feedback.current_agents(spark.createDataFrame(rows, LOG)).collect()]
    assert key(tuple(r) for r in jobs.read_agents(spark, out).collect()) == key(expected)


# --- compaction ------------------------------------------------------------------------

POSITIONS = (
    "REPORT_DATE date, SEGMENT string, TGROUP1 string, BOOK_ATTR8 string, HORIZON string, BUCKET string, "
    + ", ".join(f"{m} double" for m in PW_MEASURES)
    + ", file_name string"
)


def load(spark, store, name, days, volume):
    rows = [(dt.date(2024, 1, d), "S", "T", "B", "M+1", "x", *([float(volume)] * 9), name) for d in days]
    tables.append_raw(spark.createDataFrame(rows, POSITIONS), "PW", store.path("positions"))


def live(spark, store):
    raw = tables.read_raw(spark, store.path("positions"), PW)
    return key(map(tuple, raw.select("REPORT_DATE", "file_name", "VOLUME_BL").collect()))


def stored(spark, store):
    return spark.read.schema(tables.raw_schema(PW)).parquet(store.path("positions")).count()


def files(store):
    return sum(n.endswith(".parquet") for _, _, names in os.walk(store.path("positions")) for n in names)


def test_corrections_are_compacted_away(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for i in range(12):
        load(spark, store, "a.csv", [1, 2], i)
    load(spark, store, "b.csv", [2, 3], 100)
    snapshots.refresh(spark, store)
    before, reader = live(spark, store), tables.read_raw(spark, store.path("positions"), PW)
    n_files = files(store)
    assert len(before) == 4 and stored(spark, store) == 26
    assert tables.compact(spark, store.path("positions"), PW) == 2
    assert live(spark, store) == before
    # Nothing that an earlier reader listed is gone yet.
    assert reader.count() == 4
    assert tables.vacuum(spark, store.path("positions"), PW) == 0
    assert tables.vacuum(spark, store.path("positions"), PW, older_than_s=0) > 10
    assert live(spark, store) == before
    assert stored(spark, store) == 4 and files(store) < n_files
    assert tables.compact(spark, store.path("positions"), PW) == 0
    # The rows are the same versions as before: no date is touched.
    assert snapshots.refresh(spark, store) == 0


def test_newer_load_wins_over_a_compaction(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "store"))
    load(spark, store, "a.csv", [1], 1)
    load(spark, store, "a.csv", [1], 2)
    early = tables.new_load_id()  # drawn before the compaction, announced after it
    tables.compact(spark, store.path("positions"), PW)
    rows = [(dt.date(2024, 1, 1), "S", "T", "B", "M+1", "x", *([3.0] * 9), "a.csv")]
    tables.append_raw(spark.createDataFrame(rows, POSITIONS), "PW", store.path("positions"), early)
    name = spark.createDataFrame([("a.csv",)], "file_name string")
    tables.announce_versions(name, "PW", store.path("positions"), early)
    assert [r[2] for r in live(spark, store)] == [3.0]
    tables.vacuum(spark, store.path("positions"), PW, older_than_s=0)
    assert [r[2] for r in live(spark, store)] == [3.0]


# --- guarded queries ---------------------------------------------------------------------


@pytest.fixture
def power(spark):
    frame = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "BOOK string, VOLUME_BL double")
    frame.createOrReplaceTempView("PW_raw_data")
    frame.createOrReplaceTempView("secret_table")
    return frame


@pytest.mark.parametrize(
    "text",
    [
        "SELECT COUNT(*) AS n FROM PW_raw_data",
        "WITH x AS (SELECT BOOK FROM pw_raw_data) SELECT * FROM x JOIN PW_raw_data USING (BOOK)",
        "SELECT BOOK FROM PW_raw_data WHERE VOLUME_BL = (SELECT MAX(VOLUME_BL) FROM PW_raw_data)",
        "SELECT * FROM PW_raw_data UNION ALL SELECT * FROM PW_raw_data ORDER BY 1 LIMIT 3",
        "SELECT 'DROP TABLE x' AS BOOK FROM PW_raw_data -- INSERT INTO y",
    ],
)
def test_queries_run(spark, power, text):
    assert adhoc.run_sql(spark, text).count() >= 1


@pytest.mark.parametrize(
    "text",
    [
        "DROP VIEW PW_raw_data",
        "INSERT INTO PW_raw_data SELECT * FROM PW_raw_data",
        "WITH x AS (SELECT 1) INSERT INTO PW_raw_data SELECT * FROM x",
        "FROM PW_raw_data INSERT INTO other SELECT *",
        "CREATE TABLE t AS SELECT * FROM PW_raw_data",
        "SET spark.sql.ansi.enabled=false",
        "CACHE TABLE PW_raw_data",
        "EXPLAIN SELECT 1",
        "SELECT * FROM secret_table",
        "SELECT * FROM PW_raw_data WHERE BOOK IN (SELECT BOOK FROM secret_table)",
        "WITH x AS (SELECT * FROM secret_table) SELECT * FROM x",
        "SELECT * FROM parquet.`/etc/passwd`",
        "SELECT * FROM db.PW_raw_data",
        "SELECT * FROM range(1000000000)",
        "SELECT reflect('java.lang.System', 'exit', 1) FROM PW_raw_data",
        "SELECT * FROM IDENTIFIER('secret_' || 'table')",
        "SELECT 1; DROP VIEW PW_raw_data",
        "not sql",
        "",
    ],
)
def test_all_else_is_refused(spark, power, text):
    with pytest.raises(adhoc.RefusedQuery):
        adhoc.run_sql(spark, text)
    assert spark.table("PW_raw_data").count() == 2


def test_size_estimate(spark, power, tmp_path):
    spark.range(10_000).write.parquet(str(tmp_path / "big"))
    spark.read.parquet(str(tmp_path / "big")).createOrReplaceTempView("big")
    with pytest.raises(adhoc.RefusedQuery, match="estimated"):
        adhoc.run_sql(spark, "SELECT * FROM big", ["big"], most_bytes=1000)
    assert adhoc.run_sql(spark, "SELECT COUNT(*) AS n FROM big", ["big"], most_bytes=1000).first()[0] == 10_000


# --- catalogue table ---------------------------------------------------------------------


def test_catalogue_as_a_theta_join(spark):
    rnd = random.Random(3)
    words = ["volume", "market", "value", "peak", "off", "x", "ab", "naïve"]
    names = {"_".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(60)} | {"", "a", "xx"}
    catalogue = [(i, n.upper(), f"M{i}") for i, n in enumerate(sorted(names, key=lambda n: rnd.random()))]
    catalogue.append((len(catalogue), catalogue[3][1], "again"))  # a name under two metrics
    asked = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12)))) for i in range(40)]
    asked += [(100, None), (101, ""), (102, "a"), (103, "Naïve PEAK")]
    frame = spark.createDataFrame(asked, "id int, prompt string")
    got = prompts.select_metrics_from(frame, spark.createDataFrame(catalogue, "ord int, name string, metric string"), "id")
    wanted = set()
    for i, text in asked:
        squeezed = None if text is None else text.lower().replace(" ", "").replace("_", "")
        for o, n, m in catalogue:
            plain = n.lower().replace("_", "")
            if o == 0 or (squeezed is not None and plain != "" and plain in squeezed):
                wanted.add((i, o, n, m))
    assert {tuple(r) for r in got.collect()} == wanted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_the_constant_catalogue(spark):
    asked = spark.createDataFrame([(1, "Show volume bl and max_mkt_val_pk"), (2, None)], "id int, prompt string")
    table = prompts.catalogue_table(spark, PW)
    got = {tuple(r) for r in prompts.select_metrics_from(asked, table, "id").collect()}
    assert got == {tuple(r) for r in prompts.select_metrics(asked, PW).drop("prompt").collect()}


# --- open-ended pivots -------------------------------------------------------------------


def test_blocks_and_maps(spark):
    rows = spark.range(5000).select(
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).alias("day"),
        F.concat(F.lit("c"), F.col("id") % 1700).alias("feedback_comment"),
        F.lit(1).cast("bigint").alias("n"),
    )
    trend = rows.groupBy("day", "feedback_comment").agg(F.sum("n").alias("n"))
    domain = feedback.trend_domain(trend, 32)
    places = domain.collect()
    assert len(places) == 1700 and len({(r["block"], r["position"]) for r in places}) == 1700
    assert max(r["position"] for r in places) < 100
    long = key(map(tuple, trend.collect()))
    blocks = feedback.trend_blocks(trend, domain)
    assert key(map(tuple, feedback.trend_of_blocks(blocks, domain).collect())) == long
    maps = feedback.trend_maps(trend, domain).select("day", F.explode("uses").alias("c", "n"))
    assert key(map(tuple, maps.collect())) == long
    wide = feedback.feedback_trend_wide(trend, ["c0", "c1", "none"]).orderBy("day").collect()
    assert [r["none"] for r in wide] == [0, 0, 0] and wide[0]["c0"] + wide[1]["c0"] + wide[2]["c0"] == 3
