"""Two-report comparisons on small hand-made positions."""

import datetime as dt

import pytest

from gridledger.operators import cube, delta, trend

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
SCHEMA = (
    "REPORT_DATE date, BOOK string, SEGMENT string, TGROUP1 string, BOOK_ATTR8 string, "
    "HORIZON string, BUCKET string, VOLUME_BL double, MKT_VAL_BL double, VOLUME_PK double, "
    "VOLUME_OFPK double, MKT_VAL_PK double, MKT_VAL_OFPK double, TRD_VAL_BL double, "
    "TRD_VAL_PK double, TRD_VAL_OFPK double"
)


def row(day, segment, horizon, volume, market, book="B"):
    rest = [0.0] * 7
    return (day, book, segment, "T", "C", horizon, "base", volume, market, *rest)


@pytest.fixture(scope="module")
def positions(spark):
    rows = [
        row(D1, "OLD", "Y1", 99.0, 99.0),
        row(D2, "A", "Y1", 10.0, 100.0),
        row(D2, "A", "Y1", 5.0, None),
        row(D2, "B", "Y1", 7.0, 70.0),
        row(D2, "GONE", "Y2", 3.0, 30.0),
        row(D3, "A", "Y1", 20.0, 130.0),
        row(D3, "B", "Y1", 7.0, 70.0),
        row(D3, "B", "Y2", 1.0, 2.0),
        row(D3, "NEW", "Y1", 4.0, 40.0),
        row(D3, None, "Y1", 1000.0, 1000.0),
        row(D3, "A", None, 1000.0, 1000.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


KEYS = ["SEGMENT", "HORIZON"]


def as_dict(frame, *columns):
    return {tuple(r[k] for k in KEYS): tuple(r[c] for c in columns) for r in frame.collect()}


def test_inner(positions):
    got = as_dict(delta.delta_inner(positions, KEYS, "VOLUME_BL"), "delta")
    assert got == {("A", "Y1"): (5.0,), ("B", "Y1"): (0.0,)}


def test_left_drops_unchanged(positions):
    got = as_dict(
        delta.delta_left(positions, KEYS), "delta_volume_bl", "delta_market_val_bl"
    )
    assert got == {("A", "Y1"): (5.0, 30.0), ("B", "Y2"): (1.0, 2.0), ("NEW", "Y1"): (4.0, 40.0)}


def test_either_and_full(positions):
    got = as_dict(delta.delta_either(positions, KEYS, "VOLUME_BL"), "delta")
    assert got[("GONE", "Y2")] == (-3.0,)
    assert ("OLD", "Y1") not in got and len(got) == 5
    full = as_dict(delta.delta_full(positions, "HORIZON", "SEGMENT", "VOLUME_BL"), "delta")
    assert len(full) == 4 * 2
    assert full[("NEW", "Y2")] == (0.0,)
    assert {k: v for k, v in full.items() if k in got} == got


def test_one_report_gives_nothing(positions):
    single = positions.filter("REPORT_DATE = DATE '2024-01-03'")
    assert delta.delta_either(single, KEYS, "VOLUME_BL").count() == 0
    assert delta.nop_card(single).count() == 0
    assert delta.top_movers_all(single, "SEGMENT", "VOLUME_BL").count() == 0


def test_matrix_text(positions):
    full = delta.delta_full(positions, "HORIZON", "SEGMENT", "VOLUME_BL")
    cells = {(r["HORIZON"], r["SEGMENT"]): r["delta"] for r in delta.delta_text(full).collect()}
    assert cells[("Y1", "A")] == "+5.0" and cells[("Y2", "GONE")] == "-3.0"
    assert cells[("Y2", "NEW")] == "0.0"
    wide = delta.delta_matrix(positions, "HORIZON", "SEGMENT", "VOLUME_BL", ["A", "GONE"])
    assert {r["HORIZON"]: r["A"] for r in wide.collect()}["Y1"] == 5.0


def test_given_dates_are_read_alone(positions):
    found = delta.report_pair(positions).first()
    dates = (found["latest"], found["previous"])
    looked_up = as_dict(delta.delta_either(positions, KEYS, "VOLUME_BL"), "delta")
    given = delta.delta_either(positions, KEYS, "VOLUME_BL", dates)
    assert as_dict(given, "delta") == looked_up
    assert delta.nop_card(positions, (dates[0], None)).count() == 0


def test_movers_need_both_reports(positions):
    got = delta.top_movers(positions, "SEGMENT", "Y2", "VOLUME_BL").collect()
    # B had nothing at Y2 before; A has nothing there at all and moves by 0.
    assert [(r[0], r[1]) for r in got] == [("B", 1.0), ("A", 0.0)]


def test_movers_of_all_horizons(positions):
    for k in (1, 2, 5):
        every = delta.top_movers_all(positions, "SEGMENT", "VOLUME_BL", k).collect()
        for horizon in ("Y1", "Y2"):
            one = delta.top_movers(positions, "SEGMENT", horizon, "VOLUME_BL", k).collect()
            got = sorted((r["rank"], r["SEGMENT"], r["delta"]) for r in every if r["HORIZON"] == horizon)
            assert [(s, d) for _, s, d in got] == [(r[0], r[1]) for r in one]


def test_drivers(positions):
    got = {
        (r["view"], r["rank"]): (r["member"], r["horizon"], r["delta_market_val_bl"])
        for r in delta.top_drivers(positions).collect()
    }
    assert got[("Segment", 1)] == ("NEW", "Y1", 40.0)
    assert got[("Segment", 2)] == ("A", "Y1", 30.0)


def test_delta_on_stored_cube(spark, positions):
    stored = cube.build_cube(positions).filter("view = 'by_segment_horizon'")
    from_cube = {
        (r["member"], r["label"]): r["delta"]
        for r in delta.delta_inner(stored, ["member", "label"], "volume_bl").collect()
    }
    direct = as_dict(delta.delta_inner(positions, KEYS, "VOLUME_BL"), "delta")
    assert {k: (v,) for k, v in from_cube.items()} == direct


def test_cube_forms_agree(positions):
    one_pass = sorted(map(tuple, cube.build_cube(positions).collect()), key=repr)
    per_view = sorted(map(tuple, cube.build_cube_by_union(positions).collect()), key=repr)
    assert one_pass == per_view
    stored = cube.cube_documents(cube.build_cube(positions))
    back = sorted(map(tuple, cube.explode_cube(stored).collect()), key=repr)
    filled = sorted(map(tuple, cube.build_cube(positions).fillna(0.0).collect()), key=repr)
    assert back == filled


def test_trend(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 6)]
    series = {"F": [5, 9, 6, 4, 1], "U": [5, 1, 2, 3, 4], "S": [9, 8, 8, 7, 6], "X": [2, 1]}
    rows = [
        row(day, "A", "Y1", float(v), 0.0, book)
        for book, values in series.items()
        for day, v in zip(days, values)
    ]
    positions = spark.createDataFrame(rows, SCHEMA)

    def books(n, direction):
        return {r["BOOK"] for r in trend.consecutive_trend(positions, n, direction).collect()}

    assert books(2, "down") == {"F", "S"}
    assert books(3, "down") == {"F"}
    assert books(1, "down") == {"F", "S", "X"}
    assert books(3, "up") == {"U"}
    assert books(4, "up") == set()
