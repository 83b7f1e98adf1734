from datetime import datetime, timedelta, timezone

from causalbars.operators.grid import regular_grid

BARS = "bar_id long, series_id string, symbol string, index_ns long, close double, volume double, received_at timestamp, tz string, slot long"
INS = "symbol string, timezone_name string, rth_open string, rth_close string, bar_seconds long, volume string"
NY = [("A", "America/New_York", "09:30", "10:00", 300, "clash")]


def ns(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000_000


def run(spark, rows, ins=NY, **k):
    t0 = datetime(2020, 1, 1)
    data = [(i, s, "A", None if at is None else ns(at), c, v, t0 + timedelta(minutes=i), "x", 1) for i, (s, at, c, v) in enumerate(rows)]
    out = regular_grid(spark.createDataFrame(data, BARS), spark.createDataFrame(ins, INS), **k).collect()
    return sorted(((r.series_id or "", r.slot_ns, r.close, r.volume, r.state) for r in out))


def test_filled_gaps_and_edges(spark):
    rows = [("S", "2024-03-08 14:36:10", 10.0, 5.0), ("S", "2024-03-08 14:46:00", 12.0, 7.0), ("S", "2024-03-08 14:47:00", 13.0, 1.0)]
    got = run(spark, rows)
    assert [(g[1] - ns("2024-03-08 14:30:00")) // 300_000_000_000 for g in got] == list(range(6))
    assert [g[4] for g in got] == ["before", "reading", "filled", "reading", "after", "after"]
    assert [g[2] for g in got] == [None, 10.0, 11.5, 13.0, None, None]
    assert [g[3] for g in got] == [None, 5.0, 0.0, 8.0, None, None]
    assert [g[4] for g in run(spark, rows, max_fill=0)][2] == "gap"


def test_clock_change(spark):
    """The session of the Monday after the clocks went forward begins an hour earlier in UTC."""
    got = run(spark, [("S", "2024-03-08 14:30:00", 1.0, 1.0), ("S", "2024-03-11 13:30:00", 1.0, 1.0)])
    assert {g[1] for g in got if g[4] == "reading"} == {ns("2024-03-08 14:30:00"), ns("2024-03-11 13:30:00")}
    assert len(got) == 12


def test_copies_nulls_and_outside(spark):
    rows = [
        ("S", "2024-03-08 14:30:00", 1.0, 1.0),
        ("S", "2024-03-08 14:30:00", 2.0, 4.0),  # received later
        ("S", "2024-03-08 14:35:00", None, 1.0),  # no close: no reading
        ("S", "2024-03-08 14:59:59", 3.0, None),
        ("S", "2024-03-08 15:00:00", 9.0, 1.0),  # at the close: outside
        ("S", "2024-03-09 14:31:00", float("nan"), 1.0),
        ("S", None, 1.0, 1.0),
        (None, "2024-03-08 14:30:00", 1.0, 1.0),
    ]
    got = run(spark, rows)
    s = [g for g in got if g[0] == "S"]
    assert [g[4] for g in s] == ["reading", "gap", "gap", "gap", "gap", "reading"]
    assert s[0][2:4] == (2.0, 4.0) and s[5][2:4] == (3.0, None)
    assert len([g for g in got if g[0] == ""]) == 6


def test_empty(spark):
    assert run(spark, []) == []
