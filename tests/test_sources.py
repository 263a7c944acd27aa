import gzip
import json

import pytest

from loopline.sources import readers
from loopline.streaming.delays import windowed_delays


def test_timetable_file(spark, tmp_path):
    doc = {"meta": {"id": "x"}, "stations": [["A", "Alpha", None, "Z", 20.5, "bad"]], "trains": [{"n": "7", "name": "SEVEN", "days": ["MON"], "stops": [["A", "Alpha", None, "10:00", 1, 0], [None, "Beta", "11:00", None, None, 12.0]], "valid": {"from": "06-10", "to": "10-31"}}]}
    p = tmp_path / "t.json.gz"
    p.write_bytes(gzip.compress(json.dumps(doc).encode()))
    t = readers.timetable_file(spark, str(p))
    s = t["stations"].first()
    assert (s["code"], s["lat"], s["lon"]) == ("A", 20.5, None)
    assert [(r["seq"], r["station_code"], r["arrival"], r["km"]) for r in t["stops"].orderBy("seq").collect()] == [(1, "A", None, 0), (2, None, "11:00", 12)]
    assert t["trains"].first()["valid_from"] == "06-10"
    readers.write_timetable(t["stations"], t["trains"], t["stops"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "stops")).count() == 2


def test_code_groups(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"groups": [{"codes": ["OLD", "NEW"], "current": "NEW"}, {"codes": ["old"], "current": "ELSE"}]}))
    g = readers.code_groups(spark, str(p))
    df = spark.createDataFrame([("old ",), ("new",), ("zz",), (None,)], "code string")
    assert [r[0] for r in readers.current_code(df, "code", g).collect()].count("NEW") == 2


def test_record_routes(spark):
    body = "x#^1~aa~Alpha~First~23.00~0~0~1~^2~BB~Beta~23.50~00.10~20~50~1~^3~CC~Gamma~00.05~Last~0~40~2~"
    r = readers.record_routes(spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, body string"), "k", "body").orderBy("seq").collect()
    assert [(x["station_code"], x["arr_abs"], x["dep_abs"], x["halt"], x["ok"]) for x in r] == [("AA", None, 1380, None, True), ("BB", 1430, 1450, 20, True), ("CC", 1445, None, None, True)]
    assert r[2]["warnings"] == ["time", "distance"]


def test_html(spark):
    row = lambda *c: "<tr>" + "".join(f"<td><b>{x}</b></td>" for x in c) + "</tr>"
    page = "<table>" + row(*readers.AVERAGE_HEADER) + row(1, "ALPHA", "aa", "", "On Time") + row(2, "BETA", "BB", "00:08", "-00:02") + "</table>"
    df = spark.createDataFrame([(1, page), (2, "<table>" + row("x") + "</table>"), (3, None)], "k int, html string")
    got = readers.average_delays(df, "k", "html").orderBy("idx").collect()
    assert [(r["station_code"], r["arrival_delay_minutes"], r["departure_delay_minutes"]) for r in got] == [("AA", None, 0), ("BB", 8, -2)]
    script = "s.tooltipData = [['Date',{'type':'number','label':'AA'},{'type':'number','label':'BB'}]\n,[new Date(2026,7,29),0,null]\n,[new Date(2026,8,01),-3,12]];"
    h = readers.run_history(spark.createDataFrame([(1, script), (2, "nothing")], "k int, html string"), "k", "html")
    assert sorted((str(r["run_date"]), r["station_code"], r["delay"]) for r in h.collect()) == [("2026-08-29", "AA", 0), ("2026-09-01", "AA", -3), ("2026-09-01", "BB", 12)]


def test_json_answers(spark):
    stop = lambda n, a, d, **k: {"sequence": n, "stationCode": "aa", "arrivalDelayMinutes": a, "departureDelayMinutes": d, **k}
    good = {"success": True, "data": {"trainNumber": "7", "route": [stop(1, 9, 1, scheduledDeparture="10:00"), stop(2, 3, 4, scheduledArrival="11:00")]}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, "{broken"), (3, json.dumps({"success": False})), (4, None)], "k int, body string")
    got = readers.delay_answers(df, "k", "body").orderBy("seq").collect()
    assert [(r["k"], r["ordered"], r["arrival_delay_minutes"], r["departure_delay_minutes"]) for r in got] == [(1, True, None, 1), (1, True, 3, None)]
    train = {"trainNumber": "7", "fromStnCode": "a", "toStnCode": "b", "departureTime": "23:00", "arrivalTime": "01:00", "duration": 120, "distance": 0, "runningDays": "1000000", "avlClasses": ["SL"]}
    df = spark.createDataFrame([(1, json.dumps({"data": {"errorCode": 0, "trainList": [train]}})), (2, json.dumps({"error": {"code": "x"}}))], "k int, body string")
    r = readers.search_answers(df, "k", "body").collect()
    assert [(x["arr_day"], x["duration"], x["departs_on"], x["km"]) for x in r] == [(2, 120, 1, None)]
    days = dict.fromkeys(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"], True)
    body = {"TrainNo": "7", "DaysOfRun": days, "Schedule": [{"StationCode": "a", "ArrivalTime": "23:50", "DepartureTime": "00:10", "Distance": "5.5", "Day": 1}]}
    part = {**body, "DaysOfRun": {"Mon": True}}
    r = readers.schedule_answers(spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(part))], "k int, body string"), "k", "body").orderBy("k").collect()
    assert [(x["mask"], x["arr_abs"], x["dep_abs"], x["km"]) for x in r] == [(127, 1430, 1450, 5.5), (None, 1430, 1450, 5.5)]


def test_clean_snapshot(spark):
    st = spark.createDataFrame([(1, "a", "None", None, None, 1.0, 2.0), (2, "A", "Second", None, None, None, None)], "n int, code string, name string, state string, zone string, lat double, lon double")
    sc = spark.createDataFrame([(2, "7", "b", "Beta", "11:00:00", "11:05:00", 1), (1, "7", "a", "Alpha", "09:00:00", "10:00:00", 1), (3, "8", "a", "Alpha", None, None, 1)], "id int, train_number string, station_code string, station_name string, arrival string, departure string, day int")
    s, stops = readers.clean_snapshot(st, sc)
    assert sorted((r["code"], r["name"]) for r in s.collect()) == [("A", "A"), ("B", "Beta")]
    assert [(r["seq"], r["arr"], r["dep"]) for r in stops.orderBy("seq").collect()] == [(1, None, 600), (2, 660, None)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_stream_equals_batch(spark, tmp_path, sf):
    import os

    if not os.path.exists(sf):
        pytest.skip("no test data")
    d = spark.read.parquet(f"{sf}/delays.parquet")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = windowed_delays(s, late="400 days").writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window_start"], r["station_code"]): r["n"] for r in spark.table("w").collect()}
    want = {(r["window_start"], r["station_code"]): r["n"] for r in windowed_delays(d).collect()}
    assert got == want
