"""Readers for timetable files, record texts, HTML pages and JSON answers.

Each takes a path or a DataFrame with a text column, so one call reads one file or millions
of archived answers; malformed parts become nulls with a flag instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopline.functions import clock, text

#: Fixed format: a timetable file of positional rows.
TIMETABLE = (
    "meta map<string,string>, stations array<array<string>>, trains array<struct<n:string,name:string,type:string,classes:array<string>,"
    "days:array<string>,dist:int,stops:array<array<string>>,warnings:array<string>,valid:struct<`from`:string,`to`:string>>>"
)


def timetable_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Stations, trains and stops of a JSON timetable (gzip by extension) of positional rows.

    Stations are code, name, state, zone, lat, lon; stops are code, name, arrival, departure,
    day, km. Numbers that do not parse become null.
    """
    raw = spark.read.schema(TIMETABLE).option("multiLine", True).json(path)
    s = raw.select(F.explode("stations").alias("s"))
    stations = s.select(
        *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(["code", "station_name", "state_name", "zone_code"])],
        text.to_number(F.get("s", F.lit(4))).alias("lat"), text.to_number(F.get("s", F.lit(5))).alias("lon"),
    )
    t = raw.select(F.posexplode("trains").alias("file_order", "t"))
    trains = t.select(
        F.col("t.n").alias("train_number"), F.col("t.name").alias("train_name"), F.col("t.type").alias("train_type"), "t.classes", "t.days",
        F.col("t.dist").alias("dist_km"), F.col("t.valid.from").alias("valid_from"), F.col("t.valid.to").alias("valid_to"), "t.warnings", "file_order",
    )
    p = t.select(F.col("t.n").alias("train_number"), "file_order", F.posexplode("t.stops").alias("seq", "p"))
    at = lambda i: F.get("p", F.lit(i))
    stops = p.select(
        "train_number", "file_order", (F.col("seq") + 1).alias("seq"), at(0).alias("station_code"), at(1).alias("station_name"),
        at(2).alias("arrival"), at(3).alias("departure"), at(4).try_cast("int").alias("arr_day"), at(5).try_cast("double").cast("int").alias("km"),
    )
    return {"stations": stations, "trains": trains, "stops": stops}


def write_timetable(stations: DataFrame, trains: DataFrame, stops: DataFrame, path: str) -> None:
    """Write tables as newline-separated JSON, gzip-compressed, one folder for each."""
    for name, df in (("stations", stations), ("trains", trains), ("stops", stops)):
        df.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def code_groups(spark: SparkSession, path: str) -> DataFrame:
    """``code, current`` of a JSON file of equivalent station codes; a code listed twice keeps its first group."""
    raw = spark.read.schema("groups array<struct<codes:array<string>,current:string,names:array<string>,evidence:array<string>>>").option("multiLine", True).json(path)
    g = raw.select(F.posexplode("groups").alias("n", "g")).select("n", F.explode("g.codes").alias("code"), F.col("g.current").alias("current"))
    return g.groupBy(F.upper("code").alias("code")).agg(F.min_by("current", "n").alias("current"))


def current_code(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """``df`` with a column of codes brought to current ones; unknown codes stay, in upper case."""
    g = groups.select(F.col("code").alias("__c"), F.col("current").alias("__now"))
    return df.join(g, F.upper(F.trim(column)) == F.col("__c"), "left").withColumn(column, F.coalesce("__now", F.upper(F.trim(column)))).drop("__c", "__now")


def records(df: DataFrame, key: str, body: str) -> DataFrame:
    """``key, n, fields`` of bodies made of ``^`` records with ``~`` fields; what precedes the first ``^`` is no record."""
    parts = F.slice(F.split(body, r"\^"), 2, 2**31 - 1)
    return df.select(key, F.posexplode(parts).alias("n", "rec")).select(key, "n", F.split("rec", "~").alias("fields"))


def record_routes(df: DataFrame, key: str, body: str) -> DataFrame:
    """Stops of route records (number, code, name, arrival, departure, halt, km, day), with warnings.

    Times are ``HH.MM``; ``First`` and ``Last`` mark the ends. A departure earlier than the
    arrival is on the next day. ``warnings`` lists markers in the wrong place, halts that do
    not fit the times, and times or distances that go back; ``ok`` is false for a record
    without code, day or needed time.
    """
    from pyspark.sql import Window

    r = records(df, key, body)
    f = lambda i: F.trim(F.get("fields", F.lit(i)))
    arr, dep = clock.dotted_minutes(f(3)), clock.dotted_minutes(f(4))
    w = Window.partitionBy(key).orderBy("seq")
    s = r.select(
        key, (F.col("n") + 1).alias("seq"), F.upper(f(1)).alias("station_code"), f(2).alias("station_name"), (f(3) == "First").alias("first"),
        (f(4) == "Last").alias("last"), arr.alias("arr"), dep.alias("dep"), f(5).try_cast("int").alias("stated"), f(6).try_cast("int").alias("km"), f(7).try_cast("int").alias("day"),
        F.max("n").over(Window.partitionBy(key)).alias("end"),
    )
    s = s.withColumn("arr_abs", clock.absolute(F.col("day"), F.when(~F.col("first"), F.col("arr"))))
    s = s.withColumn("dep_abs", F.when(~F.col("last"), clock.absolute(F.col("day"), F.col("dep")) + F.when(F.col("arr_abs").isNotNull() & (F.col("dep") < F.col("arr")), clock.DAY).otherwise(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("seen", F.max(F.greatest("arr_abs", "dep_abs")).over(before)).withColumn("far", F.max("km").over(before))
    s = s.withColumn("halt", F.when(F.col("arr_abs").isNotNull() & F.col("dep_abs").isNotNull(), clock.until_next(F.col("arr"), F.col("dep"))))
    notes = F.array(
        F.when(F.col("first") != (F.col("seq") == 1), "first marker"), F.when(F.col("last") != (F.col("seq") == F.col("end") + 1), "last marker"),
        F.when(F.col("stated") != F.col("halt"), "halt"), F.when(F.least("arr_abs", "dep_abs") < F.col("seen"), "time"), F.when(F.col("km") < F.col("far"), "distance"),
    )
    ok = (F.col("station_code") != "") & (F.col("day") >= 1) & (F.col("first") | F.col("arr").isNotNull()) & (F.col("last") | F.col("dep").isNotNull())
    return s.select(key, "seq", "station_code", "station_name", "arr_abs", "dep_abs", "halt", "km", F.filter(notes, lambda x: x.isNotNull()).alias("warnings"), F.coalesce(ok, F.lit(False)).alias("ok"))


def html_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, n, cells``: the text of every cell of every table row of a page."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    r = df.select(key, F.posexplode(rows).alias("n", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return r.select(key, "n", F.transform(cells, text.cell_text).alias("cells"))


#: The header of a page of average delays.
AVERAGE_HEADER = ["Sr.", "Station", "Code", "Avg. Arr. Delay", "Avg. Dep. Delay"]


def average_delays(df: DataFrame, key: str, html: str) -> DataFrame:
    """Average delays of pages with a table of exactly the known header; other pages give no row."""
    r = html_rows(df, key, html)
    heads = r.where(F.col("cells") == F.array(*[F.lit(h) for h in AVERAGE_HEADER])).groupBy(F.col(key).alias("__k")).agg(F.min("n").alias("head"))
    body = r.join(heads, (F.col(key) == F.col("__k")) & (F.col("n") > F.col("head")) & (F.size("cells") == 5) & F.get("cells", F.lit(0)).rlike(r"^\d+$"))
    c = lambda i: F.get("cells", F.lit(i))
    return body.select(
        key, c(0).cast("int").alias("idx"), c(1).alias("station_name"), F.upper(c(2)).alias("station_code"),
        clock.signed_delay(c(3)).alias("arrival_delay_minutes"), clock.signed_delay(c(4)).alias("departure_delay_minutes"),
    )


def run_history(df: DataFrame, key: str, html: str) -> DataFrame:
    """Delays of each run and station from a page's inline table of dated rows.

    The table is a script literal whose first row names the stations and whose other rows are
    ``[new Date(y, m, d), delay, ...]`` with months from 0. It is read with patterns, never
    evaluated. Result: ``key, run_date, idx, station_code, delay``; null delays are left out.
    """
    block = F.regexp_extract(html, r"(?s)tooltipData\s*=\s*(\[.*?\]\s*\]);", 1)
    codes = F.regexp_extract_all(block, F.lit(r"'label'\s*:\s*'([^']*)'"), F.lit(1))
    rows = F.regexp_extract_all(block, F.lit(r"\[\s*new Date\(([^)]*)\)((?:\s*,\s*(?:-?\d+(?:\.\d+)?|null))*)\s*\]"), F.lit(0))
    r = df.select(key, codes.alias("codes"), F.explode(rows).alias("row"))
    date = F.split(F.regexp_extract("row", r"Date\(([^)]*)\)", 1), ",")
    part = lambda i: F.trim(F.get(date, F.lit(i))).try_cast("int")
    tail = F.regexp_extract("row", r"\)\s*,?(.*)\]$", 1)
    out = r.select(key, "codes", F.make_date(part(0), part(1) + 1, part(2)).alias("run_date"), F.posexplode(F.split(tail, ",")).alias("idx", "v"))
    return out.select(key, "run_date", "idx", F.get("codes", F.col("idx")).alias("station_code"), F.trim("v").try_cast("double").cast("int").alias("delay")).where("delay is not null")


#: Fixed format: a delay answer.
DELAY_JSON = (
    "success boolean, data struct<trainNumber:string, route:array<struct<sequence:int,stationCode:string,stationName:string,arrivalDelayMinutes:int,"
    "departureDelayMinutes:int,scheduledArrival:string,scheduledDeparture:string>>>"
)


def delay_answers(df: DataFrame, key: str, body: str) -> DataFrame:
    """Stops with delays of JSON answers; a delay without its scheduled event is null.

    ``ordered`` tells whether the answer's sequence numbers strictly ascend; broken answers
    give no row.
    """
    a = df.select(key, F.from_json(body, DELAY_JSON).alias("a")).where("a.success and a.data.route is not null")
    seq = F.col("a.data.route.sequence")
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(seq) - 1, F.lit(1))), lambda i: (F.size(seq) < 2) | (F.get(seq, i) > F.get(seq, i - 1)))
    r = a.select(key, F.col("a.data.trainNumber").alias("train_number"), F.coalesce(ordered, F.lit(False)).alias("ordered"), F.explode("a.data.route").alias("r"))
    sa, sd = clock.parse_clock(F.col("r.scheduledArrival")), clock.parse_clock(F.col("r.scheduledDeparture"))
    return r.select(
        key, "train_number", "ordered", F.col("r.sequence").alias("seq"), F.upper("r.stationCode").alias("station_code"), sa.alias("arr"), sd.alias("dep"),
        F.when(sa.isNotNull(), F.col("r.arrivalDelayMinutes")).alias("arrival_delay_minutes"), F.when(sd.isNotNull(), F.col("r.departureDelayMinutes")).alias("departure_delay_minutes"),
    )


#: Fixed format: a train-search answer.
SEARCH_JSON = (
    "data struct<errorCode:int,errorMessage:string,trainList:array<struct<trainNumber:string,trainName:string,fromStnCode:string,toStnCode:string,"
    "departureTime:string,arrivalTime:string,duration:int,distance:double,runningDays:string,avlClasses:array<string>>>>, error struct<code:string,message:string>"
)


def search_answers(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rides of JSON train-search answers with arrival days and weekday masks; failed answers give no row."""
    a = df.select(key, F.from_json(body, SEARCH_JSON).alias("a")).where("a.data.trainList is not null and coalesce(a.data.errorCode, 0) = 0")
    r = a.select(key, F.explode("a.data.trainList").alias("t"))
    dep, arr = clock.parse_clock(F.col("t.departureTime")), clock.parse_clock(F.col("t.arrivalTime"))
    at = clock.leg_arrival(dep, arr, F.col("t.duration"))
    return r.select(
        key, F.col("t.trainNumber").alias("train_number"), F.upper("t.fromStnCode").alias("from_code"), F.upper("t.toStnCode").alias("to_code"),
        dep.alias("dep"), arr.alias("arr"), clock.day_of(at).alias("arr_day"), (at - dep).alias("duration"), clock.mask_of_binary(F.col("t.runningDays")).alias("departs_on"),
        F.when(F.col("t.distance") > 0, F.col("t.distance")).alias("km"), F.col("t.avlClasses").alias("classes"),
    )


#: Fixed format: a schedule answer.
SCHEDULE_JSON = (
    "TrainName string, TrainNo string, DaysOfRun map<string,boolean>, ErrorMsg string, Classes array<string>, "
    "Schedule array<struct<StationCode:string,StationName:string,ArrivalTime:string,DepartureTime:string,Distance:string,Day:int>>"
)


def schedule_answers(df: DataFrame, key: str, body: str) -> DataFrame:
    """Stops of JSON schedule answers with stated days; weekdays are null unless all seven are stated."""
    a = df.select(key, F.from_json(body, SCHEDULE_JSON).alias("a")).where("a.Schedule is not null")
    days = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    mask: Column = F.lit(0)
    for i, d in enumerate(days):
        mask = mask + F.when(F.col("a.DaysOfRun")[d], 1 << i).when(~F.col("a.DaysOfRun")[d], 0)
    r = a.select(key, F.col("a.TrainNo").alias("train_number"), mask.alias("mask"), F.posexplode("a.Schedule").alias("i", "s"))
    arr, dep = clock.parse_clock(F.col("s.ArrivalTime")), clock.parse_clock(F.col("s.DepartureTime"))
    arr_abs = clock.absolute(F.col("s.Day"), arr)
    base = clock.absolute(F.col("s.Day"), dep)
    return r.select(
        key, "train_number", "mask", (F.col("i") + 1).alias("seq"), F.upper("s.StationCode").alias("station_code"), arr_abs.alias("arr_abs"),
        (base + F.when(dep < arr, clock.DAY).otherwise(0)).alias("dep_abs"), text.to_number(F.col("s.Distance")).alias("km"),
    )


def clean_snapshot(stations: DataFrame, schedules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations and stops of raw snapshot rows: texts cleaned, first row of a code kept, terminal times dropped.

    ``stations``: ``n, code, name, state, zone, lat, lon``; ``schedules``: ``id, train_number,
    station_code, station_name, arrival, departure, day``. Trains of fewer than two rows are
    dropped; stations met only in schedules are added without a position.
    """
    from pyspark.sql import Window

    def clean(c: str) -> Column:
        t = F.trim(c)
        return F.when((t != "") & (F.lower(t) != "none"), t)

    s = stations.withColumn("code", F.upper(clean("code"))).where("code is not null")
    s = s.groupBy("code").agg(F.min_by(F.struct(F.coalesce(clean("name"), "code").alias("name"), clean("state").alias("state"), clean("zone").alias("zone"), "lat", "lon"), "n").alias("r")).select("code", "r.*")
    r = schedules.select("id", clean("train_number").alias("train_number"), F.upper(clean("station_code")).alias("station_code"), clean("station_name").alias("station_name"), clock.parse_clock(F.col("arrival")).alias("arr"), clock.parse_clock(F.col("departure")).alias("dep"), "day").where("train_number is not null and station_code is not null")
    w = Window.partitionBy("train_number")
    stops = r.withColumn("seq", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 2").select(
        "train_number", "seq", "station_code", F.coalesce("station_name", "station_code").alias("station_name"),
        F.when(F.col("seq") > 1, F.col("arr")).alias("arr"), F.when(F.col("seq") < F.col("n"), F.col("dep")).alias("dep"), F.col("day").alias("arr_day"),
    )
    lost = stops.join(s, stops["station_code"] == s["code"], "left_anti").groupBy(F.col("station_code").alias("code")).agg(F.min_by("station_name", F.struct("train_number", "seq")).alias("name"))
    none = F.lit(None)
    return s.unionByName(lost.select("code", "name", none.cast("string").alias("state"), none.cast("string").alias("zone"), none.cast("double").alias("lat"), none.cast("double").alias("lon"))), stops
