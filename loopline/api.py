"""The questions a timetable user asks, over one set of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopline.functions import clock, text
from loopline.operators import punctuality
from loopline.operators import timetable as tt
from loopline.operators.nearby import haversine_km
from loopline.sources.chain import Source, SourceError, capabilities

PERIODS = {"1w": 7, "1m": 30, "3m": 91, "6m": 182, "1y": 365}


class Timetable:
    """Queries over ``stations, trains, stops, delays`` with the columns of the test tables.

    Methods return DataFrames and are lazy except where they check that a code or number is
    known: an unknown one raises NOT_FOUND, a known one without trains gives no rows.
    ``today`` is always a parameter, so results never depend on the clock.
    """

    def __init__(self, stations: DataFrame, trains: DataFrame, stops: DataFrame, delays: DataFrame | None = None, groups: DataFrame | None = None) -> None:
        self.stations, self.trains, self.delays, self.groups = stations, trains, delays, groups
        self.stops = tt.distinct_stops(stops)
        self.placed = tt.place_stops(self.stops)

    def _code(self, code: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9]{1,10}", code.strip()):
            raise SourceError("INVALID_INPUT", f"{code!r} is no station code")
        c = code.strip().upper()
        if self.groups is not None:
            now = self.groups.where(F.array_contains("codes", c)).select("current_code").first()
            c = now[0] if now and now[0] else c
        if not self.stations.where(F.col("code") == c).limit(1).count() and not self.stops.where(F.col("station_code") == c).limit(1).count():
            raise SourceError("NOT_FOUND", f"no station {c}; similar: {[r['code'] for r in self.search_stations(c, 5).collect()]}")
        return c

    def _on(self, date: str | None) -> tuple[DataFrame, int | None]:
        """Trains valid on a date, and its weekday."""
        if date is None:
            return self.trains, None
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
            raise SourceError("INVALID_INPUT", f"{date!r} is no date")
        import datetime

        try:
            day = datetime.date.fromisoformat(date)
        except ValueError as e:
            raise SourceError("INVALID_INPUT", f"{date!r} is no date") from e
        return tt.valid_variant(self.trains, date[5:], ["valid_from"]), day.weekday()

    def search_stations(self, query: str, limit: int = 10) -> DataFrame:
        """Stations by code or name, best match first, then by calls; one row for each code."""
        score = text.name_score(F.col("code"), text.normalise_name(F.col("station_name")), query)
        best = self.stations.withColumn("score", score).where("score > 0").groupBy("code").agg(F.max_by("station_name", "score").alias("station_name"), F.max("score").alias("score"))
        calls = self.placed.where("halts").groupBy(F.col("station_code").alias("code")).agg(F.count(F.lit(1)).alias("calls"))
        return best.join(calls, "code", "left").withColumn("calls", F.coalesce("calls", F.lit(0))).orderBy(F.desc("score"), F.desc("calls"), "code").limit(limit)

    def find_nearby_stations(self, lat: float, lon: float, radius_km: float = 50, min_calls: int = 0, limit: int = 10) -> DataFrame:
        """Stations around a point, nearest first on the rounded distance."""
        if not (6 <= lat <= 37.5 and 68 <= lon <= 97.5 and 1 <= radius_km <= 300):
            raise SourceError("INVALID_INPUT", "point or radius out of range")
        box = self.stations.where(F.col("lat").between(lat - radius_km / 110, lat + radius_km / 110))
        near = box.withColumn("d", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("d") <= radius_km)
        calls = self.placed.where("halts").groupBy(F.col("station_code").alias("code")).agg(F.count(F.lit(1)).alias("calls"))
        out = near.join(calls, "code", "left").select("code", "station_name", clock.round1(F.col("d")).alias("km"), F.coalesce("calls", F.lit(0)).alias("calls"))
        return out.where(F.col("calls") >= min_calls).orderBy("km", "code").limit(limit)

    def search_trains(self, query: str, limit: int = 10, today: str | None = None) -> DataFrame:
        """Trains by the start of their number or by words of their or their terminals' names; the variant valid today, or the first."""
        q = query.strip()
        t = tt.searchable(self.trains, self.stops, today[5:] if today else None, ["valid_from"])
        if re.fullmatch(r"\d+", q):
            hit = t.where(F.col("train_number").startswith(q))
        else:
            cond = F.lit(bool(q))
            for w in re.sub(r"[().,'’\-/]", " ", q.lower()).split():
                cond = cond & F.col("search_name").contains(text.ABBREVIATIONS.get(w, w))
            hit = t.where(cond)
        return hit.select("train_number", "train_name", "train_type", "classes", "days").orderBy("train_number").limit(limit)

    def get_train_schedule(self, train_number: str, date: str | None = None) -> DataFrame:
        """Stops of a train with journey days."""
        trains, _ = self._on(date)
        if not self.trains.where(F.col("train_number") == train_number).limit(1).count():
            raise SourceError("NOT_FOUND", f"no train {train_number}")
        if not trains.where(F.col("train_number") == train_number).limit(1).count():
            raise SourceError("NOT_FOUND", f"train {train_number} has no timings valid on {date}")
        p = self.placed.where(F.col("train_number") == train_number)
        return p.select(
            "pos", "station_code", "station_name", clock.format_clock(F.col("arr_abs")).alias("arrival"), clock.day_of(F.col("arr_abs")).alias("arrival_day"),
            clock.format_clock(F.col("dep_abs")).alias("departure"), clock.day_of(F.col("dep_abs")).alias("departure_day"), "halt", "km", "halts",
        ).orderBy("pos")

    def find_trains_between(
        self, origin: str, target: str, date: str | None = None, depart_after: int | None = None, depart_before: int | None = None, arrive_before: int | None = None,
        max_duration: int | None = None, overnight_only: bool = False, travel_class: str | None = None, sort: str = "departure", limit: int = 25,
    ) -> DataFrame:
        """Direct rides; unknown weekdays and classes pass the filters."""
        a, b = self._code(origin), self._code(target)
        trains, weekday = self._on(date)
        both = self.placed.where(F.col("station_code").isin(a, b)).select("train_number").distinct()
        rides = tt.legs(self.placed.join(both, "train_number", "left_semi"), trains.select("train_number", "days", "classes"))
        r = rides.join(trains.select("train_number").distinct(), "train_number", "left_semi").where((F.col("from_code") == a) & (F.col("to_code") == b))
        if weekday is not None:
            r = r.where(clock.runs_on(F.col("departs_on"), F.lit(weekday)))
        if depart_after is not None or depart_before is not None:
            r = r.where(clock.in_clock_window(F.col("dep"), F.lit(depart_after).cast("int"), F.lit(depart_before).cast("int")))
        if arrive_before is not None:
            r = r.where(F.col("arr") <= arrive_before)
        if max_duration is not None:
            r = r.where(F.col("duration") <= max_duration)
        if overnight_only:
            r = r.where("overnight")
        if travel_class:
            r = r.where(F.col("classes").isNull() | F.array_contains("classes", travel_class))
        order = {"departure": F.col("dep"), "duration": F.col("duration"), "arrival": F.col("dep") + F.col("duration")}[sort]
        return r.withColumn("total", F.expr("count(*) over ()")).orderBy(order, "train_number").limit(limit)

    def get_station_trains(self, station: str, date: str | None = None, start: int | None = None, end: int | None = None, towards: list[str] | None = None, coming_from: list[str] | None = None, limit: int = 40) -> DataFrame:
        """Board of a station in order of the clock."""
        trains, weekday = self._on(date)
        b = tt.board(self.placed, trains, self._code(station), weekday, start, end, towards, coming_from)
        return b.join(trains.select("train_number").distinct(), "train_number", "left_semi").orderBy("clock", "train_number", "pos").limit(limit)

    def find_connections(self, origin: str, target: str, max_trains: int = 2, date: str | None = None, shortest: int = 45, longest: int = 360, via: list[str] | None = None, hub: int = 10, limit: int = 8) -> DataFrame:
        """Journeys with one or two changes; see :func:`loopline.operators.timetable.connections`."""
        if max_trains not in (2, 3) or not 10 <= shortest <= 600 or not 30 <= longest <= 1440 or shortest > longest:
            raise SourceError("INVALID_INPUT", "trains or layover out of range")
        trains, weekday = self._on(date)
        placed = self.placed.join(trains.select("train_number").distinct(), "train_number", "left_semi")
        return tt.connections(tt.legs(placed, trains), self._code(origin), self._code(target), max_trains, weekday, shortest, longest, via, hub=hub, calls=placed.where("halts"), placed=placed, limit=limit)

    def get_punctuality(self, train_number: str, today: str, period: str = "1m", station: str | None = None) -> DataFrame:
        """Delay statistics of a train at its stations over a period that ends today."""
        if period not in PERIODS:
            raise SourceError("INVALID_INPUT", f"period is one of {sorted(PERIODS)}")
        if self.delays is None:
            raise SourceError("UNSUPPORTED", "no delays")
        day = F.lit(today).cast("date")
        keys = ["train_number", "station_code"]
        d = self.delays.where((F.col("train_number") == train_number) & (F.col("run_date") > F.date_sub(day, PERIODS[period])) & (F.col("run_date") <= day))
        if not d.limit(1).count():
            raise SourceError("NOT_FOUND", f"no runs of {train_number} in {period}; a longer period may have some")
        s = punctuality.run_stats(punctuality.latest_readings(d, keys), keys)
        return s if station is None else s.where(F.col("station_code") == self._code(station))

    def get_data_sources(self, sources: list[Source]) -> list[dict]:
        """What the given sources can answer."""
        return capabilities(sources)
