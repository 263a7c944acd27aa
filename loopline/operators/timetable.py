"""From timetable rows to schedules, legs, boards and route checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopline.functions import clock, text
from loopline.session import stage

ROW = "struct<seq:int,code:string,name:string,arr:int,dep:int,day:int,km:int>"
PLACED = "struct<seq:int,code:string,name:string,arr:int,dep:int,km:int,late:int>"


def distinct_stops(stops: DataFrame) -> DataFrame:
    """Rows of ``stops`` without whole repetitions, clocks as minutes."""
    return stops.select(
        "train_number", "seq", "station_code", "station_name",
        clock.parse_clock(F.col("arrival")).alias("arr"), clock.parse_clock(F.col("departure")).alias("dep"), "arr_day", "km",
    ).distinct()


def _place(minutes: Column, day: Column, prev: Column) -> tuple[Column, Column]:
    """(absolute minutes, whether a stated day was out of order) of the next clock after ``prev``."""
    base = F.floor(F.greatest(prev, F.lit(0)) / clock.DAY).cast("int") * clock.DAY + minutes
    inferred = F.when(base < prev, base + clock.DAY).otherwise(base)
    stated = (day - 1) * clock.DAY + minutes
    given = F.coalesce(day >= 1, F.lit(False))
    at = F.when(given & (stated >= prev), stated).otherwise(inferred)
    late = F.coalesce((given & (stated < prev)).cast("int"), F.lit(0))
    return at.cast("int"), late


def place_stops(stops: DataFrame) -> DataFrame:
    """Journey days of every stop, by a fold along each train.

    A stated day counts if it does not go back in time; otherwise, and for departures, the
    clock decides: an earlier clock than the last one is the next day. Rows without a code
    advance the clock and are then dropped. The origin's arrival and the terminus' departure
    become null, as does a departure more than 12 hours after its arrival.

    Input as from :func:`distinct_stops`. Result: ``train_number, pos`` (from 1, among coded
    rows), ``seq, station_code, station_name, arr_abs, dep_abs, km, halts, halt, late, dropped``.
    A route is a bounded group (one train's stops), so it is folded as one array.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", F.col("station_code").alias("code"), F.col("station_name").alias("name"), "arr", "dep", F.col("arr_day").alias("day"), "km").cast(ROW)))
    start = F.struct(F.lit(-1).alias("prev"), F.array().cast(f"array<{PLACED}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        coded = r["code"].isNotNull()
        arr, late = _place(r["arr"], F.when(coded, r["day"]), acc["prev"])
        mid = F.coalesce(arr, acc["prev"])
        dep, _ = _place(r["dep"], F.lit(None).cast("int"), mid)
        placed = F.struct(r["seq"].alias("seq"), r["code"].alias("code"), r["name"].alias("name"), arr.alias("arr"), dep.alias("dep"), r["km"].alias("km"), late.alias("late"))
        return F.struct(F.coalesce(dep, mid).alias("prev"), F.concat(acc["out"], F.array(placed)).alias("out"))

    folded = stops.groupBy("train_number").agg(F.aggregate(rows, start, step)["out"].alias("out"))
    kept = folded.select(
        "train_number",
        F.filter("out", lambda x: x["code"].isNotNull()).alias("kept"),
        F.size(F.filter("out", lambda x: x["code"].isNull())).alias("dropped"),
    )
    last = F.size("kept")
    one = kept.select("train_number", "dropped", last.alias("n"), F.posexplode("kept").alias("i", "s"))
    arr = F.when(F.col("i") > 0, F.col("s.arr"))
    sane = F.when((F.col("s.dep") - F.col("s.arr") > 720), None).otherwise(F.col("s.dep"))
    dep = F.when(F.col("i") < F.col("n") - 1, sane)
    return one.select(
        "train_number", (F.col("i") + 1).alias("pos"), F.col("s.seq").alias("seq"), F.col("s.code").alias("station_code"), F.col("s.name").alias("station_name"),
        arr.alias("arr_abs"), dep.alias("dep_abs"), F.col("s.km").alias("km"),
        (F.col("s.arr").isNotNull() | sane.isNotNull()).alias("halts"),
        F.when((F.col("i") > 0) & (F.col("i") < F.col("n") - 1), sane - F.col("s.arr")).alias("halt"),
        F.col("s.late").alias("late"), "dropped",
    )


def rollover_days(events: DataFrame, key: str, order: str, minutes: str) -> DataFrame:
    """Adds ``day`` (from 1): one more whenever the clock falls below that of the row before."""
    w = Window.partitionBy(key).orderBy(order)
    fell = (F.col(minutes) < F.lag(minutes).over(w)).cast("int")
    return events.withColumn("day", (1 + F.sum(F.coalesce(fell, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))


def legs(placed: DataFrame, trains: DataFrame) -> DataFrame:
    """Every ride between two halting stops of a train, the first later visit of each station only.

    The first later visit stands even if it gives no valid ride, which then gives none. Days
    are relative to boarding, weekdays are shifted to the boarding station's date; unknown
    days and classes stay null. A ride needs a departure, an arrival and a positive duration.
    """
    a = placed.where("halts").select("train_number", F.col("pos").alias("i"), F.col("station_code").alias("from_code"), F.col("dep_abs"), F.col("km").alias("km_a"))
    b = placed.where("halts").select("train_number", F.col("pos").alias("j"), F.col("station_code").alias("to_code"), F.col("arr_abs"), F.col("km").alias("km_b"))
    # the boarding station goes with (train, i); as a key of the window it lets a filter on it through
    first = Window.partitionBy("train_number", "i", "from_code", "to_code").orderBy("j")
    pairs = a.join(b, "train_number").where("j > i").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    t = trains.select("train_number", clock.days_mask(F.col("days")).alias("mask"), "classes").dropDuplicates(["train_number"])
    shift = F.floor(F.col("dep_abs") / clock.DAY)
    km = F.col("km_b") - F.col("km_a")
    return (
        pairs.where("dep_abs is not null and arr_abs > dep_abs").join(t, "train_number", "left")
        .select(
            "train_number", "from_code", "to_code", "i", "j",
            F.pmod("dep_abs", F.lit(clock.DAY)).cast("int").alias("dep"), F.pmod("arr_abs", F.lit(clock.DAY)).cast("int").alias("arr"),
            (F.floor(F.col("arr_abs") / clock.DAY) - shift + 1).cast("int").alias("arr_day"),
            (F.col("arr_abs") - F.col("dep_abs")).cast("int").alias("duration"),
            clock.crosses_midnight(F.col("dep_abs"), F.col("arr_abs")).alias("overnight"),
            clock.shift_mask(F.col("mask"), shift).alias("departs_on"),
            F.when(km > 0, km).alias("km"), "classes",
        )
    )


def visits(placed: DataFrame) -> DataFrame:
    """Number of each halting visit of a train to a station, from 0."""
    w = Window.partitionBy("train_number", "station_code").orderBy("pos")
    return placed.where("halts").select("train_number", "station_code", "pos", (F.row_number().over(w) - 1).alias("visit"))


def board(placed: DataFrame, trains: DataFrame, station: str, weekday: int | None = None, start: int | None = None, end: int | None = None, towards: list[str] | None = None, coming_from: list[str] | None = None) -> DataFrame:
    """Calls at a station: those whose weekday may fit, in a clock window, serving other stations later or earlier."""
    calls = placed.where((F.col("station_code") == station) & F.col("halts"))
    for codes, later in ((towards, True), (coming_from, False)):
        if codes:
            o = placed.where(F.col("halts") & F.col("station_code").isin(codes)).select(F.col("train_number").alias("t"), F.col("pos").alias("p"))
            calls = calls.join(o, (F.col("train_number") == F.col("t")) & ((F.col("p") > F.col("pos")) if later else (F.col("p") < F.col("pos"))), "left_semi")
    at = F.coalesce("dep_abs", "arr_abs")
    t = trains.select("train_number", clock.days_mask(F.col("days")).alias("mask")).dropDuplicates(["train_number"])
    out = calls.join(t, "train_number", "left").select(
        "train_number", "pos", F.pmod(at, F.lit(clock.DAY)).cast("int").alias("clock"), clock.shift_mask(F.col("mask"), F.floor(at / clock.DAY)).alias("calls_on")
    )
    if start is not None or end is not None:
        out = out.where(clock.in_clock_window(F.col("clock"), F.lit(start).cast("int"), F.lit(end).cast("int")))
    return out if weekday is None else out.where(clock.runs_on(F.col("calls_on"), F.lit(weekday)))


def gap_check(placed: DataFrame, longest: int = 720) -> DataFrame:
    """Events of a route that step back in time or follow a gap of more than ``longest`` minutes."""
    events = placed.select("train_number", F.posexplode(F.array("arr_abs", "dep_abs")).alias("k", "at"), "pos").where("at is not null")
    w = Window.partitionBy("train_number").orderBy("pos", "k")
    gap = F.col("at") - F.lag("at").over(w)
    return events.withColumn("gap", gap).where((F.col("gap") < 0) | (F.col("gap") > longest)).select("train_number", "pos", "k", "gap")


def pieces(rows: DataFrame, key: str, order: str, at: str, longest: int = 720) -> DataFrame:
    """Adds ``piece``: a new one wherever the next clock lies more than ``longest`` minutes ahead."""
    w = Window.partitionBy(key).orderBy(order)
    cut = F.pmod(F.col(at) - F.lag(at).over(w), F.lit(clock.DAY)) > longest
    return rows.withColumn("piece", F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def coded_neighbours(stops: DataFrame) -> DataFrame:
    """Nearest coded stop before and after each uncoded one."""
    w = Window.partitionBy("train_number").orderBy("seq")
    before = F.last("station_code", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("station_code", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return stops.withColumn("before", before).withColumn("after", after).where("station_code is null").select("train_number", "seq", "station_name", "before", "after")


def valid_variant(variants: DataFrame, month_day: str, order: list[str]) -> DataFrame:
    """The first variant of each train that is valid on a day; a train without one is absent."""
    ok = variants.where(clock.in_yearly_window(F.lit(month_day), F.col("valid_from"), F.col("valid_to")))
    w = Window.partitionBy("train_number").orderBy(*order)
    return ok.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def searchable(variants: DataFrame, stops: DataFrame, month_day: str | None, order: list[str]) -> DataFrame:
    """One row a train, the variant valid on a day or else the first, with ``search_name``: its name and its terminals' names, normalised.

    ``stops`` has ``train_number, seq, station_name``. Trains without stops are searched by their name alone.
    """
    invalid = F.lit(0) if month_day is None else (~F.coalesce(clock.in_yearly_window(F.lit(month_day), F.col("valid_from"), F.col("valid_to")), F.lit(False))).cast("int")
    w = Window.partitionBy("train_number").orderBy(invalid, *order)
    t = variants.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    ends = stops.groupBy("train_number").agg(F.min_by("station_name", "seq").alias("__from"), F.max_by("station_name", "seq").alias("__to"))
    return t.join(ends, "train_number", "left").withColumn("search_name", text.normalise_name(F.concat_ws(" ", "train_name", "__from", "__to"))).drop("__from", "__to")


def connections(rides: DataFrame, origin: str, target: str, legs_max: int = 2, weekday: int | None = None, shortest: int = 45, longest: int = 360, via: list[str] | None = None, k: int = 12, k3: int = 3, hub: int = 10, calls: DataFrame | None = None, placed: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """Journeys of two or three trains between two stations, fastest first.

    Exact evaluation over bounded frontiers: the ``k`` shortest rides from the origin to each
    station and from each station to the target, one per train, where a first ride known not
    to run on ``weekday`` takes no place; a middle train of three needs change stations of at
    least ``hub`` calls (unless ``via`` names the allowed ones) and tries ``k3`` rides on
    either side. Layovers lie within bounds, trains differ, weekdays are compatible or
    unknown, and a change that an earlier boarding or a later alighting makes pointless is
    dropped. The best journey of each train sequence counts. Ties go by train numbers.
    The frontiers start from two stations and are top-k per station, so they are small
    whatever the network's size; the middle rides are joined to them on their stations.
    """
    ride = rides.select("train_number", "from_code", "to_code", "dep", "arr", "arr_day", "duration", "departs_on")
    one = Window.partitionBy("train_number", "at").orderBy("duration", "dep", "departs_on")
    best = Window.partitionBy("at").orderBy("duration", "train_number")

    def frontier(df: DataFrame, at: str) -> DataFrame:
        df = df.withColumn("at", F.col(at)).withColumn("__n", F.row_number().over(one)).where("__n = 1")
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("__n", "at")

    first = ride.where((F.col("from_code") == origin) & (F.col("to_code") != target))
    if weekday is not None:
        first = first.where(clock.runs_on(F.col("departs_on"), F.lit(weekday)))
    last = frontier(ride.where((F.col("to_code") == target) & (F.col("from_code") != origin)), "from_code")
    first, last = stage(frontier(first, "to_code"), "first-rides"), stage(last, "last-rides")

    def named(df: DataFrame, n: int) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}{n}") for c in df.columns])

    def chained(df: DataFrame, n: int) -> DataFrame:
        """Adds layover and day shift of leg n after leg n - 1, keeping what is possible."""
        p = n - 1
        lay = F.pmod(F.col(f"dep{n}") - F.col(f"arr{p}"), F.lit(clock.DAY)).cast("int")
        before = F.col(f"shift{p}") if p > 1 else F.lit(0)
        differ = F.lit(True)
        for q in range(1, n):
            differ = differ & (F.col(f"train_number{n}") != F.col(f"train_number{q}"))
        return df.withColumn(f"layover{n}", lay).where(F.col(f"layover{n}").between(shortest, longest) & differ).withColumn(
            f"shift{n}", (before + F.col(f"arr_day{p}") - 1 + (F.col(f"arr{p}") + F.col(f"layover{n}") >= clock.DAY).cast("int")).cast("int")
        )

    def finished(df: DataFrame, n: int) -> DataFrame:
        works = F.lit(127)
        for q in range(1, n + 1):
            works = works.bitwiseAND(clock.shift_mask(F.col(f"departs_on{q}"), -F.col(f"shift{q}") if q > 1 else F.lit(0)))
        total = sum((F.col(f"layover{q}") + F.col(f"duration{q}") for q in range(2, n + 1)), F.col("duration1"))
        df = df.withColumn("works_on", works).withColumn("total", total.cast("int")).where(F.col("works_on").isNull() | (F.col("works_on") > 0))
        if weekday is not None:
            df = df.where(clock.runs_on(F.col("works_on"), F.lit(weekday)))
        if placed is not None:
            df = not_dominated(df, placed, n)
        return df.select(
            F.array(*[F.col(f"train_number{q}") for q in range(1, n + 1)]).alias("trains"),
            F.array(*[F.col(f"to_code{q}") for q in range(1, n)]).alias("changes"),
            "total", "works_on", F.lit(n).alias("n_legs"),
        )

    a = named(first, 1)
    two = a.join(named(last, 2), F.col("to_code1") == F.col("from_code2"))
    if via:
        two = two.where(F.col("to_code1").isin(via))
    found = finished(chained(two, 2), 2)
    if legs_max == 3:
        mid = ride
        if via:
            mid = mid.where(F.col("from_code").isin(via) & F.col("to_code").isin(via))
        elif calls is not None:
            hubs = calls.groupBy("station_code").count().where(F.col("count") >= hub).select(F.col("station_code").alias("from_code"))
            mid = mid.join(hubs, "from_code", "left_semi")
        three = (
            a.where(F.col("rank1") <= k3).join(named(mid.where(F.col("to_code") != origin), 2), F.col("to_code1") == F.col("from_code2"))
        )
        three = chained(three, 2).join(named(last.where(F.col("rank") <= k3), 3), F.col("to_code2") == F.col("from_code3"))
        found = found.unionByName(finished(chained(three, 3), 3))
    w = Window.partitionBy("trains").orderBy("total", "changes")
    found = found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return found.orderBy("total", "n_legs", "trains").limit(limit)


def not_dominated(df: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """Journeys no leg of which could have been boarded earlier or left later, by two anti-joins a pair of legs.

    The journeys come from bounded frontiers, so they are few: they are written once, and only
    the calls of their trains take part, which one scan of ``placed`` picks out.
    """
    df = stage(df, "journeys")
    own = df.select(F.explode(F.array(*[f"train_number{q}" for q in range(1, n + 1)])).alias("train_number")).distinct()
    placed = stage(placed.select("train_number", "station_code", "pos", "arr_abs", "dep_abs").join(own, "train_number", "left_semi"), "their-calls")
    calls = placed.groupBy("train_number", "station_code").agg(F.min("pos").alias("pos"))
    dep = placed.join(calls, ["train_number", "station_code", "pos"]).select(F.col("train_number").alias("t"), F.col("station_code").alias("c"), F.col("pos").alias("p"), "dep_abs")
    late = placed.where("arr_abs is not null").select(F.col("train_number").alias("t"), F.col("station_code").alias("c"), F.col("pos").alias("p"))
    pos = calls.select(F.col("train_number").alias("t"), F.col("station_code").alias("c"), F.col("pos").alias("p"))
    for q in range(1, n + 1):
        at = pos.select("t", "c", F.col("p").alias(f"board{q}"))
        df = df.join(at, (F.col(f"train_number{q}") == F.col("t")) & (F.col(f"from_code{q}") == F.col("c"))).drop("t", "c")
        to = placed.select(F.col("train_number").alias("t"), F.col("station_code").alias("c"), F.col("pos").alias("p"))
        key = [c for c in df.columns]
        df = df.join(to, (F.col(f"train_number{q}") == F.col("t")) & (F.col(f"to_code{q}") == F.col("c")) & (F.col("p") > F.col(f"board{q}")), "left").groupBy(*key).agg(F.min("p").alias(f"alight{q}"))
    for q in range(1, n + 1):
        for r in range(1, q):
            df = df.join(dep.where("dep_abs is not null"), (F.col(f"train_number{q}") == F.col("t")) & (F.col(f"from_code{r}") == F.col("c")) & (F.col("p") < F.col(f"board{q}")), "left_anti")
        for r in range(q + 1, n + 1):
            df = df.join(late, (F.col(f"train_number{q}") == F.col("t")) & (F.col(f"to_code{r}") == F.col("c")) & (F.col("p") > F.col(f"alight{q}")), "left_anti")
    return df
