"""Queries over the timetable operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopline.functions import clock, text
from loopline.operators import timetable as tt
from loopline.operators.nearby import haversine_km
from loopline.session import stage, table

MONTH_DAY = "03-15"


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return tt.distinct_stops(table(spark, d, "stops"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return tt.place_stops(_stops(spark, d))


def _ends(placed: DataFrame) -> tuple[str, str]:
    """The two stations with the most calls, as origin and target of journey queries."""
    top = placed.where("halts").groupBy("station_code").count().orderBy(F.desc("count"), "station_code").limit(2).collect()
    return top[0][0], top[1][0]


def t01_clock_parse(spark, d):
    s = table(spark, d, "stops_mirror")
    return s.select("train_number", "seq", clock.parse_clock(F.col("departure")).alias("minutes"), clock.format_clock(clock.parse_clock(F.col("departure")) - 35).alias("earlier"))


def t06_day_rollover(spark, d):
    events = _stops(spark, d).withColumn("at", F.coalesce("dep", "arr")).where("at is not null")
    return tt.rollover_days(events, "train_number", "seq", "at").select("train_number", "seq", "at", "day")


def t06_placed_schedule(spark, d):
    return _placed(spark, d).select("train_number", "pos", "seq", "station_code", "arr_abs", "dep_abs", "halts", "halt", "late", "dropped")


def t07_weekday_shift(spark, d):
    m = clock.days_mask(F.col("days"))
    by = F.pmod(F.coalesce("dist_km", F.lit(0)), F.lit(11)) - 5
    return table(spark, d, "trains").select("train_number", m.alias("mask"), clock.shift_mask(m, by).alias("shifted"), F.array_join(clock.mask_days(m), " ").alias("names"))


def t12_yearly_window(spark, d):
    a, b = F.col("valid_from"), F.col("valid_to")
    x, y = clock.window_complement(a, b)
    return table(spark, d, "trains").select(
        "train_number", clock.in_yearly_window(F.lit(MONTH_DAY), a, b).alias("valid"), x.alias("other_from"), y.alias("other_to"),
        F.when(a.isNotNull() & b.isNotNull(), F.size(clock.window_days(a, b))).alias("n_days"),
    )


def t14_clock_window(spark, d):
    return _stops(spark, d).where(clock.in_clock_window(F.col("dep"), F.lit(1350), F.lit(245))).select("train_number", "seq", "dep")


def t15_leg_times(spark, d):
    s = table(spark, d, "search_trains")
    dep, arr = clock.parse_clock(F.col("departure_time")), clock.parse_clock(F.col("arrival_time"))
    return s.select("search_id", clock.leg_arrival(dep, arr, F.col("duration_minutes")).alias("arrives"), clock.until_next(dep, arr).alias("ride"))


def j01_normalise_name(spark, d):
    return table(spark, d, "ct_stations").select("ct_id", text.normalise_name(F.col("station_name")).alias("name"))


def j02_station_rank(spark, d):
    s = table(spark, d, "stations")
    calls = _placed(spark, d).where("halts").groupBy("station_code").agg(F.count(F.lit(1)).alias("calls"))
    score = text.name_score(F.col("code"), text.normalise_name(F.col("station_name")), "Kul Junction")
    best = s.select("code", score.alias("score")).groupBy("code").agg(F.max("score").alias("score")).where("score > 0")
    return best.join(calls, best["code"] == calls["station_code"], "left").select("code", "score", F.coalesce("calls", F.lit(0)).alias("calls")).orderBy(F.desc("score"), F.desc("calls"), "code").limit(10)


STATUS = ["AVAILABLE-0042", "GNWL12/WL7", "RAC 5/RAC 2", "REGRET/WL99", "GNWL3/AVAILABLE-0001", "NOT AVAILABLE", "??", "TRAIN DEPARTED", "AVL 7", "AVBL 7", "GNWL3/RAC4", "XRAC 4", "CHART CLOSED/AVL 2"]


def j05_status_category(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.col("search_id") % len(STATUS) + 1).cast("int"))
    return table(spark, d, "search_trains").select("search_id", text.status_category(raw).alias("category"))


def j10_parse_classes(spark, d):
    return table(spark, d, "segments").select("segment_id", F.array_join(text.parse_classes(F.col("classes_raw")), " ").alias("classes"))


def j11_parse_days(spark, d):
    return table(spark, d, "segments").select("segment_id", text.parse_days(F.col("days_raw")).alias("mask"))


def j12_train_kind(spark, d):
    return table(spark, d, "trains").groupBy(text.train_kind(F.col("train_name")).alias("kind"), "train_type").agg(F.count(F.lit(1)).alias("n"))


def j14_nearby_haversine(spark, d):
    """Stations within 300 km of a point with their calls, nearest first on the rounded distance."""
    s = table(spark, d, "stations").where("lat between 6 and 37.5 and lon between 68 and 97.5")
    dlat = 300 / 111.0
    box = s.where(F.col("lat").between(22.0 - dlat, 22.0 + dlat))
    km = haversine_km(F.lit(22.0), F.lit(80.0), F.col("lat"), F.col("lon"))
    near = box.withColumn("km", km).where("km <= 300")
    calls = _stops(spark, d).where("station_code is not null and coalesce(arr, dep) is not null").groupBy("station_code").agg(F.count(F.lit(1)).alias("calls"))
    return near.join(calls, near["code"] == calls["station_code"], "left").select("station_id", "code", clock.round1(F.col("km")).alias("km"), F.coalesce("calls", F.lit(0)).alias("calls")).where("calls >= 1").orderBy("km", "station_id").limit(30)


def f01_valid_variants(spark, d):
    return tt.valid_variant(table(spark, d, "trains"), MONTH_DAY, ["updated_at"]).select("train_number", "valid_from", "valid_to")


def f02_running_day_filter(spark, d):
    m = clock.days_mask(F.col("days"))
    return table(spark, d, "trains").where(clock.runs_on(m, F.lit(2))).groupBy(m.isNull().alias("unknown")).agg(F.count(F.lit(1)).alias("n"))


def f04_towards_semi_join(spark, d):
    p = stage(_placed(spark, d), "placed")
    a, b = _ends(p)
    return tt.board(p, table(spark, d, "trains"), a, towards=[b]).select("train_number", "pos", "clock", "calls_on")


def f08_train_search(spark, d):
    t = tt.searchable(table(spark, d, "trains"), table(spark, d, "stops"), MONTH_DAY, ["updated_at"])
    words = t.where(F.col("search_name").contains("exp") & F.col("search_name").contains("kul"))
    number = t.where(F.col("train_number").startswith("10001"))
    return words.select("train_number", F.lit("words").alias("by")).unionByName(number.select("train_number", F.lit("number").alias("by")))


def n01_direct_trains(spark, d):
    return tt.legs(_placed(spark, d), table(spark, d, "trains")).select("train_number", "from_code", "to_code", "i", "j", "dep", "arr", "arr_day", "duration", "overnight", "departs_on", "km")


def n03_two_leg_connections(spark, d):
    p = stage(_placed(spark, d), "placed")
    a, b = _ends(p)
    j = tt.connections(tt.legs(p, table(spark, d, "trains")), a, b, placed=p, limit=20)
    return j.select(F.array_join("trains", ">").alias("trains"), F.array_join("changes", ">").alias("changes"), "total", "works_on")


def n04_three_leg_connections(spark, d):
    p = stage(_placed(spark, d), "placed")
    a, b = _ends(p)
    j = tt.connections(tt.legs(p, table(spark, d, "trains")), a, b, legs_max=3, calls=p.where("halts"), placed=p, limit=20)
    return j.select(F.array_join("trains", ">").alias("trains"), F.array_join("changes", ">").alias("changes"), "total", "works_on", "n_legs")


def n06_station_board(spark, d):
    p = stage(_placed(spark, d), "placed")
    a, _ = _ends(p)
    return tt.board(p, table(spark, d, "trains"), a, weekday=4, start=1200, end=360).orderBy("clock", "train_number", "pos")


def n11_visit_index(spark, d):
    return tt.visits(_placed(spark, d))


def a03_trains_calling(spark, d):
    return _placed(spark, d).where("halts").groupBy("station_code").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("train_number").alias("trains"))


def w07_neighbour_fill(spark, d):
    return tt.coded_neighbours(_stops(spark, d)).select("train_number", "seq", "before", "after")


def w09_gap_invariant(spark, d):
    return tt.gap_check(_placed(spark, d))


def w11_piece_ids(spark, d):
    s = _stops(spark, d).withColumn("at", F.coalesce("dep", "arr")).where("at is not null")
    return tt.pieces(s, "train_number", "seq", "at", 120).groupBy("train_number", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def l02_capped_total(spark, d):
    trains = table(spark, d, "trains").where("dist_km > 500")
    total = trains.agg(F.count(F.lit(1)).alias("total"))
    return trains.orderBy(F.desc("dist_km"), "train_number").limit(25).select("train_number", "dist_km").crossJoin(F.broadcast(total))


QUERIES = {
    f.__name__: f
    for f in (
        t01_clock_parse, t06_day_rollover, t06_placed_schedule, t07_weekday_shift, t12_yearly_window, t14_clock_window, t15_leg_times,
        j01_normalise_name, j02_station_rank, j05_status_category, j10_parse_classes, j11_parse_days, j12_train_kind, j14_nearby_haversine,
        f01_valid_variants, f02_running_day_filter, f04_towards_semi_join, f08_train_search, n01_direct_trains, n03_two_leg_connections,
        n04_three_leg_connections, n06_station_board, n11_visit_index, a03_trains_calling, w07_neighbour_fill, w09_gap_invariant,
        w11_piece_ids, l02_capped_total,
    )
}


def _min(c: str) -> str:
    return f"case when regexp_full_match({c}, '\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?') then cast(split_part({c}, ':', 1) as int) * 60 + cast(split_part({c}, ':', 2) as int) end"


def _fmt(m: str) -> str:
    return f"lpad(cast((({m}) % 1440 + 1440) % 1440 // 60 as varchar), 2, '0') || ':' || lpad(cast((({m}) % 1440 + 1440) % 1440 % 60 as varchar), 2, '0')"


def _mask(c: str) -> str:
    return f"case when {c} is not null then " + " + ".join(f"case when list_contains({c}, '{n}') then {1 << i} else 0 end" for i, n in enumerate(clock.WEEKDAYS)) + " end"


def _shift(m: str, k: str) -> str:
    k = f"((({k}) % 7 + 7) % 7)"
    return f"((({m}) << {k}) | (({m}) >> (7 - {k}))) & 127"


def _pl(m: str, g: str, prev: str) -> str:
    base = f"(greatest({prev}, 0) // 1440 * 1440 + {m})"
    return f"case when {g} >= 1 and ({g} - 1) * 1440 + {m} >= {prev} then ({g} - 1) * 1440 + {m} when {base} < {prev} then {base} + 1440 else {base} end"


S = f"s0 as (select distinct train_number, seq, station_code, station_name, {_min('arrival')} arr, {_min('departure')} dep, arr_day, km from stops)"
PLACED = f"""{S},
s1 as (select *, row_number() over (partition by train_number order by seq) rn, case when station_code is not null then arr_day end g from s0),
st(train_number, rn, prev, a_abs, d_abs) as (
  select train_number, cast(0 as bigint), cast(-1 as bigint), cast(null as bigint), cast(null as bigint) from s1 where rn = 1
  union all
  select train_number, rn, coalesce(d, p1), a, d from (
    select *, {_pl('dep', 'cast(null as int)', 'p1')} d from (
      select *, coalesce(a, prev) p1 from (
        select s1.train_number, s1.rn, st.prev, s1.dep, {_pl('s1.arr', 's1.g', 'st.prev')} a from st join s1 on s1.train_number = st.train_number and s1.rn = st.rn + 1)))),
f as (select s1.*, st.a_abs, st.d_abs, lag(st.prev) over (partition by s1.train_number order by s1.rn) before,
      count(*) filter (s1.station_code is null) over (partition by s1.train_number) dropped from s1 join st using (train_number, rn)),
g as (select *, row_number() over (partition by train_number order by seq) pos, count(*) over (partition by train_number) n,
      case when d_abs - a_abs > 720 then null else d_abs end sane,
      case when g >= 1 and arr is not null and (g - 1) * 1440 + arr < coalesce(before, -1) then 1 else 0 end late from f where station_code is not null),
placed as (select train_number, cast(pos as int) pos, seq, station_code, station_name, cast(case when pos > 1 then a_abs end as int) arr_abs, cast(case when pos < n then sane end as int) dep_abs, km,
      a_abs is not null or sane is not null halts, cast(case when pos > 1 and pos < n then sane - a_abs end as int) halt, cast(late as int) late, cast(dropped as int) dropped from g)"""
WITH = "with recursive " + PLACED
ENDS = "ends as (select station_code c, row_number() over (order by count(*) desc, station_code) r from placed where halts group by 1)"
LEGS = f"""t as (select train_number, {_mask('days')} mask from trains),
rides0 as (select a.train_number, a.station_code from_code, b.station_code to_code, a.pos i, b.pos j, a.dep_abs, b.arr_abs, b.km - a.km dk,
  row_number() over (partition by a.train_number, a.pos, b.station_code order by b.pos) nth
  from placed a join placed b on a.train_number = b.train_number and b.pos > a.pos and a.halts and b.halts),
legs as (select train_number, from_code, to_code, i, j, cast(dep_abs % 1440 as int) dep, cast(arr_abs % 1440 as int) arr,
  cast(arr_abs // 1440 - dep_abs // 1440 + 1 as int) arr_day, cast(arr_abs - dep_abs as int) duration, arr_abs // 1440 > dep_abs // 1440 overnight,
  cast({_shift('mask', 'dep_abs // 1440')} as int) departs_on, case when dk > 0 then dk end km
  from rides0 left join t using (train_number) where nth = 1 and dep_abs is not null and arr_abs > dep_abs)"""
_F1 = """fa as (select *, row_number() over (partition by train_number, to_code order by duration, dep, departs_on) one from legs where from_code = (select c from ends where r = 1) and to_code <> (select c from ends where r = 2)),
f1 as (select * from (select *, row_number() over (partition by to_code order by duration, train_number) rk from fa where one = 1) where rk <= 12),
la as (select *, row_number() over (partition by train_number, from_code order by duration, dep, departs_on) one from legs where to_code = (select c from ends where r = 2) and from_code <> (select c from ends where r = 1)),
l1 as (select * from (select *, row_number() over (partition by from_code order by duration, train_number) rk from la where one = 1) where rk <= 12),
two0 as (select a.train_number t1, b.train_number t2, a.to_code x, a.duration + b.duration + (b.dep - a.arr + 1440) % 1440 total, a.departs_on m1, b.departs_on m2,
  a.arr_day - 1 + case when a.arr + (b.dep - a.arr + 1440) % 1440 >= 1440 then 1 else 0 end sh
  from f1 a join l1 b on a.to_code = b.from_code and a.train_number <> b.train_number and (b.dep - a.arr + 1440) % 1440 between 45 and 360)"""
_CALLS = "c0 as (select train_number t, station_code c, min(pos) p from placed group by 1, 2), cd as (select c0.* from c0 join placed on placed.train_number = t and station_code = c and pos = p where dep_abs is not null), ca as (select train_number t, station_code c, pos p from placed where arr_abs is not null)"


def _dominated(trains: list[str], froms: list[str], tos: list[str]) -> str:
    """SQL condition that a journey is not dominated."""
    out = []
    for q, t in enumerate(trains):
        board = f"(select p from c0 where t = {t} and c = {froms[q]})"
        alight = f"(select min(pos) from placed where train_number = {t} and station_code = {tos[q]} and pos > {board})"
        out += [f"not exists (select 1 from cd where t = {t} and c = {froms[k]} and p < {board})" for k in range(q)]
        out += [f"not exists (select 1 from ca where t = {t} and c = {tos[k]} and p > {alight})" for k in range(q + 1, len(trains))]
    return " and ".join(out)


ORACLE = {
    "t01_clock_parse": f"select train_number, seq, {_min('departure')} as minutes, {_fmt(_min('departure') + ' - 35')} as earlier from stops_mirror",
    "t06_day_rollover": f"""with {S}, e as (select train_number, seq, coalesce(dep, arr) as "at" from s0 where coalesce(dep, arr) is not null),
w as (select *, case when "at" < lag("at") over (partition by train_number order by seq) then 1 else 0 end fell from e)
select train_number, seq, "at", cast(1 + sum(fell) over (partition by train_number order by seq) as int) as day from w""",
    "t06_placed_schedule": WITH + " select train_number, pos, seq, station_code, arr_abs, dep_abs, halts, halt, late, dropped from placed",
    "t07_weekday_shift": f"select train_number, {_mask('days')} mask, cast({_shift(_mask('days'), '(coalesce(dist_km, 0) % 11) - 5')} as int) shifted, case when days is not null then array_to_string([x for x in {clock.WEEKDAYS} if list_contains(days, x)], ' ') end \"names\" from trains",
    "t12_yearly_window": f"""select train_number, case when valid_from is null or valid_to is null then true when valid_from <= valid_to then '{MONTH_DAY}' between valid_from and valid_to else '{MONTH_DAY}' >= valid_from or '{MONTH_DAY}' <= valid_to end valid,
strftime(cast('2001-' || valid_to as date) + 1, '%m-%d') other_from, strftime(cast('2001-' || valid_from as date) - 1, '%m-%d') other_to,
cast(case when valid_from <= valid_to then cast('2001-' || valid_to as date) - cast('2001-' || valid_from as date) + 1 else 366 + (cast('2001-' || valid_to as date) - cast('2001-' || valid_from as date)) end as int) n_days from trains""",
    "t14_clock_window": f"with {S} select train_number, seq, dep from s0 where dep >= 1350 or dep <= 245",
    "t15_leg_times": f"""with x as (select search_id, {_min('departure_time')} d, {_min('arrival_time')} a, duration_minutes u from search_trains),
y as (select *, (d + u) // 1440 * 1440 + a b from x), z as (select search_id, d, a, u, unnest([b - 1440, b, b + 1440]) c from y),
k as (select search_id, c, abs(c - (d + u)) off, d, row_number() over (partition by search_id order by abs(c - (d + u)), c) r from z)
select x.search_id, cast(case when off <= 120 and c > x.d then c end as int) arrives, (a - x.d + 1440) % 1440 ride from x left join k on x.search_id = k.search_id and r = 1 where true""",
    "j01_normalise_name": r"""select ct_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
trim(regexp_replace(regexp_replace(lower(station_name), '[().,''’\-/]', ' ', 'g'), '\s+', ' ', 'g')),
'\bjunction\b', 'jn', 'g'), '\bcantonment\b', 'cantt', 'g'), '\bterminus\b', 't', 'g'), '\bterminal\b', 't', 'g'), '\broad\b', 'rd', 'g') as "name" from ct_stations""",
    "j02_station_rank": WITH + r""", n as (select code, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
trim(regexp_replace(regexp_replace(lower(station_name), '[().,''’\-/]', ' ', 'g'), '\s+', ' ', 'g')),
'\bjunction\b', 'jn', 'g'), '\bcantonment\b', 'cantt', 'g'), '\bterminus\b', 't', 'g'), '\bterminal\b', 't', 'g'), '\broad\b', 'rd', 'g') nm from stations),
sc as (select code, case when code = 'KUL JUNCTION' then 100 when nm = 'kul jn' then 90 when starts_with(nm, 'kul jn') then 70
  when len([w for w in string_split(nm, ' ') if starts_with(w, 'kul')]) > 0 and len([w for w in string_split(nm, ' ') if starts_with(w, 'jn')]) > 0 then 50
  when contains(nm, 'kul jn') then 20 else 0 end score from n)
select code, cast(max(score) as int) score, coalesce((select count(*) from placed where station_code = code and halts), 0) calls from sc where score > 0 group by code order by score desc, calls desc, code limit 10""",
    "j05_status_category": f"""with y as (select search_id, {STATUS}[search_id % {len(STATUS)} + 1] a from search_trains), x as (select *, trim(split_part(a, '/', -1)) t from y)
select search_id, case when regexp_matches(a, 'REGRET|NOT AVAILABLE|DEPARTED|CANCEL|NOT EXIST|CLOSED') then 'not_available' when regexp_matches(t, '^(AVAILABLE|AVL|CURR_AVBL)\\b') then 'available'
when regexp_matches(t, '^RAC\\b') then 'rac' when regexp_matches(t, '^[A-Z]*WL') then 'waitlist' else 'unknown' end category from x""",
    "j12_train_kind": "select case " + " ".join(f"when regexp_matches(lower(train_name), '{p}') then '{k}'" for k, p in text.TRAIN_KINDS) + " end kind, train_type, count(*) n from trains group by 1, 2",
    "j14_nearby_haversine": f"""with {S}, c as (select station_code, count(*) calls from s0 where station_code is not null and coalesce(arr, dep) is not null group by 1),
k as (select station_id, code, 2 * 6371 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(22.0)) / 2), 2) + cos(radians(22.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(80.0)) / 2), 2)))) d
  from stations where lat between 6 and 37.5 and lon between 68 and 97.5)
select station_id, code, floor(d * 10 + 0.5) / 10 km, calls from k join c on c.station_code = k.code where d <= 300 and calls >= 1 order by km, station_id limit 30""",
    "f01_valid_variants": f"""select train_number, valid_from, valid_to from (select *, row_number() over (partition by train_number order by updated_at) r from trains
where valid_from is null or valid_to is null or case when valid_from <= valid_to then '{MONTH_DAY}' between valid_from and valid_to else '{MONTH_DAY}' >= valid_from or '{MONTH_DAY}' <= valid_to end) where r = 1""",
    "f02_running_day_filter": "select days is null as unknown, count(*) n from trains where days is null or list_contains(days, 'WED') group by 1",
    "f04_towards_semi_join": WITH + f", {ENDS}, t as (select train_number, {_mask('days')} mask from trains)" + f"""
select a.train_number, a.pos, cast(coalesce(dep_abs, arr_abs) % 1440 as int) clock, cast({_shift('mask', 'coalesce(dep_abs, arr_abs) // 1440')} as int) calls_on
from placed a left join t using (train_number) where halts and station_code = (select c from ends where r = 1)
and exists (select 1 from placed b where b.train_number = a.train_number and b.halts and b.pos > a.pos and b.station_code = (select c from ends where r = 2))""",
    "f08_train_search": r"""with e as (select train_number, min_by(station_name, seq) a, max_by(station_name, seq) b from stops group by 1),
x as (select t.train_number, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', train_name, a, b)), '[().,''’\-/]', ' ', 'g'), '\s+', ' ', 'g')) nm from trains t left join e on e.train_number = t.train_number)
select train_number, 'words' as "by" from x where contains(nm, 'exp') and contains(nm, 'kul') union all select train_number, 'number' from trains where starts_with(train_number, '10001')""",
    "n01_direct_trains": WITH + f", {LEGS} select * from legs",
    "n03_two_leg_connections": WITH + f", {ENDS}, {LEGS}, {_F1}, {_CALLS}, ab as (select c a, (select c from ends where r = 2) b from ends where r = 1), two as (select *, cast(m1 & ({_shift('m2', '-sh')}) as int) works from two0, ab where {_dominated(['t1', 't2'], ['ab.a', 'x'], ['x', 'ab.b'])})" + """
select t1 || '>' || t2 trains, x changes, cast(total as int) total, works works_on from (select *, row_number() over (partition by t1, t2 order by total, x) r from two where works is null or works > 0)
where r = 1 order by total, t1, t2 limit 20""",
    "n04_three_leg_connections": WITH + f", {ENDS}, {LEGS}, {_F1}, {_CALLS}" + f""",
ab as (select c a, (select c from ends where r = 2) b from ends where r = 1),
hub as (select station_code from placed where halts group by 1 having count(*) >= 10),
two as (select [t1, t2] ts, x ch, total, cast(m1 & ({_shift('m2', '-sh')}) as int) works, 2 n from two0, ab where {_dominated(['t1', 't2'], ['ab.a', 'x'], ['x', 'ab.b'])}),
p1 as (select a.train_number t1, b.train_number t2, a.to_code x, b.to_code y, a.duration + b.duration + (b.dep - a.arr + 1440) % 1440 total, a.departs_on m1, b.departs_on m2,
  a.arr_day - 1 + case when a.arr + (b.dep - a.arr + 1440) % 1440 >= 1440 then 1 else 0 end sh2, b.arr, b.arr_day
  from f1 a join legs b on a.to_code = b.from_code and a.train_number <> b.train_number and (b.dep - a.arr + 1440) % 1440 between 45 and 360
  where a.rk <= 3 and b.from_code in (select station_code from hub) and b.to_code <> (select a from ab)),
p2 as (select t1, t2, c.train_number t3, x, y, total + c.duration + (c.dep - p1.arr + 1440) % 1440 total, m1, m2, c.departs_on m3, sh2,
  sh2 + p1.arr_day - 1 + case when p1.arr + (c.dep - p1.arr + 1440) % 1440 >= 1440 then 1 else 0 end sh3
  from p1 join l1 c on p1.y = c.from_code and c.rk <= 3 and c.train_number <> t1 and c.train_number <> t2 and (c.dep - p1.arr + 1440) % 1440 between 45 and 360),
three as (select [t1, t2, t3] ts, x || '>' || y ch, total, cast(m1 & ({_shift('m2', '-sh2')}) & ({_shift('m3', '-sh3')}) as int) works, 3 n from p2, ab where {_dominated(['t1', 't2', 't3'], ['ab.a', 'x', 'y'], ['x', 'y', 'ab.b'])})
select array_to_string(ts, '>') trains, ch changes, cast(total as int) total, works works_on, n n_legs from
(select *, row_number() over (partition by ts order by total, ch) r from (select * from two union all select * from three) where works is null or works > 0)
where r = 1 order by total, n, ts limit 20""",
    "n06_station_board": WITH + f", {ENDS}, t as (select train_number, {_mask('days')} mask from trains)" + f""",
b as (select a.train_number, a.pos, cast(coalesce(dep_abs, arr_abs) % 1440 as int) clock, cast({_shift('mask', 'coalesce(dep_abs, arr_abs) // 1440')} as int) calls_on
from placed a left join t using (train_number) where halts and station_code = (select c from ends where r = 1))
select * from b where (clock >= 1200 or clock <= 360) and (calls_on is null or (calls_on >> 4) & 1 = 1)""",
    "n11_visit_index": WITH + " select train_number, station_code, pos, cast(row_number() over (partition by train_number, station_code order by pos) - 1 as int) visit from placed where halts",
    "a03_trains_calling": WITH + " select station_code, count(*) calls, count(distinct train_number) trains from placed where halts group by 1",
    "w07_neighbour_fill": f"""with {S} select train_number, seq, before, after from (select *, last_value(station_code ignore nulls) over (partition by train_number order by seq rows between unbounded preceding and 1 preceding) before,
first_value(station_code ignore nulls) over (partition by train_number order by seq rows between 1 following and unbounded following) after from s0) where station_code is null""",
    "w09_gap_invariant": WITH + """, e as (select train_number, pos, 0 k, arr_abs as "at" from placed where arr_abs is not null union all select train_number, pos, 1, dep_abs from placed where dep_abs is not null),
w as (select *, "at" - lag("at") over (partition by train_number order by pos, k) gap from e) select train_number, pos, k, gap from w where gap < 0 or gap > 720""",
    "w11_piece_ids": f"""with {S}, e as (select train_number, seq, coalesce(dep, arr) as "at" from s0 where coalesce(dep, arr) is not null),
w as (select *, case when ("at" - lag("at") over (partition by train_number order by seq) + 1440) % 1440 > 120 then 1 else 0 end cut from e),
p as (select *, cast(sum(cut) over (partition by train_number order by seq) as int) piece from w) select train_number, piece, count(*) n, min(seq) first_seq from p group by 1, 2""",
    "l02_capped_total": "select train_number, dist_km, (select count(*) from trains where dist_km > 500) total from trains where dist_km > 500 order by dist_km desc, train_number limit 25",
}
