"""Queries over the route-merging operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopline.functions import clock, text
from loopline.operators import alignment, merging, punctuality
from loopline.operators import timetable as tt
from loopline.operators.nearby import pairs_within
from loopline.plans.evidence_queries import _NORM, n19_line_support
from loopline.plans.timetable_queries import S, _min, _stops
from loopline.session import stage, table


def w10_keep_first(spark, d):
    s = table(spark, d, "stops").select("train_number", "station_name", "arrival", "departure", "stop_id", "seq")
    return merging.keep_first(s, ["train_number", "station_name", "arrival", "departure"], ["stop_id"]).select("train_number", "seq", "stop_id")


def n15_consistent_segments(spark, d):
    a = _stops(spark, d).where("station_code is not null").select("train_number", "station_code", "arr", "dep")
    m = table(spark, d, "stops_mirror").where("station_code is not null")
    b = m.select("train_number", "seq", "station_code", clock.parse_clock(F.col("arrival")).alias("arr"), clock.parse_clock(F.col("departure")).alias("dep")).distinct()
    return merging.consistent_times(a, b, ["train_number"])


def g02_segment_offsets(spark, d):
    a = _stops(spark, d).select("train_number", "station_code", F.coalesce("dep", "arr").alias("at"))
    b = table(spark, d, "stops_mirror").select("train_number", "seq", "station_code", clock.parse_clock(F.coalesce("departure", "arrival")).alias("at")).distinct()
    o = alignment.pair_offset(a, b, "train_number", "station_code", "at").where("strict")
    links = o.select("train_number", F.lit(1).alias("a"), F.lit(2).alias("b"), F.col("offset").cast("int").alias("offset"))
    nodes = table(spark, d, "trains").select("train_number", F.explode(F.array(F.lit(1), F.lit(2))).alias("segment")).distinct()
    return merging.segment_offsets(nodes, links).where("segment = 2").select("train_number", "component", "offset", "clash")


def a09_merged_events(spark, d):
    m = table(spark, d, "stops_mirror").select("train_number", "station_code", F.lit(None).cast("string").alias("name"), clock.parse_clock(F.col("arrival")).alias("arr"), clock.parse_clock(F.col("departure")).alias("dep")).distinct()
    s = _stops(spark, d).select("train_number", "station_code", F.col("station_name").alias("name"), "arr", "dep").distinct()
    e = s.unionByName(m).where("station_code is not null and coalesce(arr, dep) is not null")
    return merging.merged_events(e, "train_number", "station_code").select("train_number", "station_code", "call", "arr", "dep", "unsure", "reports", "name")


def g04_chain_parts(spark, d):
    """Every train's route cut after its fifth stop and strung together again."""
    s = _stops(spark, d).where("station_code is not null").withColumn("at", F.coalesce("dep", "arr")).where("at is not null").withColumn("part", F.ceil(F.col("seq") / 5).cast("bigint"))
    ends = s.groupBy("train_number", "part").agg(F.min(F.struct("seq", "station_code", "at")).alias("a"), F.max(F.struct("seq", "station_code", "at")).alias("b"))
    w = ends.select("train_number", "part", F.col("a.station_code").alias("first_code"), F.col("b.station_code").alias("own_last"), F.col("a.at").alias("first_at"), F.col("b.at").alias("own_at"))
    nxt = w.select("train_number", (F.col("part") - 1).alias("part"), F.col("first_code").alias("next_code"), F.col("first_at").alias("next_at"))
    parts = w.join(nxt, ["train_number", "part"], "left").select("train_number", "part", "first_code", F.coalesce("next_code", "own_last").alias("last_code"), "first_at", F.coalesce("next_at", "own_at").alias("last_at"))
    return merging.chain_parts(parts).groupBy("train_number").agg(F.countDistinct("chain").alias("chains"), F.count(F.lit(1)).alias("parts"))


def g05_detour_choice(spark, d):
    gaps = tt.coded_neighbours(_stops(spark, d)).where("before is not null and after is not null and station_name is not null").select("train_number", "seq", text.normalise_name(F.col("station_name")).alias("name"), "before", "after")
    s = table(spark, d, "stations")
    cand = s.select(text.normalise_name(F.col("station_name")).alias("name"), "code").where("name is not null and code is not null").distinct()
    ok = s.where("lat between 6 and 37.5 and lon between 68 and 97.5").select("code", "lat", "lon", "station_id")
    pos = alignment.first_by_priority(ok, "code", [F.col("station_id")]).select("code", "lat", "lon")
    return merging.choose_by_detour(gaps, cand, pos, stage(n19_line_support(spark, d), "support"))


def h28_pair_verdicts(spark, d):
    s = table(spark, d, "stations").where("lat between 6 and 37.5 and lon between 68 and 97.5 and code is not null")
    near = pairs_within(s, "station_id", "lat", "lon", 1.0)
    n = s.select("station_id", "code", text.normalise_name(F.col("station_name")).alias("name"))
    live = table(spark, d, "stops").where("station_code is not null").select(F.col("station_code").alias("code")).distinct().withColumn("live", F.lit(True))
    n = n.join(live, "code", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    a = n.select(F.col("station_id").alias("station_id_a"), F.col("code").alias("ca"), F.col("name").alias("na"), F.col("live").alias("live_a"))
    b = n.select(F.col("station_id").alias("station_id_b"), F.col("code").alias("cb"), F.col("name").alias("nb"), F.col("live").alias("live_b"))
    p = near.join(a, "station_id_a").join(b, "station_id_b").where("ca <> cb").select(
        "station_id_a", "station_id_b", F.col("distance_km").alias("km"), F.lit(None).cast("boolean").alias("same_route"), (F.col("na") == F.col("nb")).alias("duplicate"), "live_a", "live_b",
    )
    return merging.pair_verdicts(p).select("station_id_a", "station_id_b", "verdict", "reason")


def s07_cell_times(spark, d):
    """Printed cells made of each stop's clocks, read back."""
    cell = F.concat_ws(" ", F.replace("arrival", F.lit(":"), F.lit(".")), F.replace("departure", F.lit(":"), F.lit(".")))
    t = merging.cell_times(cell, F.col("arrival").isNull(), F.col("departure").isNull())
    return table(spark, d, "stops").where("arrival is not null or departure is not null").select("stop_id", t.alias("t")).select("stop_id", "t.arr", "t.dep", "t.flagged")


def j23_table_refs(spark, d):
    return table(spark, d, "segments").select("segment_id", F.explode(F.concat(F.coalesce(merging.table_refs(F.col("from_table")), F.array().cast("array<int>")), F.coalesce(merging.table_refs(F.col("to_table")), F.array().cast("array<int>")))).alias("ref"))


def t27_overlaps(spark, d):
    s = table(spark, d, "station_stats").select("train_number", "station_code", "window_from", "window_to")
    m = alignment.merged_intervals(s, ["train_number", "station_code"], "window_from", "window_to")
    return m.where("n > 1").groupBy("train_number", "station_code").agg(F.sum("n").alias("windows"))


def a16_lag_days(spark, d):
    r = punctuality.latest_readings(table(spark, d, "delays"), ["train_number"])
    return r.groupBy("train_number").agg(F.datediff(F.lit("2027-01-01").cast("date"), F.max("run_date")).alias("lag_days"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] != "_" and k[1:3].isdigit() and callable(f) and f.__module__ == __name__}

_HAV = "2 * 6371 * asin(least(1.0, sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))"
_POS = "ps as (select code, lat, lon from (select *, row_number() over (partition by code order by station_id) r from stations where lat between 6 and 37.5 and lon between 68 and 97.5) where r = 1 and code is not null)"

ORACLE = {
    "w10_keep_first": "select train_number, seq, stop_id from (select *, row_number() over (partition by train_number, station_name, arrival, departure order by stop_id) r from stops) where r = 1",
    "n15_consistent_segments": f"""with {S}, a as (select train_number, station_code, arr, dep from s0 where station_code is not null),
b as (select distinct train_number, seq, station_code, {_min('arrival')} arr, {_min('departure')} dep from stops_mirror where station_code is not null),
j as (select train_number, a.arr a1, a.dep d1, b.arr a2, b.dep d2, [x for x in [a.arr, a.dep] if x is not null] p, [x for x in [b.arr, b.dep] if x is not null] q from a join b using (train_number, station_code))
select train_number, count(*) shared, bool_and((list_has_all(p, q) or list_has_all(q, p)) and not coalesce(a1 <> a2, false) and not coalesce(d1 <> d2, false)) consistent from j group by 1""",
    "g02_segment_offsets": f"""with {S}, a as (select train_number, station_code, min(coalesce(dep, arr)) x from s0 where station_code is not null and coalesce(dep, arr) is not null group by 1, 2 having count(*) = 1),
m as (select distinct train_number, seq, station_code, {_min('coalesce(departure, arrival)')} y from stops_mirror),
b as (select train_number, station_code, min(y) y from m where station_code is not null and y is not null group by 1, 2 having count(*) = 1),
c as (select train_number, x - y o, count(*) n from a join b using (train_number, station_code) group by 1, 2),
p as (select train_number, o, n, sum(n) over (partition by train_number) total, row_number() over (partition by train_number order by n desc, abs(o), o) r from c),
k as (select train_number, o from p where r = 1 and n * 2 > total)
select train_number, case when o is null then 2 else 1 end component, coalesce(o, 0) "offset", false clash from (select distinct train_number from trains union select train_number from k) t left join k using (train_number)
where o is not null or train_number in (select train_number from trains)""",
    "a09_merged_events": f"""with {S}, e as (select distinct train_number, station_code, station_name nm, arr, dep from s0 where station_code is not null and coalesce(arr, dep) is not null),
f as (select distinct train_number, station_code, cast(null as varchar) nm, {_min('arrival')} arr, {_min('departure')} dep from stops_mirror where station_code is not null),
u as (select * from e union all select * from f where coalesce(arr, dep) is not null),
t as (select *, coalesce(arr, dep) a from u), c as (select *, case when a - lag(a) over (partition by train_number, station_code order by a) > 360 then 1 else 0 end cut from t),
g as (select *, sum(cut) over (partition by train_number, station_code order by a range between unbounded preceding and current row) as k from c),
nm as (select train_number, station_code, k, nm from (select train_number, station_code, k, nm, row_number() over (partition by train_number, station_code, k order by count(*) desc, nm) r from g where nm is not null group by 1, 2, 3, 4) where r = 1),
z as (select train_number, station_code, k, case when count(distinct arr) = 1 then max(arr) end arr, case when count(distinct dep) = 1 then max(dep) end dep, count(distinct arr) > 1 or count(distinct dep) > 1 unsure, count(*) reports from g group by 1, 2, 3)
select z.train_number, z.station_code, cast(z.k as bigint) as "call", arr, dep, unsure, reports, nm as "name" from z left join nm on z.train_number = nm.train_number and z.station_code = nm.station_code and z.k = nm.k""",
    "g05_detour_choice": f"""with {S}, nb as (select *, last_value(station_code ignore nulls) over (partition by train_number order by seq rows between unbounded preceding and 1 preceding) before,
first_value(station_code ignore nulls) over (partition by train_number order by seq rows between 1 following and unbounded following) after from s0),
g as (select train_number, seq, {_NORM.format(c='station_name')} nm, before, after from nb where station_code is null and before is not null and after is not null and station_name is not null),
cd as (select distinct {_NORM.format(c='station_name')} nm, code from stations where station_name is not null and code is not null), {_POS},
gp as (select distinct before, after from nb where station_code is null and before is not null and after is not null and before <> after),
f as (select train_number, station_code, min(seq) pos from s0 where station_code is not null group by 1, 2),
su as (select before, after, m.station_code code, count(distinct m.train_number) n from gp join f p on p.station_code = before join f q on q.station_code = after and q.train_number = p.train_number
join f m on m.train_number = p.train_number and m.pos > least(p.pos, q.pos) and m.pos < greatest(p.pos, q.pos) group by 1, 2, 3),
d as (select train_number, seq, cd.code, {_HAV.format('b.lat', 'b.lon', 'c.lat', 'c.lon')} + {_HAV.format('c.lat', 'c.lon', 'a.lat', 'a.lon')} - {_HAV.format('b.lat', 'b.lon', 'a.lat', 'a.lon')} dt, coalesce(n, 0) n
from g join cd on g.nm = cd.nm join ps c on c.code = cd.code join ps b on b.code = before join ps a on a.code = after left join su on su.before = g.before and su.after = g.after and su.code = cd.code),
r as (select *, row_number() over (partition by train_number, seq order by dt, code) rn, lead(dt) over (partition by train_number, seq order by dt, code) nx,
row_number() over (partition by train_number, seq order by n desc, code) ln, lead(n) over (partition by train_number, seq order by n desc, code) nn from d),
z as (select train_number, seq, max(code) filter (rn = 1) c1, max(coalesce(nx - dt, 1e300)) filter (rn = 1) ld, max(code) filter (ln = 1) c2, max(n - coalesce(nn, 0)) filter (ln = 1) mo from r group by 1, 2)
select train_number, seq, case when ld >= 10 then c1 when mo > 0 then c2 end code, case when ld >= 10 then 'detour' when mo > 0 then 'support' else 'open' end how from z""",
    "h28_pair_verdicts": f"""with p as (select station_id id, code, lat, lon, radians(lat) y, radians(lon) x, {_NORM.format(c='station_name')} nm, code in (select station_code from stops where station_code is not null) live from stations where lat between 6 and 37.5 and lon between 68 and 97.5 and code is not null),
q as (select a.id ia, b.id ib, a.nm = b.nm same, a.live la, b.live lb from p a join p b on a.id < b.id and a.code <> b.code and abs(a.lat - b.lat) < 0.01
where 2 * 6371 * asin(least(1.0, sqrt(pow(sin((b.y - a.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((b.x - a.x) / 2), 2)))) <= 1.0)
select ia station_id_a, ib station_id_b, case when la <> lb and coalesce(same, false) then 'accepted' else 'rejected' end verdict,
case when la and lb then 'both in use' when la <> lb and coalesce(same, false) then 'accepted' else 'too little evidence' end reason from q""",
    "s07_cell_times": f"""select stop_id, {_min('arrival')} arr, {_min('departure')} dep, false flagged from stops where arrival is not null or departure is not null""",
    "j23_table_refs": r"select segment_id, cast(unnest(list_concat(coalesce(regexp_extract_all(from_table, '\d+'), []), coalesce(regexp_extract_all(to_table, '\d+'), []))) as int) ref from segments",
    "t27_overlaps": """with x as (select train_number, station_code, window_from, window_to, max(window_to) over (partition by train_number, station_code order by window_from, window_to rows between unbounded preceding and 1 preceding) b from station_stats),
y as (select *, sum(case when window_from > b then 1 else 0 end) over (partition by train_number, station_code order by window_from, window_to rows between unbounded preceding and current row) p from x),
m as (select train_number, station_code, p, count(*) n from y group by 1, 2, 3) select train_number, station_code, cast(sum(n) as bigint) windows from m where n > 1 group by 1, 2""",
    "a16_lag_days": "select train_number, cast(cast('2027-01-01' as date) - max(run_date) as int) lag_days from delays where coalesce(arrival_delay_minutes, departure_delay_minutes) is not null group by 1",
}
