"""Queries over the punctuality, evidence and alignment operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopline.functions import clock, text
from loopline.operators import alignment, evidence, punctuality
from loopline.operators import timetable as tt
from loopline.operators.nearby import haversine_km, pairs_within
from loopline.plans.timetable_queries import PLACED, S, WITH, _mask, _min, _placed, _stops
from loopline.session import table

PAIR = ["train_number", "station_code"]


def a01_station_delay_stats(spark, d):
    s = punctuality.run_stats(punctuality.latest_readings(table(spark, d, "delays"), PAIR), PAIR)
    return s.select(*PAIR, "runs_with_data", "avg_delay", "median_delay", "max_delay", "pct_within_15", "pct_over_30", "pct_over_60", "low_sample")


def a02_recent_window(spark, d):
    s = punctuality.run_stats(punctuality.latest_readings(table(spark, d, "delays"), PAIR), PAIR)
    return s.select(*PAIR, "recent_avg", "recent_from", "recent_to", "recent_runs")


def a01_with_gaps(spark, d):
    s = punctuality.run_stats(punctuality.latest_readings(table(spark, d, "delays"), PAIR), PAIR)
    calls = table(spark, d, "stops").where("station_code is not null")
    return punctuality.with_gaps(s, calls, PAIR).select(*PAIR, "runs_with_data", "avg_delay", "low_sample")


def _order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stops").where("station_code is not null").groupBy(*PAIR).agg(F.min("seq").alias("idx"))


def a04_route_core_seen(spark, d):
    r = punctuality.latest_readings(table(spark, d, "delays"), PAIR)
    s = punctuality.route_sets(r, _order(spark, d))
    return s.select("train_number", "lo", "hi", "n_runs", F.array_join(F.col("core").cast("array<string>"), ",").alias("core"), F.array_join(F.col("seen").cast("array<string>"), ",").alias("seen"))


def _two_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Readings as if each train ran one route until June, over two thirds of its stations, and from July on another."""
    r = punctuality.latest_readings(table(spark, d, "delays"), PAIR).withColumn("run_date", F.trunc("run_date", "month").cast("date"))
    o = _order(spark, d)
    last = o.groupBy("train_number").agg(F.max("idx").alias("last"))
    r = r.join(o, PAIR).join(last, "train_number")
    return r.where("case when month(run_date) <= 6 then 3 * idx <= 2 * last else 3 * idx > last end").select(*PAIR, "run_date").distinct()


def a04_route_variants(spark, d):
    return punctuality.route_variants(_two_seasons(spark, d), _order(spark, d))


def v17_cross_check(spark, d):
    keys = [*PAIR, "provider"]
    s = punctuality.run_stats(punctuality.latest_readings(table(spark, d, "delays"), keys), keys)
    f = s.select(*PAIR, F.col("provider").alias("source"), F.col("recent_avg").alias("value"), F.datediff("recent_to", "recent_from").alias("span"))
    return punctuality.cross_check(f, "runlog", PAIR)


def _day_reports(spark: SparkSession, d: str) -> DataFrame:
    """Running days and classes of each train by four sources; two of them print, two operate."""
    def one(df, source, prio, upstream, counted=True):
        return df.select("train_number", "field", F.lit(source).alias("source"), F.lit(prio).alias("prio"), F.lit(upstream).alias("upstream"), F.lit(counted).alias("counted"), "value")

    def fields(df, days, classes):
        pairs = F.array(F.struct(F.lit("days").alias("field"), days.cast("string").alias("value")), F.struct(F.lit("classes").alias("field"), F.array_join(F.array_sort(F.array_distinct(classes)), " ").alias("value")))
        return df.select("train_number", F.explode(pairs).alias("p")).select("train_number", "p.*")

    lists = lambda t: fields(table(spark, d, t), clock.days_mask(F.col("days")), F.col("classes"))
    search = alignment.first_by_priority(table(spark, d, "search_trains").select("train_number", "running_days", "avl_classes", "search_id"), "train_number", [F.col("search_id")])
    seg = alignment.first_by_priority(table(spark, d, "segments").where("train_number is not null").select("train_number", "days_raw", "classes_raw", "segment_id"), "train_number", [F.col("segment_id")])
    return (
        one(lists("trains"), "main", 1, "print").unionByName(one(lists("trains_mirror"), "mirror", 2, "operator"))
        .unionByName(one(fields(search, F.coalesce(text.bit_days(F.col("running_days")), text.parse_days(F.col("running_days"))), text.parse_classes(F.col("avl_classes"))), "search", 3, "operator"))
        .unionByName(one(fields(seg, text.parse_days(F.col("days_raw")), text.parse_classes(F.col("classes_raw"))), "pages", 4, "print", False))
    )


def v01_field_status(spark, d):
    return evidence.settle(_day_reports(spark, d), ["train_number", "field"]).select("train_number", "field", "status", "shown")


def v04_operational(spark, d):
    return evidence.settle(_day_reports(spark, d), ["train_number", "field"], operational=True).groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


def v05_overall_rollup(spark, d):
    f = evidence.settle(_day_reports(spark, d), ["train_number", "field"])
    return evidence.roll_up(f, ["train_number"])


def v13_corrections(spark, d):
    f = evidence.settle(_day_reports(spark, d), ["train_number", "field"])
    return f.where("status in ('majority', 'updated') and primary is not null and shown <> primary").select("train_number", "field", "primary", "shown")


def a07_weakest(spark, d):
    f = evidence.roll_up(evidence.settle(_day_reports(spark, d), ["train_number", "field"]), ["train_number"])
    t = table(spark, d, "trains").select("train_number", "train_type").distinct()
    return f.join(t, "train_number").groupBy("train_type").agg(evidence.weakest(F.col("overall")).alias("weakest"), F.count(F.lit(1)).alias("n"))


def n10_merged_visits(spark, d):
    dep = lambda t, s: table(spark, d, t).select("train_number", F.lit(s).alias("source"), clock.parse_clock(F.col("departure")).alias("dep")).where("dep is not null").distinct()
    m = evidence.merge_visits(dep("stops", "main").unionByName(dep("stops_mirror", "mirror")), ["main", "mirror"])
    return m.select("train_number", "source", "visit", "dep", F.array_join("matched", ",").alias("matched"))


def _ct_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "ct_stations")
    return c.select(F.col("station_code").alias("code"), "station_name", "state_name", text.to_number(F.col("latitude")).alias("lat"), text.to_number(F.col("longitude")).alias("lon"), F.col("ct_id").alias("id"))


def v12_copied_coordinates(spark, d):
    a = table(spark, d, "stations").select("code", "lat", "lon", F.lit(1).alias("src"), F.col("station_id").alias("id"))
    b = _ct_positions(spark, d).select("code", "lat", "lon", F.lit(2).alias("src"), "id")
    p = a.unionByName(b).where("code is not null and lat is not null and lon is not null").withColumn("prio", F.struct("src", "id"))
    # coarse positions are read off a map, not measured
    p = p.withColumn("independent", F.expr("lat * 100 <> round(lat * 100) or lon * 100 <> round(lon * 100)"))
    return evidence.copied_positions(p, ["code"]).groupBy("code").agg(F.count_if("counted").alias("independent"), F.count(F.lit(1)).alias("reported"))


def n08_priority_dedupe(spark, d):
    a = table(spark, d, "stations").select("code", "station_name", "lat", "lon", F.lit(1).alias("src"), F.col("station_id").alias("id"))
    b = _ct_positions(spark, d).select("code", "station_name", "lat", "lon", F.lit(2).alias("src"), "id")
    rows = a.unionByName(b).where("code is not null and lat is not null and lon is not null")
    return alignment.first_by_priority(rows, "code", [F.col("src"), F.col("id")]).select("code", "station_name", "lat", "lon", "src")


def n09_fill_gaps(spark, d):
    own = table(spark, d, "stations").select("station_id", "code", "state_name", "lat", "lon")
    other = alignment.first_by_priority(_ct_positions(spark, d).where("code is not null").select("code", "state_name", "lat", "lon", "id"), "code", [F.col("id")]).drop("id")
    f = alignment.fill_gaps(own, other, "code", ["state_name"], ("lat", "lon"), "ct")
    return f.select("station_id", "code", "state_name", "lat", "lon", F.array_join("filled", ",").alias("filled"))


def n14_pair_offset(spark, d):
    a = _stops(spark, d).select("train_number", "station_code", F.coalesce("dep", "arr").alias("at"))
    m = table(spark, d, "stops_mirror")
    b = m.select("train_number", "seq", "station_code", clock.parse_clock(F.coalesce("departure", "arrival")).alias("at")).distinct()
    return alignment.pair_offset(a, b, "train_number", "station_code", "at")


def n16_slot_alignment(spark, d):
    a = _stops(spark, d).where("station_code is not null").select("train_number", F.col("seq").alias("pos"), "station_code")
    b = table(spark, d, "stops_mirror").where("station_code is not null").select("train_number", F.col("seq").alias("pos"), "station_code").distinct()
    return alignment.slot_alignment(a, b)


def n18_grid_near_duplicates(spark, d):
    s = table(spark, d, "stations").where("lat between 6 and 37.5 and lon between 68 and 97.5")
    near = pairs_within(s, "station_id", "lat", "lon", 1.0)
    n = s.select("station_id", text.normalise_name(F.col("station_name")).alias("name"))
    a = n.withColumnsRenamed({"station_id": "station_id_a", "name": "na"})
    b = n.withColumnsRenamed({"station_id": "station_id_b", "name": "nb"})
    return near.join(a, "station_id_a").join(b, "station_id_b").where("na = nb").select("station_id_a", "station_id_b", F.col("na").alias("name"))


def n19_line_support(spark, d):
    s = _stops(spark, d)
    routes = s.where("station_code is not null").select("train_number", F.col("seq").alias("pos"), "station_code")
    return alignment.line_support(routes, tt.coded_neighbours(s))


def n20_compare_times(spark, d):
    a = _stops(spark, d).select("train_number", "seq", "arr", "dep")
    m = table(spark, d, "stops_mirror")
    b = m.select("train_number", "seq", clock.parse_clock(F.col("arrival")).alias("arr_b"), clock.parse_clock(F.col("departure")).alias("dep_b")).distinct()
    both = F.col("dep").isNotNull() & F.col("dep_b").isNotNull()
    return a.join(b, ["train_number", "seq"]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both).alias("compared"), F.count_if(both & (F.col("dep") == F.col("dep_b"))).alias("equal"),
        F.count_if(F.abs(F.pmod(F.col("arr") - F.col("arr_b") + 720, F.lit(1440)) - 720) <= 5).alias("arr_within_5"),
    )


def n22_stale_codes(spark, d):
    old = table(spark, d, "stops").where("station_code is not null").select("station_code", text.normalise_name(F.col("station_name")).alias("name")).distinct()
    s = table(spark, d, "stations").select("code", text.normalise_name(F.col("station_name")).alias("name")).distinct()
    stale = old.join(s.select(F.col("code").alias("station_code")).distinct(), "station_code", "left_anti")
    return stale.join(s, "name").select("station_code", "name", F.col("code").alias("current_code"))


def n23_name_cascade(spark, d):
    names = table(spark, d, "stops").where("station_code is null").select(F.col("station_name").alias("name"))
    d_ = table(spark, d, "stations").select("code", F.col("station_name").alias("label"))
    n, l = text.normalise_name(F.col("name")), text.normalise_name(F.col("label"))
    return alignment.match_names(names.where("name is not null"), d_, [("exact", F.col("name"), F.col("label")), ("normal", n, l), ("joined", F.replace(n, F.lit(" "), F.lit("")), F.replace(l, F.lit(" "), F.lit("")))])


def a09_gap_clusters(spark, d):
    s = _stops(spark, d).where("station_code is not null").withColumn("at", F.coalesce("dep", "arr"))
    return alignment.gap_clusters(s, "station_code", "at", 180)


def a11_coverage(spark, d):
    s = table(spark, d, "stops")
    return s.groupBy(F.col("station_code").isNotNull().alias("coded")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("train_number").alias("trains"), F.countDistinct("station_name").alias("names"))


def h32_merged_windows(spark, d):
    s = table(spark, d, "station_stats").select(*PAIR, "window_from", "window_to")
    return alignment.merged_intervals(s, PAIR, "window_from", "window_to")


def j18_current_codes(spark, d):
    g = table(spark, d, "station_groups").select(F.explode("codes").alias("station_code"), "current_code")
    s = table(spark, d, "stops").where("station_code is not null").groupBy("station_code").agg(F.count(F.lit(1)).alias("n"))
    return s.join(g, "station_code", "left").groupBy(F.coalesce("current_code", F.upper("station_code")).alias("code")).agg(F.sum("n").alias("stops"))


def u06_drop_contained(spark, d):
    s = table(spark, d, "trains").where("classes is not null and train_type is not null").select("train_type", "classes")
    return alignment.drop_contained(s, "train_type", "classes").select("train_type", F.array_join("classes", " ").alias("classes"))


def s08_json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def o01_json_rows(spark, d):
    s = table(spark, d, "station_groups")
    return s.select("group_id", F.to_json(F.struct("group_id", "current_code")).alias("payload"))


def n12_position_agreement(spark, d):
    a = table(spark, d, "stations").where("lat between 6 and 37.5 and lon between 68 and 97.5").select("station_id", "code", "lat", "lon")
    b = _ct_positions(spark, d).where("lat between 6 and 37.5 and lon between 68 and 97.5").select("code", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("id").alias("ct_id"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, "code").select("station_id", "ct_id", (km <= 1.0).alias("agree"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] != "_" and k[1:3].isdigit() and callable(f)}

_R = "r0 as (select *, coalesce(arrival_delay_minutes, departure_delay_minutes) dl from delays where coalesce(arrival_delay_minutes, departure_delay_minutes) is not null)"
_LATEST = f"{_R}, rd as (select train_number, station_code, run_date, dl from (select *, row_number() over (partition by train_number, station_code, run_date order by received_at desc, delay_id desc) k from r0) where k = 1), rn as (select *, row_number() over (partition by train_number, station_code order by run_date desc) nth from rd)"
_R1 = "floor(({}) * 10 + 0.5) / 10"


def _pctq(c: str) -> str:
    return _R1.format(f"count(*) filter ({c}) / count(*) * 100")


_CT = "ct as (select station_code code, station_name, state_name, try_cast(trim(latitude, ' ') as double) lat, try_cast(trim(longitude, ' ') as double) lon, ct_id id from ct_stations)"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), '[().,''’\-/]', ' ', 'g'), '\s+', ' ', 'g')), '\bjunction\b', 'jn', 'g'), '\bcantonment\b', 'cantt', 'g'), '\bterminus\b', 't', 'g'), '\bterminal\b', 't', 'g'), '\broad\b', 'rd', 'g')"


def _days_sql(table_: str, key: str, col: str, bits: bool = False) -> str:
    forms = ", ".join(f"('{f}', {1 << i})" for i, n in enumerate(clock.WEEKDAYS) for f in text.DAY_FORMS[n])
    digits = "when regexp_full_match(t, '[01]{7}') then " + " + ".join(f"case when t[{i + 1}] = '1' then {1 << i} else 0 end" for i in range(7)) if bits else ""
    return f"""(with m(f, b) as (values {forms}), x as (select {key} k, trim(regexp_replace(replace(replace(lower({col}), '.', ' '), ';', ','), '\\s+', ' ', 'g'), ' ') t from {table_}),
y as (select k, t, coalesce(regexp_extract(t, '^(?:except|exc|ex)\\s+(.+)$', 1), '') e from x),
z as (select k, t, e <> '' ex, [w for w in regexp_split_to_array(case when e <> '' then e else t end, '[,\\s&]+') if w <> ''] w from y),
q as (select k, count(*) n, count(b) found, bit_or(b) mask from (select k, unnest(w) w from z) left join m on w = f group by 1)
select z.k, cast(case when t = 'daily' then 127 {digits} when t <> '' and coalesce(n, 0) = coalesce(found, 0) then case when ex then 127 - coalesce(mask, 0) else coalesce(mask, 0) end end as int) v from z left join q on z.k = q.k)"""


def _classes_sql(table_: str, key: str, col: str, ordered: bool = False) -> str:
    out = "array_to_string([c for c in ['1A', '2A', '3A', '3E', 'SL', 'FC', 'EC', 'CC', '2S'] if list_contains(w, c)], ' ')" if ordered else "array_to_string(list_sort(list_distinct([c for c in w if list_contains(['1A', '2A', '3A', '3E', 'SL', 'FC', 'EC', 'CC', '2S'], c)])), ' ')"
    return f"""(select k, case when t <> '' and array_to_string(v, '') = t then {out} end v from
(select *, [case when c in ('3A(E)', '3AE') then '3E' else c end for c in v] w from
(select k, t, regexp_extract_all(t, '3A\\(E\\)|3AE|1A|2A|3A|3E|SL|CC|EC|2S|FC|EV|EA|PC|GEN|GS|II|P') v from (select {key} k, regexp_replace(upper({col}), '[\\s,./;:-]+', '', 'g') t from {table_}))))"""


_REPORTS = f"""se as (select * from (select *, row_number() over (partition by train_number order by search_id) r from search_trains) where r = 1),
sg as (select * from (select *, row_number() over (partition by train_number order by segment_id) r from segments where train_number is not null) where r = 1),
rep as (
  select train_number, 'days' field, 'main' src, 1 prio, 'print' up, true cnt, cast({_mask('days')} as varchar) v from trains
  union all select train_number, 'classes', 'main', 1, 'print', true, array_to_string(list_sort(list_distinct(classes)), ' ') from trains
  union all select train_number, 'days', 'mirror', 2, 'operator', true, cast({_mask('days')} as varchar) from trains_mirror
  union all select train_number, 'classes', 'mirror', 2, 'operator', true, array_to_string(list_sort(list_distinct(classes)), ' ') from trains_mirror
  union all select k, 'days', 'search', 3, 'operator', true, cast(v as varchar) from {_days_sql('se', 'train_number', 'running_days', True)}
  union all select k, 'classes', 'search', 3, 'operator', true, v from {_classes_sql('se', 'train_number', 'avl_classes')}
  union all select k, 'days', 'pages', 4, 'print', false, cast(v as varchar) from {_days_sql('sg', 'train_number', 'days_raw')}
  union all select k, 'classes', 'pages', 4, 'print', false, v from {_classes_sql('sg', 'train_number', 'classes_raw')}),
rr as (select * from rep where v is not null),
gr as (select train_number, field, v, count(distinct up) filter (cnt) support, count(distinct src) filter (cnt) services, max(case when prio = 1 then 1 else 0 end) own,
  min(up) filter (cnt) up1, min(prio) first, bool_or(cnt and up = 'print') has_print, bool_or(cnt and up = 'operator') has_op from rr group by 1, 2, 3),
fl as (select train_number, field, count(*) n_values, max(v) filter (own = 1) prim, bool_or(has_print) and bool_or(has_op) two_up, max(v) any_v,
  max(support) best, count(*) filter (support >= 2) n2, max(v) filter (support >= 2) maj_v,
  max(services) filter (own = 1) own_services, count(*) filter (own = 0 and services >= 2) n_rivals, max(v) filter (own = 0 and services >= 2) rival_v,
  max(support) filter (own = 0 and services >= 2) rival_support, max(up1) filter (own = 0 and services >= 2) rival_up,
  count(*) filter (own = 0 and services > 0) n_others, max(support) filter (own = 0 and services > 0) other_support, bool_or(has_print) filter (own = 0 and services > 0) other_print,
  max(support) filter (own = 1) own_support from gr group by 1, 2),
ds as (select fl.*, exists (select 1 from gr where gr.train_number = fl.train_number and gr.field = fl.field and gr.v <> fl.rival_v and gr.services > 0 and
  case when fl.rival_up = 'print' then has_print else has_op end) dissent from fl),
fs as (select train_number, field, prim,
  case when n_values = 1 then case when two_up then 'confirmed' else 'single_source' end
       when n2 = 1 and best >= 2 then 'majority'
       when own_services = 1 and n_rivals = 1 and rival_support = 1 and rival_up <> 'print' and not dissent then 'updated'
       else 'conflict' end status,
  case when n_values = 1 then any_v when n2 = 1 and best >= 2 then maj_v
       when own_services = 1 and n_rivals = 1 and rival_support = 1 and rival_up <> 'print' and not dissent then rival_v else prim end shown, coalesce(best, 0) > 0 counted from ds)"""
_ROLL = """ro as (select train_number, case when count(*) filter (status = 'conflict') > 0 then 'conflict' when count(*) filter (counted) = 0 then 'not_checked' when count(*) filter (status = 'updated') > 0 then 'updated'
  when count(*) filter (status in ('confirmed', 'majority')) = 0 then 'single_source' when count(*) filter (status = 'single_source') > 0 then 'partially_confirmed'
  when count(*) filter (status = 'majority') > 0 then 'majority' else 'confirmed' end overall, count(*) n_fields, count(*) filter (status = 'conflict') n_conflicts from fs group by 1)"""

ORACLE = {
    "a01_station_delay_stats": f"""with {_LATEST} select train_number, station_code, count(*) runs_with_data, {_R1.format('avg(dl)')} avg_delay, {_R1.format('median(dl)')} median_delay, max(dl) max_delay,
{_pctq('dl <= 15')} pct_within_15, {_pctq('dl > 30')} pct_over_30, {_pctq('dl > 60')} pct_over_60, count(*) < 5 low_sample from rd group by 1, 2""",
    "a02_recent_window": f"with {_LATEST} select train_number, station_code, {_R1.format('avg(dl)')} recent_avg, min(run_date) recent_from, max(run_date) recent_to, count(*) recent_runs from rn where nth <= 7 group by 1, 2",
    "a01_with_gaps": f"""with {_LATEST}, st as (select train_number, station_code, count(*) n, {_R1.format('avg(dl)')} a from rd group by 1, 2),
c as (select distinct train_number, station_code from stops where station_code is not null)
select train_number, station_code, coalesce(n, 0) runs_with_data, a avg_delay, coalesce(n, 0) < 5 low_sample from c left join st using (train_number, station_code)""",
    "a04_route_core_seen": f"""with {_LATEST}, o as (select train_number, station_code, min(seq) idx from stops where station_code is not null group by 1, 2),
x as (select rd.train_number, run_date, idx from rd join o using (train_number, station_code)),
e as (select train_number, run_date, min(idx) lo, max(idx) hi from x group by 1, 2),
g as (select train_number, lo, hi, count(*) n_runs from e group by 1, 2, 3 having count(*) >= 2 and lo < hi),
c as (select train_number, lo, hi, idx, count(distinct run_date) c from x join e using (train_number, run_date) group by 1, 2, 3, 4)
select train_number, lo, hi, n_runs, coalesce(string_agg(cast(idx as varchar), ',' order by idx) filter (c = n_runs), '') core, string_agg(cast(idx as varchar), ',' order by idx) seen
from c join g using (train_number, lo, hi) group by 1, 2, 3, 4""",
    "a04_route_variants": f"""with {_LATEST}, o as (select train_number, station_code, min(seq) idx from stops where station_code is not null group by 1, 2),
x as (select distinct train_number, cast(date_trunc('month', run_date) as date) dy, idx from rd join o using (train_number, station_code) join (select train_number, max(idx) "last" from o group by 1) using (train_number)
  where case when month(run_date) <= 6 then 3 * idx <= 2 * "last" else 3 * idx > "last" end),
ru as (select train_number, dy, min(idx) lo, max(idx) hi, list(idx) s from x group by 1, 2),
ro as (select train_number t, lo, hi, count(*) n, min(dy) f, max(dy) l from ru where lo < hi group by 1, 2, 3 having count(*) >= 2),
ct as (select ro.t, ro.lo, ro.hi, ro.n, idx, count(*) c from ro join ru on t = train_number and ro.lo = ru.lo and ro.hi = ru.hi join x using (train_number, dy) group by 1, 2, 3, 4, 5),
rs as (select ro.*, core, seen from ro join (select t, lo, hi, coalesce(list(idx) filter (c = n), []) core, list(idx) seen from ct group by 1, 2, 3) using (t, lo, hi)),
lo as (select ru.* from ru anti join ro on t = train_number and ro.lo = ru.lo and ro.hi = ru.hi),
pr as (select a.t, [i for i in a.core if not list_contains(b.seen, i)] ma, [i for i in b.core if not list_contains(a.seen, i)] mb, a.f <= b.l and b.f <= a.l meet from rs a join rs b on a.t = b.t and (a.lo, a.hi) < (b.lo, b.hi)),
ok as (select distinct t from pr where t not in (select t from pr where len(ma) = 0 or len(mb) = 0 or meet)
  and t not in (select t from pr join lo on t = train_number where list_has_any(s, ma) and list_has_any(s, mb))),
g as (select rs.* from rs join ok using (t)),
fit as (select train_number, dy, count(*) filter (lo.lo >= g.lo and lo.hi <= g.hi) n_fit, max(g.lo) filter (lo.lo >= g.lo and lo.hi <= g.hi) flo, max(g.hi) filter (lo.lo >= g.lo and lo.hi <= g.hi) fhi,
  bool_or(lo.lo >= g.lo and lo.hi <= g.hi and list_has_all(seen, s)) known, bool_or(not (lo.lo >= g.lo and lo.hi <= g.hi) and dy between f and l) elsewhere from lo join g on t = train_number group by 1, 2),
fa as (select *, n_fit = 1 and known and not elsewhere good from fit),
fin as (select t, g.lo, g.hi, least(f, min(dy)) first_run, greatest(l, max(dy)) last_run, cast(n + count(dy) as int) runs, cast(coalesce(max(rest), 0) as int) unassigned
  from g left join fa on t = train_number and flo = lo and fhi = hi and good left join (select train_number tn, count(*) filter (not good) rest from fa group by 1) on tn = t group by t, g.lo, g.hi, f, l, n)
select t train_number, lo, hi, first_run, last_run, runs, unassigned from fin
where t not in (select a.t from fin a join fin b on a.t = b.t and (a.lo, a.hi) <> (b.lo, b.hi) and a.first_run <= b.last_run and b.first_run <= a.last_run)""",
    "n10_merged_visits": f"""with m as (select train_number, 0 k, dep from (select distinct train_number, {_min('departure')} dep from stops) where dep is not null union all
select train_number, 1, dep from (select distinct train_number, {_min('departure')} dep from stops_mirror) where dep is not null),
v as (select *, row_number() over (partition by train_number, k order by dep) - 1 visit, count(*) over (partition by train_number, k) n from m),
a as (select * from v where k = 0), b as (select * from v where k = 1),
p as (select a.train_number, a.visit va, b.visit vb from a join b on a.train_number = b.train_number and case when a.n = b.n then a.visit = b.visit else a.dep = b.dep end)
select a.train_number, 'main' "source", cast(visit as int) visit, dep, case when vb is null then '' else 'mirror' end "matched" from a left join p on a.train_number = p.train_number and visit = va
union all select b.train_number, 'mirror', cast(visit as int), dep, '' from b left join p on b.train_number = p.train_number and visit = vb where vb is null""",
    "v17_cross_check": f"""with {_R}, rd as (select * from (select *, row_number() over (partition by train_number, station_code, provider, run_date order by received_at desc, delay_id desc) k from r0) where k = 1),
rn as (select *, row_number() over (partition by train_number, station_code, provider order by run_date desc) nth from rd),
f as (select train_number, station_code, provider, {_R1.format('avg(dl)')} v, cast(max(run_date) as date) - cast(min(run_date) as date) span from rn where nth <= 7 group by 1, 2, 3),
g as (select train_number, station_code, max(v) filter (provider = 'runlog') mine, count(v) filter (provider <> 'runlog') n_others, min(v) filter (provider <> 'runlog') lo, max(v) filter (provider <> 'runlog') hi, max(span) span from f group by 1, 2)
select train_number, station_code, mine, n_others, case when mine is null then 'not_checked' when n_others = 0 then 'single_source' when span > 14 then 'not_comparable' when hi - mine <= 10 and mine - lo <= 10 then 'corroborated' else 'conflict' end status from g""",
    "j10_parse_classes": f"select k segment_id, v classes from {_classes_sql('segments', 'segment_id', 'classes_raw', True)}",
    "j11_parse_days": f"select k segment_id, v mask from {_days_sql('segments', 'segment_id', 'days_raw')}",
    "v01_field_status": f"with {_REPORTS} select train_number, field, status, shown from fs",
    "v05_overall_rollup": f"with {_REPORTS}, {_ROLL} select * from ro",
    "v13_corrections": f"with {_REPORTS} select train_number, field, prim as \"primary\", shown from fs where status in ('majority', 'updated') and prim is not null and shown <> prim",
    "a07_weakest": f"""with {_REPORTS}, {_ROLL}, t as (select distinct train_number, train_type from trains)
select train_type, {evidence.STRENGTH}[min(list_position({evidence.STRENGTH}, overall))] weakest, count(*) n from ro join t using (train_number) group by 1""",
    "v12_copied_coordinates": f"with {_CT}, p as (select code, lat, lon from stations union all select code, lat, lon from ct) select code, count(distinct case when lat * 100 <> round(lat * 100) or lon * 100 <> round(lon * 100) then (lat, lon) end) independent, count(*) reported from p where code is not null and lat is not null and lon is not null group by 1",
    "n08_priority_dedupe": f"""with {_CT}, p as (select code, station_name, lat, lon, 1 src, station_id id from stations union all select code, station_name, lat, lon, 2, id from ct)
select code, station_name, lat, lon, src from (select *, row_number() over (partition by code order by src, id) r from p where code is not null and lat is not null and lon is not null) where r = 1""",
    "n09_fill_gaps": f"""with {_CT}, o as (select * from (select *, row_number() over (partition by code order by id) r from ct where code is not null) where r = 1)
select station_id, s.code, coalesce(s.state_name, o.state_name) state_name, case when s.lat is null or s.lon is null then o.lat else s.lat end lat, case when s.lat is null or s.lon is null then o.lon else s.lon end lon,
array_to_string([x for x in [case when s.state_name is null and o.state_name is not null then 'state_name:ct' end, case when (s.lat is null or s.lon is null) and o.lat is not null and o.lon is not null then 'position:ct' end] if x is not null], ',') filled
from stations s left join o on s.code = o.code""",
    "n14_pair_offset": f"""with {S}, a as (select train_number, station_code, min(coalesce(dep, arr)) x from s0 where station_code is not null and coalesce(dep, arr) is not null group by 1, 2 having count(*) = 1),
m as (select distinct train_number, seq, station_code, {_min('coalesce(departure, arrival)')} y from stops_mirror),
b as (select train_number, station_code, min(y) y from m where station_code is not null and y is not null group by 1, 2 having count(*) = 1),
c as (select train_number, x - y o, count(*) n from a join b using (train_number, station_code) group by 1, 2)
select train_number, "offset", n, total, n * 2 > total strict from (select train_number, o "offset", n, cast(sum(n) over (partition by train_number) as bigint) total, row_number() over (partition by train_number order by n desc, abs(o), o) r from c) where r = 1""",
    "n16_slot_alignment": f"""with {S}, a as (select train_number, seq pos, station_code from s0 where station_code is not null), b as (select distinct train_number, seq pos, station_code from stops_mirror where station_code is not null),
k as (select * from (select train_number, station_code, min(pos) pa from a group by 1, 2) join (select train_number, station_code, min(pos) pb from b group by 1, 2) using (train_number, station_code)),
m as (select a.train_number, a.pos, a.station_code, pa, case when a.pos = pa then pb end h from a left join k using (train_number, station_code)),
sl as (select *, max(h) over (partition by train_number order by pos rows between unbounded preceding and 1 preceding) lo, min(h) over (partition by train_number order by pos rows between 1 following and unbounded following) hi from m),
lone as (select train_number, lo, hi, min(pos) pos_a, min(station_code) code_a from sl where pa is null and lo < hi group by 1, 2, 3 having count(*) = 1),
free as (select train_number, pos pos_b, station_code code_b from b anti join k using (train_number, station_code))
select lone.train_number, pos_a, code_a, min(pos_b) pos_b, min(code_b) code_b from lone join free on lone.train_number = free.train_number and pos_b > lo and pos_b < hi group by 1, 2, 3 having count(*) = 1""",
    "n18_grid_near_duplicates": f"""with p as (select station_id id, lat, lon, radians(lat) y, radians(lon) x, {_NORM.format(c='station_name')} nm from stations where lat between 6 and 37.5 and lon between 68 and 97.5)
select a.id station_id_a, b.id station_id_b, a.nm as "name" from p a join p b on a.nm = b.nm and a.id < b.id
where 2 * 6371 * asin(least(1.0, sqrt(pow(sin((b.y - a.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((b.x - a.x) / 2), 2)))) <= 1.0""",
    "n19_line_support": f"""with {S}, nb as (select *, last_value(station_code ignore nulls) over (partition by train_number order by seq rows between unbounded preceding and 1 preceding) before,
first_value(station_code ignore nulls) over (partition by train_number order by seq rows between 1 following and unbounded following) after from s0),
g as (select distinct before, after from nb where station_code is null and before is not null and after is not null and before <> after),
f as (select train_number, station_code, min(seq) pos from s0 where station_code is not null group by 1, 2)
select before, after, m.station_code code, count(distinct m.train_number) n from g join f p on p.station_code = before join f q on q.station_code = after and q.train_number = p.train_number
join f m on m.train_number = p.train_number and m.pos > least(p.pos, q.pos) and m.pos < greatest(p.pos, q.pos) group by 1, 2, 3""",
    "n20_compare_times": f"""with {S}, b as (select distinct train_number, seq, {_min('arrival')} ab, {_min('departure')} db from stops_mirror)
select count(*) n, count(*) filter (dep is not null and db is not null) compared, count(*) filter (dep = db) "equal", count(*) filter (abs((((arr - ab + 720) % 1440) + 1440) % 1440 - 720) <= 5) arr_within_5 from s0 join b using (train_number, seq)""",
    "n22_stale_codes": f"""with o as (select distinct station_code, {_NORM.format(c='station_name')} nm from stops where station_code is not null), s as (select distinct code, {_NORM.format(c='station_name')} nm from stations)
select station_code, o.nm as "name", code current_code from o join s on o.nm = s.nm where station_code not in (select code from stations where code is not null)""",
    "n23_name_cascade": f"""with n as (select distinct station_name nm, {_NORM.format(c='station_name')} k2 from stops where station_code is null and station_name is not null),
d as (select code, station_name k1, {_NORM.format(c='station_name')} k2 from stations where code is not null),
d1 as (select k1, min(code) code, count(distinct code) c from d where k1 <> '' group by 1), d2 as (select k2, min(code) code, count(distinct code) c from d where k2 <> '' group by 1),
d3 as (select replace(k2, ' ', '') k3, min(code) code, count(distinct code) c from d where k2 <> '' group by 1)
select nm as "name", case when d1.c is not null then case when d1.c = 1 then d1.code end when d2.c is not null then case when d2.c = 1 then d2.code end when d3.c = 1 then d3.code end code,
case when d1.c is not null then case when d1.c = 1 then 'exact' else 'ambiguous' end when d2.c is not null then case when d2.c = 1 then 'normal' else 'ambiguous' end
when d3.c is not null then case when d3.c = 1 then 'joined' else 'ambiguous' end else 'none' end how
from n left join d1 on n.nm = d1.k1 left join d2 on n.k2 = d2.k2 left join d3 on replace(n.k2, ' ', '') = d3.k3""",
    "a09_gap_clusters": f"""with {S}, x as (select station_code, coalesce(dep, arr) t, count(*) c from s0 where station_code is not null and coalesce(dep, arr) is not null group by 1, 2),
y as (select *, case when t - lag(t) over (partition by station_code order by t) > 180 then 1 else 0 end cut from x),
z as (select *, cast(sum(cut) over (partition by station_code order by t) as int) k from y)
select station_code, k as "cluster", min(t) as "first", max(t) as "last", cast(sum(c) as bigint) n, count(*) as "values" from z group by 1, 2""",
    "a11_coverage": "select station_code is not null coded, count(*) n, count(distinct train_number) trains, count(distinct station_name) as \"names\" from stops group by 1",
    "h32_merged_windows": """with x as (select train_number, station_code, window_from, window_to, max(window_to) over (partition by train_number, station_code order by window_from, window_to rows between unbounded preceding and 1 preceding) b from station_stats),
y as (select *, sum(case when window_from > b then 1 else 0 end) over (partition by train_number, station_code order by window_from, window_to rows between unbounded preceding and current row) p from x)
select train_number, station_code, min(window_from) window_from, max(window_to) window_to, count(*) n from y group by train_number, station_code, p""",
    "j18_current_codes": "with g as (select unnest(codes) sc, current_code from station_groups), s as (select station_code, count(*) n from stops where station_code is not null group by 1) select coalesce(current_code, upper(station_code)) code, cast(sum(n) as bigint) stops from s left join g on sc = station_code group by 1",
    "u06_drop_contained": """with s as (select distinct train_type, list_sort(list_distinct(classes)) c from trains where classes is not null and train_type is not null)
select train_type, array_to_string(c, ' ') classes from s where not exists (select 1 from s o where o.train_type = s.train_type and len(o.c) > len(s.c) and list_has_all(o.c, s.c))""",
    "s08_json_props": "select cast(json_extract(props, '$.k') as int) k, count(*) n from events group by 1",
    "o01_json_rows": "select group_id, '{\"group_id\":' || group_id || case when current_code is null then '' else ',\"current_code\":\"' || current_code || '\"' end || '}' payload from station_groups",
    "n12_position_agreement": f"""with {_CT} select station_id, id ct_id, 2 * 6371 * asin(least(1.0, sqrt(pow(sin((radians(c.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(s.lon)) / 2), 2)))) <= 1.0 agree
from stations s join ct c on s.code = c.code where s.lat between 6 and 37.5 and s.lon between 68 and 97.5 and c.lat between 6 and 37.5 and c.lon between 68 and 97.5""",
}
