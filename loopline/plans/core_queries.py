"""The general data-quality queries (problems 3, 6 and 7) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopline.functions import clock
from loopline.operators.nearby import pairs_within
from loopline.operators.packed import split_values
from loopline.operators.reconcile import differences, set_text
from loopline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences between trains and trains_mirror and between stops and stops_mirror."""
    def sides(name):
        return F.col(name), F.col(name)

    def minutes(name):
        c = F.coalesce(clock.parse_clock(F.col(name)).cast("string"), F.trim(F.col(name)))
        return c, c

    trains = differences(
        table(spark, d, "trains"), table(spark, d, "trains_mirror"),
        {"train_number": sides("train_number"), "seq": (F.lit(0), F.lit(0))},
        {k: (set_text(F.col(k)), set_text(F.col(k))) for k in ("days", "classes")},
    )
    stops = differences(
        table(spark, d, "stops"), table(spark, d, "stops_mirror"),
        {"train_number": sides("train_number"), "seq": sides("seq")},
        {"arrival": minutes("arrival"), "departure": minutes("departure")},
    )
    return trains.select(F.lit("trains").alias("tbl"), "*").unionByName(stops.select(F.lit("stops").alias("tbl"), "*"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of positioned stations at most 1 km apart."""
    s = table(spark, d, "stations").where("lat between 6 and 37.5 and lon between 68 and 97.5")
    return pairs_within(s, "station_id", "lat", "lon", 1.0).select("station_id_a", "station_id_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value packed in the four raw fields of search_trains and segments."""
    def long(name, key, fields):
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])
        return table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.explode(pairs).alias("f")).select("tbl", "row_id", "f.*")

    raw = long("search_trains", "search_id", ["running_days", "avl_classes"]).unionByName(
        long("segments", "segment_id", ["days_raw", "classes_raw"])
    )
    return split_values(raw, ["tbl", "row_id", "field"], "raw")


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p7_found": p7_found}

_MIN = "cast(split_part({c}, ':', 1) as int) * 60 + cast(split_part({c}, ':', 2) as int)"

ORACLE = {
    "p3_found": f"""
with tm as (select distinct train_number k, list_sort(list_distinct(days)) as dd, list_sort(list_distinct(classes)) as cc from trains),
tr as (select distinct train_number k, list_sort(list_distinct(days)) as dd, list_sort(list_distinct(classes)) as cc from trains_mirror),
sm as (select distinct train_number k, seq, {_MIN.format(c='arrival')} a, {_MIN.format(c='departure')} d from stops),
sr as (select distinct train_number k, seq, {_MIN.format(c='arrival')} a, {_MIN.format(c='departure')} d from stops_mirror)
select 'trains' tbl, k train_number, cast(0 as int) seq, 'days' field from tm join tr using (k) where tm.dd is distinct from tr.dd
union all select 'trains', k, 0, 'classes' from tm join tr using (k) where tm.cc is distinct from tr.cc
union all select 'trains', k, 0, 'missing_in_mirror' from tm anti join tr using (k)
union all select 'trains', k, 0, 'missing_in_main' from tr anti join tm using (k)
union all select 'stops', k, seq, 'arrival' from sm join sr using (k, seq) where sm.a is distinct from sr.a
union all select 'stops', k, seq, 'departure' from sm join sr using (k, seq) where sm.d is distinct from sr.d
union all select 'stops', k, seq, 'missing_in_mirror' from sm anti join sr using (k, seq)
union all select 'stops', k, seq, 'missing_in_main' from sr anti join sm using (k, seq)""",
    "p6_found": """
with p as (select station_id id, lat, lon, radians(lat) y, radians(lon) x from stations where lat between 6 and 37.5 and lon between 68 and 97.5)
select a.id station_id_a, b.id station_id_b from p a join p b
on a.id < b.id and abs(a.lat - b.lat) < 0.01
where 2 * 6371 * asin(least(1.0, sqrt(pow(sin((b.y - a.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((b.x - a.x) / 2), 2)))) <= 1.0""",
    "p7_found": r"""
with raw as (
  select 'search_trains' tbl, search_id row_id, 'running_days' field, running_days raw from search_trains
  union all select 'search_trains', search_id, 'avl_classes', avl_classes from search_trains
  union all select 'segments', segment_id, 'days_raw', days_raw from segments
  union all select 'segments', segment_id, 'classes_raw', classes_raw from segments),
tok as (select tbl, row_id, field, regexp_extract_all(raw, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[\p{L}\p{N}]+') t from raw where raw is not null),
one as (select tbl, row_id, field, unnest(t) v, generate_subscripts(t, 1) i from tok),
many as (select tbl, row_id, field, i, case
    when v[1] = '"' then [replace(v[2:-2], '""', '"')]
    when v[1] = '''' then [replace(v[2:-2], '''''', '''')]
    when regexp_full_match(v, '[01]{7}') then regexp_extract_all(v, '[01]')
    when regexp_full_match(v, '(1A|2A|3A|3E|SL|FC|EC|CC|2S)+') then regexp_extract_all(v, '1A|2A|3A|3E|SL|FC|EC|CC|2S')
    else [v] end vs from one),
flat as (select tbl, row_id, field, i, unnest(vs) val, generate_subscripts(vs, 1) j from many)
select tbl, row_id, field, cast(row_number() over (partition by tbl, row_id, field order by i, j) as int) pos, val from flat where trim(val) <> ''""",
}
