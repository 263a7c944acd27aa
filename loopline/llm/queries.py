"""The matching, canonical-name and corpus queries (problems 1, 2, 4, 5, 8, 9, 10) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopline.llm import canonical, components, leaks, matching, percentiles, spam, tokenizer
from loopline.session import table

PCTS = [50, 90, 95, 99]


#: Positions outside the country are unusable: south, north, west, east.
COUNTRY = (6.0, 37.5, 68.0, 97.5)


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the two station lists with their confidence and field scores."""
    a = table(spark, d, "stations").select(F.col("station_id").alias("id"), "code", F.col("station_name").alias("name"), F.col("state_name").alias("state"), "lat", "lon")
    b = table(spark, d, "ct_stations").select(
        F.col("ct_id").alias("id"), F.col("station_code").alias("code"), F.col("station_name").alias("name"),
        F.col("state_name").alias("state"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )
    m = matching.match(a, b, COUNTRY)
    return m.withColumnsRenamed({"id_a": "station_id", "id_b": "ct_id"})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of the two station lists for the same physical station."""
    return p1_matches(spark, d).select("station_id", "ct_id")


def _group_names(spark: SparkSession, d: str) -> DataFrame:
    """Reference names with the number of coded stops of each group as its uses."""
    groups = table(spark, d, "station_groups")
    stops = table(spark, d, "stops").where("station_code is not null").groupBy("station_code").count()
    uses = (
        groups.select("group_id", F.explode("codes").alias("station_code")).join(stops, "station_code")
        .groupBy("group_id").agg(F.sum("count").alias("uses"))
    )
    names = groups.select("group_id", F.explode("names").alias("name"))
    return names.join(uses, "group_id", "left").select(F.col("group_id").alias("entry"), "name", "uses")


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stops = table(spark, d, "stops").where("station_code is null")
    found = canonical.lookup(stops.select(F.col("station_name").alias("typed")), _group_names(spark, d))
    rivals = table(spark, d, "stations").select(F.col("station_name").alias("name"))
    return stops, canonical.without_rivals(found, rivals)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Uncoded stops with the station group their typed name means."""
    stops, found = _typed(spark, d)
    hits = found.where("entry is not null").select("typed", F.col("entry").alias("group_id"))
    return stops.join(hits, stops["station_name"] == hits["typed"]).select("stop_id", "group_id")


def p2_misses(spark: SparkSession, d: str) -> DataFrame:
    """Typed names of uncoded stops that mean no station group, with the rows that hold them."""
    stops, found = _typed(spark, d)
    misses = found.where("entry is null").select("typed", "base", "qualifier")
    counts = stops.groupBy("station_name").agg(F.count(F.lit(1)).alias("n_stops"))
    return counts.join(misses, F.col("station_name").eqNullSafe(F.col("typed"))).select("station_name", "base", "qualifier", "n_stops")


METRICS = {"arrival_delay_minutes": "delays", "median_delay_minutes": "station_stats", "pct_within_15_min": "station_stats"}


def _summary(spark: SparkSession, d: str, by: list) -> DataFrame:
    parts = []
    for metric, name in METRICS.items():
        day = F.col("run_date" if name == "delays" else "window_from").alias("day")
        rows = table(spark, d, name).select(F.lit(metric).alias("metric"), "station_code", day, F.col(metric).cast("double").alias("x"))
        parts.append(rows)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return percentiles.summarise(rows, by, F.col("x"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile of three columns per station."""
    by = ["metric", "station_code"]
    return percentiles.percentiles(_summary(spark, d, by), by, PCTS)


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles from the summaries of separate months, merged."""
    by = ["metric", "station_code"]
    rows = None
    for metric, name in METRICS.items():
        day = "run_date" if name == "delays" else "window_from"
        part = table(spark, d, name).select(F.lit(metric).alias("metric"), "station_code", F.trunc(F.col(day).cast("date"), "month").alias("month"), F.col(metric).cast("double").alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    monthly = percentiles.summarise(rows, [*by, "month"], F.col("x"))
    return percentiles.percentiles(percentiles.merge(monthly, by=by), by, PCTS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every code of an accepted pair with the least code of its group."""
    clean = lambda c: F.upper(F.trim(F.col(c), F.lit(" \t\r\n ")))
    pairs = table(spark, d, "code_pairs").where("verdict = 'accepted'").select(clean("code_a").alias("a"), clean("code_b").alias("b")).where("a <> '' and b <> ''")
    return components.components(pairs, "a", "b").select(F.col("vertex").alias("code"), F.col("component").alias("group_code"))


def g03_union_find_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of linked codes with their size; one that holds several current codes is rejected."""
    found = p5_found(spark, d)
    current = table(spark, d, "station_groups").select(F.col("current_code").alias("code"), F.lit(1).alias("now")).distinct()
    g = found.join(current, "code", "left").groupBy("group_code").agg(F.count(F.lit(1)).alias("size"), F.count("now").alias("current_codes"))
    return g.withColumn("verdict", F.when(F.col("current_codes") > 1, "rejected").otherwise("kept"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by the byte_bpe_50k vocabulary."""
    return tokenizer.encode(table(spark, d, "documents"), ["doc_id"], "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding a passage of an evaluation item, with the item."""
    found = leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose text is keyword repetition, links or tags."""
    return spam.find_spam(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_matches": p1_matches,
    "p2_found": p2_found, "p2_misses": p2_misses,
    "p4_percentiles": p4_percentiles, "p4_combined": p4_combined,
    "p5_found": p5_found, "g03_union_find_groups": g03_union_find_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

_P4 = """
with x as (
  select 'arrival_delay_minutes' metric, station_code, cast(arrival_delay_minutes as double) v from delays
  union all select 'median_delay_minutes', station_code, median_delay_minutes from station_stats
  union all select 'pct_within_15_min', station_code, pct_within_15_min from station_stats),
r as (select metric, station_code, v, row_number() over (partition by metric, station_code order by v) i,
      count(*) over (partition by metric, station_code) n from x where v is not null)
select metric, station_code, n, """ + ", ".join(f"max(v) filter (i = (n * {p} + 99) // 100) p{p}" for p in PCTS) + """
from r group by metric, station_code, n"""

_P5 = r"""
with recursive e as (
  select upper(trim(code_a, e' \t\r\n ')) a, upper(trim(code_b, e' \t\r\n ')) b from code_pairs
  where verdict = 'accepted' and trim(code_a, e' \t\r\n ') <> '' and trim(code_b, e' \t\r\n ') <> ''),
s as (select a, b from e union select b, a from e),
r as (select a code, a seen from s union select r.code, s.b from r join s on s.a = r.seen)"""

ORACLE = {
    "p4_percentiles": _P4,
    "p4_combined": _P4,
    "p5_found": _P5 + " select code, min(seen) group_code from r group by code",
    "g03_union_find_groups": _P5 + """, f as (select code, min(seen) g from r group by code)
select g group_code, count(*) size, count(current_code) current_codes, case when count(current_code) > 1 then 'rejected' else 'kept' end verdict
from f left join (select distinct current_code from station_groups) on code = current_code group by g""",
}
