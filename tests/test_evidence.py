import datetime

import pytest
from pyspark.sql import functions as F

from loopline.operators import evidence, punctuality

SCHEMA = "item string, field string, source string, prio int, upstream string, counted boolean, value string"


def settled(spark, reports, **kw):
    """reports: (upstream, value) in priority order, upstream starting with '-' is not counted."""
    rows = [("i", "f", f"s{n}", n, u.strip("-"), not u.startswith("-"), v) for n, (u, v) in enumerate(reports, 1)]
    r = evidence.settle(spark.createDataFrame(rows, SCHEMA), ["item", "field"], **kw).first()
    return r and (r["status"], r["shown"])


@pytest.mark.parametrize("reports, want", [
    ([("p", "1"), ("o", "1")], ("confirmed", "1")),
    ([("p", "1"), ("p", "1")], ("single_source", "1")),
    ([("p", "1"), ("-o", "1")], ("single_source", "1")),
    ([("p", "1"), ("o", None)], ("single_source", "1")),
    ([("p", "1"), ("o", "2")], ("conflict", "1")),
    ([("p", "1"), ("o", "2"), ("x", "2")], ("majority", "2")),
    ([("p", "1"), ("o", "2"), ("o", "2")], ("updated", "2")),
    ([("p", "1"), ("o", "2"), ("o", "2"), ("o", "3")], ("conflict", "1")),
    ([("p", "1"), ("p", "2"), ("p", "2")], ("conflict", "1")),
    ([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], ("conflict", "1")),
    ([("a", "1"), ("b", "1"), ("c", "2")], ("majority", "1")),
    ([("p", None)], None),
])
def test_settle(spark, reports, want):
    assert settled(spark, reports) == want


def test_settle_options(spark):
    assert settled(spark, [("p", "1"), ("o", "2"), ("x", "2")], applies=False) == ("conflict", "1")
    mirror = [("o", "1"), ("o", "1"), ("p", "2")]
    assert settled(spark, mirror) == ("conflict", "1")
    assert settled(spark, mirror, operational=True) == ("updated", "1")


def test_roll_up_and_weakest(spark):
    df = spark.createDataFrame([("a", "confirmed"), ("a", "single_source"), ("b", "confirmed"), ("b", "conflict"), ("c", "majority"), ("c", "confirmed")], "item string, status string")
    got = {r["item"]: r["overall"] for r in evidence.roll_up(df, ["item"]).collect()}
    assert got == {"a": "partially_confirmed", "b": "conflict", "c": "majority"}
    assert df.agg(evidence.weakest(F.col("status")).alias("w")).first()["w"] == "conflict"


def test_tolerance_is_not_transitive(spark):
    g = spark.range(1).select(evidence.tolerant_groups(F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0)), 2.0).alias("g")).first()["g"]
    assert g == [[0.0, 2.0], [4.0]]
    g = spark.range(1).select(evidence.tolerant_groups(F.array(F.lit(2.0), F.lit(0.0), F.lit(4.0)), 2.0).alias("g")).first()["g"]
    assert g == [[2.0, 0.0, 4.0]]


def test_merge_visits(spark):
    rides = spark.createDataFrame([("1", "a", 10), ("1", "a", 20), ("1", "b", 20), ("2", "b", 5), ("3", "a", 1), ("3", "b", 2)], "train_number string, source string, dep int")
    got = sorted((r["train_number"], r["source"], r["dep"], tuple(r["matched"])) for r in evidence.merge_visits(rides, ["a", "b"]).collect())
    assert got == [("1", "a", 10, ()), ("1", "a", 20, ("b",)), ("2", "b", 5, ()), ("3", "a", 1, ("b",))]


def test_route_variants(spark):
    day = lambda n: datetime.date(2026, 1, n)
    rows = [("1", day(n), c) for n in (1, 2) for c in "ABC"] + [("1", day(n), c) for n in (5, 6) for c in "ADE"] + [("1", day(7), "D")]
    r = spark.createDataFrame(rows, "train_number string, run_date date, station_code string")
    o = spark.createDataFrame([("1", c, i) for i, c in enumerate("ABCDE")], "train_number string, station_code string, idx int")
    got = [(x["lo"], x["hi"], x["runs"], x["unassigned"]) for x in punctuality.route_variants(r, o).collect()]
    assert got == [(0, 2, 2, 0), (0, 4, 3, 0)]
    mixed = r.union(spark.createDataFrame([("1", day(3), c) for c in "BD"], r.schema))
    assert punctuality.route_variants(mixed, o).count() == 0


def test_cross_check(spark):
    rows = [("a", "x", 5.0, 6), ("a", "y", 15.0, None), ("b", "x", 5.0, 6), ("b", "y", 15.1, None), ("c", "x", None, None), ("c", "y", 1.0, None), ("d", "x", 1.0, 3), ("e", "x", 1.0, 15), ("e", "y", 1.0, None)]
    f = spark.createDataFrame(rows, "k string, source string, value double, span int")
    got = {r["k"]: r["status"] for r in punctuality.cross_check(f, "x", ["k"]).collect()}
    assert got == {"a": "corroborated", "b": "conflict", "c": "not_checked", "d": "single_source", "e": "not_comparable"}


def test_uncounted_items_are_not_checked(spark):
    f = spark.createDataFrame([("a", "single_source", False), ("b", "single_source", False), ("b", "single_source", True), ("c", "conflict", False)], "item string, status string, counted boolean")
    assert {r["item"]: r["overall"] for r in evidence.roll_up(f, ["item"]).collect()} == {"a": "not_checked", "b": "single_source", "c": "conflict"}


def test_dependent_positions_are_no_evidence(spark):
    p = spark.createDataFrame([("a", 1, 1.0, 2.0, False), ("a", 2, 1.0, 2.0, True), ("a", 3, 1.0, 2.0, True), ("a", 4, 5.0, 2.0, True)], "code string, prio int, lat double, lon double, independent boolean")
    assert {r["prio"]: r["counted"] for r in evidence.copied_positions(p, ["code"]).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_merge_three_sources(spark):
    rides = [("1", "a", 10), ("1", "b", 11), ("1", "c", 10), ("1", "c", 11), ("2", "b", 5), ("2", "b", 5), ("2", "c", 5)]
    df = spark.createDataFrame(rides, "train_number string, source string, dep int")
    got = sorted((r["train_number"], r["source"], r["visit"], tuple(r["matched"]), tuple(r["missing"])) for r in evidence.merge_visits(df, ["a", "b", "c"]).collect())
    assert got == [("1", "a", 0, ("b", "c"), ()), ("1", "c", 1, (), ("a", "b")), ("2", "b", 0, ("c",), ("a",)), ("2", "b", 1, (), ("a", "c"))]
    assert evidence.merge_visits(df.limit(0), ["a", "b"]).count() == 0
