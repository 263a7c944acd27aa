import random
from math import asin, cos, radians, sin, sqrt

from pyspark.sql import functions as F

from loopline.operators.nearby import pairs_within
from loopline.operators.packed import resolve, split_values
from loopline.operators.reconcile import differences, set_text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def diff(a, b):
    c = lambda n: (F.col(n), F.col(n))
    return rows(differences(a, b, {"k": c("k")}, {"x": c("x"), "y": (set_text(F.col("y")), set_text(F.col("y")))}))


def test_differences(spark):
    schema = "k string, x int, y array<string>, field string"
    a = spark.createDataFrame([("a", 1, ["p", "q"], "z"), ("a", 1, ["p", "q"], "z"), ("b", None, None, None), ("c", 1, [], None), (None, 5, None, None), ("d", 1, None, None)], schema)
    b = spark.createDataFrame([("a", 1, ["q", "p", "p"], "other"), ("b", None, None, None), ("c", 2, None, None), (None, 6, None, None), ("e", 1, None, None)], schema)
    assert sorted(diff(a, b), key=str) == sorted([("c", "x"), ("c", "y"), (None, "x"), ("d", "missing_in_mirror"), ("e", "missing_in_main")], key=str)
    empty = spark.createDataFrame([], schema)
    assert diff(empty, empty) == []
    assert diff(empty, b.where("k = 'e'")) == [("e", "missing_in_main")]
    two = spark.createDataFrame([("a", 1, None, None), ("a", 2, None, None)], schema)
    assert diff(two, two.where("x = 1")) == [("a", "x")]


def km(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * asin(min(1, sqrt(h)))


def test_pairs_within_equals_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, 20 + rnd.random() / 8, 75 + rnd.random() / 8) for i in range(400)]
    pts += [(1000 + i, 20.05, 75.05) for i in range(30)] + [(2000, None, 75.0), (2001, float("nan"), 75.0), (1000, 20.05, 75.05)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double").withColumn("strip", F.lit("clash"))
    good = {p[0]: p[1:] for p in pts if p[1] is not None and p[1] == p[1]}
    want = sorted((a, b) for a in good for b in good if a < b and km(good[a], good[b]) <= 1.0)
    for strip in (5000, 40):
        got = pairs_within(df, "id", "lat", "lon", 1.0, per_tile=strip)
        assert sorted((r["id_a"], r["id_b"]) for r in got.collect()) == want
    assert pairs_within(df.limit(0), "id", "lat", "lon", 1.0).count() == 0


def test_pairs_across_the_meridian_and_near_the_pole(spark):
    rnd = random.Random(6)
    pts = [(i, -10 + rnd.random() / 5, ((180 + (rnd.random() - 0.5) / 3 + 180) % 360) - 180) for i in range(300)]
    pts += [(400 + i, 89.2 + rnd.random() / 2, rnd.random() * 360 - 180) for i in range(60)] + [(900, 91.0, 0.0), (901, 0.0, 181.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    want = sorted((a[0], b[0]) for a in pts[:-2] for b in pts[:-2] if a[0] < b[0] and km(a[1:], b[1:]) <= 4.0)
    got = sorted((r["id_a"], r["id_b"]) for r in pairs_within(df, "id", "lat", "lon", 4.0, per_tile=20).collect())
    assert got == want


def test_split_values(spark):
    raw = ["1A, \"GEN / II\"; SL", "FC2A'3A (E)'", "\"Sat \"\"fog\"\" list\"+1", "0110000", " ; ,", None, "", "it's", "'' \" \" x", "SLsl", "é1 ü", "A" * 5000 + ",B", "x\ty\nz"]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string").withColumn("pos", F.lit(1)).withColumn("places", F.lit(2))
    got: dict = {}
    for r in sorted(split_values(df, ["id"], "raw").collect(), key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["val"])
    for few in ({"most_rules": 2}, {"most_rules": 0}, {"longest_rule": 3}):
        assert rows(split_values(df, ["id"], "raw", **few)) == rows(split_values(df, ["id"], "raw"))
    assert got == {
        0: ["1A", "GEN / II", "SL"], 1: ["FC", "2A", "3A (E)"], 2: ['Sat "fog" list', "1"], 3: list("0110000"), 7: ["it", "s"], 8: ["x"],
        9: ["SLsl"], 10: ["é1", "ü"], 11: ["A" * 5000, "B"], 12: ["x", "y", "z"],
    }
    assert split_values(df.limit(0), ["id"], "raw").count() == 0
    assert resolve("a,'a") == [(1, 1, False), (4, 1, False)]
