from pyspark.sql import functions as F

from loopline.operators import merging as m


def test_cells(spark):
    r = spark.createDataFrame([("10.05 10.10", False, False), ("23:55", True, False), ("24.00", False, True), ("x", False, False), (None, False, False), ("9.00 9.05", True, False)], "c string, f boolean, l boolean")
    got = [tuple(x["t"]) for x in r.select(m.cell_times(F.col("c"), F.col("f"), F.col("l")).alias("t")).collect()]
    assert got == [(605, 610, False), (None, 1435, False), (0, None, False), (None, None, False), (None, None, False), (None, 545, True)]
    assert spark.range(1).select(m.table_refs(F.lit("12A, 7")).alias("x")).first()["x"] == [12, 7]
    assert m.assign_cells(["1", "2"], ["a", "b"], {"1": {"a", "b"}, "2": {"b"}}) == {"1": "a", "2": "b"}
    assert m.assign_cells(["1", "2"], ["a", "b"], {"1": {"a", "b"}, "2": {"a", "b"}}) == {}
    assert m.assign_cells(["1", "2", "3"], ["a"], {"1": {"a"}, "2": set()}) == {"1": "a"}


def test_offsets_and_chains(spark):
    seg = spark.createDataFrame([("t", i) for i in (1, 2, 3, 4)], "train_number string, segment long")
    links = spark.createDataFrame([("t", 1, 2, 60), ("t", 2, 3, 30)], "train_number string, a long, b long, offset int")
    got = sorted((r["segment"], r["component"], r["offset"], r["clash"]) for r in m.segment_offsets(seg, links).collect())
    assert got == [(1, 1, 0, False), (2, 1, 60, False), (3, 1, 90, False), (4, 4, 0, False)]
    clash = links.union(spark.createDataFrame([("t", 1, 3, 5)], links.schema))
    assert {r["clash"] for r in m.segment_offsets(seg, clash).where("component = 1").collect()} == {True}
    parts = spark.createDataFrame([("t", 1, "A", "B", 0, 60), ("t", 2, "B", "C", 70, 90), ("t", 3, "X", "Y", 0, 5), ("t", 4, "C", "D", 95, 99), ("t", 5, "C", "E", 96, 99)], "train_number string, part long, first_code string, last_code string, first_at int, last_at int")
    assert sorted((r["part"], r["chain"], r["place"]) for r in m.chain_parts(parts).collect()) == [(1, 1, 0), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0)]


def test_merged_events(spark):
    e = spark.createDataFrame([("t", "A", "Alpha", 10, 12), ("t", "A", "Alpha", 10, 13), ("t", "A", "Alfa", 800, None), ("t", "B", None, None, 5)], "k string, p string, name string, arr int, dep int")
    got = sorted((r["p"], r["call"], r["arr"], r["dep"], r["unsure"], r["name"]) for r in m.merged_events(e, "k", "p").collect())
    assert got == [("A", 0, 10, None, True, "Alpha"), ("A", 1, 800, None, False, "Alfa"), ("B", 0, None, 5, False, None)]


def test_choice_and_verdicts(spark):
    gaps = spark.createDataFrame([("t", 2, "x", "A", "B"), ("u", 2, "y", "A", "B")], "train_number string, seq int, name string, before string, after string")
    cand = spark.createDataFrame([("x", "N"), ("x", "F"), ("y", "N"), ("y", "M")], "name string, code string")
    pos = spark.createDataFrame([("A", 20.0, 75.0), ("B", 20.0, 76.0), ("N", 20.0, 75.5), ("M", 20.0, 75.6), ("F", 25.0, 75.5)], "code string, lat double, lon double")
    sup = spark.createDataFrame([("A", "B", "M", 3)], "before string, after string, code string, n long")
    assert sorted((r["train_number"], r["code"], r["how"]) for r in m.choose_by_detour(gaps, cand, pos, sup).collect()) == [("t", "N", "detour"), ("u", "M", "support")]
    rows = [(0.5, None, True, False, True), (0.5, None, None, False, True), (6.0, True, True, False, True), (0.1, True, True, True, True), (None, True, True, False, True), (0.1, True, True, None, True), (0.1, True, True, False, False)]
    p = spark.createDataFrame(rows, "km double, same_route boolean, duplicate boolean, live_a boolean, live_b boolean")
    assert [r["reason"] for r in m.pair_verdicts(p).collect()] == ["accepted", "too little evidence", "far apart", "both in use", "too little evidence", "status unknown", "too little evidence"]


def test_consistent(spark):
    s = "k string, station_code string, arr int, dep int"
    a = spark.createDataFrame([("x", "A", None, 1), ("x", "B", 2, 3), ("y", "A", 1, 2), ("z", "A", None, 5), ("n", "A", 1, 1)], s)
    b = spark.createDataFrame([("x", "A", None, 1), ("x", "B", None, 3), ("y", "A", 1, 3), ("z", "A", 5, None), ("m", "A", 1, 1)], s)
    assert sorted((r["k"], r["shared"], r["consistent"]) for r in m.consistent_times(a, b, ["k"]).collect()) == [("x", 2, True), ("y", 1, False), ("z", 1, True)]
