import json
import os
import random
import string

import pytest
from pyspark.sql import functions as F

from loopline.llm import canonical, components, leaks, matching, percentiles, spam, tokenizer
from loopline.llm.names import Name, fold, near, read_name


# ---- names -----------------------------------------------------------------

@pytest.mark.parametrize("raw, want", [
    ("28. Lod-gerom  Kot (H)", Name("lodgeromkot", "halt", False)), ("ROAD Kadmilpur", Name("kadmilpur", "road", False)),
    ("KadmilpurJunction", Name("kadmilpur", "junction", False)), ("Kаdmilpur Rly Stn", Name("kadmilpur", "", False)),
    ("Kadmilpur - All stations", Name("kadmilpur", "", True)), ("Kadmil­pur Jucntion", Name("kadmilpur", "junction", False)),
    (None, Name("", "", False)), ("", Name("", "", False)), (" ?? ", Name("", "", False)), ("Ｋａｄｍｉｌｐｏｏｒ", Name("kadmilpur", "", False)),
])
def test_read_name(raw, want):
    assert read_name(raw) == want


def test_near_is_damerau_levenshtein():
    assert [near("abcd", x, 2) for x in ("abcd", "abdc", "abc", "xbcd", "badc", "zzzz")] == [0, 1, 1, 1, 2, 3]
    assert fold("bheewanoor") == "bivanur"


# ---- canonical names -------------------------------------------------------

REFERENCE = [(1, "Kadmilpur Junction", 5), (2, "Kadmilpur", 1), (3, "Gomtibandh", 9), (4, "Gomtibendh", 1), (5, None, 1), (6, "Mavtimenpur All stations", 9)]
TYPED = ["Mavtimenpur", "All stations Kadmilpur", "kadmilpur jn", "Kadmiplur Jn.", "kadmilpur road", "GOMTIBINDH", "Gomtibandhh", "zzzzzzzz", None, "", "kadmilpur jn"]


@pytest.mark.parametrize("limit", [64_000_000, 0])
def test_lookup(spark, limit):
    ref = spark.createDataFrame(REFERENCE, "entry bigint, name string, uses bigint")
    typed = spark.createDataFrame([(t, 0) for t in TYPED], "typed string, base int")
    got = {r["typed"]: (r["entry"], r["edits"]) for r in canonical.lookup(typed, ref, broadcast_bytes=limit).collect()}
    assert got == {
        "kadmilpur jn": (1, 0), "Kadmiplur Jn.": (1, 1), "kadmilpur road": (None, None), "GOMTIBINDH": (3, 1), "Gomtibandhh": (3, 1),
        "Mavtimenpur": (None, None), "All stations Kadmilpur": (None, None), "zzzzzzzz": (None, None), None: (None, None), "": (None, None),
    }
    assert canonical.lookup(typed.limit(0), ref, broadcast_bytes=limit).count() == 0
    assert {r["entry"] for r in canonical.lookup(typed, ref.limit(0), broadcast_bytes=limit).collect()} == {None}


def test_rivals(spark):
    found = canonical.lookup(spark.createDataFrame([("Gomtibondo",), ("Gomtibandh",), ("Gomtibanda",)], "typed string"), spark.createDataFrame(REFERENCE, "entry bigint, name string, uses bigint"))
    rivals = spark.createDataFrame([("Gomtibondo",), (None,), ("Gomtibandh",)], "name string")
    got = {r["typed"]: r["entry"] for r in canonical.without_rivals(found, rivals).collect()}
    assert got == {"Gomtibondo": None, "Gomtibandh": 3, "Gomtibanda": 3}


def test_deletes(spark):
    got = spark.createDataFrame([("abc",), ("x",), ("",), ("éa",)], "t string").select(canonical.deletes(F.col("t"), 2).alias("d")).collect()
    assert [set(r["d"]) for r in got] == [{"abc", "ab", "ac", "bc", "a", "b", "c"}, {"x"}, {""}, {"éa", "é", "a"}]


# ---- matching --------------------------------------------------------------

BOX = (6.0, 37.5, 68.0, 97.5)
REC = "id long, code string, name string, state string, lat string, lon string, score string"


def test_match(spark):
    left = [
        (1, "AA", "Kadmilpur Junction", "Narmesh", "20.0", "75.0", "x"), (2, "AB", "Kadmilpur Road", "Narmesh", "20.005", "75.0", "x"),
        (3, "AC", "Gomtibandh", "Belmor", None, None, "x"), (4, "AD", "Lurgendih Halt", None, "21.0", "76.0", "x"), (5, "AE", "Dartimkot", "Belmor", "25.0", "80.0", "x"),
        (6, "AA", "Kadmilpur Jn", "Narmesh", "20.001", "75.0", "x"), (7, None, None, None, None, None, None),
    ]
    right = [
        (101, None, "kadmiplur jn", "NAR", "20.002", "75.001", "x"), (102, "zz", "Gomtibandh", "BELMOR", "12.0", "77.0", "x"), (103, "AD", "lurgendih (h)", "Belmor", "0", "0", "x"),
        (104, "AE", "Renamednagar City", "Belmor", "25,0003", "80.0° E", "x"), (105, None, "Kadmilpur - All stations", "Narmesh", "20.0", "75.0", "x"),
        (106, "AA", "Dartimkot", "Narmesh", "30.0", "90.0", "x"), (107, None, "Kadmilpur Road", "Narmesh", "75.0", "20.005", "x"), (108, None, "", "", "", "", ""),
    ]
    a, b = spark.createDataFrame(left, REC), spark.createDataFrame(right, REC)
    got = sorted((r["id_a"], r["id_b"]) for r in matching.match(a, b, BOX).collect())
    assert got == [(1, 101), (2, 107), (3, 102), (4, 103), (5, 104), (6, 101)]
    assert matching.match(a.limit(0), b, BOX).count() == 0
    twice = matching.match(a.where("id = 2").unionByName(a.where("id = 2").withColumn("id", F.lit(9).cast("long"))), b, BOX)
    assert sorted((r["id_a"], r["id_b"]) for r in twice.collect()) == [(2, 107), (9, 107)]


def test_misspelt_copy_is_no_rival(spark):
    """A station listed twice keeps both rows beside the very name; a like name elsewhere or of another qualifier is dropped."""
    left = [
        (1, "AA", "Kuljeduvpur", "Narmesh", "20.0", "75.0", None), (2, "AB", "Kujleduvpur", "Narmesh", "20.003", "75.0", None),
        (3, "AC", "Kujleduvpur Road", "Narmesh", "20.004", "75.0", None), (4, "AD", "Kujleduvpur", "Narmesh", "20.02", "75.0", None),
    ]
    b = spark.createDataFrame([(101, None, "Kuljeduvpur", "Narmesh", "20.001", "75.001", None)], REC)
    got = sorted((r["id_a"], r["id_b"]) for r in matching.match(spark.createDataFrame(left, REC), b, BOX).collect())
    assert got == [(1, 101), (2, 101)]


def test_candidates_hold_every_close_vector(spark):
    """Multi-index hashing finds all pairs within the guaranteed distance, against brute force."""
    rnd = random.Random(3)
    syl = ["kad", "mil", "pur", "gom", "tib", "lur", "gen", "nor", "sal", "vek"]
    names = ["".join(rnd.choice(syl) for _ in range(4)) for _ in range(60)]
    rows = [(i, None, n, "Narmesh", None, None, None) for i, n in enumerate(names)]
    noisy = [(1000 + i, None, n[: (k := rnd.randrange(len(n)))] + n[k + 1 :], "Narmesh", None, None, None) for i, n in enumerate(names)]
    a, _ = matching.profiles(matching.encode(spark.createDataFrame(rows, REC), BOX, 1.7))
    b, _ = matching.profiles(matching.encode(spark.createDataFrame(noisy, REC), BOX, 1.7))
    mask = (1 << 64) - 1
    vec = lambda r: (r["n1"] & mask) << 64 | (r["n0"] & mask)
    want = {(x["p"], y["p"]) for x in a.collect() for y in b.collect() if bin(vec(x) ^ vec(y)).count("1") <= 3}
    got = {(r["pa"], r["pb"]) for r in matching.candidates(a, b).collect()}
    assert want and want <= got


def test_candidates_hold_every_like_name_without_position(spark):
    """Names within SLIPS edits are found where a position is missing, against brute force."""
    rnd = random.Random(5)
    syl = ["kad", "mil", "pur", "gom", "tib", "lur", "gen", "nor", "sal", "vek"]

    def slip(n):
        k, c = rnd.randrange(len(n) - 1), rnd.choice("abdegiklmnoprstuv")
        return rnd.choice([n[:k] + n[k + 1 :], n[:k] + c + n[k:], n[:k] + c + n[k + 1 :]])

    names = ["".join(rnd.choice(syl) for _ in range(4)) for _ in range(60)]
    placed = lambda i: ("20.0", "75.0") if i % 2 else (None, None)
    rows = [(i, None, n, "Narmesh", *placed(i), None) for i, n in enumerate(names)]
    noisy = [(1000 + i, None, slip(slip(slip(n))), "Narmesh", *placed(i + 1), None) for i, n in enumerate(names)]
    a, _ = matching.profiles(matching.encode(spark.createDataFrame(rows, REC), BOX, 1.7))
    b, _ = matching.profiles(matching.encode(spark.createDataFrame(noisy, REC), BOX, 1.7))
    pairs = a.crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in ("p", "base", "qualifier", "lat")]))
    like = pairs.where((F.levenshtein("base", "b_base") <= matching.SLIPS) & (F.col("qualifier") == F.col("b_qualifier")) & (F.col("lat").isNull() | F.col("b_lat").isNull()))
    want = {(r["p"], r["b_p"]) for r in like.collect()}
    got = {(r["pa"], r["pb"]) for r in matching.candidates(a, b).collect()}
    assert len(want) >= 40 and want <= got


def test_candidates_in_a_cell_hold_every_distance_of_like_names(spark):
    """Inside a map cell all pairs up to 15 bits apart are found, which SLIPS edits of up to 4 bits cannot exceed."""
    rnd = random.Random(4)
    names = ["".join(rnd.choice(["kad", "mil", "pur", "gom", "tib", "lur"]) for _ in range(4)) for _ in range(60)]
    rows = [(i, None, n, "Narmesh", "20.0", "75.0", None) for i, n in enumerate(names)]
    a, _ = matching.profiles(matching.encode(spark.createDataFrame(rows, REC), BOX, 1.7))
    b, _ = matching.profiles(matching.encode(spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows], REC), BOX, 1.7))
    vec = lambda r: (r["n1"] & (1 << 64) - 1) << 64 | (r["n0"] & (1 << 64) - 1)
    want = {(x["p"], y["p"]) for x in a.collect() for y in b.collect() if bin(vec(x) ^ vec(y)).count("1") <= 15}
    assert want and want <= {(r["pa"], r["pb"]) for r in matching.candidates(a, b).collect()}


def test_other_qualifiers_are_candidates_without_position(spark):
    """Like names of a state meet whatever their qualifiers, so that an equal code is weighed with a calibrated score."""
    a = spark.createDataFrame([(1, "AA", "Kadmilpur Road", "Narmesh", None, None, None), (2, None, "Gomtibandh Halt", None, None, None, None)], REC)
    b = spark.createDataFrame([(101, "AA", "Kadmilpur", "NAR", None, None, None), (102, None, "Gomtibandh", "Belmor", "20.0", "75.0", None)], REC)
    a, b = matching.profiles(matching.encode(a, BOX, 1.7))[0], matching.profiles(matching.encode(b, BOX, 1.7))[0]
    assert {(r["pa"], r["pb"], r["by_code"]) for r in matching.candidates(a, b).collect()} >= {(1, 101, False), (2, 102, False)}


def staged_rows(monkeypatch):
    """Rows that the matching writes, by the name of the intermediate table."""
    rows, write = {}, matching.stage

    def counting(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(matching, "stage", counting)
    return rows


def test_pairs_of_unlike_names_are_not_written(spark, monkeypatch):
    """Records of one state whose names only share pieces are compared, yet what is written follows the records, not their square."""
    rnd = random.Random(6)
    names = sorted({"".join(rnd.choice("bdgklmnrstv") + rnd.choice("aiu") for _ in range(4)) + "pur" for _ in range(80)})
    rows = [(i, f"C{i}", n, "Narmesh", None, None, None) for i, n in enumerate(names)]
    right = spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows], REC)
    rows, got = staged_rows(monkeypatch), matching.match(spark.createDataFrame(rows, REC), right, BOX).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} >= {(i, 1000 + i) for i in range(len(names))}
    like = sum(near(x, y, 3) <= 3 for x in names for y in names)
    assert rows["scored"] <= like < len(names) ** 2 / 4 and sum(rows.values()) <= like + 2 * len(names)


def test_unwritten_pairs_count_and_return_where_they_match(spark):
    """Codes that agree wherever unlike names stand together make such names match, for pairs without codes too."""
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("bdgklmnrstv") + rnd.choice("aiu") for _ in range(5))
    spot = lambda i: (str(10 + i * 0.2), "75.01")
    left = [(i, f"C{i}" if i else None, name(), "Narmesh", *spot(i), None) for i in range(70)]
    right = [(1000 + i, f"C{i}" if i else None, name(), "Narmesh", *spot(i), None) for i in range(70)]
    got = matching.match(spark.createDataFrame(left, REC), spark.createDataFrame(right, REC), BOX).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == {(i, 1000 + i) for i in range(70)}
    far = [r for r in got if r["id_a"] == 0]
    assert far[0]["score"] in matching.FAR_SCORES and far[0]["code_dice"] is None


def test_codes_of_many_are_evidence(spark):
    """Renamed and moved records match by a code however many carry it; a code of many lets no unlike names elsewhere match."""
    rnd = random.Random(8)
    name = lambda: "".join(rnd.choice("bdgklmnrstv") + rnd.choice("aiu") for _ in range(5))
    names, spot = [name() for _ in range(6)], lambda i: (str(10 + i), "75.01")
    left = [(i, "ZZ", names[i], "Narmesh", *spot(i), None) for i in range(6)] + [(10 + i, f"L{i}", name(), "Ojaspur", None, None, None) for i in range(400)]
    right = [(100 + i, "ZZ", name(), "Narmesh", *spot(i), None) for i in range(3)] + [(100 + i, "zz", names[i], "Belmor", None, None, None) for i in range(3, 6)]
    right += [(200 + i, f"R{i}", name(), "Devgaon", None, None, None) for i in range(400)]
    a, b = spark.createDataFrame(left, REC), spark.createDataFrame(right, REC)
    for most in (5, 1000):
        assert sorted((r["id_a"], r["id_b"]) for r in matching.match(a, b, BOX, most_per_code=most).collect()) == [(i, 100 + i) for i in range(6)]


def test_a_placeholder_code_matches_nothing_alone(spark):
    """A code that half of all records carry lets neither moved nor like names match where their own evidence does not."""
    rnd = random.Random(10)
    names = ["".join(rnd.choice("bdgklmnrstv") + rnd.choice("aiu") for _ in range(5)) for _ in range(40)]
    rows = lambda k, at: [(k + i, "XX" if i % 2 else f"{k}N{i}", n, "Narmesh", str(at + i * 0.2), "75.01", None) for i, n in enumerate(names)]
    a, b = spark.createDataFrame(rows(0, 10), REC), spark.createDataFrame(rows(1000, 20), REC)
    assert matching.match(a, b, BOX, most_per_code=2).count() == 0


def test_split_codes_lose_no_pair_that_counts(spark):
    """Holders of a frequent code meet by cell or name piece: all pairs with like names or within reach, each once."""
    rnd = random.Random(9)
    syl = ["kad", "mil", "pur", "gom", "tib", "lur"]
    spot = lambda: (str(20 + rnd.random() * 0.1), str(75 + rnd.random() * 0.1)) if rnd.random() < 0.7 else (None, None)
    rows = lambda k: [(k + i, rnd.choice(["ZZ", "ZZ", "A1"]), "".join(rnd.choice(syl) for _ in range(4)), rnd.choice(["Narmesh", "Belmor", None]), *spot(), None) for i in range(70)]
    a, b = (matching.profiles(matching.encode(spark.createDataFrame(rows(k), REC), BOX, 1.7))[0] for k in (0, 1000))
    a, b = matching.with_shares(a, b, 30)
    assert {(r["code"], r["share"] > 0) for r in a.collect()} == {("ZZ", True), ("A1", False)}
    what = F.struct("pa", "pb", "by_code").alias("x")
    whole, split = (matching.scored(matching.paired(a, b, s)).where(f"not by_code or near or km <= {matching.REACH_KM}").select(what).collect() for s in (False, True))
    assert any(r["x"]["by_code"] for r in whole) and sorted(whole) == sorted(split)
    assert matching.paired(a, b, True).count() < matching.paired(a, b).count()


def test_calibrate_is_monotone():
    odds, same, other = matching.calibrate([(-5.0, 1000, 0), (0.0, 100, 20), (1.0, 100, 10), (5.0, 100, 60), (8.0, 1000, 600), (9.0, 10, 1)])
    assert [odds[s] for s in (-5.0, 0.0, 1.0, 5.0, 8.0)] == sorted(odds[s] for s in (-5.0, 0.0, 1.0, 5.0, 8.0))
    assert odds[-5.0] < -5 and odds[8.0] > 1 and same > 0 > other
    assert matching.calibrate([])[1] > 0


# ---- percentiles -----------------------------------------------------------

def test_percentiles_equal_brute_force(spark):
    rnd = random.Random(1)
    data = [("hot", rnd.gauss(0, 50) if rnd.random() < 0.7 else 5.0) for _ in range(4000)] + [("b", float(i % 7)) for i in range(40)] + [(None, 3.0), ("n", None), ("nan", float("nan")), ("one", 1.5)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("value", F.lit("clash")).withColumn("n", F.lit(1))
    s = percentiles.summarise(df, ["g"], F.col("v"))
    want = {}
    for g in {g for g, _ in data}:
        v = sorted(x for k, x in data if k == g and x is not None and x == x)
        if v:
            want[g] = (len(v), *[v[max(1, -(-len(v) * p // 100)) - 1] for p in (1, 50, 99, 100)])
    for block in (100_000, 64):
        got = {r["g"]: tuple(r)[1:] for r in percentiles.percentiles(s, ["g"], [1, 50, 99, 100], block_values=block).collect()}
        assert got == want
    halves = [percentiles.summarise(df.where(c), ["g"], F.col("v")) for c in ("v < 0", "v >= 0 or v is null")]
    got = {r["g"]: tuple(r)[1:] for r in percentiles.percentiles(percentiles.merge(*halves, by=["g"]), ["g"], [1, 50, 99, 100]).collect()}
    assert got == want
    rough = percentiles.percentiles(percentiles.summarise(df, ["g"], F.col("v"), resolution=2.0), ["g"], [1, 50, 99, 100])
    assert all(abs(x - y) <= 1.0 for r in rough.collect() for x, y in zip(tuple(r)[2:], want[r["g"]][1:]))
    assert percentiles.percentiles(s.limit(0), ["g"], [50]).count() == 0


# ---- components ------------------------------------------------------------

@pytest.mark.parametrize("cell", [200_000, 40])
def test_components_equal_union_find(spark, cell):
    rnd = random.Random(7)
    ids = [f"v{i:04d}" for i in range(300)]
    pairs = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(170)] + [("hub", i) for i in ids[:60]] + list(zip(ids[200:], ids[201:])) + [("s", "s"), (None, "v0001"), ("v0001", None)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs + pairs[:50] + [(b, a) for a, b in pairs[:50]], "a string, b string").withColumn("v", F.lit(1))
    got = [(r["vertex"], r["component"]) for r in components.components(df, "a", "b", cell_edges=cell).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in list(parent))
    assert components.components(df.limit(0), "a", "b").count() == 0


# ---- tokenizer -------------------------------------------------------------

def texts():
    rnd = random.Random(2)
    pool = [chr(c) for c in [*range(32, 127)] * 3 + [0, 9, 10, 13, 0x1C, 0x85, 0xA0, 0x3000, 0x200B, 0xAD, 0x905, 0x93E, 0x94D, 0x301, 0x4E00, 0x1F600, 0xB2, 0xBD]]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    return out + ["a" * 300, " " * 200, "ab" * 5000, "it's we'LL 'tis", "<|endoftext|>", "".join(rnd.choice(string.ascii_lowercase + " ") for _ in range(200_000))]


@pytest.mark.skipif(not os.path.exists(tokenizer.VOCABULARY), reason="no vocabulary")
def test_encode(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer.VOCABULARY)
    t.encode_special_tokens = True
    raw = texts()
    rows = [(i, x, 1) for i, x in enumerate(raw)] + [(-1, None, 1), (-2, "", 1), (0, raw[0], 1)]
    df = spark.createDataFrame(rows, "id long, text string, ids int")
    out = tokenizer.encode(df, ["id"], "text", flush=5000)
    assert dict(out.dtypes)["ids"] == "array<int>" and out.count() == len(rows)
    got = {r["id"]: r["ids"] for r in out.collect()}
    assert got[-1] == [] and got[-2] == []
    want = {i: e.ids for i, e in enumerate(t.encode_batch(raw, add_special_tokens=False))}
    assert {i: v for i, v in got.items() if i >= 0} == want
    back = {r["id"]: r["text"] for r in tokenizer.decode(out, ["id"], "ids").collect()}
    assert all(back[i] == x for i, x in enumerate(raw)) and back[-1] == ""
    assert tokenizer.encode(df.limit(0), ["id"], "text").count() == 0


# ---- leaks -----------------------------------------------------------------

def words(rnd, n):
    return ["".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(3, 9))) for _ in range(n)]


def test_leaks(spark):
    rnd = random.Random(11)
    items = [words(rnd, 80) for _ in range(6)]
    noise = lambda n: " ".join(words(rnd, n))
    changed = [w if k % 10 != 5 else "changed" for k, w in enumerate(items[1][10:45])]
    inserted = items[2][0:10] + ["extra"] + items[2][10:24]
    docs = [
        (1, noise(50) + " " + " ".join(items[0]) + " " + noise(900)), (2, noise(20) + ". " + ",  ".join(changed).upper()), (3, " ".join(inserted)),
        (4, noise(30) + " ".join(items[3][5:17]) + " " + noise(30)), (5, " ".join(items[4][0:12]) + " " + noise(200) + " " + " ".join(items[4][40:55])),
        (6, noise(400)), (7, None), (8, ""), (9, " ".join(items[0][30:52])), (10, " ".join(reversed(items[5]))), (1, " ".join(items[0])),
    ]
    c = spark.createDataFrame([(*d, 0) for d in docs], "doc long, text string, words int")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "only few words here")], "item long, text string")
    for block in (2_000_000, 700):
        got = sorted((r["doc"], r["item"]) for r in leaks.find_leaks(c, "doc", "text", i, "item", "text", block_chars=block).collect())
        assert got == [(1, 0), (2, 1), (3, 2), (5, 4), (9, 0)]
    assert leaks.find_leaks(c.limit(0), "doc", "text", i, "item", "text").count() == 0
    assert leaks.find_leaks(c, "doc", "text", i.limit(0), "item", "text").count() == 0


def test_leaks_count_changed_words_and_short_stretches():
    """20 words with two changed, also near the ends, and 21 words in three stretches are leaks; a dozen words and 18 are none."""
    rnd = random.Random(12)
    item, noise = words(rnd, 60), words(rnd, 40)
    change = lambda at: [w if k not in at else "changed" for k, w in enumerate(item[10:30])]
    cases = [
        (noise + change({6, 13}) + noise, True), (noise + change({2, 17}) + noise, True),
        (noise + item[5:12] + noise[:9] + item[12:19] + noise[9:18] + item[19:26] + noise, True),
        (noise + item[19:26] + noise[:9] + item[12:19] + noise[9:18] + item[5:12] + noise, False),
        (noise + item[5:12] + noise[:9] + item[20:27] + noise[9:18] + item[40:47] + noise, False),
        (noise + item[10:22] + noise, False), (noise + item[10:28] + noise, False),
    ]
    index = leaks.Items([(0, " ".join(item))], leaks.Rules())
    assert [bool(leaks.scan([" ".join(d)], index)) for d, _ in cases] == [want for _, want in cases]


# ---- spam ------------------------------------------------------------------

SENTENCES = "The evening train left at nine. Nobody knew why it waited near the mill, but the guard waved a flag. We drank tea and looked out.\n"
RECORDS = "\n".join(f"{h:02d}:15\tPlace {chr(65 + h)} Junction\t{17 * h} km" for h in range(20))
SPAM = {
    "soup": "cheap ticket best price cheap hotel ticket best cheap price hotel offer " * 12,
    "links": "\n".join(f'<li><a href="https://www.shop{i}.test/x?id={i}">best price {i}</a></li>' for i in range(20)),
    "tags": "#deal #sale #offer1 #mug " * 20,
    "products": "\n".join(f"Deal mug | SKU {i}77 | {i}.00 | Buy now" for i in range(20)),
    "list": "\n".join(f"train booking {chr(65 + i)}alpur to {chr(66 + i)}obandh" for i in range(20)),
    "mixed": SENTENCES + "cheap ticket best price cheap hotel ticket best cheap price hotel offer " * 12,
}
FINE = {"text": SENTENCES * 5, "records": RECORDS, "ends": SENTENCES * 5 + "See also: https://a.test/x https://b.test/y", "json": '{"a": 1, "b": "X"}\n' * 20, "none": None, "empty": "", "blank": " \n \n", "long": SENTENCES * 3000, "one line": SENTENCES.strip() * 3000}
SPAM |= {"long list": "cheap ticket, " * 50_000, "long soup": "cheap ticket " * 50_000, "long dots": "a.b." * 50_000 + " " + "cheap ticket " * 50_000}


def test_spam(spark):
    rows = [(k, v, 0.0) for k, v in [*SPAM.items(), *FINE.items(), ("soup", SPAM["soup"])]]
    df = spark.createDataFrame(rows, "id string, text string, share double")
    assert sorted(r["id"] for r in spam.find_spam(df, "id", "text").collect()) == sorted([*SPAM, "soup"])
    assert spam.find_spam(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("page, spam_page", [
    ("Cheap rail tickets 2024, best rail tickets 2024\n" * 200, True), ("Buy cheap rail tickets!\n" * 40, True),
    ("".join(f"Book {a} Rail {b} Today 24\n" for a in ("Cheap", "Best") for b in ("Tickets", "Passes")) * 10, True),
    ("".join(f"Train 10{i * 37:05d} will not stop at Dollimar Junction until further notice.\n" for i in range(9)), False),
    ("".join(f"2026-01-01 12:{i:02d} poller heartbeat\n" for i in range(40)), False), ('{"a": 1, "b": "X"}\n' * 20, False), (RECORDS, False),
])
def test_dominating_shapes(spark, page, spam_page):
    """Few shapes whose words repeat over their lines flag a page; notices, logs and records do not."""
    df = spark.createDataFrame([(page,)], "t string")
    assert (spam.spam_share(df, "t").first()["share"] > 0.5) == spam_page


def test_shapes(spark):
    cases = {
        "12:15  Alpha Beta, km 7": "9 A,a 9", "see https://x.test/a <b>x</b> #tag #two": "a L a #", "Deal mug | SKU 77 | 3.00 | Buy now": "a|A 9|9|a",
        "best price, Cheap hotel, ticket, best, offer, mug": "&", '<li><a href="https://a.test">Best price</a></li>': " La ", "": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").withColumn("tokens", spam.tokens_of(F.col("t"))[0])
    got = [r["s"] for r in df.withColumn("s", spam.shape_of(F.col("tokens"))).orderBy("i").collect()]
    assert got == list(cases.values())


def test_shapes_decide(spark, monkeypatch):
    """With one shape for all lines the pages of labels and links are no longer found."""
    df = spark.createDataFrame([(k, SPAM[k]) for k in ("links", "tags", "products")], "id string, text string")
    assert spam.find_spam(df, "id", "text").count() == 3
    monkeypatch.setattr(spam, "shape_of", lambda tokens: F.regexp_replace(tokens, r"[^\n]+", "a."))
    monkeypatch.setattr(spam, "_lines", lambda rules, real=spam._lines: real(rules).replace("l.t", "l.s"))
    assert spam.find_spam(df, "id", "text").count() == 0


def test_spam_windows_are_not_mixed_by_clashing_names(spark):
    names = ["plain", "tokens", "bare", "lines", "groups", "judged", "share", "p", "t", "s", "w", "k"]
    df = spark.createDataFrame([("a", SPAM["tags"], *names)], ", ".join(f"{c} string" for c in ["doc", "text", *names]))
    assert [r["doc"] for r in spam.find_spam(df, "doc", "text").collect()] == ["a"]


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """Workers live on between queries; each must use the vocabulary of its own query."""
    letters = {c: i for i, c in enumerate(tokenizer.byte_letters())}
    def write(name, merges):
        vocab = letters | {a + b: 1000 + i for i, (a, b) in enumerate(merges)}
        path = tmp_path / name
        path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}), encoding="utf-8")
        return str(path)

    one, two = write("one.json", [("a", "b")]), write("two.json", [("b", "a"), ("b", "b")])
    df = spark.createDataFrame([(1, "abab"), (2, None)], "i int, t string")
    for _ in range(2):
        assert [r["ids"] for r in tokenizer.encode(df, ["i"], "t", one).orderBy("i").collect()] == [[1000, 1000], []]
        assert [r["ids"] for r in tokenizer.encode(df, ["i"], "t", two).orderBy("i").collect()] == [[letters["a"], 1000, letters["b"]], []]


def test_hub_cells_are_sliced(spark):
    """A star of many edges with tiny cells: slices of its cells still give one component."""
    rows = [("hub", f"v{i:03d}") for i in range(300)] + [("x", "y"), ("y", "z")]
    got = {r["vertex"]: r["component"] for r in components.components(spark.createDataFrame(rows, "a string, b string"), "a", "b", cell_edges=10).collect()}
    assert got == {"hub": "hub"} | {f"v{i:03d}": "hub" for i in range(300)} | {c: "x" for c in "xyz"}


def test_placeholder_codes_are_no_evidence(spark):
    schema = "p long, code string, c0 long, base string"
    df = spark.createDataFrame([(i, "ZZZ", 5, "x") for i in range(4)] + [(9, "AB", 6, "y"), (10, None, 0, "z")], schema)
    got = {r["p"]: (r["code"], r["c0"]) for r in matching.without_placeholders(df, 3).collect()}
    assert got == {**{i: (None, 0) for i in range(4)}, 9: ("AB", 6), 10: (None, 0)}
    assert matching.without_placeholders(df, 4).where("code is not null").count() == 5
