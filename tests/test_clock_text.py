import pytest
from pyspark.sql import functions as F

from loopline.functions import clock, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize("raw, want", [("5:07", 307), ("23:59", 1439), ("07:05:59", 425), ("24:00", None), ("7.05", None), ("", None), (None, None), ("12:60", None)])
def test_parse_clock(spark, raw, want):
    assert one(spark, clock.parse_clock(L(raw).cast("string"))) == want


@pytest.mark.parametrize("m, want", [(0, "00:00"), (-35, "23:25"), (1500, "01:00"), (None, None)])
def test_format_clock(spark, m, want):
    assert one(spark, clock.format_clock(L(m).cast("int"))) == want


def test_weekday_masks(spark):
    assert one(spark, clock.days_mask(L(None).cast("array<string>"))) is None
    assert one(spark, clock.days_mask(F.array().cast("array<string>"))) == 0
    assert one(spark, clock.days_mask(F.array(L("MON"), L("SUN")))) == 65
    assert one(spark, clock.shift_mask(L(64), L(1))) == 1
    assert one(spark, clock.shift_mask(L(1), L(-1))) == 64
    assert one(spark, clock.mask_days(L(5))) == ["MON", "WED"]
    assert one(spark, clock.runs_on(L(None).cast("int"), L(3)))
    assert one(spark, clock.mask_of_binary(L("1000001"))) == 65
    assert one(spark, clock.mask_of_binary(L("100000"))) is None


def test_yearly_windows(spark):
    inside = lambda d, a, b: one(spark, clock.in_yearly_window(L(d), L(a).cast("string"), L(b).cast("string")))
    assert inside("12-31", "11-01", "06-09") and inside("06-09", "11-01", "06-09") and not inside("06-10", "11-01", "06-09")
    assert inside("07-01", None, None)
    a, b = clock.window_complement(L("06-10"), L("10-31"))
    assert (one(spark, a), one(spark, b)) == ("11-01", "06-09")
    assert len(one(spark, clock.window_days(L("11-01"), L("06-09")))) == 365 - len(one(spark, clock.window_days(L("06-10"), L("10-31"))))
    a, b = clock.season_window(L("Valid 10th June to 31st October"))
    assert (one(spark, a), one(spark, b)) == ("06-10", "10-31")


def test_clock_window_and_legs(spark):
    w = lambda c, a, b: one(spark, clock.in_clock_window(L(c), L(a).cast("int"), L(b).cast("int")))
    assert w(1430, 1380, 60) and w(30, 1380, 60) and not w(700, 1380, 60) and w(700, None, 720)
    assert one(spark, clock.leg_arrival(L(1380), L(60), L(130))) == 1500
    assert one(spark, clock.leg_arrival(L(600), L(60), L(100))) is None
    assert one(spark, clock.halt(L(1430), L(10))) == 20
    assert one(spark, clock.halt(L(10), L(1430))) is None
    assert one(spark, clock.round1(L(-2.25))) == -2.2


def test_text_clocks(spark):
    assert one(spark, clock.dotted_minutes(L("43.25"))) == 2605
    assert one(spark, clock.printed_clock(L("24.00"))) == 0
    assert [one(spark, clock.signed_delay(L(x))) for x in ("On Time", "-00:05", "01:10", " ", "-", "100:00")] == [0, -5, 70, None, None, 6000]
    with pytest.raises(Exception, match="unrecognised delay"):
        one(spark, clock.signed_delay(L("00:75")))
    assert one(spark, clock.is_iso_date(L("2026-02-30"))) is False


def test_names_and_lists(spark):
    assert one(spark, text.normalise_name(L("St. Mary's  Junction (Road)"))) == "st mary s jn rd"
    score = lambda code, name, q: one(spark, text.name_score(L(code), L(name), q))
    assert [score("ABC", "alpha jn", q) for q in ("abc", "Alpha Junction", "alp", "jn al", "AB", "pha", "zz")] == [100, 90, 70, 50, 30, 20, 0]
    assert one(spark, text.parse_classes(L("SL2A/1A"))) == ["1A", "2A", "SL"]
    assert one(spark, text.parse_classes(L("SLX"))) is None
    assert [one(spark, text.parse_days(L(x).cast("string"))) for x in ("Daily", "Ex. Su", "Exc Su", "Mo, Tu", "M;W & F", "0000001", "Mo-Tu", "Mo, ??x", "", None)] == [127, 63, 63, 3, 21, None, None, None, None, None]
    assert [one(spark, text.bit_days(L(x).cast("string"))) for x in ("0000001", " 1100000", "110000", "Daily", None)] == [64, 3, None, None, None]
    assert [one(spark, text.parse_classes(L(x).cast("string"))) for x in ("SL EC", "SL GEN", "gen", "3A(E),3AE 1a", "", None)] == [["SL", "EC"], ["SL"], [], ["1A", "3E"], None, None]
    assert [one(spark, text.train_kind(L(x))) for x in ("Alpha Jan Shatabdi", "B Vande Bharat Exp", "C SF Exp", "D Mail Express", "E")] == ["Jan Shatabdi", "Vande Bharat", "SF", "Mail", None]
    assert [one(spark, text.status_category(L(x))) for x in ("REGRET/WL99", "AVL 7", "AVBL 7", "XRAC 1", "GNWL3/RAC 4", "PQWL 2", "chart closed/AVL")] == ["not_available", "available", "unknown", "unknown", "rac", "waitlist", "not_available"]
    assert one(spark, text.flag_values(L("101"), ["1A", "2A", None])) is None
    assert one(spark, text.flag_values(L("110"), ["1A", "2A", None])) == ["1A", "2A"]
    assert one(spark, text.cell_text(L("<td> a&nbsp;<b>b</b> &amp; c</td>"))) == "a b & c"
    assert one(spark, text.to_number(L("NaN"))) is None
    assert one(spark, text.status_category(L("GNWL3/AVAILABLE-0001"))) == "available"
