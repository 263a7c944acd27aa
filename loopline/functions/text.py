"""Names, class and day lists, status texts and other strings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopline.functions.clock import WEEKDAYS

#: Abbreviations used when names are compared.
ABBREVIATIONS = {"junction": "jn", "cantonment": "cantt", "terminus": "t", "terminal": "t", "road": "rd"}

#: Class codes in their fixed order, how they are printed, and printed codes that are no class.
CLASS_ORDER = ["1A", "2A", "3A", "3E", "SL", "FC", "EC", "CC", "2S"]
CLASS_FORMS = {"3A(E)": "3E", "3AE": "3E"}
CLASSES_IGNORED = ["EV", "EA", "PC", "GEN", "GS", "II", "P"]

#: How weekdays are printed.
DAY_FORMS = {
    "SUN": ["su", "sun"], "MON": ["m", "mo", "mon"], "TUE": ["tu", "tue"], "WED": ["w", "we", "wed"], "THU": ["th", "thu"],
    "FRI": ["f", "fr", "fri"], "SAT": ["sa", "sat"],
}


def normalise_name(name: Column) -> Column:
    """Lower case, punctuation to blanks, blanks squeezed, common words abbreviated."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[().,'’\-/]", " "), r"\s+", " "))
    for word, short in ABBREVIATIONS.items():
        n = F.regexp_replace(n, rf"\b{word}\b", short)
    return n


def _starts_with(w: str):
    return lambda x: x.startswith(w)


def name_score(code: Column, name: Column, query: str) -> Column:
    """How well a station fits a query: 100 its code, 90 its name, 70 a prefix, 50 all words are
    prefixes of words, 30 a code prefix, 20 contained, 0 no match. ``name`` is normalised."""
    raw = query.strip().upper()
    q = " ".join(query.lower().translate({ord(c): " " for c in "().,'’-/"}).split())
    for word, short in ABBREVIATIONS.items():
        q = " ".join(short if w == word else w for w in q.split(" "))
    if not q:
        return F.lit(0)
    words = F.split(name, " ")
    every = F.lit(True)
    for w in q.split(" "):
        every = every & F.exists(words, _starts_with(w))
    by_code = code.startswith(raw) if len(raw) >= 2 and raw.isascii() and raw.isalpha() else F.lit(False)
    return (
        F.when(code == raw, 100).when(name == q, 90).when(name.startswith(q), 70).when(every, 50)
        .when(by_code, 30).when(name.contains(q), 20).otherwise(0)
    )


def status_category(text: Column) -> Column:
    """available, rac, waitlist, not_available or unknown from a seat status.

    Words of refusal count anywhere in the text; else the part after the last slash decides.
    """
    t = F.upper(text)
    last = F.trim(F.element_at(F.split(t, "/"), -1))
    return (
        F.when(t.rlike("REGRET|NOT AVAILABLE|DEPARTED|CANCEL|NOT EXIST|CLOSED"), "not_available")
        .when(last.rlike(r"^(AVAILABLE|AVL|CURR_AVBL)\b"), "available").when(last.rlike(r"^RAC\b"), "rac").when(last.rlike("^[A-Z]*WL"), "waitlist")
        .otherwise("unknown")
    )


def to_number(text: Column) -> Column:
    """A finite number, or null for anything else."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_classes(text: Column) -> Column:
    """Class codes of a printed text, each once, in the fixed order; null unless all of it is read.

    Blanks, commas, stops, slashes, colons, semicolons and hyphens are skipped. Codes of
    unreserved and service cars are read but are no class.
    """
    t = F.regexp_replace(F.upper(text), r"[\s,./;:-]+", "")
    codes = [c.replace("(", r"\(").replace(")", r"\)") for c in [*CLASS_FORMS, *CLASS_ORDER, *CLASSES_IGNORED]]
    found = F.regexp_extract_all(t, F.lit("|".join(codes)), F.lit(0))
    same = lambda c: [c, *[f for f, x in CLASS_FORMS.items() if x == c]]
    ordered = F.array_compact(F.array(*[F.when(F.arrays_overlap(found, F.array(*[F.lit(f) for f in same(c)])), F.lit(c)) for c in CLASS_ORDER]))
    return F.when((F.length(t) > 0) & (F.length(F.array_join(found, "")) == F.length(t)), ordered)


def parse_days(text: Column) -> Column:
    """Weekday mask of ``Daily``, ``Except``, ``Exc`` or ``Ex`` with days, and lists of days; null if any word is unknown.

    Days are separated by blanks, commas, semicolons or ampersands; stops count as blanks.
    """
    t = F.trim(F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("."), F.lit(" ")), F.lit(";"), F.lit(",")), r"\s+", " "))
    excepted = F.regexp_extract(t, r"^(?:except|exc|ex)\s+(.+)$", 1)
    tokens = F.filter(F.split(F.when(excepted != "", excepted).otherwise(t), r"[,\s&]+"), lambda x: x != "")
    bits = {f: 1 << i for i, d in enumerate(WEEKDAYS) for f in DAY_FORMS[d]}
    table = F.create_map(*[F.lit(x) for f, b in bits.items() for x in (f, b)])
    values = F.transform(tokens, lambda x: F.try_element_at(table, x))
    mask = F.aggregate(values, F.lit(0), lambda a, x: a.bitwiseOR(x))
    known = (t != "") & F.forall(values, lambda x: x.isNotNull())
    return F.when(t == "daily", 127).when(known, F.when(excepted != "", F.lit(127) - mask).otherwise(mask))


def bit_days(text: Column) -> Column:
    """Weekday mask of seven binary digits, Monday first; null for anything else."""
    t = F.trim(text)
    mask = F.lit(0)
    for i in range(7):
        mask = mask + F.when(F.substring(t, i + 1, 1) == "1", 1 << i).otherwise(0)
    return F.when(t.rlike("^[01]{7}$"), mask)


#: Kinds of train by words of the name, the first that fits.
TRAIN_KINDS = [
    ("Vande Bharat", r"vande\s*bharat"), ("Rajdhani", r"rajdhani"), ("Jan Shatabdi", r"jan\s*shatabdi"), ("Shatabdi", r"shatabdi"), ("Duronto", r"duronto"),
    ("Garib Rath", r"garib\s*rath"), ("Humsafar", r"humsafar"), ("Tejas", r"tejas"), ("Gatimaan", r"gatiman|gatimaan"), ("Amrit Bharat", r"amrit\s*bharat"),
    ("Antyodaya", r"antyodaya"), ("Sampark Kranti", r"sampark\s*kranti"), ("Double Decker", r"double\s*decker"), ("Uday", r"\buday\b"),
    ("Namo Bharat", r"namo\s*bharat"), ("MEMU", r"\bmemu\b"), ("DEMU", r"\bdemu\b"), ("Passenger", r"passenger"), ("Mail", r"\bmail\b"),
    ("SF", r"superfast|\bsf\b"), ("Exp", r"express|\bexp\b"),
]


def train_kind(name: Column) -> Column:
    """Kind of train by the first fitting word of an ordered list, else null."""
    return F.coalesce(*[F.when(F.lower(name).rlike(p), F.lit(k)) for k, p in TRAIN_KINDS])


def flag_values(flags: Column, names: list[str | None]) -> Column:
    """Names of the set positions of a string of 0 and 1; null if a set position has no name or the string is malformed."""
    used = F.array(*[F.when(F.substring(flags, i + 1, 1) == "1", F.lit(n if n is not None else "?")) for i, n in enumerate(names)])
    kept = F.filter(used, lambda x: x.isNotNull())
    return F.when(flags.rlike(f"^[01]{{{len(names)}}}$") & ~F.array_contains(kept, "?"), kept)


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same elements as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def cell_text(html: Column) -> Column:
    """Text of an HTML cell: no tags, common entities resolved, blanks squeezed."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
