"""Reading a typed place name as a base name, a qualifier and marks.

Works on single strings so that it can run on distinct names inside Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: The qualifiers of station names and the ways they are written.
QUALIFIERS = {
    "road": ["road", "rd", "roa", "ro", "r"],
    "halt": ["halt", "hlt", "hal", "ha", "h"],
    "junction": ["junction", "jn", "jct", "junc", "jun", "ju", "j"],
    "terminus": ["terminus", "terminal", "term", "t"],
    "central": ["central", "cent", "ctrl", "ctl"],
    "city": ["city", "cty"],
    "town": ["town", "twn", "tn"],
    "cantt": ["cantt", "cant", "cantonment"],
    "north": ["north", "nth", "n"],
    "south": ["south", "sth", "s"],
    "east": ["east", "est", "e"],
    "west": ["west", "wst", "w"],
}
QUALIFIER_OF = {form: q for q, forms in QUALIFIERS.items() for form in forms}
#: Forms that may stand without a blank at the end of a base name, longest first.
GLUED = sorted((f for f in QUALIFIER_OF if len(f) > 2 or f in ("rd", "jn", "tn")), key=len, reverse=True)
GLUED = [f for f in GLUED if f not in ("roa", "hal", "jun")]

#: Words that say nothing about the place, and words for all stations of a town.
NOISE = {"station", "stn", "railway", "rly", "dep", "arr", "stations"}
CITY_WIDE = {"all", "stations"}

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтнвѕјԁ", "aeopcyxikmthbsjd")

SHORTEST_BASE = 6


class Name(NamedTuple):
    """``base`` is folded (see :func:`fold`), ``qualifier`` canonical or empty."""

    base: str
    qualifier: str
    city_wide: bool


def plain(text: str) -> str:
    """Lower case without accents, invisible characters, apostrophes and lookalike letters."""
    if text.isascii():
        return re.sub("['`]", "", text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).lower()
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Me"))
    return re.sub("['’`´]", "", text.translate(LOOKALIKES))


def fold(base: str) -> str:
    """One spelling for sounds written in several ways: long vowels, aspirates, w, doubled letters."""
    base = re.sub(r"oo", "u", re.sub(r"ee", "i", base)).replace("w", "v")
    base = re.sub(r"(?<=[bcdfgjklmnprstvz])h", "", base)
    return re.sub(r"(.)\1+", r"\1", base)


@lru_cache(maxsize=200_000)
def near(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions) up to ``most``, else ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=100_000)
def qualifier(word: str) -> str:
    """Canonical qualifier of a word, one slip allowed in words of five letters or more; else empty."""
    if word in QUALIFIER_OF:
        return QUALIFIER_OF[word]
    if 4 <= len(word) <= 9:
        for form, q in QUALIFIER_OF.items():
            if len(form) >= 4 and near(word, form, 1) <= 1:
                return q
    return ""


@lru_cache(maxsize=200_000)
def read_name(text: str | None) -> Name:
    """Parse a typed name; null, blank and symbol-only names give an empty base."""
    if not text:
        return Name("", "", False)
    t = re.sub(r"^\s*\d+\s*[.)]\s*", "", plain(text))
    words = re.findall(r"[^\W_]+", t)
    wide = "all" in words[:1] + words[-2:] and "stations" in words or words[-1:] == ["stations"] or words[-1:] == ["all"]
    if wide:
        words = [w for w in words if w not in CITY_WIDE and w != "of"]
    kept = [w for w in words if w not in NOISE] or words
    q = ""
    if len(kept) > 1:
        if len("".join(kept[:-1])) >= SHORTEST_BASE and (q := qualifier(kept[-1])):
            kept = kept[:-1]
        elif len("".join(kept[1:])) >= SHORTEST_BASE and (q := qualifier(kept[0])):
            kept = kept[1:]
    base = "".join(kept)
    if not q:
        for form in GLUED:
            if base.endswith(form) and len(base) - len(form) >= SHORTEST_BASE:
                base, q = base[: -len(form)], QUALIFIER_OF[form]
                break
    return Name(fold(base), q, wide)
