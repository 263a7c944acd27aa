"""Passages of held-out texts inside a corpus, by q-gram counting in diagonal bands.

Both sides are reduced to lower-case words. Character q-grams that a document shares with an
item are counted per band of diagonals (document position minus item position), neighbouring
half bands being added so that bands overlap. By the q-gram lemma a passage of L characters
with e spoilt places keeps at least L + 1 - q (e + 1) common q-grams near one diagonal, so
bands and items below that bound cannot hold a leak and are dropped. The q-grams left are
joined to runs on one diagonal, whose whole words bound what an alignment can match; what is
left after that is verified by a banded alignment of words around the longest runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopline.session import spread

WORD = re.compile(r"[^\W_]+")


class Rules(NamedTuple):
    """What counts as a leak: ``words`` spanned by stretches, at least the share ``least`` of them
    matched. Stretches have at least ``stretch`` matched words, or ``piece`` where up to three
    follow one another in the item; inside one a changed, missing or extra word costs ``penalty`` matched ones."""

    words: int = 20
    stretch: int = 10
    penalty: int = 3
    q: int = 8
    band: int = 64
    reach: int = 12
    piece: int = 7
    least: float = 0.85


class Items:
    """The index of a block of items: sorted q-gram codes with their postings."""

    def __init__(self, items: list[tuple[int, str]], rules: Rules) -> None:
        self.rules = rules
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [WORD.findall((t or "").lower()) for _, t in items]
        codes, item, pos, self.starts, need, local = [], [], [], [], [], []
        for k, w in enumerate(self.words):
            starts = np.cumsum([0] + [len(x) + 1 for x in w[:-1]]) if w else np.zeros(0, dtype=np.int64)
            self.starts.append(np.asarray(starts, dtype=np.int64))
            c = grams(" ".join(w), rules.q)
            codes.append(c)
            item.append(np.full(len(c), k))
            pos.append(np.arange(len(c)))
            ends = np.array([x + len(y) for x, y in zip(starts, w)], dtype=np.int64)
            # the lemma's bounds for the shortest passage, a tenth of its words changed and cut in
            # three stretches, and for the shortest stretch, one word in it changed, or piece, none changed
            span = [int((ends[n - 1 :] - np.asarray(starts)[: len(w) - n + 1]).min()) if len(w) >= n else 1 << 30 for n in (rules.words, rules.stretch, rules.piece)]
            need.append(max(rules.q, span[0] + 1 - rules.q * (rules.words // 10 + 3)))
            local.append(max(rules.q, min(span[1] + 1 - 2 * rules.q, span[2] + 1 - rules.q)))
        codes_ = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(codes_, kind="stable")
        self.codes, first = np.unique(codes_[order], return_index=True)
        self.first = np.append(first, len(codes_))
        self.item = (np.concatenate(item) if item else np.zeros(0, dtype=int))[order].astype(np.int64)
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, dtype=int))[order].astype(np.int64)
        self.need = np.array(need, dtype=np.int64)
        self.local = np.array(local, dtype=np.int64)
        # the items' words in one row of places, to count the whole words of a run
        sizes = [len(" ".join(w)) + rules.q for w in self.words]
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.word_starts = np.concatenate([x + o for x, o in zip(self.starts, self.offset)] or [np.zeros(0, dtype=np.int64)])
        self.word_ends = self.word_starts + np.array([len(x) for w in self.words for x in w], dtype=np.int64)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.codes >> np.uint64(42)).astype(np.int64)] = True


def grams(text: str, q: int) -> np.ndarray:
    """64-bit codes of the character q-grams of a text, one for each start."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            code = code * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n] + np.uint64(1)
            code ^= code >> np.uint64(29)
    return code * np.uint64(0xBF58476D1CE4E5B9)


def aligned(places: dict[str, list[int]], item: list[str], band: tuple[int, int, int], rules: Rules, used: set[int]) -> list[tuple[int, int]]:
    """Item words and the document words they match, ascending, in the best local alignment within ``reach`` of a word diagonal.

    ``places`` lists where each word stands in the document; ``band`` is the diagonal and the
    first and last item word to look at. Item words in ``used`` are not matched again. Only
    cells with a positive score are kept, row by row. Empty if the best stretch is too short.
    """
    (diagonal, low, high), w, p = band, rules.reach, rules.penalty
    low, high = max(0, low), min(len(item), high + 1)
    width = 2 * w + 1
    last: dict[int, int] = {}
    trace: list[dict[int, int]] = []
    best, at = 0, (low - 1, 0)
    for i in range(low, high):
        row: dict[int, int] = {}
        back: dict[int, int] = {}
        for k, v in last.items():
            if v > p:
                if row.get(k, 0) < v - p:
                    row[k], back[k] = v - p, 1
                if k and row.get(k - 1, 0) < v - p:
                    row[k - 1], back[k - 1] = v - p, 2
        if i not in used:
            first = i + diagonal - w
            for j in places.get(item[i], ()):
                k = j - first
                if 0 <= k < width and row.get(k, 0) <= last.get(k, 0) + 1:
                    row[k], back[k] = last.get(k, 0) + 1, 0
        for k in sorted(row):
            v = row[k] - p
            while v > 0 and k + 1 < width and row.get(k + 1, 0) < v:
                k += 1
                row[k], back[k] = v, 3
                v -= p
        for k, v in row.items():
            if v > best:
                best, at = v, (i, k)
        trace.append(back)
        last = row
    i, k = at
    out: list[tuple[int, int]] = []
    while i >= low and k in trace[i - low]:
        b = trace[i - low][k]
        if b == 0:
            out.append((i, i + diagonal - w + k))
        if b == 3:
            k -= 1
        else:
            i, k = i - 1, k + (b == 2)
    return out[::-1] if len(out) >= rules.piece else []


def beyond(doc: list[str], item: list[str], at: tuple[int, int], step: int, used: set[int], most: int) -> list[tuple[int, int]]:
    """Up to ``most`` matches past one changed, missing or extra word at an end of a stretch, too few to pay its penalty."""
    for di, dj in ((2, 2), (2, 1), (1, 2)):
        i, j = at[0] + step * di, at[1] + step * dj
        out: list[tuple[int, int]] = []
        while 0 <= i < len(item) and 0 <= j < len(doc) and len(out) < most and item[i] == doc[j] and i not in used:
            out.append((i, j))
            i, j = i + step, j + step
        if out:
            return out
    return []


def leaked_words(doc: list[str], item: list[str], bands: list[tuple[int, int, int]], rules: Rules) -> int:
    """Words of an item, changed ones included, that a document holds in long enough stretches in the given bands."""
    used: set[int] = set()
    wanted, places = set(item), {}
    for j, word in enumerate(doc):
        if word in wanted:
            places.setdefault(word, []).append(j)
    found: list[list[tuple[int, int]]] = []
    for band in bands:
        while got := aligned(places, item, band, rules, used):
            used.update(i for i, _ in got)
            found.append(got)
    best = 0
    long = [s for s in found if len(s) >= rules.stretch]
    # shorter stretches must follow one another in the item: scattered ones are shared wording
    runs: list[list[list[tuple[int, int]]]] = [long]
    follows = lambda s, o: 0 < o[0][0] - s[-1][0] <= 3 and s[-1][1] < o[0][1]
    found.sort()
    for at, s in enumerate(found):
        run = [s]
        for o in found[at + 1 :]:
            if len(run) < 3 and follows(run[-1], o):
                run.append(o)
        runs.append(run)
    for kept in runs:
        held: set[int] = {i for s in kept for i, _ in s}
        spanned: set[int] = set()
        for s in kept:
            ends = beyond(doc, item, s[0], -1, held, rules.penalty) + s + beyond(doc, item, s[-1], 1, held, rules.penalty)
            inside = [i for i, _ in ends]
            held.update(inside)
            spanned.update(range(min(inside), max(inside) + 1))
        best = max(best, len(held), len(spanned) if len(held) >= rules.least * len(spanned) else 0)
    return best


def scan(texts: list[str | None], index: Items) -> list[tuple[int, int, int]]:
    """(text number, item number, leaked words) of all leaks in some texts."""
    r = index.rules
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    joined = [" ".join(w) for w in words]
    sizes = np.array([len(j) + 1 for j in joined], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    codes = grams("\n".join(joined), r.q)
    at = np.flatnonzero(index.sieve[(codes >> np.uint64(42)).astype(np.int64)])
    if not len(at) or not len(index.codes):
        return []
    slot = np.searchsorted(index.codes, codes[at])
    slot[slot == len(index.codes)] = 0
    hit = index.codes[slot] == codes[at]
    at, slot = at[hit], slot[hit]
    many = index.first[slot + 1] - index.first[slot]
    if not len(at):
        return []
    where = np.repeat(at, many)
    post = np.repeat(index.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    text = np.searchsorted(begin, where, side="right") - 1
    item, ipos, dpos = index.item[post], index.pos[post], where - begin[text]
    half = r.band // 2
    low = int(index.pos.max()) + half
    bin_ = (dpos - ipos + low) // half
    bins = int(bin_.max()) + 2
    n_items = len(index.words)
    key = (text * n_items + item) * bins + bin_
    cells, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    # a band is two neighbouring bins; every cell counts the better of its two bands
    right = np.zeros_like(count)
    next_ = np.flatnonzero(np.diff(cells) == 1)
    right[next_] = count[next_ + 1]
    left = np.zeros_like(count)
    left[next_ + 1] = count[next_]
    pair = cells // bins
    strong = count + np.maximum(left, right) >= index.local[pair % n_items]
    pairs, of = np.unique(pair, return_inverse=True)
    total = np.bincount(of, weights=count * strong, minlength=len(pairs))
    ok = (strong & (total >= index.need[pairs % n_items])[of])[inverse]
    out = []
    for t, k, bands in regions((key // bins)[ok], dpos[ok], ipos[ok], words, index):
        n = leaked_words(words[t], index.words[k], bands, r)
        if n >= r.words:
            out.append((t, k, n))
    return out


def stretches(runs: list[tuple[int, int]], rules: Rules) -> list[tuple[int, int, int]]:
    """(first item word, last, most matches) of what an alignment can make of the runs (item word, words) of one band.

    An upper bound: a gap counts as if every second word of it matched, and extra words of the
    document cost nothing.
    """
    out: list[tuple[int, int, int]] = []
    begin = end = score = most = 0
    for word, n in sorted(runs):
        fresh = word + n - max(word, end) if most else n
        if most and fresh <= 0:
            continue
        gap = max(0, word - end)
        left = score - rules.penalty * (gap - gap // 2) + gap // 2
        if most and left > 0:
            score, most, end = left + fresh, most + fresh + gap // 2, word + n
        else:
            if most >= rules.piece:
                out.append((begin, end - 1, most))
            begin, end, score, most = word, word + n, n, n
    if most >= rules.piece:
        out.append((begin, end - 1, most))
    return out


def hopeful(found: list[tuple[int, int, int]], rules: Rules) -> bool:
    """Whether stretches can be a leak: one long enough with what lies beyond its ends, two long ones, or pieces that follow one another."""
    if any(most >= int(rules.least * rules.words) - 2 * rules.penalty for _, _, most in found):
        return True
    if sum(most >= rules.stretch for _, _, most in found) >= 2:
        return True
    found = sorted(found)
    return any(0 < o[0] - s[1] <= 2 * rules.penalty for i, s in enumerate(found) for o in found[i + 1 :])


def regions(pair: np.ndarray, dpos: np.ndarray, ipos: np.ndarray, words: list[list[str]], index: Items) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text number, item number, bands to align) of pairs whose exact runs can make up a leak.

    Common q-grams one after another on one diagonal are a run of equal characters and hold
    so many whole words. A stretch never pays for a change before it has matched more words
    than the penalty, so each holds a run of that many; nearly all words of a stretch lie in
    runs of two words or more, and so do the matched words of a leak but for single words
    between two changes. Pairs and bands short of these counts are dropped.
    """
    r, n_items = index.rules, len(index.words)
    diagonal = dpos - ipos
    order = np.lexsort((ipos, diagonal, pair))
    pair, diagonal, ipos = pair[order], diagonal[order], ipos[order]
    if not len(pair):
        return
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (ipos[1:] != ipos[:-1] + 1)])
    last = np.r_[new[1:], len(pair)] - 1
    pair, diagonal, low, high = pair[new], diagonal[new], ipos[new], ipos[last] + r.q
    item = pair % n_items
    first = np.searchsorted(index.word_starts, index.offset[item] + low)
    held = np.searchsorted(index.word_ends, index.offset[item] + high, side="right") - first
    several = held >= 2
    pair, diagonal, item, first, held = pair[several], diagonal[several], item[several], first[several], held[several]
    if not len(pair):
        return
    cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    good = (np.maximum.reduceat(held, cuts) > r.penalty) & (np.add.reduceat(held, cuts) >= int(r.least * r.words) - r.penalty - 1)
    ends = np.r_[cuts[1:], len(pair)]
    of, starts = -1, np.zeros(0, dtype=np.int64)
    for lo, hi in zip(cuts[good].tolist(), ends[good].tolist()):
        t, k = int(pair[lo]) // n_items, int(item[lo])
        if t != of:
            of, starts = t, np.cumsum([0, *map(len, words[t][:-1])]) + np.arange(len(words[t]))
        word = first[lo:hi] - index.first_word[k]
        line = np.searchsorted(starts, index.starts[k][word] + diagonal[lo:hi], side="right") - 1 - word
        n = held[lo:hi]
        taken: list[tuple[int, int, int]] = []
        likely: list[tuple[int, int, int]] = []
        for at in np.argsort(-n, kind="stable").tolist():
            x = int(line[at])
            if n[at] <= r.penalty:
                break
            if all(abs(x - y) > r.reach // 2 for y, _, _ in taken):
                close = np.abs(line - x) <= r.reach // 2
                here = stretches(list(zip(word[close].tolist(), n[close].tolist())), r)
                if here:
                    likely += here
                    taken.append((x, min(s[0] for s in here) - r.reach, max(s[1] for s in here) + r.reach))
        if taken and hopeful(likely, r):
            yield t, k, taken


def find_leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    rules: Rules = Rules(), block_chars: int = 2_000_000, chunk_chars: int = 400_000,
) -> DataFrame:
    """Columns ``key``, ``item_key``, ``words``: every document holding a passage of an item.

    A passage is at least ``rules.words`` words of the item in their order, changed ones
    included, in stretches of at least ``rules.stretch`` words or up to three of ``rules.piece``
    that follow one another in the item, whatever the case, blanks and punctuation, about one word in ten changed. Null and empty texts on either side and items with fewer words match nothing;
    repeated documents and items each count. Integer keys; other columns play no part. Items
    are indexed in blocks of at most about ``block_chars`` characters, which bounds what is
    broadcast: more items mean more passes over the corpus, none is left out. Documents are
    taken whole, ``chunk_chars`` only groups small ones.
    """
    item_rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    chars = item_rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    rows = spread(corpus.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''"))
    context = corpus.sparkSession.sparkContext
    out = None
    for b in range(blocks):
        part = item_rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else item_rows
        shared = context.broadcast([(r["i"], r["t"]) for r in part.collect()])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Items(shared.value, rules)
            for batch in batches:
                sizes = batch["t"].str.len().cumsum().to_numpy() // chunk_chars
                for _, g in batch.groupby(sizes):
                    found = scan(g["t"].tolist(), index)
                    ks = g["k"].to_numpy()
                    yield pd.DataFrame(
                        {"k": [int(ks[t]) for t, _, _ in found], "i": [int(index.ids[i]) for _, i, _ in found], "w": [n for _, _, n in found]}
                    ).astype({"k": "int64", "i": "int64", "w": "int32"})

        got = rows.mapInPandas(run, "k bigint, i bigint, w int")
        out = got if out is None else out.unionByName(got)
    return out.groupBy(F.col("k").alias(key), F.col("i").alias(item_key)).agg(F.max("w").alias("words"))
