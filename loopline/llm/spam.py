"""Pages of repeated keywords, links or tags instead of sentences, judged by line shapes.

Each line is reduced to a shape: links, hashtags and numbers become one letter each, a run of
words another (one with a lower-case word, or names alone), separators stay, lists of many
short items are one sign, and the count of words stands in front in three steps. The shape
alone says which class a line is of. The lines of a page are grouped by shape, and a group
counts against the page when its words keep repeating more than its class allows: links and
tags always count, lists, rows of labels and bare phrases (no sentences) at little repetition,
long lines and sentences only at much, and records, which are led or ended by numbers as in
timetables, lists of places and logs, only where even the numbers repeat. A page is flagged
when the groups that count hold most of its text. All of it is built-in functions over the
rows of the corpus: no Python, no shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopline.session import spread

#: Patterns of a line's parts. None of them crosses a line end.
LINE_ENDS = "[\\r\\n\\x0b\\x0c\\x85\\u2028\\u2029]+"
LINKED_MARKUP = r"<[^<>\n]*?(?:href|://)[^<>\n]*+>"
MARKUP = r"<[^<>\n]*+>"
LINK = r"(?:https?://|www\.)[^\s<>\")\]\x01]++|(?<![\p{L}\p{N}_.-])[\p{L}\p{N}_-][\p{L}\p{N}_.-]*\.[a-z]{2,10}(?:/[^\s<>\")\]]*+)?(?![\p{L}\p{N}_.])"
HASHTAG = r"#[\p{L}\p{M}\p{N}_]++"
NUMBER = r"\d[\d:.,/-]*+"
NAME = r"\p{Lu}[\p{L}\p{M}\p{N}_'’-]*+"
WORD = r"\p{L}[\p{L}\p{M}\p{N}_'’-]*+"
NO_WORD = r"[^\p{L}\p{M}\p{N}\n:.,/-]++|(?<!\p{N})[:.,/-]++|[:.,/-]++(?!\p{N})"
#: The steps from tokens to a shape. What repeats has a fixed length, so that the longest line needs no deep stack.
SHAPES = [
    (r"[ \t\xa0]++", " "), (r" ?([,;|،/·•>»~+–—-]) ?", "$1"), (r"\x04(?: \x04)*+", "A"), (r"[Aa](?: [Aa])++", "a"),
    (r"\x01(?: \x01)*+", "L"), (r"\x02(?: \x02)*+", "#"), (r"\x03(?: \x03)*+", "9"), (r"[Aa](?:[,;|،/·•>»~+–—-][Aa]){5,}+", "&"),
]
SENTENCE_END = "[.!?।…][^AaL#9]*$"


class Rules(NamedTuple):
    """Bounds on the variety of a group's words (distinct share in windows of ``window`` words), by class of shape.

    ``lists`` holds for lists and rows of labels, ``phrases`` for bare phrases and for lines of
    ``long`` words or more without a number or the end of a sentence, ``lines`` for other long
    lines and repeated other shapes, ``sentences`` for three sentences or more of one shape.
    Groups of fewer than ``least`` words are too short to repeat.
    """

    lists: float = 0.9
    phrases: float = 0.65
    lines: float = 0.36
    sentences: float = 0.25
    window: int = 50
    long: int = 25
    least: int = 12


def tokens_of(text: Column) -> tuple[Column, Column]:
    """A text's tokens (signs for links, tags, numbers, names and words, separators as they are) and its lower-case words and numbers."""
    marked = F.regexp_replace(F.regexp_replace(text, LINKED_MARKUP, "\x01"), MARKUP, " ")
    marked = F.regexp_replace(F.regexp_replace(marked, LINK, "\x01"), HASHTAG, "\x02")
    tokens = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, NUMBER, "\x03"), NAME, "\x04"), WORD, "a")
    return tokens, F.regexp_replace(F.lower(marked), NO_WORD, " ")


def shape_of(tokens: Column) -> Column:
    """Shapes of tokens: links L, tags #, numbers 9, runs of names A, runs with other words a, lists &, separators as they are."""
    return reduce(lambda s, step: F.regexp_replace(s, *step), SHAPES, tokens)


def _lines(rules: Rules) -> str:
    """SQL for the lines of a page: their class and group by shape alone, their characters and words."""
    count = lambda signs: f"(length(l.t) - length(translate(l.t, '{signs}', '')))"
    words, small = count("\\u0004a"), count("a")
    shape, tail = "trim(l.s)", "right(trim(l.s), 12)"
    bare = f"{shape} not like '%9%' and not {tail} rlike '{SENTENCE_END}'"
    kind = f"""
      case when {shape} like '{{%' then 'data'
        when {count(chr(92) + 'u0001')} > 0 and {words} <= 6 * {count(chr(92) + 'u0001')} then 'link'
        when {count(chr(92) + 'u0002')} > 0 and {count(chr(92) + 'u0002')} >= {words} then 'tag'
        when {shape} like '[%' then 'data'
        when {shape} rlike '^9|9$' then 'record'
        when {shape} like '%&%' and 2 * {small} >= {words} and {bare} then 'list'
        when {shape} rlike '^[Aa][^|]*[|][^|]*9[^|]*[|](?:[^|]*[|])?[^|9]*[Aa]$' then 'row'
        when {words} >= {rules.long} then if({bare}, 'run', 'long')
        when {tail} rlike '{SENTENCE_END}' then 'sentence'
        when not {shape} rlike '[L#9]' and 10 * {small} >= 3 * {words} and {small} > 0 then 'phrase'
        else 'other' end"""
    return f"""
      transform(transform(filter(arrays_zip(p, t, s, w), l -> trim(l.p) <> ''),
        l -> struct({kind} as kind, concat(case when {words} < {rules.least} then 1 when {words} < {rules.long} then 2 else 3 end, {shape}) as shape, length(trim(l.p)) as chars, trim(l.w) as words)),
        l -> struct(if(l.kind = 'phrase', 'phrase', concat(l.kind, l.shape)) as g, l.kind, l.chars, l.words))"""


def spam_share(df: DataFrame, text: str, rules: Rules = Rules()) -> DataFrame:
    """Adds ``share``: the share of a page's characters in groups that count; 0 where there is no text."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINE_ENDS, "\n")
    tokens, bare = tokens_of(F.col("plain"))
    df = df.withColumn("plain", plain).withColumns({"tokens": tokens, "bare": bare}).withColumn("shapes", shape_of(F.col("tokens")))
    df = df.withColumns({a: F.split(c, "\n") for a, c in (("p", "plain"), ("t", "tokens"), ("s", "shapes"), ("w", "bare"))})
    df = df.withColumn("lines", F.expr(f"array_sort({_lines(rules)})"))
    # equal shapes lie side by side now: a group is a slice
    df = df.withColumn("first", F.expr("filter(transform(lines, (l, i) -> if(i = 0 or l.g <> get(lines, i - 1).g, i + 1, 0)), i -> i > 0)"))
    df = df.withColumn("groups", F.expr("""
      transform(transform(first, (b, k) -> slice(lines, b, coalesce(get(first, k + 1), size(lines) + 1) - b)),
        g -> struct(g[0].kind as kind, size(g) as lines, aggregate(g, 0L, (n, l) -> n + l.chars) as chars,
                    filter(split(array_join(g.words, ' '), ' +'), w -> w <> '') as words))"""))
    variety = f"""
      if(size(g.words) = 0, 1D, aggregate(sequence(0, greatest(0, size(g.words) - {rules.window // 2} - 1), {rules.window}), struct(0D as s, 0 as n),
        (a, i) -> struct(a.s + size(array_distinct(slice(g.words, i + 1, {rules.window}))) / least({rules.window}, size(g.words) - i) as s, a.n + 1 as n), a -> a.s / a.n))"""
    df = df.withColumn("judged", F.expr(f"transform(groups, g -> struct(g.kind, g.lines, g.chars, size(g.words) as n, {variety} as variety, if(g.kind = 'record', filter(g.words, w -> w rlike '^[0-9]'), array()) as numbers))"))
    counts = f"""
      case g.kind when 'link' then true when 'tag' then true when 'data' then false
        when 'record' then g.lines >= 3 and g.n >= {rules.least} and 2 * size(array_distinct(g.numbers)) < size(g.numbers) and g.variety < {rules.lines}
        when 'long' then g.variety < {rules.lines}
        when 'sentence' then g.lines >= 3 and g.n >= {rules.least} and g.variety < {rules.sentences}
        when 'other' then g.lines >= 3 and g.n >= {rules.least} and g.variety < {rules.lines}
        when 'list' then g.variety < {rules.lists}
        when 'row' then g.n >= {rules.least} and g.variety < {rules.lists}
        else g.n >= {rules.least} and g.variety < {rules.phrases} end"""
    share = f"aggregate(judged, 0L, (n, g) -> n + if({counts}, g.chars, 0L)) / nullif(aggregate(judged, 0L, (n, g) -> n + g.chars), 0L)"
    return df.withColumn("share", F.expr(f"coalesce({share}, 0D)"))


def find_spam(corpus: DataFrame, key: str, text: str, most: float = 0.5, rules: Rules = Rules()) -> DataFrame:
    """``key`` and ``share`` of the pages more than ``most`` of whose text is in groups of lines that count.

    Null, empty and blank texts are no spam. Whole texts are read; repeated rows each count.
    Other columns and their names play no part. Rows are judged one by one, without a shuffle.
    """
    rows = spread(corpus.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''"))
    judged = spam_share(rows, "t", rules)
    # a filter would be pushed below the steps and repeat them; a generator is not
    return judged.select(F.col("k").alias(key), F.explode(F.when(F.col("share") > most, F.array("share")).otherwise(F.array().cast("array<double>"))).alias("share"))
