"""Names, ids and tolerant parsing of text as columns."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that Unicode decomposition leaves as they are: fixed values.
TRANSLITERATION = {"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "ł": "l", "ə": "e", "ı": "i", "ħ": "h", "ŋ": "n"}
_FOLD = str.maketrans(TRANSLITERATION | {k.upper(): v for k, v in TRANSLITERATION.items() if len(k.upper()) == 1})


@functools.lru_cache(maxsize=200_000)
def normalise(name: str | None, transliterate: bool = False) -> str | None:
    """Small ASCII words of a name, single-spaced; ``&`` reads as "and", letters without an ASCII form break words
    unless they are transliterated."""
    if name is None:
        return None
    if transliterate:
        name = name.translate(_FOLD)
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).casefold().replace("&", " and ")
    return " ".join(re.findall(r"[a-z0-9]+", bare))


@F.pandas_udf(T.StringType())
def normalised_name(names: pd.Series) -> pd.Series:
    """:func:`normalise` of a column, in Arrow batches."""
    return names.map(normalise, na_action="ignore")


@F.pandas_udf(T.StringType())
def transliterated_name(names: pd.Series) -> pd.Series:
    """:func:`normalise` with transliteration, so that ``Łukasz Ðór`` is ``lukasz dor``."""
    return names.map(lambda n: normalise(n, True), na_action="ignore")


def ascii_name(name: Column) -> Column:
    """The same for ASCII names, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("&"), F.lit(" and "))), "[^a-z0-9]+", " "))


def compatible_names(a: Column, b: Column) -> Column:
    """Whether two normalised names can be one person's: the same words in any order, or one side's given name only an
    initial of the other's and the same last word, or all of a shorter name's words, two at least, in the longer."""
    x, y = F.split(a, " "), F.split(b, " ")
    last = F.element_at(x, -1) == F.element_at(y, -1)
    first = F.left(x[0], F.lit(1)) == F.left(y[0], F.lit(1))
    initial = (F.length(x[0]) == 1) | (F.length(y[0]) == 1)
    least = F.least(F.size(x), F.size(y))
    inside = (F.size(F.array_intersect(x, y)) == least) & (least >= 2)
    return (F.array_sort(x) == F.array_sort(y)) | ((least >= 2) & last & first & initial) | inside


def strip_affixes(name: Column, affixes: tuple[str, ...]) -> Column:
    """A normalised name without the listed words at either end, one or two of them."""
    words = "|".join(map(re.escape, affixes))
    bare = F.regexp_replace(F.regexp_replace(name, rf"^(?:(?:{words}) ){{1,2}}", ""), rf"(?: (?:{words})){{1,2}}$", "")
    return F.when(bare == "", name).otherwise(bare)


def contains_words(text: Column, words: Column) -> Column:
    """Whether the words occur whole and in a row in a single-spaced text."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def stable_id(kind: str, *parts: Column, namespace: str) -> Column:
    """A version-5 UUID over the kind and parts joined by bars, from built-in functions only."""
    name = F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    bits = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.concat_ws("-", *[F.substring(bits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def whole_number(text: Column) -> Column:
    """The integer part of a number written as text; null for blanks and anything else."""
    value = text.try_cast("double")
    return (F.floor(F.abs(value)) * F.signum(value)).cast("bigint")


def decimal_number(text: Column) -> Column:
    """A number written as text, a trailing percent sign ignored."""
    return F.rtrim(F.regexp_replace(text, r"%\s*$", "")).try_cast("double")


def passes_completed(total: Column, accuracy: Column) -> Column:
    """Completed passes and percentage, from a second value that is either: marked as a percentage, above the total or
    a number that isn't text means percent, otherwise a count. Null in, null out."""
    value = decimal_number(accuracy)
    percent = accuracy.endswith("%") | (value > total)
    return F.struct(F.when(percent, F.bround(total * value / 100)).otherwise(value).cast("bigint").alias("completed"), F.when(percent, value).otherwise(value * 100.0 / F.nullif(total, F.lit(0))).alias("percent"))


def text_list(text: Column) -> Column:
    """A list of texts delivered as JSON, as one bare text, or not at all; blanks are no element."""
    bare = F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), bare, F.array().cast("array<string>"))


def label_seed(base: int, *labels: str) -> Column:
    """A seed for each combination of labels: ``base`` plus the first eight bytes of their hash."""
    digest = F.sha2(F.concat_ws("|", *labels), 256)
    return F.lit(base).cast("decimal(20,0)") + F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def quarter_lines(low: Column, high: Column) -> Column:
    """All lines from ``low`` to ``high`` in steps of a quarter."""
    return F.transform(F.sequence(F.round(low * 4).cast("int"), F.round(high * 4).cast("int")), lambda q: q / 4.0)


def market_question(question: Column, home: Column, away: Column) -> Column:
    """``kind, side, line, home_score, away_score`` of a market's question about a match of two named sides; null kind
    where it follows none of the templates, or names another side."""
    q = F.trim(question)
    group = lambda pattern, n: F.nullif(F.regexp_extract(q, pattern, n), F.lit(""))
    side = lambda name: F.when(F.lower(name) == F.lower(home), "home").when(F.lower(name) == F.lower(away), "away")
    pair = F.concat(home, F.lit(" vs. "), away)
    after = F.when(F.startswith(F.lower(q), F.lower(F.concat(pair, F.lit(": ")))), F.substring(q, F.length(pair) + 3, F.lit(1 << 20)))
    rest = lambda pattern, n: F.nullif(F.regexp_extract(after, pattern, n), F.lit(""))
    win, spread = side(group(r"^Will (.+) win on \d{4}-\d{2}-\d{2}\?$", 1)), side(group(r"^Spread: (.+) \(-\d+(?:\.\d+)?\)$", 1))
    team = side(rest(r"^(.+) O/U \d+(?:\.\d+)?$", 1))
    exact = F.regexp_extract(q, r"^Exact Score: (.+) (\d+) - (\d+) (.+)\?$", 1)
    scored = (F.lower(exact) == F.lower(home)) & (F.lower(group(r"^Exact Score: (.+) (\d+) - (\d+) (.+)\?$", 4)) == F.lower(away))
    total = rest(r"^O/U (\d+(?:\.\d+)?)$", 1)
    kind = (
        F.when(win.isNotNull(), "win").when(F.lower(q) == F.lower(F.concat(F.lit("Will "), pair, F.lit(" end in a draw?"))), "draw").when(spread.isNotNull(), "handicap").when(team.isNotNull(), "team_total")
        .when(total.isNotNull(), "total").when(after == "Both Teams to Score", "both_score").when(scored, "exact")
    )
    line = F.coalesce(F.when(spread.isNotNull(), group(r"\(-(\d+(?:\.\d+)?)\)$", 1)), F.when(team.isNotNull(), rest(r" O/U (\d+(?:\.\d+)?)$", 1)), total).cast("double")
    goals = lambda n: F.when(scored, group(r"^Exact Score: (.+) (\d+) - (\d+) (.+)\?$", n).cast("int"))
    return F.struct(kind.alias("kind"), F.coalesce(win, spread, team).alias("side"), line.alias("line"), goals(2).alias("home_score"), goals(3).alias("away_score"))
