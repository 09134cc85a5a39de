"""Text expressions: tokens, normal forms, phrases, years, scripts, typed values. All are Column expressions but the two Unicode forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
#: Words that carry no identity.
STOP_WORDS = ["the", "of", "and", "de", "la", "le", "et", "der", "die", "das", "und", "el"]


def words(text: Column) -> Column:
    """All runs of letters and digits, lower-cased, in order; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words of two characters or more that are neither stop words nor digits alone.

    Upper and lower case are one; other Unicode forms (ligatures, full width, sharp s) are not: give nfkc_casefold(text) where they should be.
    """
    return F.filter(words(text), is_token)


def is_token(word: Column) -> Column:
    """Whether a word of `words` is one of `tokens`."""
    return (F.length(word) > 1) & ~word.isin(STOP_WORDS) & (F.translate(word, "0123456789", "") != "")


def norm(text: Column) -> Column:
    """Words one space apart."""
    return F.array_join(words(text), " ")


def trigrams_of(value: Column) -> Column:
    """Distinct runs of three characters; fewer than three give none. One pass: a look-ahead at every place."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(value, F.lit("(?=(.{3}))"), F.lit(1)), F.array().cast("array<string>")))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the normal form."""
    return trigrams_of(norm(text))


def char_grams(token: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of a token padded by a space on either side, repeats included."""
    padded = F.concat(F.lit(" "), token, F.lit(" "))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) < n, F.array().cast("array<string>")).otherwise(every)

    return F.concat(*map(runs, sizes))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of one normal form in another; an empty phrase is in none."""
    return (phrase != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def contains_run(haystack: Column, needle: Column) -> Column:
    """needle as a contiguous part of haystack."""
    n = F.size(needle)
    return (n > 0) & (F.size(haystack) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(haystack) - n + 1, F.lit(1))), lambda i: F.slice(haystack, i, n) == needle)


def edit_limit(length: Column) -> Column:
    """0, 1 or 2 edits for tokens shorter than 5, shorter than 9, or longer."""
    return F.when(length < 5, 0).when(length < 9, 1).otherwise(2)


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Within the edit limit of the shorter token; tokens with digits are equal or not."""
    limit = F.least(edit_limit(F.length(a)), edit_limit(F.length(b)))
    return (a == b) | (~a.rlike("[0-9]") & ~b.rlike("[0-9]") & (limit > 0) & (F.levenshtein(a, b) <= limit))


def is_year(token: Column) -> Column:
    return token.rlike(r"^(18|19|20)[0-9]{2}$")


def years(text: Column) -> Column:
    """Standalone years 1800 to 2099, in order, repeats included."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\b((?:18|19|20)[0-9]{2})\b"), F.lit(1)), F.array().cast("array<string>"))


def without_years(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(18|19|20)[0-9]{2}\b", " "), r" +", " "))


def script_class(text: Column) -> Column:
    """LAT, CYR, MIXED, OTHER (letters of neither) or NONE (no letters)."""
    lat, cyr = text.rlike(r"[A-Za-zÀ-ɏ]"), text.rlike(r"[Ѐ-ӿ]")
    return F.when(lat & cyr, "MIXED").when(cyr, "CYR").when(lat, "LAT").when(text.rlike(r"\p{L}"), "OTHER").otherwise("NONE")


def spelling(text: Column) -> Column:
    return F.regexp_replace(text, r"iya\b", "ia")


def consumed_values(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Keys of the aliases found as whole phrases, the longest alias first, each taking its words out of the text before shorter ones look.

    aliases: (phrase, key). The result is in that order, so 'extra small' is not also 'small'.
    """
    ordered = sorted(aliases, key=lambda a: (-len(a[0]), a[0]))
    table = F.array(*[F.struct(F.lit(f" {p} ").alias("p"), F.lit(k).alias("k")) for p, k in ordered])
    start = F.struct(F.concat(F.lit(" "), F.replace(norm(text), F.lit(" "), F.lit("  ")), F.lit(" ")).alias("t"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, alias: Column) -> Column:
        phrase = F.concat(F.lit(" "), F.replace(F.trim(alias["p"]), F.lit(" "), F.lit("  ")), F.lit(" "))
        hit = state["t"].contains(phrase)
        return F.struct(F.replace(state["t"], phrase, F.lit(" | ")).alias("t"), F.when(hit, F.array_append(state["found"], alias["k"])).otherwise(state["found"]).alias("found"))

    return F.aggregate(table, start, step, lambda s: F.array_distinct(s["found"]))


def compare_sets(observed: Column, expected: Column) -> Column:
    """unknown if either set is null or empty, matched if every observed value is expected, contradicted if none is, else partial."""
    both = F.size(F.array_intersect(observed, expected))
    return F.when(observed.isNull() | expected.isNull() | (F.size(observed) == 0) | (F.size(expected) == 0), "unknown").when(both == F.size(F.array_distinct(observed)), "matched").when(both == 0, "contradicted").otherwise("partial")


def ordinal_band(score: Column) -> Column:
    """1.0 from .90, .5 from .70, else .3; null for null."""
    return F.when(score.isNull(), None).when(score >= 0.9, 1.0).when(score >= 0.7, 0.5).otherwise(0.3)


#: Characters of a passage.
PASSAGE = 200
#: Where a passage may begin: controls and spaces, digits, Han. No form takes them away or joins them to what stands before or behind, and a sigma before or behind them is not inside a word.
_BREAK = r"\x00-\x200-9\x{4E00}-\x{9FFF}"


def passages(text: Column) -> Column:
    """A text cut into passages of PASSAGE characters and what is left of the word; null and empty texts have none. A word without a digit is not cut.

    The Unicode forms below and the lower case of a text are those of its passages, one behind another. As each of them keeps the characters that passages begin with,
    and forms only add to them, two of these are equal for a text if they are for all of its passages, and only then.
    """
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PASSAGE}}}[^{_BREAK}]*"), F.lit(0)), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """NFKD without marks, lower-cased."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("#", F.least(a.cast("string"), b.cast("string")), F.greatest(a.cast("string"), b.cast("string")))


def hash_share(salt: str, key: Column) -> Column:
    """A share in [0, 1) from the first 32 bits of a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
