"""Quality rules: an ordered list of threshold conjunctions, learnt from labelled statistics and written as Spark conditional expressions.

Only DataFrame expressions. The statistics of a text are counts of its words, lines and characters. Shares of these counts, as whole numbers from 0 to TOP, are what rules look at. Sequential covering grows
one rule after the other on two thirds of the labelled rows: each step is one aggregation that counts good and bad rows by feature and value (at most TOP + 1 values a feature, whatever the number of
rows), and takes the threshold of the largest gain of information. A rule then loses the last conditions that do not help on the third of the rows that is set aside, stands if it is pure
enough there, and takes the rows that it covers away before the next one is grown.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed

GAP = r"[ \t\n\x0B\f\r]"
NOT_GAP = r"[^ \t\n\x0B\f\r]"
#: Largest value of a feature.
TOP = 1000
#: Rules of a list and conditions of a rule at most; bad rows that a rule must cover where it is grown; share of bad rows among those it covers where it is pruned.
MOST_RULES, MOST_CONDITIONS, LEAST_COVERED, PURITY = 24, 4, 5, 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_different", "n_upper", "n_digits", "n_single", "n_ended", "n_marks"]


def _share(part: str, whole: str) -> str:
    return f"cast(least({TOP}, {TOP} * {part} div greatest({whole}, 1)) as int)"


#: name: SQL over the counts. Whole-number division: a threshold is met or not without rounding.
FEATURES = {
    "symbols_per_1000_words": _share("n_symbols", "n_words"),
    "repeated_lines_of_1000": _share("n_dup_lines", "n_lines"),
    "repeated_words_of_1000": _share("n_repeat_words", "n_words"),
    "different_words_of_1000": _share("n_different", "n_words"),
    "capitals_of_1000": _share("n_upper", "word_chars"),
    "digits_of_1000": _share("n_digits", "word_chars"),
    "single_characters_of_1000": _share("n_single", "n_words"),
    "ended_lines_of_1000": _share("n_ended", "n_lines"),
    "marks_per_1000_characters": _share("n_marks", "word_chars"),
    "characters_per_100_words": f"cast(least({TOP}, 100 * word_chars div greatest(n_words, 1)) as int)",
    "words_per_line": f"cast(least({TOP}, n_words div greatest(n_lines, 1)) as int)",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more.

    Texts whose windows all have different hashes have none. In others, windows are sorted by 33 bits of their hash and their place, as longs; neighbours of equal bits are sorted again by their
    words, so that windows are equal only if their words are. The places of those with an equal neighbour, in order, cover three words each, less what the one before has covered.
    """
    window = lambda w, p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    bits = lambda x: F.shiftright(x, 31)
    beside = lambda xs, i, same: F.coalesce(same(F.get(xs, i - 1)), F.lit(False)) | F.coalesce(same(F.get(xs, i + 1)), F.lit(False))
    none = F.lit(0).cast("long")

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda p: F.xxhash64(F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))

    def alike(keys: Column) -> Column:
        return F.filter(keys, lambda x, i: beside(keys, i, lambda y: bits(x) == bits(y)))

    def spelt(w: Column, keys: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.sort_array(F.transform(keys, lambda x: F.struct(window(w, place(x)).alias("v"), place(x).alias("p"))))

    def places(found: Column) -> Column:
        return F.sort_array(F.transform(F.filter(found, lambda x, i: beside(found, i, lambda y: x["v"] == y["v"])), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get(at, i - 1), F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)

    def count(w: Column, h: Column) -> Column:
        return let(placed(h), lambda keys: let(alike(keys), lambda near: let(spelt(w, near), lambda found: let(places(found), covered))))

    def of(w: Column) -> Column:
        return let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(count(w, h)))

    return let(words, lambda w: F.when(F.size(w) < 3, none).otherwise(of(w)))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, and COUNTS as longs) of every whole text; a null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id", "text", F.array_remove(F.split("text", GAP), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_GAP)).alias("lines"),
    )
    only = lambda kind: F.char_length(F.regexp_replace("text", f"[^{kind}]+", ""))
    counts = {
        "n_words": F.size("w"), "word_chars": F.char_length(F.array_join("w", "")), "n_symbols": only("#*$%&|<>"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("w")), "n_lines": F.size("lines"), "n_different": F.size(F.array_distinct("w")), "n_upper": only("A-Z"), "n_digits": only("0-9"),
        "n_single": F.size(F.filter("w", lambda x: F.char_length(x) == 1)), "n_ended": F.size(F.filter("lines", lambda x: x.rlike(r"[.!?]\s*$"))), "n_marks": only(".,;!?"),
    }
    return rows.select("doc_id", *(counts[c].cast("long").alias(c) for c in COUNTS))


#: The base rule: too few words, or too many of them in repeated windows.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Condition:
    """A feature that is at least, or at most, a value."""

    feature: str
    at_least: bool
    value: int

    def over(self, features: dict[str, str] | None = None) -> str:
        return f"{(features or FEATURES)[self.feature]} {'>=' if self.at_least else '<='} {self.value}"

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a text. One that none takes is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def expression(self) -> Column:
        """True for texts that are kept, over the counts of statistics()."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(F.expr(" and ".join(f"({c.over()})" for c in rule)), F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["else keep"])


def gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    """FOIL's gain of information of a condition that leaves bad and good of all rows that a rule covers."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def best(counts: list[tuple[int, int, int, int]], names: list[str], least: int) -> Condition | None:
    """The condition of the largest gain. counts: (feature, value, bad, good) of the rows that a rule covers so far. Ties go to the earlier feature, `at least`, and the smaller value.

    A threshold lies in the middle between the last value that it takes and the next that it leaves; one that leaves none is no condition.
    """
    found, most = None, 1e-9
    for k, name in enumerate(names):
        own = sorted((v, b, g) for f, v, b, g in counts if f == k)
        all_bad, all_good = sum(x[1] for x in own), sum(x[2] for x in own)
        for at_least in (True, False):
            bad = good = 0
            options, inward = [], own[::-1] if at_least else own
            for (v, b, g), (after, _, _) in zip(inward, inward[1:], strict=False):
                bad, good = bad + b, good + g
                options.append(((v + after + at_least) // 2, bad, good))
            for v, b, g in sorted(options):
                if b >= least and (value := gain(b, g, all_bad, all_good)) > most + 1e-9:
                    found, most = Condition(name, at_least, v), value
    return found


def learn(rows: DataFrame, features: dict[str, str] | None = None) -> DecisionList:
    """Rules that tell bad rows. rows: bad (boolean), aside (boolean: set aside for pruning), and the counts that `features` (FEATURES if None) look at.

    The order and number of partitions of rows play no part. Without bad or without good rows the list is empty.
    """
    features = features or FEATURES
    names = list(features)
    left = checkpointed(rows.select("bad", "aside", *(F.expr(sql).alias(name) for name, sql in features.items())))
    holds = lambda rule: F.expr(" and ".join(["true", *map(str, rule)]))
    out = DecisionList()
    while len(out.rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            cells = left.where(~F.col("aside") & holds(rule)).select("bad", F.posexplode(F.array(*names)).alias("feature", "value"))
            counts = [tuple(r) for r in cells.groupBy("feature", "value").agg(F.count_if("bad"), F.count_if(~F.col("bad"))).collect()]  # at most (TOP + 1) rows a feature
            more = best(counts, names, LEAST_COVERED)
            if more is None:
                break
            rule.append(more)
            first = [(v, b, g) for f, v, b, g in counts if f == names.index(more.feature)]
            if not sum(g for v, _, g in first if (v >= more.value if more.at_least else v <= more.value)):
                break
        if not rule:
            break
        tried = [rule[: k + 1] for k in range(len(rule))]
        aside = left.where("aside").agg(*(F.count_if(holds(r) & (F.col("bad") == b)) for r in tried for b in (True, False))).first()
        worth = [((aside[2 * k] - aside[2 * k + 1]) / max(1, aside[2 * k] + aside[2 * k + 1]), -k) for k in range(len(tried))]
        k = -max(worth)[1]
        if aside[2 * k] < PURITY * (aside[2 * k] + aside[2 * k + 1]) or not aside[2 * k]:
            break
        out.rules.append(tuple(tried[k]))
        left = left.where(~holds(tried[k]))
    return out


def labelled(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """counts with bad and aside: rows of documents with one known quality that the base rule leaves. Every third id, by hash, is set aside."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    known = known.select("doc_id", (F.col("low") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("aside"))
    return counts.where(~F.expr(BASE_FAILED)).join(known, "doc_id")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document.

    Null, empty and wordless texts have no words and fail the base rule; rows of a null id are judged like others but teach nothing; every copy of a repeated row is judged alike, and teaches as often as
    it is there; labels of one id that differ teach nothing; without labels of both kinds what the base rule leaves is kept; an empty table gives no rows; other columns play no part.
    """
    counts = checkpointed(statistics(docs))
    rules = learn(labelled(counts, labels))
    base = F.expr(BASE_FAILED)
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & rules.expression()).alias("kept"))
