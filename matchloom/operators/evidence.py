"""Evidence for candidates: lines, coverage, exclusivity, rivals, typed states, skylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as tx

from .graph import checkpointed, sided
from .retrieval import covering


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, idx, line) of every text, in order."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "line"))


def grouped_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, reading, n, first_idx, idxs): lines of equal normal form, in first-seen order by first_idx; wordless lines go."""
    return rows.withColumn("reading", tx.norm(F.col("line"))).where("reading != ''").groupBy(key, "reading").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.array_join(F.sort_array(F.collect_list("idx")), ",").alias("idxs"))


def previous_and_next(rows: DataFrame, key: str, value: str, ahead: int = 3) -> DataFrame:
    """rows with the value of the line before and of the `ahead` lines after."""
    w = Window.partitionBy(key).orderBy("idx")
    return rows.withColumn("before", F.lag(value).over(w)).withColumns({f"after_{i}": F.lead(value, i).over(w) for i in range(1, ahead + 1)})


def coverage(claims: DataFrame, read: DataFrame, claim: str, packet: str, weight: str = "w", floor: float = 0.0) -> DataFrame:
    """(claim, packet, coverage, n_read): the weighted share of a claim's terms that a packet reads, each term once at its best grade, from `floor` on.

    claims: claim, term, weight; read: packet, term, grade in 0..1. Terms that no claim has do not leave their task; with a floor, packets are
    found by the heaviest terms of a claim (see retrieval.covering).
    """
    wanted = sided(checkpointed(claims.select("term").distinct()))
    best = read.join(wanted, "term", "left_semi").groupBy(packet, "term").agg(F.max("grade").alias("grade"))
    if floor > 0:
        got = covering(claims, best, claim, packet, weight, floor, F.col("grade"))
        return got.select(claim, packet, F.round(F.col("hit") / F.col("mass"), 9).alias("coverage"), "n_read")
    mass = claims.groupBy(claim).agg(F.sum(weight).alias("mass"))
    hit = claims.join(best, "term").groupBy(claim, packet).agg(F.sum(F.col(weight) * F.col("grade")).alias("hit"), F.count("*").alias("n_read"))
    return hit.join(mass, claim).where("mass > 0").select(claim, packet, F.round(F.col("hit") / F.col("mass"), 9).alias("coverage"), "n_read")


def exclusivity(marks: DataFrame, pool: str, candidate: str, line: str) -> DataFrame:
    """(pool, candidate, n_lines, exclusivity): mean over a candidate's lines of 1 minus the share of the other candidates on that line; 1 alone in a pool.

    marks: distinct rows (pool, candidate, line). Counts by line replace a self-join.
    """
    size = marks.groupBy(pool).agg(F.countDistinct(candidate).alias("size"))
    on_line = marks.groupBy(pool, line).agg(F.count(candidate).alias("on_line"))
    each = marks.join(on_line, [pool, line]).join(size, pool)
    share = F.when(F.col("size") > 1, 1 - (F.col("on_line") - 1) / (F.col("size") - 1)).otherwise(1.0)
    return each.groupBy(pool, candidate).agg(F.count("*").alias("n_lines"), F.round(F.avg(share), 9).alias("exclusivity"))


def pool_rarity(marks: DataFrame, pool: str, candidate: str, term: str) -> DataFrame:
    """(pool, term, f, rarity): ln((n + 1) / (f + 1)) / ln(n + 1) of a term that f of n candidates hold."""
    size = marks.groupBy(pool).agg(F.countDistinct(candidate).alias("n"))
    f = marks.groupBy(pool, term).agg(F.countDistinct(candidate).alias("f"))
    return f.join(size, pool).select(pool, term, "f", F.round(F.log((F.col("n") + 1) / (F.col("f") + 1)) / F.log(F.col("n") + 1), 9).alias("rarity"))


def rivals(rows: DataFrame, pool: str, candidate: str, group: str, score: str) -> DataFrame:
    """rows with `rival`, the best score in the pool among rows of another group (null if there is none), and the lead over it.

    The best of each group and the two best groups of a pool suffice: no row meets every other.
    """
    groups = rows.groupBy(pool, group).agg(F.max(score).alias("best"))
    w = Window.partitionBy(pool).orderBy(F.desc("best"), group)
    top2 = groups.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(pool).agg(F.max(F.when(F.col("r") == 1, F.col(group))).alias("g1"), F.max(F.when(F.col("r") == 1, F.col("best"))).alias("b1"), F.max(F.when(F.col("r") == 2, F.col("best"))).alias("b2"))
    rival = F.when(F.col(group) == F.col("g1"), F.col("b2")).otherwise(F.col("b1"))
    return rows.join(top2, pool).withColumn("rival", rival).withColumn("lead", F.col(score) - F.col("rival")).drop("g1", "b1", "b2")


def family_terms(rows: DataFrame, family: str, member: str, term: str) -> DataFrame:
    """(family, members, n_union, n_common): distinct terms of a family, and those that all of its members have. rows are distinct."""
    size = rows.groupBy(family).agg(F.countDistinct(member).alias("members"))
    per = rows.groupBy(family, term).agg(F.countDistinct(member).alias("holders")).join(size, family)
    return per.groupBy(family).agg(F.first("members").alias("members"), F.count("*").alias("n_union"), F.count_if(F.col("holders") == F.col("members")).alias("n_common"))


def typed_states(observed: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) for every key of either side: matched, contradicted, partial or unknown, on the sets of values."""
    o = observed.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("seen"))
    e = expected.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("wanted"))
    return o.join(e, key, "full").select(key, tx.compare_sets(F.col("seen"), F.col("wanted")).alias("state"))


def skyline(rows: DataFrame, by: str, first: Column, second: Column, key: str) -> DataFrame:
    """Rows that no other row of their partition beats: smaller or equal in both values and smaller in one.

    Ordered by the first value, a row stays if its second value is below all that came before, or equal in both to one that stays.
    """
    r = rows.withColumns({"a__": first, "b__": second})
    w = Window.partitionBy(by).orderBy("a__").rangeBetween(Window.unboundedPreceding, -1)
    before = r.withColumn("least_before", F.min("b__").over(w)).withColumn("least_equal", F.min("b__").over(Window.partitionBy(by, "a__")))
    kept = before.where((F.col("b__") == F.col("least_equal")) & (F.col("least_before").isNull() | (F.col("b__") < F.col("least_before"))))
    return kept.drop("a__", "b__", "least_before", "least_equal")


def holders_of_all(pairs: DataFrame, wanted: DataFrame, owner: str, term: str, group: str) -> DataFrame:
    """(group, owner): relational division, owners that have every term of a group. Both inputs are distinct."""
    need = wanted.groupBy(group).agg(F.count(term).alias("need"))
    have = wanted.join(pairs, term).groupBy(group, owner).agg(F.count(term).alias("have"))
    return have.join(need, group).where("have = need").select(group, owner)
