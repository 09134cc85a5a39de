"""Paired evaluation: tallies, ledgers, cross-tabs, percentiles, differences, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, running


def tally(rows: DataFrame, old: Column, new: Column, slices: str) -> DataFrame:
    """Per slice, and over all (slice null): n, correct before and after, fixes, regressions, net."""
    marked = rows.select(F.col(slices).alias("slice"), old.alias("old"), new.alias("new"))
    both = marked.groupingSets([[F.col("slice")], []], F.col("slice"))
    return both.agg(F.count("*").alias("n"), F.count_if("old").alias("correct_old"), F.count_if("new").alias("correct_new"), F.count_if(~F.col("old") & F.col("new")).alias("fixes"), F.count_if(F.col("old") & ~F.col("new")).alias("regressions")).withColumn("net", F.col("fixes") - F.col("regressions"))


def ledger(base: DataFrame, arm: DataFrame, key: list[str], answer: str, truth: str) -> DataFrame:
    """(key, before, after, kind) where the answer changed: fix, regression, wrong_to_wrong, added, removed. base holds the truth."""
    a = base.select(*key, F.col(answer).alias("before"), F.col(truth).alias("truth"), F.lit(1).alias("in_base"))
    b = arm.select(*key, F.col(answer).alias("after"), F.lit(1).alias("in_arm"))
    both = a.join(b, key, "full")
    kind = (
        F.when(F.col("in_base").isNull(), "added").when(F.col("in_arm").isNull(), "removed")
        .when(F.col("after").eqNullSafe(F.col("truth")), "fix").when(F.col("before").eqNullSafe(F.col("truth")), "regression").otherwise("wrong_to_wrong")
    )
    return both.where(F.col("in_base").isNull() | F.col("in_arm").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select(*key, "before", "after", kind.alias("kind"))


def cross_tab(rows: DataFrame, by: str, cell: str, cells: list[str]) -> DataFrame:
    """One row per `by` with a count for each cell, 0 where there is none."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(cell) == c).alias(f"n_{c}") for c in cells], F.count("*").alias("n"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, min, lower median, nearest-rank p95, p95 by floor and rounded index, max, zeros. Nulls do not count.

    Equal values are counted first; the places of different values come from running sums over ranges of them, so that no group is one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("m"))
    placed = running(counted, [value], "m", by)
    sizes = counted.groupBy(by).agg(F.sum("m").alias("n"))
    sized = placed.join(sizes.withColumnRenamed(by, "by__"), F.col(by).eqNullSafe(F.col("by__"))).drop("by__")
    n, i, m = F.col("n"), F.col("before"), F.col("m")
    at = lambda k: F.max(F.when((i <= k) & (k < i + m), F.col(value)))
    return sized.groupBy(by).agg(
        F.first("n").alias("n"), F.min(value).alias("least"), at(F.ceil(n * 0.5) - 1).alias("p50_lower"), at(F.ceil(n * 0.95) - 1).alias("p95_nearest"),
        at(F.floor((n - 1) * 0.95)).alias("p95_floor"), at(F.floor((n - 1) * 0.95 + 0.5)).alias("p95_rounded"), F.max(value).alias("most"), F.sum(F.when(F.col(value) == 0, m).otherwise(0)).alias("zeros"),
    )


def diff(left: DataFrame, right: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """(key, path, left_value, right_value, kind) of every field that differs: changed, missing_left or missing_right. Values as text."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("v")) for p in paths])
        return df.select(key, F.explode(cells).alias("c")).select(key, F.col("c.path").alias("path"), F.col("c.v").alias(name), F.lit(1).alias(f"in_{name}"))

    both = long(left, "left_value").join(long(right, "right_value"), [key, "path"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("in_left_value").isNull() | F.col("in_right_value").isNull())
    kind = F.when(F.col("in_left_value").isNull(), "missing_left").when(F.col("in_right_value").isNull(), "missing_right").otherwise("changed")
    return both.select(key, "path", "left_value", "right_value", kind.alias("kind"))


def gates(figures: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) for named conditions over one row of figures, and 'all'; a null condition fails."""
    cells = [F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]
    whole = F.lit(True)
    for c in checks.values():
        whole = whole & F.coalesce(c, F.lit(False))
    return figures.select(F.explode(F.array(*cells, F.struct(F.lit("all").alias("gate"), whole.alias("passed")))).alias("g")).select("g.gate", "g.passed")


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, n_distinct, digest): a digest of a table that no order of rows changes.

    A sum and an exclusive-or of 60-bit row hashes: both are partial aggregates, so nothing is gathered or sorted.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_distinct"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))


def uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """(n, n_keys, n_null, unique)"""
    return rows.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null")).withColumn("unique", F.col("n") == F.col("n_keys"))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both): sizes of the differences and the intersection of two key sets."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    return x.join(y, key, "full").agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"))


def nested_values(rows: DataFrame, key: str, document: str, name: str) -> DataFrame:
    """(key, path, value): every value under a name in a JSON document (text), at any depth, in objects and in arrays; paths are like a.b[0].c.

    A level is taken apart into its members, and those that are objects or arrays are the next level, until one is empty: as many steps as the deepest document has levels. A value is its
    text, an object's or array's its JSON, a JSON null null. A document that does not parse, or has a name twice in one object, has no values.
    """
    level = checkpointed(rows.select(F.col(key).alias("own"), F.lit("").alias("at"), F.try_parse_json(document).alias("doc")).where(F.schema_of_variant("doc").rlike("^(OBJECT|ARRAY)")))
    out = None
    while True:
        members = level.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("doc").outer()))  # pos, key (null in arrays), value
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("at") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        members = members.select("own", F.concat("at", step).alias("at"), F.col("key").alias("name"), F.col("value").alias("doc"))
        found = members.where(F.col("name") == name).select(F.col("own").alias(key), F.col("at").alias("path"), F.col("doc").cast("string").alias("value"))
        out = found if out is None else out.union(found)
        level = checkpointed(members.where(F.schema_of_variant("doc").rlike("^(OBJECT|ARRAY)")).select("own", "at", "doc"))
        if level.isEmpty():
            return out


def scrubbed(rows: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """rows without the columns whose name matches a pattern (times, say), so that what is left can be compared."""
    import re

    return rows.select(*[c for c in columns if not re.search(pattern, c)])
