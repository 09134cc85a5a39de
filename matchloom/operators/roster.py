"""Rosters: holds with reasons, budgets, galleries that only grow, repeats, choices between arms, and checks of expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import spread


def held(rows: DataFrame, key: str, decisions: DataFrame, order: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key, decision, reasons, role): rows with the first decision on them, by `order`, and why they are held: 'decision' if that is not 'keep', and every check that holds.

    decisions: (key, decision, order...). role is held with any reason, else fit.
    """
    first = decisions.withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r__ = 1").select(key, "decision")
    out = rows.join(first, key, "left")
    named = F.array_compact(F.array(F.when(F.coalesce(F.col("decision") != "keep", F.lit(False)), F.lit("decision")), *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    out = out.withColumn("reasons", F.array_join(named, ","))
    return out.select(key, "decision", "reasons", F.when(F.col("reasons") == "", "fit").otherwise("held").alias("role"))


def within_budget(rows: DataFrame, by: str, order: list, eligible: Column, budget: int) -> DataFrame:
    """rows with `eligible`, and `state`: tried while no more than `budget` eligible ones of the group came, then over_budget; others are not_eligible."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    n = F.sum(F.col("eligible").cast("int")).over(w)
    return out.withColumn("state", F.when(~F.col("eligible"), "not_eligible").when(n <= budget, "tried").otherwise("over_budget"))


def appended(parent: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """parent and the rows of new whose key it lacks, with `origin`; a new row of a known key raises unless it is equal to the old one."""
    columns = parent.columns
    both = parent.join(new.select(*(F.col(c).alias(f"{c}_new") for c in columns)), F.col(key) == F.col(f"{key}_new"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}_new"))
    if not both.where(differs).isEmpty():
        raise ValueError(f"rows of known {key} would change")
    added = new.select(columns).join(parent.select(key), key, "left_anti").select(columns)
    return parent.withColumn("origin", F.lit("parent")).unionByName(added.withColumn("origin", F.lit("added")))


def largest_difference(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """(n, only_a, only_b, most): aligned vectors of two tables, rows of one side only, and the largest difference of a component."""
    x, y = a.select(key, F.col(vector).alias("x")), b.select(key, F.col(vector).alias("y"))
    apart = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    both = x.join(y, key, "full").select(F.col("x").isNull().alias("no_x"), F.col("y").isNull().alias("no_y"), apart.alias("d"))
    return both.agg(F.count_if(~F.col("no_x") & ~F.col("no_y")).alias("n"), F.count_if("no_y").alias("only_a"), F.count_if("no_x").alias("only_b"), F.max("d").alias("most"))


def cycled(rows: DataFrame, by: str, order: list[str], steps: int) -> DataFrame:
    """(by, step, place) and the rows: `steps` presentations of each group, its rows again and again in order."""
    w = Window.partitionBy(by).orderBy(*order)
    placed = rows.withColumns({"place": F.row_number().over(w) - 1, "n__": F.count("*").over(Window.partitionBy(by))})
    turns = F.transform(F.sequence(F.lit(0), F.ceil((F.lit(steps) - F.col("place")) / F.col("n__")).cast("int") - 1), lambda k: F.col("place") + k * F.col("n__").cast("int"))
    return placed.where(F.col("place") < steps).withColumn("step", F.explode(turns)).drop("n__")


def seed(key: Column, salt: str) -> Column:
    """A 31-bit seed from a salted digest, the same on every run."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % F.lit(1 << 31)).cast("long")


def arm_choice(base: DataFrame, arms: dict[str, DataFrame], key: str, answer: str, truth: str) -> DataFrame:
    """(arm, fixes, regressions, lost_fixes, chosen): arms against a base that holds the truth. lost_fixes: fixes of the other arms that an arm lacks.

    An arm is chosen if it has fixes, no regression and loses no fix of another; of several the one of most fixes, then of the smaller name; none: no row is chosen.
    """
    marked = None
    for name, arm in arms.items():
        both = base.select(key, F.col(answer).alias("before"), F.col(truth).alias("truth")).join(arm.select(key, F.col(answer).alias("after")), key)
        ok = lambda c: F.coalesce(F.col(c) == F.col("truth"), F.lit(False))
        own = both.select(key, F.lit(name).alias("arm"), (ok("after") & ~ok("before")).alias("fix"), (ok("before") & ~ok("after")).alias("loss"))
        marked = own if marked is None else marked.union(own)
    fixed = marked.where("fix").select(key).distinct().withColumn("some", F.lit(True))
    per = marked.join(fixed, key, "left").groupBy("arm").agg(F.count_if("fix").alias("fixes"), F.count_if("loss").alias("regressions"), F.count_if(F.coalesce("some", F.lit(False)) & ~F.col("fix")).alias("lost_fixes"))
    passes = (F.col("fixes") > 0) & (F.col("regressions") == 0) & (F.col("lost_fixes") == 0)
    w = Window.partitionBy(F.lit(0)).orderBy(F.when(passes, 0).otherwise(1), F.desc("fixes"), "arm")  # one row an arm
    return per.withColumn("chosen", passes & (F.row_number().over(w) == 1))


def expectations(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, ok) for every expected value; a value that is absent or occurs twice is not ok. Both: key and value."""
    have = actual.groupBy(key).agg(F.count("*").alias("n"), F.max("value").alias("actual"))
    out = expected.select(key, F.col("value").alias("expected")).join(have, key, "left")
    return out.select(key, "expected", "actual", (F.coalesce(F.col("n") == 1, F.lit(False)) & F.col("actual").eqNullSafe(F.col("expected"))).alias("ok"))


def unique_versions(asked: DataFrame, versions: DataFrame, digest: str, version: str) -> DataFrame:
    """(digest, n, version, state): the one version of a digest; missing, or ambiguous where several have it."""
    found = versions.groupBy(digest).agg(F.countDistinct(version).alias("n"), F.min(version).alias("v"))
    out = asked.select(digest).distinct().join(found, digest, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(digest, "n", F.when(F.col("n") == 1, F.col("v")).alias(version), F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "bound").otherwise("ambiguous").alias("state"))


def listwise_admitted(rows: DataFrame, query: str, key: str, label: str, ignored: str) -> DataFrame:
    """(query, n, positives, kept, reasons, admitted) of ranking rows: keys are unique, there is a positive, no positive is ignored, and of the kept rows there are two or more, of both kinds.

    Rows are dealt by query once, and counted where they lie.
    """
    g = spread(rows, query).groupBy(query).agg(
        F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if((F.col(label) == 1) & F.col(ignored)).alias("hidden"),
        F.count_if(~F.col(ignored)).alias("kept"), F.count_if(~F.col(ignored) & (F.col(label) == 0)).alias("negatives"),
    )
    from .pool import reasons

    why = reasons({"unique": F.col("keys") == F.col("n"), "positive": F.col("positives") > 0, "mask": F.col("hidden") == 0, "both_kinds": (F.col("kept") >= 2) & (F.col("negatives") > 0)})
    return g.select(query, "n", "positives", "kept", why.alias("reasons"), (why == "").alias("admitted"))


def census(rows: DataFrame, dimensions: list[str], sets: list[list[str]]) -> DataFrame:
    """(dimensions..., n) over several sets of dimensions at once; a dimension that a set lacks is null, and `level` names the set."""
    out = None
    for chosen in sets:
        part = rows.groupBy(*chosen).agg(F.count("*").alias("n")).withColumn("level", F.lit("+".join(chosen) or "all"))
        part = part.withColumns({d: F.lit(None).cast(rows.schema[d].dataType) for d in dimensions if d not in chosen})
        out = part if out is None else out.unionByName(part)
    return out.select("level", *dimensions, "n")


def one_column_changed(a: DataFrame, b: DataFrame, key: list[str], allowed: str) -> DataFrame:
    """(n, changed, other_changed, only_a, only_b): aligned rows in which the allowed column differs, and rows in which any other does, of which there should be none."""
    others = [c for c in a.columns if c not in key and c != allowed]
    x = a.select(*key, F.struct(*others).alias("x"), F.col(allowed).alias("p"), F.lit(1).alias("in_a"))
    y = b.select(*key, F.struct(*others).alias("y"), F.col(allowed).alias("q"), F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return x.join(y, key, "full").agg(
        F.count_if(both).alias("n"), F.count_if(both & ~F.col("p").eqNullSafe(F.col("q"))).alias("changed"), F.count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("other_changed"),
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
    )


def sole_owners(pairs: DataFrame, phrase: str, owner: str) -> DataFrame:
    """(phrase, owner) of phrases that one owner alone has."""
    return pairs.groupBy(phrase).agg(F.min(owner).alias(owner), F.max(owner).alias("most__")).where(F.col(owner) == F.col("most__")).drop("most__")


def strongest(rows: DataFrame, by: str, strength: Column, order: str) -> DataFrame:
    """(by, order, strength): the reading of most strength, the first in order among equals."""
    best = rows.groupBy(by).agg(F.max(F.struct(strength.alias("s"), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(by, (-F.col("b.o")).alias(order), F.col("b.s").alias("strength"))


def fused_lines(a: DataFrame, b: DataFrame, key: list[str], script: Column) -> DataFrame:
    """(key, text, reader): one reading a line of two readers (key, text): that of the first where `script`, of column text of the first, says so or the second has none, else the second's. Never by score."""
    both = a.select(*key, "text").join(b.select(*key, F.col("text").alias("other")), key, "full")
    first = F.col("text").isNotNull() & (F.coalesce(script, F.lit(False)) | F.col("other").isNull())
    return both.select(*key, F.when(first, F.col("text")).otherwise(F.col("other")).alias("text"), F.when(first, "first").otherwise("second").alias("reader"))
