"""Names and their words within a catalogue: distinct names, short forms, word roles; and weighted statistics over nested groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .retrieval import fuzzy_pairs


def nested_mean(rows: DataFrame, group: str, query: str, value: str, floor: float = 0.05) -> DataFrame:
    """(n_groups, n_queries, mean, std): every group weighs the same, in it every query, in that every row; std is at least `floor`. Three aggregations, each combined before its shuffle."""
    x = F.col(value)
    by_query = rows.groupBy(group, query).agg(F.avg(x).alias("m1"), F.avg(x * x).alias("m2"))
    by_group = by_query.groupBy(group).agg(F.count("*").alias("n"), F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    out = by_group.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_queries"), F.avg("m1").alias("mean"), F.avg("m2").alias("m2"))
    return out.select("n_groups", "n_queries", "mean", F.greatest(F.sqrt(F.greatest(F.col("m2") - F.col("mean") ** 2, F.lit(0.0))), F.lit(floor)).alias("std"))


def capped_shares(rows: DataFrame, by: str, weight: str, cap: float) -> DataFrame:
    """(by, weight, share, capped): the share of all weight, and the same cut at `cap`."""
    sums = rows.groupBy(by).agg(F.sum(weight).alias("weight"))
    total = F.lit(rows.agg(F.sum(weight)).first()[0])
    return sums.select(by, "weight", (F.col("weight") / total).alias("share"), F.least(F.col("weight") / total, F.lit(cap)).alias("capped"))


def _runs(words: Column) -> Column:
    """All proper runs of consecutive words, joined by spaces."""
    n = F.size(words)
    every = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.struct(F.array_join(F.slice(words, i, k), " ").alias("run"), k.alias("k")))))
    return F.transform(F.filter(every, lambda s: s["k"] < n), lambda s: s["run"])


def distinct_names(names: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, name) of names that are no run of words of another name of their owner: an anti-join on the runs, not on pairs of names."""
    own = names.select(owner, name).distinct()
    held = own.select(owner, F.explode(_runs(F.split(name, " "))).alias(name)).distinct()
    return own.join(held, [owner, name], "left_anti")


def _without(i: Column) -> Column:
    """The column form less its word at place i, from 1."""
    return F.concat(F.slice("form", F.lit(1), i - 1), F.slice("form", i + 1, F.size("form")))


def short_forms(products: DataFrame, product: str, words: str) -> DataFrame:
    """(product, form, n_words): sets of words of any size that one product alone has and no subset of which does; form is sorted and joined by spaces.

    Level by level: a set is extended by a later word of its product only if two products or more share it, and what comes out is looked at only if all its subsets are shared too. Sets that are
    nobody else's end there, so that no set above a short form is ever made. Products of equal words are one row, so that copies add none. The sides of its joins grow with the products and are never broadcast: of lists of words Spark's guess
    is far too low. Null products and words take no part; the rows of one product are judged by themselves, and together are one product.
    """
    t = F.sort_array(F.array_distinct(F.array_compact(words)))
    rows = products.where(F.col(product).isNotNull()).select(F.col(product).alias("product"), t.alias("t")).where(F.size("t") > 0)
    own = checkpointed(rows.groupBy("t").agg(F.min("product").alias("least"), F.max("product").alias("most")).withColumn("row", F.monotonically_increasing_id()))
    level = own.select("least", "most", "row", F.explode(F.transform("t", lambda x: F.array(x))).alias("form"))
    out, size = None, 1
    while True:
        level = checkpointed(level)
        holders = level.groupBy("form").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        alone = holders.where("least = most").select(F.col("least").alias(product), F.array_join("form", " ").alias("form"), F.lit(size).alias("n_words"))
        out = alone if out is None else out.union(alone)
        shared = checkpointed(level.join(holders.where("least < most").select("form").hint("merge"), "form", "left_semi"))
        if shared.isEmpty():
            return out
        longer = shared.join(own.select("row", "t").hint("merge"), "row").select("least", "most", "row", F.explode(F.transform(F.filter("t", lambda x: x > F.element_at("form", -1)), lambda x: F.array_append("form", x))).alias("form"))
        # the subset without the last word is shared; so must be those without another one
        subsets = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), _without))
        held = longer.withColumn("sub", subsets).join(shared.select("row", F.col("form").alias("sub")).hint("merge"), ["row", "sub"], "left_semi")
        longer = held.groupBy("least", "most", "row", "form").agg(F.count("*").alias("n")).where(F.col("n") == size).drop("n")
        level, size = longer, size + 1


def word_roles(named: DataFrame, printed: DataFrame, owner: str, product: str, word: str) -> DataFrame:
    """(owner, word, n_named, n_printing, role): of an owner's products, how many have the word in their name and how many print it; role is name, origin or both."""
    both = named.select(owner, product, word, F.lit(1).alias("a"), F.lit(0).alias("b")).union(printed.select(owner, product, word, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = both.groupBy(owner, product, word).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = seen.groupBy(owner, word).agg(F.sum("a").alias("n_named"), F.sum("b").alias("n_printing"))
    return out.withColumn("role", F.when(F.col("n_printing") == 0, "name").when(F.col("n_named") == 0, "origin").otherwise("both"))


def fuzzy_frequency(rows: DataFrame, owner: str, word: str) -> DataFrame:
    """(word, df, fuzzy_df): owners of a word, and owners of all words that are fuzzily equal to it."""
    own = rows.select(owner, F.col(word).alias("word")).distinct()
    pairs = fuzzy_pairs(own, "word")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    spread = own.withColumnRenamed("word", "other").join(near, "other").select("word", owner)
    counts = own.withColumn("own", F.lit(1)).unionByName(spread.withColumn("own", F.lit(0)))
    by_owner = counts.groupBy("word", owner).agg(F.max("own").alias("own"))
    return by_owner.groupBy("word").agg(F.sum("own").alias("df"), F.count("*").alias("fuzzy_df"))


def first_reason(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with one boolean column a check (null counts as failed), `reason` (the first failed check) and `eligible`."""
    out = rows.withColumns({name: F.coalesce(check, F.lit(False)) for name, check in checks.items()})
    reason = F.coalesce(*(F.when(~F.col(name), F.lit(name)) for name in checks))
    return out.withColumns({"reason": reason, "eligible": reason.isNull()})


def inherited_roles(members: DataFrame, roles: DataFrame, key: str, component: str, salt: str, share: float) -> DataFrame:
    """(key, component, n_roles, role): a component with one role passes it to all members, with several it is held, with none a salted hash of it decides."""
    known = members.join(roles, key).groupBy(component).agg(F.countDistinct("role").alias("n"), F.min("role").alias("own"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col(component).cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out = members.join(known, component, "left").withColumn("n_roles", F.coalesce("n", F.lit(0)))
    role = F.when(F.col("n_roles") == 1, F.col("own")).when(F.col("n_roles") > 1, "held").when(drawn < share, "selection").otherwise("fit")
    return out.select(key, component, "n_roles", role.alias("role"))
