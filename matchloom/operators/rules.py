"""Rules over evidence and answers: consensus, ladders, scopes, repairs, longest forms, aliases, masks, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import readings as rd
from matchloom.functions import text as tx


def consensus(a: DataFrame, b: DataFrame, by: str, channel: str, answer: str, guard: DataFrame) -> DataFrame:
    """(by, before, after, reason): the answer of arm b replaces that of arm a only where all channels of b agree on it, a had another, and the guard (by, ok) lets it pass.

    a: (by, answer); b: (by, channel, answer). reason: switched, same, split (channels differ), guarded, or missing (b has none).
    """
    agreed = b.groupBy(by).agg(F.countDistinct(answer).alias("n"), F.min(answer).alias("new"), F.countDistinct(channel).alias("channels"))
    rows = a.select(by, F.col(answer).alias("before")).join(agreed, by, "left").join(guard.select(by, "ok"), by, "left")
    reason = F.when(F.col("n").isNull(), "missing").when((F.col("n") > 1) | (F.col("channels") < 2), "split").when(F.col("new") == F.col("before"), "same").when(~F.coalesce("ok", F.lit(False)), "guarded").otherwise("switched")
    return rows.withColumn("reason", reason).select(by, "before", F.when(F.col("reason") == "switched", F.col("new")).otherwise(F.col("before")).alias("after"), "reason")


def ladder(rows: DataFrame, steps: list[tuple[str, Column]], other: str, name: str = "verdict") -> DataFrame:
    """rows with the name of the first step that holds (null does not), else `other`."""
    out = F.lit(other)
    for label, condition in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(out)
    return rows.withColumn(name, out)


def scope(rows: DataFrame, key: str, missed: Column, stratum: str, order: str, controls: int) -> DataFrame:
    """(key, stratum, role): all misses, and of the others the first `controls` of every stratum that has a miss."""
    marked = rows.withColumn("miss__", F.coalesce(missed, F.lit(False)))
    misses = marked.where("miss__").select(key, stratum, F.lit("miss").alias("role"))
    w = Window.partitionBy(stratum).orderBy(order)
    rest = marked.where("not miss__").join(misses.select(stratum).distinct(), stratum, "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= controls)
    return misses.unionByName(rest.select(key, stratum, F.lit("control").alias("role")))


def repaired(rows: DataFrame, text: str, repairs: list[tuple[str, str, str]], blocked: str) -> DataFrame:
    """rows with `repaired` and `edits` (kind:count, comma-joined): whole words put right by a table (kind, wrong, right), but for texts that a pattern blocks. No row is lost."""
    out, counts = F.concat(F.lit(" "), F.regexp_replace(tx.norm(F.col(text)), " ", "  "), F.lit(" ")), {}
    open_ = ~F.coalesce(F.col(text).rlike(blocked), F.lit(False))
    for kind, wrong, right in repairs:
        word = f" {wrong.replace(' ', '  ')} "
        # the text gets shorter by the word for each place that it is taken from
        counts.setdefault(kind, []).append(((F.length(out) - F.length(F.replace(out, F.lit(word), F.lit("")))) / len(word)).cast("int"))
        out = F.replace(out, F.lit(word), F.lit(f" {right.replace(' ', '  ')} "))
    total = {k: sum(v[1:], v[0]) for k, v in counts.items()}
    edits = F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(f"{k}:"), n.cast("string"))) for k, n in total.items()])), ",")
    plain = F.trim(F.regexp_replace(out, " +", " "))
    return rows.withColumns({"repaired": F.when(open_, plain).otherwise(tx.norm(F.col(text))), "edits": F.when(open_, edits).otherwise("")})


def longest_forms(hits: DataFrame, by: list[str], phrase: str) -> DataFrame:
    """hits without those whose phrase stands inside a longer one of the same group."""
    longer = hits.select(*by, F.col(phrase).alias("long__")).distinct()
    inside = hits.select(*by, phrase).distinct().join(longer, by).where((F.length("long__") > F.length(phrase)) & tx.contains_phrase(F.col("long__"), F.col(phrase)))
    return hits.join(inside.select(*by, phrase).distinct(), [*by, phrase], "left_anti")


def tiered_hits(hits: DataFrame, by: list[str], tier: str, first: str, second: str) -> DataFrame:
    """Distinct hits of two tiers; one of the second goes where the first has the same."""
    own = hits.select(*by, tier).distinct()
    high, low = own.where(F.col(tier) == first), own.where(F.col(tier) == second)
    return high.unionByName(low.join(high.select(*by), by, "left_anti").select(*by, tier))


def first_source(rows: DataFrame, key: str, sources: list[str], value: str, source: str, disputed: str) -> DataFrame:
    """(key, value, source) by precedence: the value of the first source that has one; empty where the key is disputed."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col(source))
    best = rows.where(F.col(value).isNotNull() & (place > 0)).groupBy(key).agg(F.min(F.struct(place.alias("p"), F.col(value).alias("v"), F.col(source).alias("s"))).alias("b"))
    out = rows.groupBy(key).agg(F.max(disputed).alias("d")).join(best, key, "left")
    usable = ~F.coalesce(F.col("d"), F.lit(False))
    return out.select(key, F.when(usable, F.col("b.v")).alias(value), F.when(usable, F.col("b.s")).alias(source))


def unattested(aliases: DataFrame, known: DataFrame, form: str) -> DataFrame:
    """aliases whose phonetic key no known form has."""
    keyed = known.select(rd.search_key(F.col(form)).alias("k__")).distinct()
    return aliases.withColumn("k__", rd.search_key(F.col(form))).join(keyed, "k__", "left_anti").drop("k__")


def derived_aliases(names: DataFrame, owner: str, name: str, prefixes: list[str]) -> DataFrame:
    """(alias, owner): names without a leading legal form, where one owner alone has the rest."""
    pattern = "^(" + "|".join(prefixes) + ") +"
    cut = names.where(F.col(name).rlike(pattern)).select(owner, F.regexp_replace(name, pattern, "").alias("alias")).where("alias != ''")
    every = cut.select("alias", owner).union(names.select(F.col(name).alias("alias"), owner)).distinct()
    one = every.groupBy("alias").agg(F.countDistinct(owner).alias("n")).where("n = 1").select("alias")
    return cut.distinct().join(one, "alias").select("alias", owner)


def masks_of(rows: DataFrame, key: list[str], positive: str, sources: list[DataFrame]) -> DataFrame:
    """rows with `ignored`: the key is in one of the mask tables and the row is no positive."""
    hit = sources[0].select(*key)
    for s in sources[1:]:
        hit = hit.union(s.select(*key))
    out = rows.join(hit.distinct().withColumn("m__", F.lit(True)), key, "left")
    return out.withColumn("ignored", F.coalesce("m__", F.lit(False)) & ~F.coalesce(F.col(positive), F.lit(False))).drop("m__")


def alternatives(ranked: DataFrame, by: str, entity: str, product: str, rank: str, most: int) -> DataFrame:
    """(by, chosen, others, n_more): the first entity, the next of other products (one a product, `most` at most, comma-joined), and how many more there are."""
    first = ranked.groupBy(by, product).agg(F.min(F.struct(F.col(rank).alias("r"), F.col(entity).alias("e"))).alias("b"))
    placed = first.withColumn("p", F.row_number().over(Window.partitionBy(by).orderBy("b.r")))
    kept = placed.where(F.col("p") <= most + 1)
    lists = kept.groupBy(by).agg(F.max(F.when(F.col("p") == 1, F.col("b.e"))).alias("chosen"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") > 1, F.struct("p", F.col("b.e").alias("e"))))), lambda s: s["e"].cast("string")), ",").alias("others"))
    more = placed.groupBy(by).agg(F.greatest(F.count("*") - most - 1, F.lit(0)).alias("n_more"))
    return lists.join(more, by)


def anchored(claims: DataFrame, read: DataFrame, key: str, specific: str, weight: str) -> DataFrame:
    """(key, coverage): the weighted share of a claim's tokens that were read, 0 unless a specific one was. claims: key, token, specific, weight; read: key, token."""
    each = claims.join(read.select(key, "token").distinct().withColumn("seen", F.lit(True)), [key, "token"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    got = each.groupBy(key).agg(F.sum(weight).alias("mass"), F.sum(F.when(F.col("seen"), F.col(weight)).otherwise(0.0)).alias("hit"), F.max(F.col("seen") & F.col(specific)).alias("anchor"))
    return got.select(key, F.when(F.col("anchor") & (F.col("mass") > 0), F.col("hit") / F.col("mass")).otherwise(0.0).alias("coverage"))


def raised_features(before: DataFrame, after: DataFrame, key: list[str], positive: str, features: list[str]) -> DataFrame:
    """(feature, on_positive, on_negative, lowered): how often a feature is larger after than before, on positive and on other candidates, and how often smaller."""
    long = lambda df, name: df.select(*key, *([positive] if name == "old" else []), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(name)) for f in features])).alias("c")).select(*key, *([positive] if name == "old" else []), "c.*")
    both = long(before, "old").join(long(after, "new"), [*key, "feature"])
    up, good = F.col("new") > F.col("old"), F.coalesce(F.col(positive), F.lit(False))
    return both.groupBy("feature").agg(F.count_if(up & good).alias("on_positive"), F.count_if(up & ~good).alias("on_negative"), F.count_if(F.col("new") < F.col("old")).alias("lowered"))


def line_sources(lines: DataFrame, reads: DataFrame, key: str, same: list[str], source: str) -> DataFrame:
    """lines with n_sources and sources (sorted, comma-joined): all reads of equal key and values; a line without one stays."""
    got = reads.groupBy(key, *same).agg(F.countDistinct(source).alias("n_sources"), F.array_join(F.sort_array(F.collect_set(F.col(source).cast("string"))), ",").alias("sources"))
    return lines.join(got, [key, *same], "left").withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)), "sources": F.coalesce("sources", F.lit(""))})
