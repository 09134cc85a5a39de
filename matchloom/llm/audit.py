"""Which filters take which documents: survivors of every subset of filters, and what each order of them removes.

Every document fails some of the filters, which makes a mask of bits. Counts by part and mask are all that is kept of the documents. A zeta transform over the
subsets (one pass a filter) turns the counts of a part into the number of documents that survive each set of filters; the same is done for the documents of each
label. A step of an order then is the difference of two neighbouring sets: those before it, and those before it with its own filter.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed

#: Names of the five filters; the bit of a filter is its place.
FILTERS = "ABCDE"
GAP = r"[ \t\n\x0B\f\r]"
SYMBOLS = "[#$%&*|]"


def words(text: Column) -> Column:
    """The maximal runs of characters that are no white space (space, and tab to carriage return)."""
    return F.array_remove(F.split(text, GAP), "")


def _text_mask(text: Column, found: Column) -> Column:
    """Bits of the filters that look at one text alone."""
    n, different = F.size(found).cast("long"), F.size(F.array_distinct(found)).cast("long")
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, 100 * different < 50 * n, 100 * upper > 2 * F.char_length(text).cast("long"), text.rlike(SYMBOLS)]
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << k).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by source and by the filters that they fail.

    A null text is empty, a null source is the empty string, a null id is smaller than no id and has no smaller one, so that E never takes it. Repeated rows of one id count each, and
    none is a smaller id's. An id has a label if any of its label rows says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text")).withColumn("found", words(F.col("text")))
    rows = checkpointed(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _text_mask(F.col("text"), F.col("found")).alias("mask")))
    # the smallest id of each text; a document is looked up by text and id, so that copies of one text are spread by their ids
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return known.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def zeta(cells: Column, n_filters: int) -> Column:
    """cells: an array by mask. The array of sums over all masks that are subsets of each mask."""

    def over(bit: int, own: Column) -> Column:
        return F.transform(own, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(own, m - bit)).otherwise(0))

    for k in range(n_filters):
        cells = F.transform(F.array(cells), partial(over, 1 << k))[0]  # the inner array is made once, not once a cell
    return cells


def survivors(counts: DataFrame, values: list[str], n_filters: int) -> DataFrame:
    """(part, and for each of `values` an array by set of filters): how many of a part fail no filter of the set. counts: (part, mask, values)."""
    size = 1 << n_filters
    cell = lambda v, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(v))), F.lit(0)).cast("long")
    cells = counts.groupBy("part").agg(*(F.array(*(cell(v, m) for m in range(size))).alias(v) for v in values))
    # a document survives a set if its mask is a subset of the other filters
    return cells.select("part", *(F.reverse(zeta(F.col(v), n_filters)).alias(v) for v in values))


def _steps(filters: str) -> list[tuple]:
    """(order, step, bits before, bit) of all orders."""
    out = []
    for order in permutations(filters):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << filters.index(name)
            out.append(("".join(order), k + 1, before, bit))
            before |= bit
    return out


def orders(alive: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what stays, goes, went before, and how that is shared among filters. alive: see survivors."""
    n, whole = len(filters), (1 << len(filters)) - 1
    at = lambda v, s: F.get(F.col(v), s if isinstance(s, Column) else F.lit(s))
    # the number of orders in which exactly the filters of a set come before a filter
    removed = lambda k, s: at("n", s) - at("n", s | 1 << k)
    shares = []
    for k in range(n):
        others = [j for j in range(n) if j != k]
        terms = [factorial(size) * factorial(n - 1 - size) * removed(k, sum(1 << j for j in s)) for size in range(n) for s in combinations(others, size)]
        shares.append(sum(terms[1:], terms[0]))
    kind = T.ArrayType(T.StructType([T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("bit", T.IntegerType())]))
    spark = alive.sparkSession
    steps = F.broadcast(spark.createDataFrame([(_steps(filters),)], T.StructType([T.StructField("steps", kind)])))  # one row, n * n! steps
    rows = alive.withColumn("shares", F.array(*shares)).join(steps).select("*", F.explode("steps").alias("s")).select("part", *(v for v in alive.columns if v != "part"), "shares", "s.*")
    before, bit = F.col("before"), F.col("bit")
    after = before.bitwiseOR(bit)
    gone = at("n", before) - at("n", after)
    place = F.log2(bit.cast("double")).cast("int")
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), gone.alias("removed"), (at("n", 0) - at("n", bit) - gone).alias("redundant"),
        (at("n", F.lit(whole).bitwiseXOR(bit)) - at("n", whole)).alias("unique_fails"), (at("n_good", before) - at("n_good", after)).alias("good_lost"),
        (at("n_toxic", before) - at("n_toxic", after)).alias("toxic_lost"), F.get(F.col("shares"), place).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each source, all orders of the five filters and each step.

    Odd rows: see masks. A table without rows gives none; other columns play no part.
    """
    return orders(survivors(checkpointed(masks(docs, labels)), ["n", "n_good", "n_toxic"], len(FILTERS)))


def oracle() -> str:
    """Every order is applied to the documents' masks step by step; no sums over subsets."""
    return """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
smallest AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (SELECT w.doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * len(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w JOIN smallest USING (text)),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS places FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
named AS (SELECT places, array_to_string(list_transform(places, lambda p: substr('ABCDE', p::INT, 1)), '') AS filter_order FROM o),
s AS (SELECT part, filter_order, step::INT AS step, places[step] AS own, fails, n, n_good, n_toxic,
    coalesce(list_min(list_filter(range(1, 6), lambda k: fails[places[k]])), 6) AS falls_at
  FROM m, named, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (falls_at > step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (falls_at = step), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails[own] AND falls_at < step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (falls_at = step), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (falls_at = step), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
