"""Queries over catalogue names, eligibility, rosters and nested statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx
from matchloom.functions import text as tx
from matchloom.operators import mining

from . import govern
from .common import query_into, sql_words, table

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


@query("""WITH q AS (SELECT o_orderpriority AS g, o_custkey AS q, avg(o_totalprice) AS m1, avg(o_totalprice * o_totalprice) AS m2 FROM orders GROUP BY ALL),
g AS (SELECT g, count(*) AS n, avg(m1) AS m1, avg(m2) AS m2 FROM q GROUP BY g), t AS (SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_queries, avg(m1) AS mean, avg(m2) AS m2 FROM g)
SELECT n_groups, n_queries, round(mean, 2) AS mean, round(greatest(sqrt(m2 - mean * mean), 0.05), 2) AS std FROM t""")
def stat_nested_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of order prices, with equal mass for each priority, in it each customer, in that each order."""
    out = mining.nested_mean(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_totalprice")
    return out.withColumns({c: F.round(c, 2) for c in ("mean", "std")})


@query("""WITH s AS (SELECT l_suppkey, sum(l_quantity) AS weight FROM lineitem GROUP BY 1), t AS (SELECT sum(l_quantity) AS total FROM lineitem)
SELECT l_suppkey, weight, round(weight / total, 9) AS share, round(least(weight / total, 0.01), 9) AS capped FROM s, t""")
def stat_capped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of suppliers in all quantities, and the same cut at one in a hundred."""
    out = mining.capped_shares(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 0.01)
    return out.withColumns({c: F.round(c, 9) for c in ("share", "capped")})


@query("""SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) - count(quality) AS missing
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language against all documents: counts, and how many have none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), (F.count("*") - F.count("quality")).alias("missing"))


@query(f"""WITH {govern._PREDICT}, c AS (SELECT lang, count(*) FILTER (new AND truth) AS tp, count(*) FILTER (new AND NOT truth) AS fp, count(*) FILTER (truth AND NOT new) AS fn FROM p GROUP BY GROUPING SETS ((lang), ()))
SELECT lang, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM c""")
def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a predictor, by language and over all (lang null)."""
    p = govern._predictions(spark, sf_dir)
    new, truth = F.col("new"), F.col("truth")
    c = p.rollup("lang").agg(F.count_if(new & truth).alias("tp"), F.count_if(new & ~truth).alias("fp"), F.count_if(truth & ~new).alias("fn"))
    share = lambda other: F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), 6)
    return c.withColumns({"precision": share("fp"), "recall": share("fn")})


@query(f"SELECT event_id, min(path) AS first_path, count(*) AS n FROM ({govern.ORACLES['eval_diff_paths']}) GROUP BY event_id")
def eval_first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first differing path of every event that a rewrite changed, and how many differ."""
    return govern.eval_diff_paths(spark, sf_dir).groupBy("event_id").agg(F.min("path").alias("first_path"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS state_open, o_totalprice >= 50000 AS price_enough, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent,
CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 'state_open' WHEN o_totalprice < 50000 THEN 'price_enough' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'urgent' END AS reason,
o_orderstatus IN ('F', 'P') AND o_totalprice >= 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS eligible FROM orders""")
def elig_first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the value of every condition, and the first that fails."""
    checks = {"state_open": F.col("o_orderstatus").isin("F", "P"), "price_enough": F.col("o_totalprice") >= 50000, "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}
    return mining.first_reason(table(spark, sf_dir, "orders"), checks).select("o_orderkey", *checks, "reason", "eligible")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS component FROM documents), r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'fit' ELSE 'selection' END AS role FROM labels),
k AS (SELECT component, count(DISTINCT role) AS n, min(role) AS own FROM d JOIN r USING (doc_id) GROUP BY component)
SELECT doc_id, component, coalesce(n, 0) AS n_roles, CASE WHEN n = 1 THEN own WHEN n > 1 THEN 'held' WHEN ('0x' || substr(sha256('place-1:' || component), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'selection' ELSE 'fit' END AS role
FROM d LEFT JOIN k USING (component)""")
def gov_inherited_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of documents by the labels of their exact copies: one role is inherited, two hold, none is drawn."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("component"))
    roles = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "fit").otherwise("selection").alias("role"))
    return mining.inherited_roles(d, roles, "doc_id", "component", "place-1:", 0.2)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'),
s AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_a FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL)
SELECT c_nationkey, count(*) FILTER (in_a) AS only_a, count(*) FILTER (NOT in_a) AS only_b FROM s JOIN customer ON c_custkey = k GROUP BY 1""")
def audit_changed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers that are in only one of two rosters: those with finished and those with open orders."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    sides = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("in_a"), F.max(F.col("o_orderstatus") == "O").alias("in_b")).where("in_a != in_b")
    return sides.join(table(spark, sf_dir, "customer"), "c_custkey").groupBy("c_nationkey").agg(F.count_if("in_a").alias("only_a"), F.count_if("in_b").alias("only_b"))


_NAMES = """names AS (SELECT DISTINCT p_brand, p_type AS name FROM part UNION SELECT DISTINCT p_brand, p_name || ' ' || p_type FROM part WHERE p_size > 25)"""


@query(f"""WITH {_NAMES} SELECT p_brand, name FROM names n WHERE NOT EXISTS (SELECT 1 FROM names m WHERE m.p_brand = n.p_brand AND m.name <> n.name AND contains(' ' || m.name || ' ', ' ' || n.name || ' '))""")
def mine_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand that are no part of another of its names."""
    p = table(spark, sf_dir, "part")
    names = p.select("p_brand", F.col("p_type").alias("name")).union(p.where("p_size > 25").select("p_brand", F.concat_ws(" ", "p_name", "p_type")))
    return mining.distinct_names(names, "p_brand", "name")


_PART_WORDS = sql_words("p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size::VARCHAR")


@query(f"""
WITH t AS (SELECT p_partkey AS product, list_sort(list_distinct({_PART_WORDS})) AS t FROM part),
f AS (SELECT product, list_filter(t, lambda x, i: (bits >> (i - 1)) & 1 = 1) AS form FROM (SELECT product, t, unnest(range(1, (1::BIGINT << len(t)::INT)::BIGINT)) AS bits FROM t)),
s AS (SELECT form, min(product) AS product FROM f GROUP BY form HAVING count(*) = 1)
SELECT product AS p_partkey, array_to_string(form, ' ') AS form, len(form)::INT AS n_words FROM s
WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.product = s.product AND len(x.form) < len(s.form) AND list_has_all(s.form, x.form))""")
def mine_short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest sets of words of name, type, brand and size, of any number, that only one part has. The SQL makes all subsets."""
    p = table(spark, sf_dir, "part").select("p_partkey", tx.words(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))).alias("w"))
    return mining.short_forms(p, "p_partkey", "w")


@query(f"""WITH a AS (SELECT DISTINCT p_brand, p_partkey, unnest({sql_words("p_name")}) AS word FROM part), b AS (SELECT DISTINCT p_brand, p_partkey, unnest({sql_words("p_type")}) AS word FROM part),
c AS (SELECT p_brand, word, 1 AS a, 0 AS b FROM a UNION ALL SELECT p_brand, word, 0, 1 FROM b)
SELECT p_brand, word, sum(a)::BIGINT AS n_named, sum(b)::BIGINT AS n_printing, CASE WHEN sum(b) = 0 THEN 'name' WHEN sum(a) = 0 THEN 'origin' ELSE 'both' END AS role FROM c GROUP BY ALL""")
def mine_word_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every brand by whether its parts have them in their names, in their types, or in both."""
    p = table(spark, sf_dir, "part")
    named, printed = (p.select("p_brand", "p_partkey", F.explode(tx.words(F.col(c))).alias("word")) for c in ("p_name", "p_type"))
    return mining.word_roles(named, printed, "p_brand", "p_partkey", "word")


@query(f"""WITH own AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest({sql_words("text")}) AS word FROM benchmark) WHERE regexp_matches(word, '^[a-z]+$')),
k AS (SELECT DISTINCT word AS w, CASE WHEN length(word) < 5 THEN 0 WHEN length(word) < 9 THEN 1 ELSE 2 END AS e FROM own),
near AS (SELECT a.w AS a, b.w AS b FROM k a JOIN k b ON a.w = b.w OR (least(a.e, b.e) > 0 AND abs(length(a.w) - length(b.w)) <= 2 AND (a.w[1] = b.w[1] OR a.w[-1] = b.w[-1]) AND levenshtein(a.w, b.w) <= least(a.e, b.e)))
SELECT a AS word, count(DISTINCT item_id) FILTER (a = b) AS df, count(DISTINCT item_id) AS fuzzy_df FROM near JOIN own ON own.word = b GROUP BY a""")
def text_fuzzy_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of every word, and of all words that are fuzzily equal to it."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.words(F.col("text"))).alias("word")).where(F.col("word").rlike("^[a-z]+$"))
    return mining.fuzzy_frequency(words, "item_id", "word")


@query(f"""WITH {govern._BOXES}, p AS (SELECT * FROM bx WHERE score > 40000), l AS (SELECT * FROM bx WHERE score <= 40000),
h AS (SELECT l.image, l.key AS label_key, p.key AS parent_key, l.y1 - p.y2 AS gap FROM l JOIN p USING (image) WHERE l.y1 - p.y2 BETWEEN 0 AND 10 AND greatest(least(l.x2, p.x2) - greatest(l.x1, p.x1), 0) >= 0.5 * (l.x2 - l.x1))
SELECT image, label_key, count(*) AS n_parents, arg_min(parent_key, (gap, parent_key)) AS parent_key, min(gap) AS gap FROM h GROUP BY ALL""")
def geo_beneath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap boxes directly beneath dear ones: half of their width below it, at most ten away; the nearest is named."""
    b = govern._boxes(spark, sf_dir)
    cols = ("key", "x1", "y1", "x2", "y2")
    p = b.where("score > 40000").select("image", *(F.col(c).alias(f"p_{c}") for c in cols))
    low = b.where("score <= 40000").select("image", *(F.col(c).alias(f"l_{c}") for c in cols))
    width = F.greatest(F.least("l_x2", "p_x2") - F.greatest("l_x1", "p_x1"), F.lit(0.0))
    near = low.join(p, "image").withColumn("gap", F.col("l_y1") - F.col("p_y2")).where(F.col("gap").between(0, 10) & (width >= 0.5 * (F.col("l_x2") - F.col("l_x1"))))
    best = near.groupBy("image", F.col("l_key").alias("label_key")).agg(F.count("*").alias("n_parents"), F.min(F.struct("gap", "p_key")).alias("b"))
    return best.select("image", "label_key", "n_parents", F.col("b.p_key").alias("parent_key"), F.col("b.gap").alias("gap"))


@query(f"""WITH {govern._BOXES}, e AS (SELECT *, ((x1 + x2) / 2 - 45) * ((x1 + x2) / 2 - 45) + ((y1 + y2) / 2 - 40) * ((y1 + y2) / 2 - 40) AS d FROM bx QUALIFY (x2 - x1) * (y2 - y1) >= 0.5 * max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY image)),
r AS (SELECT image, key, lead(d) OVER w - d AS margin, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY image ORDER BY d, key))
SELECT image, CASE WHEN margin IS NULL OR margin > 0 THEN key END AS key, round(margin, 6) AS margin, CASE WHEN margin IS NULL THEN 'only' WHEN margin > 0 THEN 'central' ELSE 'ambiguous' END AS state FROM r WHERE r = 1""")
def geo_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the boxes at least half as large as the largest of their image the most central, with its margin; a tie is ambiguous."""
    b = bx.box()
    area, x, y = bx.area(b), (b[0] + b[2]) / 2 - 45, (b[1] + b[3]) / 2 - 40
    rows = govern._boxes(spark, sf_dir).withColumns({"area": area, "d": x * x + y * y}).withColumn("most", F.max("area").over(Window.partitionBy("image"))).where("area >= 0.5 * most")
    w = Window.partitionBy("image").orderBy("d", "key")
    first = rows.withColumns({"margin": F.lead("d").over(w) - F.col("d"), "r": F.row_number().over(w)}).where("r = 1")
    clear = F.col("margin").isNull() | (F.col("margin") > 0)
    return first.select("image", F.when(clear, F.col("key")).alias("key"), F.round("margin", 6).alias("margin"), F.when(F.col("margin").isNull(), "only").when(F.col("margin") > 0, "central").otherwise("ambiguous").alias("state"))


@query("""SELECT p_brand, count(*) AS cards, count(DISTINCT p_name) AS products, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS with_reference FROM part GROUP BY p_brand""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards, products and cards with a reference by brand."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("has", F.lit(1))
    p = table(spark, sf_dir, "part").join(refs, "p_partkey", "left")
    return p.groupBy("p_brand").agg(F.count("*").alias("cards"), F.countDistinct("p_name").alias("products"), F.count("has").alias("with_reference"))
