"""Queries over rosters, budgets, galleries, arms and checks; and public forms of nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import roster

from . import govern
from .common import query_into, sql_words, table

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


@query("""WITH f AS (SELECT l_orderkey AS o_orderkey, CASE WHEN l_returnflag = 'N' THEN 'keep' ELSE 'drop' END AS decision FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),
r AS (SELECT o_orderkey, decision, concat_ws(',', CASE WHEN decision <> 'keep' THEN 'decision' END, CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END) AS reasons FROM orders LEFT JOIN f USING (o_orderkey))
SELECT *, CASE WHEN reasons = '' THEN 'fit' ELSE 'held' END AS role FROM r""")
def roster_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are held, with every reason; of several decisions on an order that of its first line counts."""
    li = table(spark, sf_dir, "lineitem").withColumn("decision", F.when(F.col("l_returnflag") == "N", "keep").otherwise("drop")).withColumnRenamed("l_orderkey", "o_orderkey")
    checks = {"cheap": F.col("o_totalprice") < 50000, "open": F.col("o_orderstatus") == "P"}
    return roster.held(table(spark, sf_dir, "orders"), "o_orderkey", li, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], checks)


@query("""WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS eligible FROM orders) SELECT o_custkey, o_orderkey, eligible,
CASE WHEN NOT eligible THEN 'not_eligible' WHEN count(*) FILTER (eligible) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2 THEN 'tried' ELSE 'over_budget' END AS state FROM e""")
def roster_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two finished orders of every customer are tried, further ones are over the budget."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return roster.within_budget(o, "o_custkey", ["o_orderkey"], F.col("o_orderstatus") == "F", 2).drop("o_orderstatus")


@query("""SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 3 <> 0 THEN 'parent' ELSE 'added' END AS origin FROM part""")
def roster_gallery_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gallery of two thirds of the parts, to which all parts are offered: known rows must be equal, others are added."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return roster.appended(p.where("p_partkey % 3 != 0"), p, "p_partkey")


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 0), b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN vec_id = 10 THEN 0.25 ELSE 0.125 END) AS v FROM embeddings WHERE vec_id % 11 <> 0),
d AS (SELECT a.v IS NULL AS no_a, b.v IS NULL AS no_b, list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS d FROM a FULL JOIN b USING (vec_id))
SELECT count(*) FILTER (NOT no_a AND NOT no_b) AS n, count(*) FILTER (no_b) AS only_a, count(*) FILTER (no_a) AS only_b, round(max(d) FILTER (NOT no_a AND NOT no_b), 6) AS most FROM d""")
def audit_vector_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest difference of a component between two tables of vectors, and rows that one of them lacks."""
    e = table(spark, sf_dir, "embeddings")
    moved = F.transform("embedding", lambda x: x.cast("double") + F.when(F.col("vec_id") == 10, 0.25).otherwise(0.125))
    out = roster.largest_difference(e.where("vec_id % 7 != 0"), e.where("vec_id % 11 != 0").withColumn("embedding", moved), "vec_id", "embedding")
    return out.withColumn("most", F.round("most", 6))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, place::INT AS place, s::INT AS step, (('0x' || substr(sha256('aug-1:' || l_partkey), 1, 8))::BIGINT % 2147483648) AS seed FROM p, range(0, 5) t(s) WHERE s % n = place""")
def sched_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five presentations of every order, its lines again and again, each with a seed that follows from its part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = roster.cycled(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 5)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "place", "step", roster.seed(F.col("l_partkey"), "aug-1:").alias("seed"))


@query(f"""WITH {govern._PREDICT}, x AS (SELECT doc_id, truth, old AS base, new AS a, old OR truth AS b FROM p), m AS (SELECT doc_id, unnest(['a', 'b']) AS arm, unnest([a, b]) AS after, base, truth FROM x),
k AS (SELECT doc_id, arm, after = truth AND base <> truth AS fix, base = truth AND after <> truth AS loss FROM m), f AS (SELECT DISTINCT doc_id FROM k WHERE fix),
g AS (SELECT arm, count(*) FILTER (fix) AS fixes, count(*) FILTER (loss) AS regressions, count(*) FILTER (doc_id IN (SELECT doc_id FROM f) AND NOT fix) AS lost_fixes FROM k GROUP BY arm)
SELECT *, fixes > 0 AND regressions = 0 AND lost_fixes = 0 AND row_number() OVER (ORDER BY CASE WHEN fixes > 0 AND regressions = 0 AND lost_fixes = 0 THEN 0 ELSE 1 END, fixes DESC, arm) = 1 AS chosen FROM g""")
def eval_arm_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms against a base: the one that fixes, loses nothing and lacks no fix of the other."""
    p = govern._predictions(spark, sf_dir)
    arm = lambda c: p.select("doc_id", c.alias("answer"))
    return roster.arm_choice(p.select("doc_id", F.col("old").alias("answer"), "truth"), {"a": arm(F.col("new")), "b": arm(F.col("old") | F.col("truth"))}, "doc_id", "answer", "truth")


@query("""WITH a AS (SELECT o_orderstatus AS name, count(*)::VARCHAR AS value FROM orders GROUP BY 1 UNION ALL SELECT 'O', 'twice') SELECT name, expected, max(value) AS actual, coalesce(count(value) = 1 AND max(value) = expected, false) AS ok
FROM (SELECT 'F' AS name, (SELECT count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'F') AS expected UNION ALL SELECT 'O', 'twice' UNION ALL SELECT 'P', '1' UNION ALL SELECT 'X', '0') e LEFT JOIN a USING (name) GROUP BY name, expected""")
def audit_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected values against what the table has: equal, other, absent, and twice there."""
    o = table(spark, sf_dir, "orders")
    actual = o.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").cast("string").alias("value")).union(spark.createDataFrame([("O", "twice")], "name string, value string"))
    known = o.where("o_orderstatus = 'F'").agg(F.lit("F").alias("name"), F.count("*").cast("string").alias("value"))
    return roster.expectations(known.union(spark.createDataFrame([("O", "twice"), ("P", "1"), ("X", "0")], "name string, value string")), actual, "name")


@query("""WITH v AS (SELECT sha256(p_name) AS digest, p_type AS version FROM part), a AS (SELECT DISTINCT sha256(p_name) AS digest FROM part UNION SELECT sha256('nothing'))
SELECT digest, count(DISTINCT version) AS n, CASE WHEN count(DISTINCT version) = 1 THEN min(version) END AS version, CASE count(DISTINCT version) WHEN 0 THEN 'missing' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS state FROM a LEFT JOIN v USING (digest) GROUP BY digest""")
def audit_unique_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one type that a name's digest stands for; missing and ambiguous ones are said."""
    p = table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("digest"), F.col("p_type").alias("version"))
    asked = p.select("digest").union(spark.range(1).select(F.sha2(F.lit("nothing"), 256).alias("digest")))
    return roster.unique_versions(asked, p, "digest", "version")


@query("""WITH r AS (SELECT l_orderkey AS q, l_suppkey AS k, (l_returnflag = 'R')::INT AS label, l_quantity > 45 AS ignored FROM lineitem),
g AS (SELECT q, count(*) AS n, count(DISTINCT k) AS keys, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND ignored) AS hidden, count(*) FILTER (NOT ignored) AS kept, count(*) FILTER (NOT ignored AND label = 0) AS negatives FROM r GROUP BY q),
w AS (SELECT q, n, positives, kept, concat_ws(',', CASE WHEN keys <> n THEN 'unique' END, CASE WHEN positives = 0 THEN 'positive' END, CASE WHEN hidden > 0 THEN 'mask' END, CASE WHEN kept < 2 OR negatives = 0 THEN 'both_kinds' END) AS reasons FROM g) SELECT *, reasons = '' AS admitted FROM w""")
def roster_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranking queries: which may be used for a listwise fit, and why others may not."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("k"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") > 45).alias("ignored"))
    return roster.listwise_admitted(r, "q", "k", "label", "ignored")


@query("""WITH r AS (SELECT o_orderstatus AS state, o_orderpriority AS priority, year(o_orderdate)::INT AS year FROM orders) SELECT CASE GROUPING(state, priority, year) WHEN 0 THEN 'state+priority+year' WHEN 3 THEN 'state' WHEN 5 THEN 'priority' ELSE 'all' END AS level, state, priority, year, count(*) AS n
FROM r GROUP BY GROUPING SETS ((state, priority, year), (state), (priority), ())""")
def eval_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted by state, priority and year at several levels."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return roster.census(r, ["state", "priority", "year"], [["state", "priority", "year"], ["state"], ["priority"], []])


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size, CASE WHEN p_partkey = 7 THEN 0.0 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 4 <> 0)
SELECT count(*) FILTER (a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL) AS n, count(*) FILTER (a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL AND a.p_size IS DISTINCT FROM b.p_size) AS changed,
count(*) FILTER (a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL AND (a.p_name, a.p_brand, a.p_type, a.p_retailprice) IS DISTINCT FROM (b.p_name, b.p_brand, b.p_type, b.p_retailprice)) AS other_changed, count(*) FILTER (b.p_partkey IS NULL) AS only_a, count(*) FILTER (a.p_partkey IS NULL) AS only_b
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def audit_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts before and after a rewrite that may change sizes alone."""
    p = table(spark, sf_dir, "part")
    new = p.where("p_partkey % 4 != 0").withColumns({"p_size": F.least("p_size", F.lit(40)), "p_retailprice": F.when(F.col("p_partkey") == 7, 0.0).otherwise(F.col("p_retailprice"))})
    return roster.one_column_changed(p.where("p_partkey % 5 != 0"), new, ["p_partkey"], "p_size")


@query(f"""WITH t AS (SELECT DISTINCT p_brand, unnest({sql_words("p_name || ' ' || p_type || p_size")}) AS phrase FROM part) SELECT phrase, min(p_brand) AS p_brand FROM t GROUP BY phrase HAVING count(*) = 1""")
def mine_sole_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names and typed sizes that one brand alone has."""
    code = F.concat(F.concat_ws(" ", "p_name", "p_type"), F.col("p_size").cast("string"))
    return roster.sole_owners(table(spark, sf_dir, "part").select("p_brand", F.explode(tx.words(code)).alias("phrase")).distinct(), "phrase", "p_brand")


@query("""WITH r AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\p{L}'))::BIGINT AS strength FROM conversations WHERE turn < 3) SELECT conv_id, turn, strength FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY strength DESC, turn) = 1""")
def line_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first three turns of a conversation the one of most letters, the earlier among equals."""
    r = table(spark, sf_dir, "conversations").where("turn < 3")
    letters = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}"), F.lit(0))).cast("long")
    return roster.strongest(r, "conv_id", letters, "turn")


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 2), b AS (SELECT conv_id, turn, upper(role) AS text FROM conversations WHERE turn % 3 <> 1),
j AS (SELECT conv_id, turn, a.text, b.text AS other, a.text IS NOT NULL AND (coalesce(length(a.text) % 2 = 0, false) OR b.text IS NULL) AS first FROM a FULL JOIN b USING (conv_id, turn))
SELECT conv_id, turn, sha256(CASE WHEN first THEN text ELSE other END) AS text, CASE WHEN first THEN 'first' ELSE 'second' END AS reader FROM j""")
def line_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading a turn of two readers, by a rule on the first one's text and never by score (digests of the texts)."""
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("turn % 3 != 2"), c.where("turn % 3 != 1").withColumn("text", F.upper("role"))
    return roster.fused_lines(a, b, ["conv_id", "turn"], F.length("text") % 2 == 0).withColumn("text", F.sha2("text", 256))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand ELSE 'unresolved-card:' || p_partkey END AS candidate, CASE WHEN p_type <> 'STANDARD' AND p_size <= 40 THEN p_name END AS visible_name, concat_ws(',', CASE WHEN p_size > 10 THEN 'size' END, CASE WHEN p_retailprice > 905 THEN 'price' END) AS held,
p_size > 10 AND p_retailprice > 905 AS triggered, CASE WHEN regexp_matches(p_brand, '^Brand#[0-9]$') THEN p_brand END AS code FROM part""")
def card_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public form of a card: a key that says when it is unresolved, values that may be shown, every condition of a trigger, and codes of the right form."""
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size") > 10, F.col("p_retailprice") > 905
    return p.select(
        "p_partkey", F.when(size, F.col("p_brand")).otherwise(F.concat(F.lit("unresolved-card:"), F.col("p_partkey").cast("string"))).alias("candidate"),
        F.when((F.col("p_type") != "STANDARD") & (F.col("p_size") <= 40), F.col("p_name")).alias("visible_name"), F.concat_ws(",", F.when(size, "size"), F.when(price, "price")).alias("held"),
        (size & price).alias("triggered"), F.when(F.col("p_brand").rlike("^Brand#[0-9]$"), F.col("p_brand")).alias("code"),
    )
