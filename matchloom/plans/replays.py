"""Queries that compare and replay stored runs, and boxes that meet in a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import canonical, conflicts, geometry, graph, ranking, replay, vector

from . import govern
from .common import SQL_RANKS, gallery, query_into, table, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


@query("""
WITH l AS (SELECT l_orderkey, l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice::DECIMAL(18, 2) AS v, l_linenumber, l_shipdate, l_quantity FROM lineitem),
a AS (SELECT l_orderkey, list(v ORDER BY l_linenumber, v) AS a FROM l GROUP BY ALL), b AS (SELECT l_orderkey, list(v ORDER BY l_shipdate, v) FILTER (l_quantity <= 45) AS b FROM l GROUP BY ALL),
p AS (SELECT l_orderkey, a, coalesce(b, []) AS b, list_transform(a, lambda v: coalesce(list_position(coalesce(b, []), v), 0)) AS at FROM a JOIN b USING (l_orderkey))
SELECT l_orderkey, len(a)::INT AS n_base, len(b)::INT AS n_other, len(list_filter(at, lambda x: x = 0))::INT AS n_lost,
  CASE WHEN list_contains(at, 0) THEN 'lost' WHEN at = list_sort(at) THEN 'kept' ELSE 'reordered' END AS state FROM p""".replace(" AS at", " AS places").replace("(at,", "(places,").replace("at = list_sort(at)", "places = list_sort(places)"))
def replay_packet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders in the order of their numbers against those shipped, in the order of their dates and without large ones: kept, reordered or lost."""
    v = F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("v"), "l_linenumber", "l_shipdate", "l_quantity")
    base = li.select("l_orderkey", F.struct("l_linenumber").alias("pos"), "v")
    other = li.where("l_quantity <= 45").select("l_orderkey", F.struct("l_shipdate").alias("pos"), "v")
    return replay.packet_order(base, other, "l_orderkey", "pos", "v")


@query("""
WITH m AS (SELECT p_partkey, CASE WHEN p_size <> 7 THEN p_name || '/' || p_size END AS id FROM part),
d AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, list(q ORDER BY id) AS q, list(id ORDER BY id) AS ids, count(*) AS n, count(id) AS known, count(DISTINCT id) AS n_new FROM d JOIN m ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT *, CASE WHEN known < n THEN 'unknown' WHEN n_new < n THEN 'merged' ELSE 'ok' END AS state FROM g)
SELECT l_orderkey, state, CASE WHEN state = 'ok' THEN array_to_string(ids, ',') END AS ids, CASE WHEN state = 'ok' THEN array_to_string(list_transform(q, lambda x: x::INT), ',') END AS quantities FROM s""")
def replay_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders, with their quantities aligned, under ids of name and size: some ids are missing, and some orders hold two parts that become one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.concat_ws("/", "p_name", "p_size")).alias("id"))
    lines = graph.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    each = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    nested = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "q"))).alias("s")).select("l_orderkey", F.col("s.l_partkey").alias("ids"), F.col("s.q").alias("quantities"))
    out = replay.rekeyed(nested, "l_orderkey", "ids", ["quantities"], parts, "p_partkey", "id")
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c), ",")).alias(c)
    return out.withColumn("quantities", F.transform("quantities", lambda x: x.cast("int").cast("string"))).select("l_orderkey", "state", joined("ids"), joined("quantities"))


_DECISIONS = """d AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'promoted' ELSE 'held' END AS action,
    CASE o_orderkey % 3 WHEN 0 THEN 'wrong_to_correct' WHEN 1 THEN 'correct_to_wrong' END AS change, o_custkey AS selected, o_custkey + 1 AS baseline FROM orders),
t AS (SELECT l_orderkey AS key, l_discount >= 0.07 AS rival, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem QUALIFY rank <= 5),
r AS (SELECT key, bool_or(rival AND rank > 1) AS rivals, bool_or(rival AND rank >= 5) AS cut FROM t GROUP BY key),
s AS (SELECT d.*, rivals, CASE WHEN action <> 'promoted' THEN 'untouched' WHEN cut THEN 'refused' ELSE 'decided' END AS certificate FROM d LEFT JOIN r USING (key)),
z AS (SELECT key, action, change, selected, baseline, certificate, CASE WHEN certificate = 'refused' THEN NULL WHEN certificate = 'decided' AND rivals THEN 'blocked' ELSE action END AS after_action,
    CASE WHEN certificate = 'refused' OR (certificate = 'decided' AND rivals) THEN NULL ELSE change END AS change_after,
    CASE WHEN certificate = 'refused' THEN NULL WHEN certificate = 'decided' AND rivals THEN baseline ELSE selected END AS selected_after FROM s)"""


def _redecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("o_orderkey") % 3 == 0, "wrong_to_correct").when(F.col("o_orderkey") % 3 == 1, "correct_to_wrong")
    action = F.when(F.col("o_orderstatus") == "F", "promoted").otherwise("held")
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("key"), action.alias("action"), change.alias("change"), F.col("o_custkey").alias("selected"), (F.col("o_custkey") + 1).alias("baseline"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_discount") >= 0.07).alias("rival"), "l_extendedprice", "l_partkey", "l_suppkey")
    t = ranking.placed(li, "key", [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"], "rank").where("rank <= 5")
    return replay.redecided(d, t, "key", "promoted", "blocked", 5)


@query(f"WITH {_DECISIONS} SELECT * FROM z")
def replay_redecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as promotions that a discounted line among the five dearest blocks, and those that the cut at five does not let decide."""
    return _redecided(spark, sf_dir)


@query(f"""WITH {_DECISIONS} SELECT count(*) FILTER (certificate = 'decided') AS n_decided, count(*) FILTER (certificate = 'refused') AS n_refused,
  count(*) FILTER (certificate = 'decided' AND change = 'wrong_to_correct' AND change_after IS NOT NULL) AS fixes_kept, count(*) FILTER (certificate = 'decided' AND change = 'wrong_to_correct' AND change_after IS NULL) AS fixes_lost,
  count(*) FILTER (certificate = 'decided' AND change = 'correct_to_wrong' AND change_after IS NULL) AS regressions_removed,
  count(*) FILTER (certificate = 'decided' AND change = 'correct_to_wrong' AND change_after IS NOT NULL) AS regressions_left FROM z""")
def replay_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule keeps and loses, in one row of counts."""
    return replay.outcome(_redecided(spark, sf_dir))


_CHANGED = SQL_RANKS.replace("embedding::DOUBLE[] AS v FROM embeddings)", "CASE WHEN vec_id % 50 = 1 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 70 <> 3)", 1)


@query(f"WITH {_CHANGED} SELECT query_id, channel, entity, round(score, 6) AS score, row_id, rank FROM ranks")
def vec_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a gallery in which some vectors were turned around and some were taken away: only entities that hold one of them are scored again."""
    old = gallery(spark, sf_dir)
    turned = F.when(F.col("row_id") % 50 == 1, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    new = old.where("row_id % 70 != 3").withColumn("vector", turned)
    changed = old.where("row_id % 50 = 1 or row_id % 70 = 3").select("entity", "channel")
    queries = vector_queries(spark, sf_dir)
    out = replay.replayed(vector.entity_scores(queries, old), queries, new, changed)
    return out.select("query_id", "channel", "entity", F.round("score", 6).alias("score"), "row_id", "rank")


@query(f"""
WITH {govern._BOXES}, p AS (SELECT * FROM bx WHERE score > 40000), l AS (SELECT * FROM bx WHERE score <= 40000), t AS (SELECT * FROM bx WHERE score > 60000),
n AS (SELECT l.image, l.key, p.key AS parent, least(l.x1, p.x1) AS x1, least(l.y1, p.y1) AS y1, greatest(l.x2, p.x2) AS x2, greatest(l.y2, p.y2) AS y2 FROM l JOIN p ON l.image = p.image
  WHERE l.y1 - p.y2 BETWEEN 0 AND 10 AND least(l.x2, p.x2) - greatest(l.x1, p.x1) >= 0.5 * (l.x2 - l.x1)),
o AS (SELECT image, key, count(*) AS n, min(parent) AS parent, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM n GROUP BY ALL),
g AS (SELECT DISTINCT o.image, o.key FROM o JOIN t ON o.image = t.image WHERE o.n = 1 AND least(o.x2, t.x2) >= greatest(o.x1, t.x1) AND least(o.y2, t.y2) >= greatest(o.y1, t.y1)
  AND (least(o.x2, t.x2) - greatest(o.x1, t.x1)) * (least(o.y2, t.y2) - greatest(o.y1, t.y1))
    > 0.5 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - (least(o.x2, t.x2) - greatest(o.x1, t.x1)) * (least(o.y2, t.y2) - greatest(o.y1, t.y1))))
SELECT l.image, l.key, CASE WHEN n = 1 THEN parent END AS parent,
  CASE WHEN n IS NULL THEN 'no_parent_beneath' WHEN n > 1 THEN 'ambiguous_parent_beneath' WHEN (l.image, l.key) IN (SELECT (image, key) FROM g) THEN 'existing_target' ELSE 'adopted' END AS state
FROM l LEFT JOIN o ON o.image = l.image AND o.key = l.key""")
def geo_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap boxes as labels and dear ones as their parents beneath: adopted where there is one and the dearest do not cover both already."""
    b = govern._boxes(spark, sf_dir)
    box = lambda where: b.where(where).select("image", "key", "x1", "y1", "x2", "y2")
    return geometry.orphans(box("score <= 40000"), box("score > 40000"), box("score > 60000"), "image").select("image", "key", "parent", "state")


@query("""
WITH RECURSIVE w AS (SELECT l_orderkey, string_split(string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), ' ') AS ws FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS s FROM part),
al AS (SELECT s AS phrase, min(atom) AS atom FROM (SELECT s, 'zz' || array_to_string(s, '') || 'zz' AS atom FROM n
    UNION ALL SELECT [a.s[2], b.s[1], b.s[2]], 'yy' || a.s[2] || b.s[2] || 'yy' FROM n a JOIN n b ON a.s[1] = b.s[1] AND a.s[2] < b.s[2]
    UNION ALL SELECT [s[1]], 'xx' || s[1] || 'xx' FROM n WHERE s[1] < 'm') GROUP BY s),
r AS (SELECT l_orderkey, ws, 1 AS i, []::VARCHAR[] AS tokens, 0 AS applied FROM w
  UNION ALL SELECT l_orderkey, ws, i + coalesce(len(phrase), 1), list_append(tokens, coalesce(atom, ws[i])), applied + CASE WHEN phrase IS NULL THEN 0 ELSE 1 END
  FROM (SELECT r.*, phrase, atom, row_number() OVER (PARTITION BY l_orderkey ORDER BY len(phrase) DESC NULLS LAST) AS best FROM r LEFT JOIN al ON r.ws[r.i:r.i + len(phrase) - 1] = phrase WHERE i <= len(ws)) WHERE best = 1)
SELECT l_orderkey, array_to_string(tokens, ' ') AS tokens, applied FROM r WHERE i > len(ws)""")
def text_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of an order's parts as running words, in which names, and words across two names, are aliases of one to three words."""
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_name"))), lambda x: x["p_name"])
    rows = li.groupBy("l_orderkey").agg(F.split(F.array_join(lines, " "), " ").alias("ws"))
    n = p.select(F.split("p_name", " ").alias("s")).distinct()
    a, b = n.select(F.col("s")[0].alias("x"), F.col("s")[1].alias("y")), n.select(F.col("s")[0].alias("x"), F.col("s")[1].alias("z"))
    alias = lambda phrase, atom: (phrase.alias("phrase"), F.concat(*atom).alias("atom"), F.lit(0).alias("priority"))
    whole = n.select(*alias(F.col("s"), [F.lit("zz"), F.array_join("s", ""), F.lit("zz")]))
    across = a.join(b, "x").where("y < z").select(*alias(F.array("y", "x", "z"), [F.lit("yy"), F.col("y"), F.col("z"), F.lit("yy")]))
    first = a.where("x < 'm'").select("x").distinct().select(*alias(F.array("x"), [F.lit("xx"), F.col("x"), F.lit("xx")]))
    out = canonical.canonical(rows, "ws", whole.union(across).union(first))
    return out.select("l_orderkey", F.array_join("tokens", " ").alias("tokens"), F.size("applied").alias("applied"))


_CONFLICTS = """pr AS (SELECT DISTINCT p_brand || '/' || p_type AS product, p_brand, p_type FROM part),
pairs AS (SELECT a.product AS a, b.product AS b, a.p_brand || ':' || a.p_type || '-' || b.p_type AS conflict FROM pr a JOIN pr b ON a.p_brand = b.p_brand AND a.p_type < b.p_type)"""


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("product"), "p_brand", "p_type").distinct()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two types of one brand as a pair in conflict."""
    a = _products(spark, sf_dir)
    b = a.select("p_brand", F.col("product").alias("b"), F.col("p_type").alias("other"))
    return a.withColumnRenamed("product", "a").join(b, "p_brand").where("p_type < other").select("a", "b", F.concat("p_brand", F.lit(":"), "p_type", F.lit("-"), "other").alias("conflict"))


@query(f"""
WITH {_CONFLICTS}, l AS (SELECT l_orderkey, p_brand || '/' || p_type AS product, p_type, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT l_orderkey, product, min(rank) AS rank FROM l WHERE rank <= 5 GROUP BY ALL), f AS (SELECT l_orderkey, arg_min(product, rank) AS top1 FROM t GROUP BY ALL),
m AS (SELECT f.l_orderkey, top1, t.product AS y, conflict FROM f JOIN t USING (l_orderkey) JOIN pairs ON (a = top1 AND b = t.product) OR (b = top1 AND a = t.product)),
g AS (SELECT l_orderkey, top1, list_sort(list_append(list(DISTINCT y), top1)) AS members, list_sort(list(DISTINCT conflict)) AS conflicts FROM m GROUP BY l_orderkey, top1),
o AS (SELECT l_orderkey, list(DISTINCT p_type) AS seen FROM l WHERE l_linenumber >= 4 GROUP BY ALL),
s AS (SELECT g.*, list_filter(members, lambda x: list_contains(coalesce(seen, []), split_part(x, '/', 2))) AS hit FROM g LEFT JOIN o USING (l_orderkey))
SELECT l_orderkey, top1, array_to_string(members, ',') AS members, array_to_string(conflicts, ',') AS conflicts, CASE WHEN len(hit) = 1 THEN hit[1] END AS selectable,
  CASE WHEN len(hit) = 1 THEN 'conflict_resolved_by_text' ELSE 'ambiguous_reference_conflict' END AS status FROM s""")
def guard_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose dearest line is of a brand that another of the first five lines has in another type: a conflict that the types of later lines may resolve."""
    p = graph.sided(table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat_ws("/", "p_brand", "p_type").alias("product")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    n, same = lines.count(), F.col("l_partkey") == F.col("p_partkey")
    if table(spark, sf_dir, "part").count() <= graph.MOST_BROADCAST:
        li = graph.spread(lines, "l_orderkey", rows=n).join(p, same)
    else:
        li = graph.spread(graph.spread(lines, "l_partkey", rows=n).join(p, same), "l_orderkey", rows=n)
    ranks = ranking.placed(li, "l_orderkey", [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"], "rank").select("l_orderkey", "product", "rank")
    values = _products(spark, sf_dir).select("product", F.col("p_type").alias("value"))
    observed = li.where("l_linenumber >= 4").select("l_orderkey", F.col("p_type").alias("value"))
    out = conflicts.annotated(ranks, _pairs(spark, sf_dir), values, observed, "l_orderkey", "product", 5)
    return out.select("l_orderkey", "top1", F.array_join("members", ",").alias("members"), F.array_join("conflicts", ",").alias("conflicts"), "selectable", "status")


@query(f"""
WITH {_CONFLICTS}, s AS (SELECT o_orderkey AS step, o_orderpriority AS kind, a.p_brand || '/' || a.p_type AS x, b.p_brand || '/' || b.p_type AS y, max(o_orderkey) OVER () + 1 AS cycle
  FROM orders JOIN part a ON a.p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN part b ON b.p_partkey = o_custkey % (SELECT count(*) FROM part))
SELECT kind, sum(greatest(0, (cycle * 2 + cycle // 2 - step) // cycle + 1))::BIGINT AS n FROM s JOIN pairs ON (x = a AND y = b) OR (x = b AND y = a) GROUP BY kind""")
def guard_presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule of orders, each showing two parts, replayed two and a half times: how often it shows two types of one brand, by priority."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("product"))
    n, o = p.count(), table(spark, sf_dir, "orders")
    side = lambda name, at: p.select(F.col("product").alias(name), F.col("p_partkey").alias(at))
    steps = o.select(F.col("o_orderkey").alias("step"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % n).alias("i"), (F.col("o_custkey") % n).alias("j")).join(side("x", "i"), "i").join(side("y", "j"), "j")
    cycle = o.agg(F.max("o_orderkey")).first()[0] + 1
    return conflicts.presentations(steps.select("step", "kind", "x", "y"), _pairs(spark, sf_dir), cycle * 2 + cycle // 2)


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part), g AS (SELECT * FROM r WHERE p_size > 20)
SELECT w.p_partkey, (SELECT arg_min(g.p_partkey, (g.p_retailprice, g.p_partkey)) FROM g WHERE g.p_brand = w.p_brand AND g.p_type = w.p_type AND g.p_partkey <> w.p_partkey) AS donor FROM r w WHERE w.p_size < 10 OR w.p_size > 45""")
def roster_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For small and for very large parts the cheapest other part of size over 20 of their brand and type."""
    p = table(spark, sf_dir, "part")
    giving = p.where("p_size > 20").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return conflicts.donors(giving, p.where("p_size < 10 or p_size > 45").select("p_partkey", "p_brand", "p_type"), "p_partkey", ["p_brand", "p_type"], ["p_retailprice"])
