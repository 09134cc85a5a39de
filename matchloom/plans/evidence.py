"""Queries over evidence, ranking and resolution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import evidence, ranking, retrieval, vector

from .common import SQL_RANKS, gallery, query_into, sql_tokens, sql_words, table, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS idx, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
r AS (SELECT doc_id, idx, array_to_string({sql_words("line")}, ' ') AS reading FROM l)
SELECT doc_id, reading, count(*) AS n, min(idx) AS first_idx, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS idxs FROM r WHERE reading <> '' GROUP BY ALL""")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document grouped by equal readings, in first-seen order."""
    return evidence.grouped_lines(evidence.lines(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query("""WITH l AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role, 1) OVER w AS after_1, lead(role, 2) OVER w AS after_2, lead(role, 3) OVER w AS after_3 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the role before it and the three after."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role")
    return evidence.previous_and_next(rows, "conv_id", "role").withColumnRenamed("idx", "turn")


_CLAIMS = f"""ix AS (SELECT DISTINCT doc_id, unnest({sql_tokens("text")}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM ix GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
claims AS (SELECT item_id, term, ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM (SELECT DISTINCT item_id, unnest({sql_tokens("text")}) AS term FROM benchmark) LEFT JOIN df USING (term), n)"""


@query(f"""WITH {_CLAIMS}, mass AS (SELECT item_id, sum(w) AS mass FROM claims GROUP BY item_id),
hit AS (SELECT item_id, doc_id, sum(w * CASE WHEN length(term) > 4 THEN 1.0 ELSE 0.5 END) AS hit, count(*) AS n_read FROM claims JOIN ix USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(hit / mass, 6) AS coverage, n_read FROM hit JOIN mass USING (item_id) WHERE mass > 0 AND round(hit / mass, 9) >= 0.25""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents read at least a quarter of an item's weighted terms; short terms count half."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    claims, held = retrieval.query_terms(items, docs, "item_id", "doc_id", "text", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)))
    grade = F.when(F.length("term") > 4, 1.0).otherwise(0.5)
    got = retrieval.covering(claims, held, "item_id", "doc_id", "idf", 0.25, grade)
    return got.select("item_id", "doc_id", F.round(F.col("hit") / F.col("mass"), 6).alias("coverage"), "n_read")


_MARKS = f"""marks AS (SELECT DISTINCT source AS pool, doc_id, array_to_string({sql_words("line")}, ' ') AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("pool"), "doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return rows.select("pool", "doc_id", tx.norm(F.col("l")).alias("line")).where("line != ''").distinct()


@query(f"""WITH {_MARKS}, m AS (SELECT * FROM marks WHERE line <> ''), s AS (SELECT pool, count(DISTINCT doc_id) AS size FROM m GROUP BY pool), o AS (SELECT pool, line, count(*) AS c FROM m GROUP BY ALL)
SELECT pool, doc_id, count(*) AS n_lines, round(avg(CASE WHEN size > 1 THEN 1 - (c - 1) / (size - 1) ELSE 1.0 END), 6) AS exclusivity FROM m JOIN o USING (pool, line) JOIN s USING (pool) GROUP BY ALL""")
def evidence_exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How exclusive the lines of a document are within its source."""
    return evidence.exclusivity(_marks(spark, sf_dir), "pool", "doc_id", "line").withColumn("exclusivity", F.round("exclusivity", 6))


@query(f"""WITH {_MARKS}, m AS (SELECT * FROM marks WHERE line <> ''), s AS (SELECT pool, count(DISTINCT doc_id) AS n FROM m GROUP BY pool)
SELECT pool, line, count(DISTINCT doc_id) AS f, round(ln((n + 1) / (count(DISTINCT doc_id) + 1)) / ln(n + 1), 6) AS rarity FROM m JOIN s USING (pool) GROUP BY pool, line, n""")
def evidence_pool_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare every line is among the documents of its source."""
    return evidence.pool_rarity(_marks(spark, sf_dir), "pool", "doc_id", "line").withColumn("rarity", F.round("rarity", 6))


@query("""WITH s AS (SELECT l_orderkey AS pool, l_partkey AS candidate, l_linenumber, l_suppkey AS grp, l_extendedprice AS score FROM lineitem),
r AS (SELECT a.pool, a.candidate, a.l_linenumber, a.grp, a.score, max(b.score) AS rival FROM s a LEFT JOIN s b ON a.pool = b.pool AND a.grp <> b.grp GROUP BY ALL)
SELECT *, round(score - rival, 6) AS lead FROM r""")
def evidence_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of an order the best price of another supplier in it, and the lead over that."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pool"), F.col("l_partkey").alias("candidate"), "l_linenumber", F.col("l_suppkey").alias("grp"), F.col("l_extendedprice").alias("score"))
    return evidence.rivals(rows, "pool", "candidate", "grp", "score").withColumn("lead", F.round("lead", 6)).select("pool", "candidate", "l_linenumber", "grp", "score", "rival", "lead")


@query(f"""WITH t AS (SELECT DISTINCT p_brand, p_partkey, unnest({sql_words("p_name")}) AS term FROM part), s AS (SELECT p_brand, count(DISTINCT p_partkey) AS members FROM t GROUP BY p_brand),
h AS (SELECT p_brand, term, count(DISTINCT p_partkey) AS holders FROM t GROUP BY ALL)
SELECT p_brand, members, count(*) AS n_union, count(*) FILTER (holders = members) AS n_common FROM h JOIN s USING (p_brand) GROUP BY ALL""")
def evidence_family_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name words of every brand: all of them, and those that all of its parts share."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.explode(tx.words(F.col("p_name"))).alias("term")).distinct()
    return evidence.family_terms(rows, "p_brand", "p_partkey", "term")


@query(f"""WITH t AS (SELECT DISTINCT p_partkey, unnest({sql_words("p_name")}) AS term FROM part), g AS (SELECT DISTINCT p_name, unnest({sql_words("p_name")}) AS term FROM part), need AS (SELECT p_name, count(*) AS need FROM g GROUP BY p_name)
SELECT p_name, p_partkey FROM g JOIN t USING (term) JOIN need USING (p_name) GROUP BY p_name, p_partkey, need HAVING count(*) = need""")
def evidence_holders_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have every word of a name (relational division)."""
    part = table(spark, sf_dir, "part")
    pairs = part.select("p_partkey", F.explode(tx.words(F.col("p_name"))).alias("term")).distinct()
    wanted = part.select("p_name", F.explode(tx.words(F.col("p_name"))).alias("term")).distinct()
    return evidence.holders_of_all(pairs, wanted, "p_partkey", "term", "p_name")


@query("""WITH o AS (SELECT l_orderkey AS k, list(DISTINCT l_linestatus) AS seen FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN ['F', 'O'] ELSE [o_orderstatus] END AS wanted FROM orders)
SELECT k, CASE WHEN seen IS NULL OR wanted IS NULL THEN 'unknown' WHEN len(list_intersect(seen, wanted)) = len(seen) THEN 'matched' WHEN len(list_intersect(seen, wanted)) = 0 THEN 'contradicted' ELSE 'partial' END AS state FROM o FULL JOIN e USING (k)""")
def typed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the line states of an order agree with its own state: matched, contradicted, partial, or unknown without lines."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("v"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit("F"), F.lit("O"))).otherwise(F.array("o_orderstatus"))).alias("v"))
    return evidence.typed_states(seen, wanted, "k", "v")


@query("""SELECT p_brand, p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""")
def rank_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand that no other beats in both size and price."""
    return evidence.skyline(table(spark, sf_dir, "part"), "p_brand", F.col("p_size"), F.col("p_retailprice"), "p_partkey").select("p_brand", "p_partkey", "p_size", "p_retailprice")


#: Weights and scales of the linear scorer over channel features.
WEIGHTS = {"s0": 2.0, "s1": 1.5, "rr0": 0.6, "rr1": 0.4, "support": 0.25}
SCALES = {"s0": 0.8, "s1": 0.8}

_FEATURES = f"""{SQL_RANKS}, f AS (SELECT query_id, entity, max(CASE WHEN channel = 0 THEN score END) AS s0, max(CASE WHEN channel = 1 THEN score END) AS s1,
  max(CASE WHEN channel = 0 THEN 1.0 / rank END) AS rr0, max(CASE WHEN channel = 1 THEN 1.0 / rank END) AS rr1, count(*) FILTER (rank <= 3) AS support FROM ranks GROUP BY ALL),
sc AS (SELECT f.query_id, f.entity, support, q.truth, round(coalesce(s0, 0) * {2.0 / 0.8} + coalesce(s1, 0) * {1.5 / 0.8} + coalesce(rr0, 0) * 0.6 + coalesce(rr1, 0) * 0.4 + support * 0.25, 9) AS score FROM f JOIN q USING (query_id)),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, support DESC, entity))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vector.ranked(vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir)), ["query_id", "channel"])
    cell = lambda c, x: F.max(F.when(F.col("channel") == c, x))
    f = ranks.groupBy("query_id", "entity").agg(cell(0, F.col("score")).alias("s0"), cell(1, F.col("score")).alias("s1"), cell(0, 1.0 / F.col("rank")).alias("rr0"), cell(1, 1.0 / F.col("rank")).alias("rr1"), F.count_if(F.col("rank") <= 3).alias("support"))
    return f.join(vector_queries(spark, sf_dir).select("query_id", "truth"), "query_id")


@query(f"WITH {_FEATURES} SELECT query_id, entity, round(score, 6) AS score, rank, CASE WHEN rank = 1 THEN round(score - next, 6) END AS margin FROM ranked")
def rank_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools ranked by a linear scorer, with the margin of the first."""
    out = ranking.linear_rank(_features(spark, sf_dir), "query_id", "entity", WEIGHTS, SCALES, "support")
    return out.select("query_id", "entity", F.round("score", 6).alias("score"), "rank", F.round("margin", 6).alias("margin"))


@query(f"""WITH {_FEATURES}, firsts AS (SELECT query_id, min(entity) AS chosen FROM ranks WHERE rank = 1 GROUP BY query_id HAVING count(DISTINCT entity) = 1 AND count(DISTINCT channel) >= 2)
SELECT r.query_id, r.entity, r.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY CASE WHEN r.entity = chosen THEN 0 ELSE 1 END, r.rank) AS new_rank FROM ranked r LEFT JOIN firsts USING (query_id)""")
def rank_promote_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all channels agree on one entity it goes to the front; the others keep their order."""
    f = _features(spark, sf_dir)
    ranks = vector.ranked(vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir)), ["query_id", "channel"])
    chosen = ranking.agreed(ranks, "query_id", "channel", "entity").withColumnRenamed("entity", "chosen")
    out = ranking.linear_rank(f, "query_id", "entity", WEIGHTS, SCALES, "support").join(chosen, "query_id", "left")
    return ranking.promoted(out, "query_id", F.col("entity").eqNullSafe(F.col("chosen"))).select("query_id", "entity", "rank", "new_rank")


@query(f"""WITH {_FEATURES}, c AS (SELECT query_id, entity AS control FROM ranks WHERE channel = 0 AND rank = 1), p AS (SELECT query_id, entity AS proposal, score - next AS margin, support FROM ranked WHERE rank = 1),
j AS (SELECT query_id, control, proposal, concat_ws(',', CASE WHEN NOT coalesce(margin >= 0.05, false) THEN 'margin' END, CASE WHEN NOT coalesce(support >= 2, false) THEN 'support' END) AS reasons FROM c JOIN p USING (query_id))
SELECT query_id, control, proposal, reasons, CASE WHEN reasons = '' THEN proposal ELSE control END AS final FROM j""")
def resolve_keep_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposal of the scorer replaces the first of channel 0 only if its margin and support suffice; else the reasons say why not."""
    ranks = vector.ranked(vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir)), ["query_id", "channel"])
    control = ranks.where("channel = 0 and rank = 1").select("query_id", F.col("entity").alias("control"))
    first = ranking.linear_rank(_features(spark, sf_dir), "query_id", "entity", WEIGHTS, SCALES, "support").where("rank = 1").select("query_id", F.col("entity").alias("proposal"), F.col("margin"), "support")
    out = ranking.resolved(control.join(first, "query_id"), "control", "proposal", {"margin": F.col("margin") >= 0.05, "support": F.col("support") >= 2})
    return out.select("query_id", "control", "proposal", "reasons", "final")


def _rescored(changed: str) -> str:
    """The score with 0.1 added to one feature."""
    terms = {"s0": 2.0 / 0.8, "s1": 1.5 / 0.8, "rr0": 0.6, "rr1": 0.4, "support": 0.25}
    return "round(" + " + ".join(f"(coalesce({n}, 0) + {0.1 if n == changed else 0}) * {w}" for n, w in terms.items()) + ", 9)"


@query(f"""WITH {_FEATURES}, r AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, {_rescored('')} AS base, {_rescored(n)} AS after FROM f" for n in ("s0", "s1", "rr0", "rr1", "support"))})
SELECT feature, count(*) AS n, count(*) FILTER (after > base) AS raised, count(*) FILTER (after < base) AS violations FROM r GROUP BY feature""")
def eval_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raising a feature in the direction of its weight raises a score and never lowers it: every candidate is scored again."""
    return ranking.perturbed(_features(spark, sf_dir), WEIGHTS, 0.1, SCALES)


@query("""WITH r AS (SELECT l_partkey, l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_extendedprice DESC, l_suppkey) AS rank FROM lineitem)
SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM r WHERE rank = 1 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1 AND count(DISTINCT l_returnflag) >= 2""")
def rank_agreed_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose dearest line has one supplier under every return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_extendedprice")
    best = lines.groupBy("l_partkey", "l_returnflag").agg(F.min(F.struct(-F.col("l_extendedprice"), "l_suppkey")).alias("b"))
    return ranking.agreed(best.select("l_partkey", "l_returnflag", F.col("b.l_suppkey").alias("l_suppkey"), F.lit(1).alias("rank")), "l_partkey", "l_returnflag", "l_suppkey")


@query("""
WITH r AS (SELECT l_orderkey, 'price' AS channel, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM lineitem
  UNION ALL SELECT l_orderkey, 'quantity', l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) FROM lineitem
  UNION ALL SELECT l_orderkey, 'discount', l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) FROM lineitem WHERE l_discount > 0.05)
SELECT l_orderkey, min(l_partkey) AS l_partkey FROM r WHERE rank = 1 GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1 AND count(DISTINCT channel) >= 3""")
def rank_agreed_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose dearest, largest and most discounted line is of one part; orders without a discount have no third list."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    channels = {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "discount": F.when(F.col("l_discount") > 0.05, F.col("l_discount"))}
    return ranking.agreed_first(li, "l_orderkey", "l_partkey", channels, least=3)


@query(f"""WITH {_FEATURES}, a AS (SELECT query_id, entity AS first FROM (SELECT query_id, entity, round(coalesce(s0, 0) * 2.0 + coalesce(s1, 0) * 1.5 + coalesce(rr0, 0) * 0.6 + coalesce(rr1, 0) * 0.4 + support * 0.25, 9) AS s FROM f) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity) = 1),
b AS (SELECT query_id, entity AS second FROM (SELECT query_id, entity, round(coalesce(s1, 0) * 1.5 + coalesce(rr0, 0) * 0.6 + coalesce(rr1, 0) * 0.4 + support * 0.25, 9) AS s FROM f) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity) = 1)
SELECT count(*) AS n, count(*) FILTER (first <> second) AS changed FROM a JOIN b USING (query_id)""")
def eval_feature_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first candidate changes without the score of channel 0."""
    out = ranking.without_feature(_features(spark, sf_dir), "query_id", "entity", WEIGHTS, "s0")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("first") != F.col("first_without")).alias("changed"))


@query()
def fit_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-bounded listwise weights of the channel features, fitted by distributed gradients (iterative: no SQL form)."""
    features = ["s0", "s1", "rr0", "rr1"]
    rows = _features(spark, sf_dir).withColumn("label", (F.col("entity") == F.col("truth")).cast("int")).fillna(0.0, features).persist()
    model = ranking.fit_listwise(rows, "query_id", "label", features, {f: 1 for f in features}, steps=6)
    rows.unpersist()
    out = [(f, round(float(w), 9), bool(w >= 0), round(float(model["losses"][0]), 9), round(float(np.min(model["losses"])), 9)) for f, w in model["weights"].items()]
    return spark.createDataFrame(out, "feature string, weight double, sign_kept boolean, first_loss double, last_loss double")


@query(f"""WITH {SQL_RANKS} SELECT query_id, entity, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3_share, round(sum(1.0 / rank), 6) AS reciprocal, count(*) AS channels FROM ranks GROUP BY ALL""")
def rank_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support counters: share of channels with the entity among the first three, and the sum of reciprocal ranks."""
    ranks = vector.ranked(vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir)), ["query_id", "channel"])
    return ranks.groupBy("query_id", "entity").agg(F.round(F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0)), 6).alias("top3_share"), F.round(F.sum(1.0 / F.col("rank")), 6).alias("reciprocal"), F.count("*").alias("channels"))


@query("""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'STANDARD' THEN 0 ELSE 1 END, p_size DESC, p_partkey) = 1""")
def rank_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that stands for a brand: a standard one, then the largest, then the smallest key."""
    return ranking.representative(table(spark, sf_dir, "part"), "p_brand", "p_partkey", [F.when(F.col("p_type") == "STANDARD", 0).otherwise(1), F.desc("p_size")])


