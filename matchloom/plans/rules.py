"""Queries over rules: consensus of arms, ladders, scopes, repairs, longest forms, aliases, masks, alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx
from matchloom.functions import text as tx
from matchloom.operators import ranking, rules

from .common import query_into, sql_search_key, sql_words, table
from .govern import _BOXES, _boxes

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""WITH a AS (SELECT l_orderkey AS k, min(l_suppkey) AS before FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, l_returnflag AS c, max(l_suppkey // 20) * 20 AS x FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
g AS (SELECT k, count(DISTINCT x) AS n, min(x) AS new, count(DISTINCT c) AS channels FROM b GROUP BY k), o AS (SELECT o_orderkey AS k, o_totalprice > 30000 AS ok FROM orders),
r AS (SELECT k, before, new, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 OR channels < 2 THEN 'split' WHEN new = before THEN 'same' WHEN NOT coalesce(ok, false) THEN 'guarded' ELSE 'switched' END AS reason FROM a LEFT JOIN g USING (k) LEFT JOIN o USING (k))
SELECT k, before, CASE WHEN reason = 'switched' THEN new ELSE before END AS after, reason FROM r""")
def resolve_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier of an order gives way to the group that all its return flags agree on, if the order is large."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    a = li.groupBy("k").agg(F.min("l_suppkey").alias("x"))
    b = li.where("l_quantity > 10").groupBy("k", F.col("l_returnflag").alias("c")).agg((F.max(F.floor(F.col("l_suppkey") / 20)) * 20).cast("long").alias("x"))
    return rules.consensus(a, b, "k", "c", "x", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 30000).alias("ok")))


@query("""SELECT p_partkey, CASE WHEN p_size < 5 THEN 'too_small' WHEN p_retailprice < 905 AND p_type = 'STANDARD' THEN 'plain' WHEN p_size > 40 OR p_retailprice > 915 THEN 'accepted' ELSE 'abstain' END AS verdict FROM part""")
def elig_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of conditions over parts; none that holds is an abstention."""
    steps = [("too_small", F.col("p_size") < 5), ("plain", (F.col("p_retailprice") < 905) & (F.col("p_type") == "STANDARD")), ("accepted", (F.col("p_size") > 40) | (F.col("p_retailprice") > 915))]
    return rules.ladder(table(spark, sf_dir, "part"), steps, "abstain").select("p_partkey", "verdict")


@query("""WITH m AS (SELECT o_orderkey, o_custkey, o_totalprice < 20000 AS miss FROM orders), c AS (SELECT o_orderkey, o_custkey FROM m WHERE NOT miss AND o_custkey IN (SELECT o_custkey FROM m WHERE miss) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2)
SELECT o_orderkey, o_custkey, 'miss' AS role FROM m WHERE miss UNION ALL SELECT o_orderkey, o_custkey, 'control' FROM c""")
def roster_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap orders, and two others of each customer that has one."""
    return rules.scope(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") < 20000, "o_custkey", "o_orderkey", 2)


#: Words of part names that are put right, with the kind of the edit.
REPAIRS = [("letter", "blue", "bleu"), ("split", "small ring", "smallring"), ("letter", "gear", "geer")]


def _repair_sql() -> str:
    t = f"' ' || replace(array_to_string({sql_words('x')}, ' '), ' ', '  ') || ' '"
    counts: dict[str, list[str]] = {}
    for kind, wrong, right in REPAIRS:
        word = f" {wrong.replace(' ', '  ')} "
        counts.setdefault(kind, []).append(f"((length({t}) - length(replace({t}, '{word}', ''))) // {len(word)})")
        t = f"replace({t}, '{word}', ' {right.replace(' ', '  ')} ')"
    edits = ", ".join(f"CASE WHEN {' + '.join(n)} > 0 THEN '{k}:' || ({' + '.join(n)}) END" for k, n in counts.items())
    return f"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_name || ' ' || p_type AS x FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(x, 'PROMO') THEN array_to_string({sql_words('x')}, ' ') ELSE trim(regexp_replace({t}, ' +', ' ', 'g')) END AS repaired, CASE WHEN regexp_matches(x, 'PROMO') THEN '' ELSE concat_ws(',', {edits}) END AS edits FROM p"""


@query(_repair_sql())
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of doubled part names put right, with counts by kind; promotional parts are left as they are."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_name", "p_type").alias("x"))
    return rules.repaired(p, "x", REPAIRS, "PROMO").select("p_partkey", "repaired", "edits")


_FORMS = "h AS (SELECT DISTINCT l_orderkey, p_name AS phrase FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT l_orderkey, split_part(p_name, ' ', 2) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0)"


@query(f"WITH {_FORMS} SELECT l_orderkey, phrase FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.l_orderkey = a.l_orderkey AND length(b.phrase) > length(a.phrase) AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))")
def text_longest_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and last words of an order's parts, without those that a longer one holds."""
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    hits = both.select("l_orderkey", F.col("p_name").alias("phrase")).union(both.where("l_linenumber % 2 = 0").select("l_orderkey", F.split("p_name", " ")[1])).distinct()
    return rules.longest_forms(hits, ["l_orderkey"], "phrase")


@query("""WITH h AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS role, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS tier FROM lineitem) SELECT * FROM h WHERE tier = 'high' OR NOT EXISTS (SELECT 1 FROM h x WHERE x.l_orderkey = h.l_orderkey AND x.role = h.role AND x.tier = 'high')""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an order by role, sure ones before unsure ones of the same role."""
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("role"), F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("tier"))
    return rules.tiered_hits(hits, ["l_orderkey", "role"], "tier", "high", "low")


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_discount > 0.02 THEN l_partkey END AS value, l_returnflag AS source, l_tax > 0.07 AS disputed FROM lineitem), b AS (SELECT l_orderkey, value, source FROM r WHERE value IS NOT NULL AND source IN ('R', 'A') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE source WHEN 'R' THEN 1 ELSE 2 END, value) = 1),
d AS (SELECT l_orderkey, bool_or(disputed) AS d FROM r GROUP BY 1) SELECT l_orderkey, CASE WHEN NOT d THEN value END AS value, CASE WHEN NOT d THEN source END AS source FROM d LEFT JOIN b USING (l_orderkey)""")
def evidence_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of an order by source: returned lines before accepted ones; none where one is disputed."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0.02, F.col("l_partkey")).alias("value"), F.col("l_returnflag").alias("source"), (F.col("l_tax") > 0.07).alias("disputed"))
    return rules.first_source(r, "l_orderkey", ["R", "A"], "value", "source", "disputed")


@query(f"""WITH w AS (SELECT DISTINCT unnest({sql_words("text")}) AS form FROM benchmark), k AS (SELECT DISTINCT {sql_search_key("form")} AS s FROM w WHERE length(form) % 2 = 0) SELECT form FROM w WHERE length(form) % 2 = 1 AND {sql_search_key("form")} NOT IN (SELECT s FROM k)""")
def text_unattested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of odd length whose phonetic key no word of even length has."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("form")).distinct()
    return rules.unattested(w.where("length(form) % 2 = 1"), w.where("length(form) % 2 = 0"), "form")


@query("""WITH n AS (SELECT DISTINCT p_brand, p_name || ' ' || p_size AS name FROM part), c AS (SELECT DISTINCT regexp_replace(name, '^(small|red|hot) +', '') AS alias, p_brand FROM n WHERE regexp_matches(name, '^(small|red|hot) +')),
e AS (SELECT alias, p_brand FROM c UNION SELECT name, p_brand FROM n) SELECT alias, p_brand FROM c WHERE alias IN (SELECT alias FROM e GROUP BY alias HAVING count(DISTINCT p_brand) = 1)""")
def mine_derived_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand without their first word, where no other brand has the rest."""
    n = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name")).distinct()
    return rules.derived_aliases(n, "p_brand", "name", ["small", "red", "hot"])


@query("""WITH m AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax > 0.06 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey, l_partkey) IN (SELECT (l_orderkey, l_partkey) FROM m) AND l_returnflag <> 'R' AS ignored FROM lineitem""")
def gov_mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that one of two masks leaves out of a loss; returned lines, the positives, never are."""
    li = table(spark, sf_dir, "lineitem")
    out = rules.masks_of(li.withColumn("positive", F.col("l_returnflag") == "R"), ["l_orderkey", "l_partkey"], "positive", [li.where("l_tax > 0.06"), li.where("l_quantity > 45")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ignored")


@query("""WITH f AS (SELECT l_orderkey, l_suppkey % 6 AS product, arg_min(l_partkey, r) AS e, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS p FROM f)
SELECT l_orderkey, max(e) FILTER (p = 1) AS chosen, coalesce(string_agg(e::VARCHAR, ',' ORDER BY p) FILTER (p BETWEEN 2 AND 3), '') AS others, greatest(count(*) - 3, 0) AS n_more FROM p GROUP BY l_orderkey""")
def rank_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of an order and up to two others, one a product, and how many more products there are."""
    li = ranking.placed(table(spark, sf_dir, "lineitem"), "l_orderkey", _ORDER, "r").withColumn("product", F.col("l_suppkey") % 6)
    return rules.alternatives(li, "l_orderkey", "l_partkey", "product", "r", 2)


@query(f"""WITH t AS (SELECT DISTINCT p_partkey, unnest({sql_words("p_name || ' ' || p_type")}) AS token FROM part), c AS (SELECT p_partkey, token, token NOT IN ('small', 'red', 'standard') AS specific, length(token)::DOUBLE AS w FROM t),
r AS (SELECT DISTINCT p_partkey, split_part(p_name, ' ', 1 + (p_size % 2)::INT) AS token FROM part), e AS (SELECT c.*, r.token IS NOT NULL AS seen FROM c LEFT JOIN r USING (p_partkey, token))
SELECT p_partkey, round(CASE WHEN bool_or(seen AND specific) THEN sum(CASE WHEN seen THEN w ELSE 0 END) / sum(w) ELSE 0 END, 6) AS coverage FROM e GROUP BY p_partkey""")
def evidence_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a part's words that one word of its name covers; none if that word is a common one."""
    p = table(spark, sf_dir, "part")
    claims = p.select("p_partkey", F.explode(F.array_distinct(tx.words(F.concat_ws(" ", "p_name", "p_type")))).alias("token")).withColumns({"specific": ~F.col("token").isin("small", "red", "standard"), "w": F.length("token").cast("double")})
    read = p.select("p_partkey", F.element_at(F.split("p_name", " "), (1 + F.col("p_size") % 2).cast("int")).alias("token"))
    return rules.anchored(claims, read, "p_partkey", "specific", "w").withColumn("coverage", F.round("coverage", 6))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS pos, l_quantity AS q0, l_discount AS d0, CASE WHEN l_partkey % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q1, CASE WHEN l_partkey % 5 = 0 THEN l_discount - 0.01 ELSE l_discount END AS d1 FROM lineitem)
SELECT 'l_quantity' AS feature, count(*) FILTER (q1 > q0 AND pos) AS on_positive, count(*) FILTER (q1 > q0 AND NOT pos) AS on_negative, count(*) FILTER (q1 < q0) AS lowered FROM b
UNION ALL SELECT 'l_discount', count(*) FILTER (d1 > d0 AND pos), count(*) FILTER (d1 > d0 AND NOT pos), count(*) FILTER (d1 < d0) FROM b""")
def eval_raised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a rewrite raises on returned lines, on others, and that it lowers."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select(*key, (F.col("l_returnflag") == "R").alias("pos"), "l_quantity", "l_discount")
    new = li.withColumns({"l_quantity": F.col("l_quantity") + F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0), "l_discount": F.col("l_discount") - F.when(F.col("l_partkey") % 5 == 0, 0.01).otherwise(0.0)})
    return rules.raised_features(li, new, key, "pos", ["l_quantity", "l_discount"])


@query("""WITH l AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), s AS (SELECT conv_id, role, n, count(DISTINCT turn) AS n_sources, string_agg(DISTINCT turn::VARCHAR, ',' ORDER BY turn::VARCHAR) AS sources FROM l WHERE turn > 0 GROUP BY ALL)
SELECT conv_id, role, n, turn, coalesce(n_sources, 0) AS n_sources, coalesce(sources, '') AS sources FROM l LEFT JOIN s USING (conv_id, role, n)""")
def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with all later turns of the same conversation, role and length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return rules.line_sources(rows, rows.where("turn > 0"), "conv_id", ["role", "n"], "turn").select("conv_id", "role", "n", "turn", "n_sources", "sources")


@query(f"""WITH {_BOXES}, r AS (SELECT image, key, '[' || x1 || ',' || y1 || ',' || (x1 + 20) || ',' || CASE WHEN key % 4 = 0 THEN 'x' ELSE (y1 + 15)::VARCHAR END || ']' AS roi, x1, y1, x2, y2 FROM bx)
SELECT image, key, CASE WHEN key % 4 = 0 THEN 'bad_roi' WHEN x1 + 20 > 55 THEN 'outside_frame' WHEN (x1 + x2) / 2 >= x1 + 20 OR (y1 + y2) / 2 >= y1 + 15 THEN 'centre_outside' END AS reason FROM r""")
def geo_roi_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions given as text, and why a box is not in its own: not four numbers, outside the frame, or the centre of the box outside. Rejected boxes stay."""
    b = _boxes(spark, sf_dir)
    last = F.when(F.col("key") % 4 == 0, "x").otherwise((F.col("y1") + 15).cast("string"))
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("x1").cast("string"), F.col("y1").cast("string"), (F.col("x1") + 20).cast("string"), last), F.lit("]"))
    roi = F.from_json(text, "array<double>")
    r = b.withColumn("roi", F.when((F.size(roi) == 4) & F.forall(roi, lambda x: x.isNotNull()), roi))
    inside = bx.centre_inside(bx.box(), tuple(F.col("roi")[i] for i in range(4)))
    steps = [("bad_roi", F.col("roi").isNull()), ("outside_frame", F.col("roi")[2] > 55), ("centre_outside", ~inside)]
    out = rules.ladder(r, steps, "", "reason")
    return out.select("image", "key", F.nullif("reason", F.lit("")).alias("reason"))
