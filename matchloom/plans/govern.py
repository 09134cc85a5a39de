"""Queries over governance, evaluation, sets, geometry and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.operators import evaluation, geometry, governance, graph

from .common import query_into, sql_words, table

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)



@query("""WITH d AS (SELECT doc_id, source, lang, sha256(text) AS sha, sha256(string_split(text, chr(10))[1]) AS head FROM documents),
bad AS (SELECT DISTINCT sha256(string_split(text, chr(10))[1]) AS head FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
low AS (SELECT DISTINCT sha FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT doc_id, concat_ws(',', CASE WHEN sha IN (SELECT sha FROM low) THEN 'copy_of_low' END, CASE WHEN head IN (SELECT head FROM bad) THEN 'head_of_toxic' END) AS reasons,
 sha NOT IN (SELECT sha FROM low) AND head NOT IN (SELECT head FROM bad) AS allowed FROM d""")
def gov_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents denied because their text is that of a low-quality one, or their first line that of a toxic one; all reasons are listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.sha2(F.split("text", "\n")[0], 256).alias("head"))
    labels = table(spark, sf_dir, "labels")
    pools = [
        ("copy_of_low", docs.join(labels.where("quality = 0"), "doc_id", "left_semi"), "sha", "sha"),
        ("head_of_toxic", docs.join(labels.where("toxic = 1"), "doc_id", "left_semi"), "head", "head"),
    ]
    return governance.audit(docs, "doc_id", pools).select("doc_id", "reasons", "allowed")


_EDGES = """f AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1), d AS (SELECT doc_id, sha256(text) AS h, sha256(lower(trim(string_split(text, chr(10))[-1]))) AS tail FROM documents),
t AS (SELECT tail, min(doc_id) AS first FROM d GROUP BY 1 HAVING count(*) BETWEEN 2 AND 1000000),
e AS (SELECT doc_id AS u, first AS v FROM d JOIN f USING (h) WHERE doc_id <> first UNION SELECT doc_id, first FROM d JOIN t USING (tail) WHERE doc_id <> first)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a document to the first with its text and to the first with its last line: a star a group, never all pairs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.lower(F.trim(F.element_at(F.split("text", "\n"), -1))), 256).alias("tail"))
    out = None
    for key in ("h", "tail"):
        first = d.groupBy(key).agg(F.min("doc_id").alias("v"))
        e = d.join(first, key).where("doc_id != v").select(F.col("doc_id").alias("u"), "v")
        out = e if out is None else out.union(e)
    return out.distinct()


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, v) AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
SELECT u AS node, least(u, min(v)) AS root FROM r GROUP BY u""")
def gov_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage components of documents that share their text or their last line."""
    return graph.components(_edges(spark, sf_dir))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 0), r(node) AS (SELECT 3::BIGINT UNION SELECT e.child FROM r JOIN e ON e.parent = r.node) SELECT node FROM r""")
def gov_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything derived from a closed item, down a tree of customers."""
    c = table(spark, sf_dir, "customer").where("c_custkey > 0")
    return governance.closure(c.select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).cast("long").alias("parent")), spark.createDataFrame([(3,)], "node long"))


@query("""SELECT source, count(*) AS n, CASE WHEN ('0x' || substr(sha256('split-1:' || source), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'selection' ELSE 'fit' END AS role FROM documents GROUP BY source""")
def gov_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources split by a salted hash alone."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return governance.share_split(rows, "source", "split-1:", 0.2)


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('split-2:' || source), source) AS i FROM documents GROUP BY source), t AS (SELECT 0.2 * count(*) AS want FROM documents),
w(i, source, taken, role) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, '' UNION ALL SELECT g.i, g.source, w.taken + CASE WHEN w.taken < want AND w.taken + n <= 1.25 * want THEN n ELSE 0 END, CASE WHEN w.taken < want AND w.taken + n <= 1.25 * want THEN 'selection' ELSE 'fit' END
  FROM w JOIN g ON g.i = w.i + 1, t) SELECT source, role FROM w WHERE i > 0""")
def gov_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in hash order until a fifth of all rows is taken, one that overshoots being skipped."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return governance.grouped_split(rows, "source", "n", "split-2:", 0.2)


@query("""WITH g AS (SELECT DISTINCT least(p_name, p_type) || '#' || greatest(p_name, p_type) AS pair FROM part WHERE p_size > 45)
SELECT p_partkey, (least(p_name, p_type) || '#' || greatest(p_name, p_type)) IN (SELECT pair FROM g) AND p_name <> p_type AS masked FROM part""")
def gov_pair_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name and type are a confusable pair, in either order (here: pairs of very large parts)."""
    part = table(spark, sf_dir, "part")
    pairs = part.where("p_size > 45").select(tx.pair_key(F.col("p_name"), F.col("p_type")).alias("pair"))
    return governance.masked(part, F.col("p_name"), F.col("p_type"), pairs).select("p_partkey", "masked")


@query("""WITH m AS (SELECT DISTINCT p_brand, p_type FROM part), e AS (SELECT DISTINCT least(a.p_type, b.p_type) AS x, greatest(a.p_type, b.p_type) AS y FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type < b.p_type WHERE a.p_size = b.p_size),
n AS (SELECT p_brand, count(*) * (count(*) - 1) // 2 AS pairs FROM m GROUP BY 1), h AS (SELECT a.p_brand, count(*) AS admitted FROM e JOIN m a ON a.p_type = x JOIN m b ON b.p_brand = a.p_brand AND b.p_type = y GROUP BY 1)
SELECT p_brand, pairs::BIGINT AS pairs, coalesce(admitted, 0) AS admitted, coalesce(admitted, 0) = pairs AS all_admitted FROM n LEFT JOIN h USING (p_brand)""")
def gov_edges_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every brand, whether all pairs of its types are admitted edges (types of two parts of one name and size)."""
    part = table(spark, sf_dir, "part")
    by = part.select("p_name", "p_size", "p_type").distinct()
    edges = by.join(by.withColumnRenamed("p_type", "other"), ["p_name", "p_size"]).where("p_type < other").select(tx.pair_key(F.col("p_type"), F.col("other")).alias("pair")).distinct()
    return governance.edges_admitted(part, "p_brand", "p_type", edges)


_FP = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"


@query(f"""WITH r AS (SELECT p_partkey, p_brand, {_FP.format("p_name || p_type")} AS a FROM part), g AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS p_brand, {_FP.format("s_name")} AS b FROM supplier)
SELECT p_partkey, min(bit_count(xor(a, b)))::INT AS min_bits FROM r LEFT JOIN g USING (p_brand) GROUP BY p_partkey""")
def gov_near_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least Hamming distance of a part's hash to the references of its own brand."""
    fp = lambda x: F.conv(F.substring(F.sha2(x, 256), 1, 8), 16, 10).cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", fp(F.concat("p_name", "p_type")).alias("a"))
    refs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), fp(F.col("s_name")).alias("b"))
    return governance.nearest_hash(rows, refs, "p_brand", "a", "b").select("p_partkey", "min_bits")


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, n // 4 AS step, (n % 4)::INT AS slot FROM b""")
def gov_schedule_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every order in steps of four."""
    out = governance.batches(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 4)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "step", "slot")


@query("SELECT presentations, count(*) AS keys FROM (SELECT l_partkey, count(*) AS presentations FROM lineitem GROUP BY 1) GROUP BY 1")
def gov_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts are presented how often."""
    return governance.count_of_counts(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT h, doc_id, source FROM (SELECT sha256(text) AS h, doc_id, source FROM documents) QUALIFY row_number() OVER (PARTITION BY h ORDER BY source, doc_id) = 1""")
def gov_first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a text: that of the first source, then of the smallest id."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return governance.first_wins(d, "h", ["source", "doc_id"])


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10")
def gov_stratified_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of every language: a control pick, whose number is the feature."""
    return governance.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 10).select("lang", "doc_id")


_PREDICT = """p AS (SELECT doc_id, lang, quality = 1 AS truth, n_chars > 200 AS old, n_chars > 150 AND contains(text, '. ') AS new FROM labels JOIN documents USING (doc_id))"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 200).alias("old"), ((F.col("n_chars") > 150) & F.col("text").contains(". ")).alias("new"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")).join(d, "doc_id")


@query(f"""WITH {_PREDICT} SELECT lang AS slice, count(*) AS n, count(*) FILTER (old = truth) AS correct_old, count(*) FILTER (new = truth) AS correct_new, count(*) FILTER (old <> truth AND new = truth) AS fixes,
count(*) FILTER (old = truth AND new <> truth) AS regressions, count(*) FILTER (old <> truth AND new = truth) - count(*) FILTER (old = truth AND new <> truth) AS net FROM p GROUP BY GROUPING SETS ((lang), ())""")
def eval_paired_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes and regressions of one predictor against another, by language and over all."""
    return evaluation.tally(_predictions(spark, sf_dir), F.col("old") == F.col("truth"), F.col("new") == F.col("truth"), "lang")


@query(f"""WITH {_PREDICT} SELECT doc_id, old AS before, new AS after, CASE WHEN new = truth THEN 'fix' ELSE 'regression' END AS kind FROM p WHERE old <> new""")
def eval_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of an answer, with its kind."""
    p = _predictions(spark, sf_dir)
    return evaluation.ledger(p.select("doc_id", F.col("old").alias("answer"), "truth"), p.select("doc_id", F.col("new").alias("answer")), ["doc_id"], "answer", "truth")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS n FROM orders GROUP BY 1""")
def eval_rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and state."""
    return evaluation.cross_tab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, min(value) AS least, max(value) FILTER (i = ceil(n * 0.5) - 1) AS p50_lower, max(value) FILTER (i = ceil(n * 0.95) - 1) AS p95_nearest, max(value) FILTER (i = floor((n - 1) * 0.95)) AS p95_floor,
max(value) FILTER (i = floor((n - 1) * 0.95 + 0.5)) AS p95_rounded, max(value) AS most, count(*) FILTER (value = 0) AS zeros FROM v GROUP BY event_type""")
def eval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of event values by type, under each of their definitions."""
    return evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH a AS (SELECT event_id, event_type, user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS k FROM events),
b AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS event_type, user_id, CASE WHEN k::INT > 90 THEN NULL ELSE k END AS k FROM a WHERE event_type <> 'error'),
l AS (UNPIVOT (SELECT event_id, coalesce(event_type, '~') AS event_type, coalesce(user_id, '~') AS user_id, coalesce(k, '~') AS k FROM a) ON event_type, user_id, k INTO NAME path VALUE v),
r AS (UNPIVOT (SELECT event_id, coalesce(event_type, '~') AS event_type, coalesce(user_id, '~') AS user_id, coalesce(k, '~') AS k FROM b) ON event_type, user_id, k INTO NAME path VALUE v)
SELECT event_id, path, nullif(l.v, '~') AS left_value, nullif(r.v, '~') AS right_value, CASE WHEN l.v IS NULL THEN 'missing_left' WHEN r.v IS NULL THEN 'missing_right' ELSE 'changed' END AS kind
FROM l FULL JOIN r USING (event_id, path) WHERE l.v IS DISTINCT FROM r.v""")
def eval_diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field differences of nested events before and after a rewrite, rows that one side lacks included."""
    a = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("k"))
    b = a.where("event_type != 'error'").select("event_id", F.when(F.col("event_type") == "view", "seen").otherwise(F.col("event_type")).alias("event_type"), "user_id", F.when(F.col("k").cast("int") > 90, None).otherwise(F.col("k")).alias("k"))
    return evaluation.diff(a, b, "event_id", ["event_type", "user_id", "k"])


@query(f"""WITH {_PREDICT}, f AS (SELECT count(*) AS n, count(*) FILTER (old <> truth AND new = truth) AS fixes, count(*) FILTER (old = truth AND new <> truth) AS regressions FROM p),
g AS (SELECT n >= 50 AS enough, fixes >= regressions AS no_loss, fixes > 0 AS some_gain FROM f)
SELECT unnest(['enough', 'no_loss', 'some_gain', 'all']) AS gate, unnest([enough, no_loss, some_gain, enough AND no_loss AND some_gain]) AS passed FROM g""")
def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release gates over the paired evaluation."""
    t = evaluation.tally(_predictions(spark, sf_dir), F.col("old") == F.col("truth"), F.col("new") == F.col("truth"), "lang").where("slice is null")
    return evaluation.gates(t, {"enough": F.col("n") >= 50, "no_loss": F.col("fixes") >= F.col("regressions"), "some_gain": F.col("fixes") > 0})


@query("""WITH h AS (SELECT ('0x' || substr(sha256(concat_ws(chr(31), o_custkey::VARCHAR, o_orderkey::VARCHAR, o_orderstatus)), 1, 15))::BIGINT AS h FROM orders)
SELECT count(*) AS n, count(DISTINCT h) AS n_distinct, sum(h::HUGEINT)::VARCHAR AS digest FROM h""")
def audit_counts_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and a digest of orders that no order of rows changes."""
    return evaluation.table_digest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_orderstatus"])


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys, count(*) FILTER (doc_id IS NULL) AS n_null, count(*) = count(DISTINCT doc_id) AS \"unique\" FROM documents")
def audit_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether document ids are unique."""
    return evaluation.uniqueness(table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS "both" FROM a FULL JOIN b USING (k)""")
def audit_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders against all customers: differences and intersection."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return evaluation.set_report(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


_BOXES = """bx AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS key, l_extendedprice AS score, (l_partkey % 40)::DOUBLE AS x1, (l_suppkey % 30)::DOUBLE AS y1,
 (l_partkey % 40)::DOUBLE + 5 + l_quantity AS x2, (l_suppkey % 30)::DOUBLE + 5 + l_linenumber * 4 AS y2 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.row_number().over(w).cast("long").alias("key"), F.col("l_extendedprice").alias("score"), x.alias("x1"), y.alias("y1"), (x + 5 + F.col("l_quantity")).alias("x2"), (y + 5 + F.col("l_linenumber") * 4).alias("y2"))


_LIST_BOTH = "greatest(least(k.x2, o.b.x2) - greatest(k.x1, o.b.x1), 0) * greatest(least(k.y2, o.b.y2) - greatest(k.y1, o.b.y1), 0)"
_LIST_IOU = f"{_LIST_BOTH} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.b.x2 - o.b.x1) * (o.b.y2 - o.b.y1) - {_LIST_BOTH})"


@query(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT image, {{'key': key, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b, row_number() OVER (PARTITION BY image ORDER BY score DESC, key) AS i FROM bx),
w(image, i, kept) AS (SELECT image, i, [b] FROM o WHERE i = 1 UNION ALL SELECT w.image, o.i, CASE WHEN len(list_filter(w.kept, lambda k: {_LIST_IOU} > 0.3)) > 0 THEN w.kept ELSE list_append(w.kept, o.b) END FROM w JOIN o ON o.image = w.image AND o.i = w.i + 1),
l AS (SELECT image, kept FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY i DESC) = 1) SELECT image, unnest(kept).key AS key FROM l""")
def geo_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes kept by score-ordered suppression within every order."""
    return geometry.suppressed(_boxes(spark, sf_dir), "image", "key", "score", 0.3)


@query()
def geo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even key matched one to one to boxes of odd key (greedy: no SQL form)."""
    b = _boxes(spark, sf_dir)
    return geometry.matched(b.where("key % 2 = 0"), b.where("key % 2 = 1"), "image", 0.2)


@query(f"""WITH {_BOXES}, p AS (SELECT * FROM bx WHERE score > 40000), l AS (SELECT * FROM bx WHERE score <= 40000),
h AS (SELECT l.image, l.key, count(*) AS n, min(p.key) AS parent FROM l JOIN p USING (image) WHERE
 greatest(least(l.x2, p.x2) - greatest(l.x1, p.x1), 0) * greatest(least(l.y2, p.y2) - greatest(l.y1, p.y1), 0) / ((l.x2 - l.x1) * (l.y2 - l.y1)) >= 0.5
 AND (l.x1 + l.x2) / 2 >= p.x1 AND (l.x1 + l.x2) / 2 < p.x2 AND (l.y1 + l.y2) / 2 >= p.y1 AND (l.y1 + l.y2) / 2 < p.y2 GROUP BY ALL)
SELECT l.image, l.key AS label_key, coalesce(n, 0) AS n_parents, CASE WHEN n = 1 THEN parent END AS parent_key, CASE WHEN n IS NULL THEN 'orphan' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS state FROM l LEFT JOIN h USING (image, key)""")
def geo_associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap boxes put into the dear one that holds them, with orphans and ambiguous ones named."""
    b = _boxes(spark, sf_dir)
    return geometry.associated(b.where("score > 40000"), b.where("score <= 40000"), "image", 0.5)


@query(f"WITH {_BOXES} SELECT image, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM bx GROUP BY image")
def geo_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union box of every order."""
    return geometry.envelope(_boxes(spark, sf_dir), "image")


@query(f"""WITH {_BOXES} SELECT image, key, count(*) OVER (PARTITION BY image) AS n, round((x2 - x1) * (y2 - y1) / 7200.0, 6) AS area_share FROM bx
QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(((x1 + x2) / 2 - 45) * ((x1 + x2) / 2 - 45) + ((y1 + y2) / 2 - 40) * ((y1 + y2) / 2 - 40), 6), round((x2 - x1) * (y2 - y1), 6) DESC, key) = 1""")
def geo_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every order that is nearest to the centre of its frame."""
    return geometry.primary(_boxes(spark, sf_dir), "image", "key", F.lit(90.0), F.lit(80.0)).withColumn("area_share", F.round("area_share", 6))


@query(f"""SELECT role, count(*) AS turns, sum(len({sql_words("text")}))::BIGINT AS words FROM conversations GROUP BY role""")
def audit_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and words by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size(tx.words(F.col("text")))).alias("words"))
