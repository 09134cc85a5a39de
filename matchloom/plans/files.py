"""Queries that write tables with the library's sinks and read them again with its sources, and queries over single expressions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx
from matchloom.functions import numbers
from matchloom.functions import text as tx
from matchloom.operators import evaluation, ranking, retrieval
from matchloom.sources import readers, sinks
from matchloom.streaming import journal

from .common import query_into, sql_words, table

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; of this machine alone only where all runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='files-')).rstrip('/')}/files-{os.urandom(6).hex()}"


_ORDERS = "o_orderkey long, o_orderstatus string, o_totalprice double"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")


_SQL_ORDERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"


@query(_SQL_ORDERS)
def src_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as compressed JSON lines, nulls kept, and read again."""
    at = _folder(spark)
    sinks.write_json_lines(_orders(spark, sf_dir), at, "gzip")
    return readers.json_lines(spark, at, _ORDERS)


@query("SELECT r_regionkey, r_name FROM region")
def src_json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as one JSON document of many lines, compressed, and read again."""
    at = _folder(spark)
    whole = table(spark, sf_dir, "region").agg(F.to_json(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), {"pretty": "true"}).alias("value"))  # five rows
    whole.write.option("compression", "gzip").text(at)
    return readers.json_document(spark, at, "r_regionkey int, r_name string")


@query(f"SELECT * FROM ({_SQL_ORDERS}) WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def src_filtered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of open orders, found by a pattern before they are parsed."""
    at = _folder(spark)
    sinks.write_json_lines(_orders(spark, sf_dir), at)
    return readers.filtered_lines(spark, at, '"o_orderstatus":"P"', _ORDERS, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000))


@query("SELECT DISTINCT o_orderpriority AS found FROM orders")
def src_found_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities picked from raw lines, nothing parsed."""
    at = _folder(spark)
    sinks.write_json_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), at, "gzip")
    return readers.found_in_lines(spark, at, '"o_orderpriority":"([^"]*)"', 1)


@query("SELECT 'c' || c_custkey AS query_id, 'img/' || c_custkey || '.jpg' AS image_path FROM customer")
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of customers, written by tabs and read with its checks."""
    at, key = _folder(spark), F.col("c_custkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("query_id"), F.concat(F.lit("img/"), key, F.lit(".jpg")).alias("image_path"))
    rows.write.csv(at, sep="\t", header=True)
    return readers.manifest(spark, at)


@query("SELECT count(*) + 2 AS n, count(*) AS n_ok, 2::BIGINT AS n_bad FROM region")
def src_verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by their digests against pins: all regions' files, one pin of another digest and one without a file."""
    at = _folder(spark)
    table(spark, sf_dir, "region").repartition("r_regionkey").write.partitionBy("r_regionkey").json(at)
    found = readers.files(spark, at, "*.json").select("path", "length", "sha256", F.regexp_extract("path", "(r_regionkey=[0-9]+)", 1).alias("name"))
    pins = found.select("name", "sha256").union(spark.createDataFrame([("gone", "0")], "name string, sha256 string"))
    wrong = found.where("name = 'r_regionkey=0'").select("name", F.lit("0").alias("sha256"))
    checked = readers.verified(found, pins.union(wrong))
    return checked.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"))


@query("SELECT k AS p_partkey, p_name, p_partkey IS NOT NULL AS known FROM (SELECT DISTINCT l_partkey + 3 AS k FROM lineitem) LEFT JOIN part ON k = p_partkey AND p_size > 10")
def src_card_or_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of keys; keys without one stay, and are marked."""
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 3).alias("p_partkey")).distinct()
    return readers.card_or_bare(keys, table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 >= 0.4")
def src_checked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a score of at least .4; a score outside 0..1 would raise."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"))
    return readers.checked_scores(rows, "score", 0.4)


@query("SELECT 'written' AS first, 'same' AS second, true AS refused, count(*) AS n FROM orders")
def sink_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written once, found the same, and other rows refused."""
    at, rows = _folder(spark), _orders(spark, sf_dir)
    said = [sinks.write_once(rows, at), sinks.write_once(rows, at)]
    try:
        sinks.write_once(rows.where("o_orderkey % 2 = 0"), at)
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(at).agg(F.lit(said[0]).alias("first"), F.lit(said[1]).alias("second"), F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS batch FROM orders")
def sink_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all orders in a ledger, then all: known keys keep their first row, and a third run adds none."""
    at, rows = _folder(spark), table(spark, sf_dir, "orders").select("o_orderkey")
    for n, batch in ((1, rows.where("o_orderkey % 3 = 0")), (2, rows), (3, rows)):
        sinks.append_missing(batch.withColumn("batch", F.lit(n)), at, "o_orderkey")
    return spark.read.parquet(at).select("o_orderkey", "batch")


@query("""WITH r AS (SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name), h AS (SELECT ('0x' || substr(sha256(concat_ws(chr(31), p_name, p_partkey::VARCHAR)), 1, 15))::BIGINT AS h FROM r)
SELECT 'p_name' AS key, count(*) AS n, count(DISTINCT h) AS n_distinct, sum(h::HUGEINT)::VARCHAR AS digest FROM h""")
def sink_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part a name in a bundle with its manifest, which is what comes back."""
    at = _folder(spark)
    sinks.write_bundle(table(spark, sf_dir, "part").select("p_partkey", "p_name"), at, "p_name")
    return spark.read.schema("key string, n long, n_distinct long, digest string").json(f"{at}/manifest")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def sink_broken_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed orders of which every fifth was changed after: those are found."""
    sealed = sinks.sealed(_orders(spark, sf_dir))
    return sinks.broken_seals(sealed.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))).select("o_orderkey")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, as a stream that is read to its end gives them."""
    at = _folder(spark)
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
    counts = journal.windowed_counts(stream, "ts", "event_type", "1 hour", "30 days")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("SELECT event_id, event_type FROM events WHERE event_id IS NOT NULL")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a journal that was fed twice: every key once."""
    at = _folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.write.parquet(f"{at}/in")
    for run in ("first", "again"):
        journal.journal(spark.readStream.schema(events.schema).parquet(f"{at}/in"), f"{at}/ledger", "event_id", f"{at}/{run}").awaitTermination()
    return spark.read.parquet(f"{at}/ledger").select("event_id", "event_type")


@query(f"""WITH w AS (SELECT p_partkey, array_to_string({sql_words("p_name || ' ' || p_type")}, ' ') AS t, {sql_words("p_name")} AS w, lower(p_type) AS p FROM part)
SELECT p_partkey, w[1] = w[2] OR (least(CASE WHEN length(w[1]) < 5 THEN 0 WHEN length(w[1]) < 9 THEN 1 ELSE 2 END, CASE WHEN length(w[2]) < 5 THEN 0 WHEN length(w[2]) < 9 THEN 1 ELSE 2 END) > 0
  AND levenshtein(w[1], w[2]) <= least(CASE WHEN length(w[1]) < 5 THEN 0 WHEN length(w[1]) < 9 THEN 1 ELSE 2 END, CASE WHEN length(w[2]) < 5 THEN 0 WHEN length(w[2]) < 9 THEN 1 ELSE 2 END)) AS fuzzy,
contains(' ' || t || ' ', ' ' || w[2] || ' ' || p || ' ') AS phrase, regexp_replace(w[1] || 'iya', 'iya\\b', 'ia', 'g') AS spelt, CASE WHEN p_retailprice / 1000 >= 0.9 THEN 1.0 WHEN p_retailprice / 1000 >= 0.7 THEN 0.5 ELSE 0.3 END::DOUBLE AS band,
round(1 / (1 + exp(-greatest(-40, least(40, (p_size - 25) * 3)))), 9) AS gate, round(ln(1 + p_size) / ln(129), 9) AS size, least(p_size / 25, 2) / 2 AS capped FROM w JOIN part USING (p_partkey)""")
def num_text_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single expressions over parts: fuzzy equality of the words of a name, a phrase in it, a spelling, a band, a clipped sigmoid, a size and a capped value."""
    w = tx.words(F.col("p_name"))
    a, b = w[0], w[1]
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.fuzzy_equal(a, b).alias("fuzzy"), tx.contains_phrase(tx.norm(F.concat_ws(" ", "p_name", "p_type")), F.concat_ws(" ", b, F.lower("p_type"))).alias("phrase"),
        tx.spelling(F.concat(a, F.lit("iya"))).alias("spelt"), tx.ordinal_band(F.col("p_retailprice") / 1000).alias("band"), F.round(numbers.sigmoid((F.col("p_size") - 25) * 3), 9).alias("gate"),
        F.round(numbers.log_size(F.col("p_size")), 9).alias("size"), numbers.capped(F.col("p_size") / 25).alias("capped"),
    )


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber * 5.0 AS y, unnest([0, 90, 180, 270]) AS turn FROM lineitem) SELECT l_orderkey, l_linenumber, turn, x, y::DOUBLE AS y,
(CASE turn WHEN 0 THEN x WHEN 90 THEN 60 - y WHEN 180 THEN 60 - x ELSE y END)::DOUBLE AS back_x, (CASE turn WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN 50 - y ELSE 50 - x END)::DOUBLE AS back_y FROM p""")
def geo_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of turned frames back in their frame."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 5.0).alias("y"), F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("turn"))
    x, y = bx.rotated_back(F.col("x"), F.col("y"), F.col("turn"), F.lit(60.0), F.lit(50.0))
    return p.select("l_orderkey", "l_linenumber", "turn", "x", "y", x.alias("back_x"), y.alias("back_y"))


@query("""WITH s AS (SELECT l_orderkey AS q, l_returnflag = 'R' AS y, l_quantity * 0.05 - l_discount * 2 AS s FROM lineitem), m AS (SELECT q, ln(sum(exp(s))) - ln(sum(exp(s)) FILTER (y)) AS loss FROM s GROUP BY q HAVING bool_or(y))
SELECT count(*) AS n, round(avg(loss), 9) AS loss FROM m""")
def loss_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listwise loss of a linear score over orders, returned lines being positives."""
    import numpy as np

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_discount")
    loss, _, n = ranking.listwise_loss_gradient(rows, "q", "y", ["l_quantity", "l_discount"], np.array([0.05, -2.0]))
    return spark.createDataFrame([(n, round(loss, 9))], "n long, loss double")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (lower(strip_accents(text)) <> lower(text)) AS had_marks FROM documents WHERE regexp_matches(text, '^[\\x00-\\x{024F}]*$') GROUP BY lang""")
def text_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of Latin letters whose letters have marks, by language."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?s)^[\\x00-\\x{024F}]*$"))
    return retrieval.changed(d, "lang", "text", {"had_marks": tx.unmarked})


@query("""
WITH a AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, 'k' AS path, k AS value FROM a WHERE k IS NOT NULL
UNION ALL SELECT event_id, 'outer.k', k FROM a WHERE k IS NOT NULL AND event_id % 2 = 0
UNION ALL SELECT event_id, 'list[' || i || '].in.k', CASE i WHEN 0 THEN k WHEN 1 THEN '{"k":' || k || '}' END FROM a, range(2) t(i) WHERE k IS NOT NULL AND event_id % 2 = 0
UNION ALL SELECT event_id, 'list[1].in.k.k', k FROM a WHERE k IS NOT NULL AND event_id % 2 = 0""")
def doc_nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value under a name, at any depth of nested properties and lists, with its path."""
    p = F.col("props")
    deep = F.concat(F.lit('{"outer": '), p, F.lit(', "list": [{"in": '), p, F.lit('}, {"in": {"k": '), p, F.lit("}}], "), F.expr("substring(props, 2)"))
    props = F.when(F.col("event_id") % 2 == 0, deep).otherwise(p)
    return evaluation.nested_values(table(spark, sf_dir, "events").select("event_id", props.alias("props")), "event_id", "props", "k")
