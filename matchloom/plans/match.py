"""Queries over graded matches of tokens, phrases, years and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import match
from matchloom.functions import readings as rd
from matchloom.functions import text as tx
from matchloom.operators import matching

from .common import query_into, sql_key, sql_lookalikes, sql_norms, sql_words, table

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


#: Words as print may garble them, by their length: some Cyrillic letters, other ones, or a 0 for an o.
_GARBLED = """CASE length(word) % 4 WHEN 1 THEN translate(word, 'aeopcxy', 'аеорсху') WHEN 2 THEN replace(word, 'o', '0')
  WHEN 3 THEN translate(word, 'aeo', 'аео') ELSE word END"""


def _sql_grades(words: str) -> str:
    """m: (word, part, claim, rank) of the words of a table w (word) and the claims of a table k (claim)."""
    return f"""{words},
p AS (SELECT word, strip_accents(word) AS plain, {sql_norms("word")} AS norms FROM w),
d AS (SELECT word, part, CASE WHEN len(norms) = 1 THEN [norms[part]] || {sql_lookalikes("plain", "norms[1]")} ELSE [norms[part]] END AS forms
  FROM (SELECT word, plain, norms, unnest(range(1, len(norms) + 1)) AS part FROM p)),
f AS (SELECT word, part, forms[i] AS form, i, {sql_key("forms[i]")} AS a FROM (SELECT word, part, forms, unnest(range(1, len(forms) + 1)) AS i FROM d)),
kk AS (SELECT claim, {sql_key("claim")} AS b FROM k),
ka AS (SELECT DISTINCT a FROM f WHERE length(a) >= 5 AND NOT regexp_matches(a, '[0-9]')), kb AS (SELECT DISTINCT b FROM kk WHERE length(b) >= 5 AND NOT regexp_matches(b, '[0-9]')),
near AS (SELECT a, b FROM ka JOIN kb ON a[1] = b[1] AND levenshtein(a, b) <= CASE WHEN length(a) >= 9 AND length(b) >= 9 THEN 2 ELSE 1 END),
g AS (SELECT word, part, claim, CASE WHEN i = 1 THEN 0 ELSE 1 END AS rank FROM f JOIN k ON claim = form
  UNION ALL SELECT word, part, claim, 2 FROM f JOIN kk ON a = b WHERE length(b) >= 3
  UNION ALL SELECT word, part, claim, 3 FROM f JOIN near USING (a) JOIN kk USING (b)),
m AS (SELECT word, part - 1 AS part, claim, min(rank) AS rank FROM g GROUP BY ALL)"""


@query(f"""
WITH {_sql_grades(f"""o AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark), w AS (SELECT DISTINCT {_GARBLED} AS word FROM o),
k AS (SELECT DISTINCT claim FROM (SELECT unnest({sql_norms("word")}) AS claim FROM o) WHERE length(claim) % 2 = 0)""")}
SELECT word, part, claim, rank, ['exact', 'homoglyph', 'translit', 'fuzzy'][rank + 1] AS kind FROM m""")
def match_token_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark, many of them garbled by letters of another script or digits, against all normal forms of even length: the form itself, a look-alike, an equal or a near phonetic key."""
    o = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
    claims = matching.dictionary(o, "word").select(F.col("forms")[0].alias("claim")).where("length(claim) % 2 = 0")
    got = matching.token_matches(matching.dictionary(o.select(F.expr(_GARBLED).alias("word")), "word"), claims)
    return got.withColumn("kind", match.kind(F.col("rank")))


_PIECES = r"regexp_extract_all(text, '\p{L}+|[0-9]+')"


@query(f"""
WITH {_sql_grades(f"""w AS (SELECT DISTINCT unnest({_PIECES}) AS word FROM benchmark), k AS (SELECT DISTINCT unnest({sql_norms("word")}) AS claim FROM w)""")},
y AS (SELECT word, part - 1 AS part, forms[1] AS norm FROM d WHERE NOT regexp_matches(forms[1], '^(18|19|20)[0-9][0-9]$')),
li AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i, part) - 1 AS pos, word, part, norm
  FROM (SELECT item_id, i, ws[i] AS word FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, {_PIECES} AS ws FROM benchmark))) JOIN y USING (word)),
ph AS (SELECT a.item_id AS phrase, a.norm AS p1, b.norm AS p2 FROM li a JOIN li b ON a.item_id = b.item_id AND a.pos = 1 AND b.pos = 2),
r1 AS (SELECT item_id, phrase, pos, rank FROM ph JOIN m ON claim = p1 JOIN li USING (word, part)), r2 AS (SELECT item_id, phrase, pos, rank FROM ph JOIN m ON claim = p2 JOIN li USING (word, part)),
z AS (SELECT r1.item_id, r1.phrase, greatest(r1.rank, r2.rank) AS weakest, r1.rank + r2.rank AS total, r1.pos AS start
  FROM r1 JOIN r2 ON r1.item_id = r2.item_id AND r1.phrase = r2.phrase AND r2.pos = r1.pos + 1)
SELECT item_id, phrase, weakest, total::BIGINT AS total, start FROM z QUALIFY row_number() OVER (PARTITION BY item_id, phrase ORDER BY weakest, total, start) = 1""")
def match_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the second and third token of a benchmark item stand in a row in another, each matched in some kind; the best place of each."""
    b = table(spark, sf_dir, "benchmark")
    words = matching.dictionary(b.select(F.explode(rd.pieces(F.col("text"))).alias("word")), "word")
    tokens = matching.line_tokens(b, "item_id", "text", words)
    norms = words.select("word", "part", F.col("forms")[0].alias("norm"))
    second = tokens.where("pos in (1, 2)").join(norms, ["word", "part"]).groupBy(F.col("item_id").alias("phrase"))
    phrases = second.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]).alias("claims")).where(F.size("claims") == 2)
    return matching.phrase_matches(tokens, phrases, matching.token_matches(words, norms.select(F.col("norm").alias("claim"))), "item_id", "phrase")


@query(f"""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS text FROM part), w AS (SELECT p_partkey, unnest(string_split(text, ' ')) AS word FROM p),
t AS (SELECT p_partkey, {_GARBLED} AS span, word, row_number() OVER () AS i FROM w),
s AS (SELECT DISTINCT p_partkey, span, word FROM t)
SELECT p_partkey, span FROM s WHERE span <> word AND NOT regexp_matches(span, '[0-9]')""")
def text_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part garbled by letters of another script, and which of them its own name and type still hold: all but those with a digit."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    w = p.select("p_partkey", F.explode(F.split("text", " ")).alias("word")).withColumn("span", F.expr(_GARBLED)).where("span != word")
    got = matching.recovered(w, p.withColumn("field", F.lit("name")), "p_partkey", "span", "field", "text")
    return got.select("p_partkey", "span")


@query(r"""
WITH p AS (SELECT p_partkey, p_brand || '-' || p_type || p_size || ' ' || replace(p_name, 'o', '0') || (p_size % 10) || ' x' || p_size || 'y' AS text FROM part),
w AS (SELECT p_partkey, j, unnest(regexp_extract_all(ws[j], '\d+|\D+')) AS run, generate_subscripts(regexp_extract_all(ws[j], '\d+|\D+'), 1) AS i
  FROM (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS j FROM (SELECT p_partkey, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM p))),
g AS (SELECT *, regexp_matches(run, '^[0346]$') AS glue FROM w),
n AS (SELECT *, CASE WHEN i = 1 OR NOT (glue OR lag(glue) OVER (PARTITION BY p_partkey, j ORDER BY i)) THEN 1 ELSE 0 END AS new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY p_partkey, j ORDER BY i) AS piece FROM n),
s AS (SELECT p_partkey, j, piece, string_agg(run, '' ORDER BY i) AS piece_text FROM c GROUP BY ALL)
SELECT p_partkey, string_agg(piece_text, ' ' ORDER BY j, piece) AS pieces FROM s GROUP BY p_partkey""")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of parts cut where digits begin or end, but for single digits that may be letters."""
    code = F.expr("concat(p_brand, '-', p_type, p_size, ' ', replace(p_name, 'o', '0'), p_size % 10, ' x', p_size, 'y')")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rd.pieces(code), " ").alias("pieces"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END AS observed FROM orders), r AS (SELECT l_orderkey AS o_orderkey, max(year(l_shipdate)) AS reference, bool_and(l_linestatus = 'F') AS verified FROM lineitem GROUP BY ALL)
SELECT o_orderkey, observed::INT AS observed, reference::INT AS reference, CASE WHEN observed IS NULL OR reference IS NULL OR NOT verified THEN 'unknown' WHEN observed = reference THEN 'same_as_reference' ELSE 'different_from_reference' END AS relation FROM o LEFT JOIN r USING (o_orderkey)""")
def text_year_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of an order against that of its last shipment: known as the same or another only where both are known and the shipment is final."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("observed"))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.year("l_shipdate")).alias("reference"), F.min(F.col("l_linestatus") == "F").alias("verified"))
    known = F.col("observed").isNotNull() & F.col("reference").isNotNull() & F.col("verified")
    relation = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.col("observed") == F.col("reference"), "same_as_reference").otherwise("different_from_reference")
    return o.join(r, "o_orderkey", "left").select("o_orderkey", "observed", "reference", relation.alias("relation"))


_CARDS = "lower(p_name) || ' ' || lower(p_type)"


@query(f"""WITH l AS (SELECT DISTINCT p_partkey AS key, {sql_words(_CARDS + " || ' ' || p_size")} AS w FROM part), g AS (SELECT DISTINCT key, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT key, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT key, w, unnest([2, 3, 4]) AS n FROM l) WHERE len(w) >= n)),
b AS (SELECT p_partkey AS key, array_to_string({sql_words(_CARDS)}, ' ') AS f FROM part), a AS (SELECT p_partkey AS key, array_to_string({sql_words("p_name || ' ' || p_brand")}, ' ') AS f FROM part)
SELECT key, phrase FROM g JOIN b USING (key) WHERE contains(' ' || b.f || ' ', ' ' || phrase || ' ') EXCEPT SELECT key, phrase FROM g JOIN a USING (key) WHERE contains(' ' || a.f || ' ', ' ' || phrase || ' ')""")
def text_lost_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of a part's line that its old card, name and type, holds and its new one, name and brand, does not."""
    p = table(spark, sf_dir, "part")
    lines = p.select(F.col("p_partkey").alias("key"), tx.words(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))).alias("words"))
    card = lambda *c: p.select(F.col("p_partkey").alias("key"), tx.norm(F.concat_ws(" ", *c)).alias("f"))
    return matching.lost_phrases(lines, card("p_name", "p_type"), card("p_name", "p_brand"), "key", "words", "f")


@query("""WITH o AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_returnflag || l_partkey AS text FROM lineitem), n AS (SELECT key, count(*) AS n FROM o GROUP BY key),
s AS (SELECT key, CASE WHEN pos >= n - 1 THEN 2 ELSE 1 END AS block, CASE WHEN pos >= n - 1 THEN 0 ELSE pos - (n - 3) END AS pos, CASE WHEN key % 3 = 0 AND pos = n - 3 THEN 'x' ELSE text END AS text FROM o JOIN n USING (key) WHERE pos >= n - 3),
z AS (SELECT key, block, count(*) AS m FROM s GROUP BY ALL), t AS (SELECT z.key, z.block, n - sum(m) OVER (PARTITION BY z.key ORDER BY block DESC) AS first FROM z JOIN n USING (key)),
ok AS (SELECT t.key, t.block, t.first, bool_and(o.text IS NOT DISTINCT FROM s.text) AS own FROM t JOIN s ON s.key = t.key AND s.block = t.block LEFT JOIN o ON o.key = t.key AND o.pos = t.first + s.pos GROUP BY ALL),
w AS (SELECT *, bool_and(own) OVER (PARTITION BY key ORDER BY block DESC) AS matched FROM ok) SELECT key, block, CASE WHEN matched THEN first END::BIGINT AS first, matched FROM w""")
def text_traced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of an order and the two before it as supplement blocks, found again from the end; in every third order the first of them was changed."""
    li = table(spark, sf_dir, "lineitem")
    from matchloom.operators import ranking

    o = ranking.placed(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "r").select(F.col("l_orderkey").alias("key"), (F.col("r") - 1).alias("pos"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    s = o.join(o.groupBy("key").agg(F.count("*").cast("int").alias("n")), "key").where("pos >= n - 3")
    last = F.col("pos") >= F.col("n") - 1
    text = F.when((F.col("key") % 3 == 0) & (F.col("pos") == F.col("n") - 3), "x").otherwise(F.col("text"))
    blocks = s.select("key", F.when(last, 2).otherwise(1).alias("block"), F.when(last, 0).otherwise(F.col("pos") - (F.col("n") - 3)).alias("pos"), text.alias("text"))
    # an order of two lines has a first block that begins at its first line
    return matching.traced(o, blocks, "key", "block")
