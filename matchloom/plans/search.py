"""Queries over vectors and texts: nearest entities, fusion, votes, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import readings as rd
from matchloom.functions import text as tx
from matchloom.functions.numbers import RRF_LCM
from matchloom.operators import ranking, retrieval, vector

from .common import SQL_RANKS, gallery, query_into, sql_search_key, sql_tokens, sql_words, table, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir))
    return vector.ranked(scores, ["query_id", "channel"])


@query(f"""WITH {SQL_RANKS},
whole AS (SELECT query_id, entity, max(score) AS score, arg_min(row_id, (-score, row_id)) AS row_id FROM best GROUP BY ALL)
SELECT query_id, row_number() OVER w AS rank, entity, row_id, round(score, 6) AS score, round(score - lead(score) OVER w, 6) AS margin
FROM whole WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, entity) QUALIFY row_number() OVER w <= 5""")
def vec_topk_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest entities of each query over both channels, with the margin to the next."""
    scores = vector.entity_scores(vector_queries(spark, sf_dir), gallery(spark, sf_dir))
    best = scores.groupBy("query_id", "entity").agg(F.max(F.struct("score", (-F.col("row_id")).alias("b"))).alias("m")).select("query_id", "entity", F.col("m.score").alias("score"), (-F.col("m.b")).alias("row_id"))
    return vector.top(best, ["query_id"], 5).select("query_id", "rank", "entity", "row_id", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {SQL_RANKS},
pool AS (SELECT query_id, entity, max(CASE WHEN channel = 0 THEN score END) AS s0, max(CASE WHEN channel = 1 THEN score END) AS s1,
  max(CASE WHEN channel = 0 AND rank = 1 THEN entity END) AS f0, max(CASE WHEN channel = 1 AND rank = 1 THEN entity END) AS f1 FROM ranks WHERE rank <= 5 GROUP BY ALL)
SELECT query_id, entity, round(s0, 6) AS score_0, round(s1, 6) AS score_1, row_number() OVER (PARTITION BY query_id ORDER BY s0 DESC NULLS LAST, entity) AS union_rank,
  max(f0) OVER (PARTITION BY query_id) IS DISTINCT FROM max(f1) OVER (PARTITION BY query_id) AS disagree FROM pool""")
def vec_two_channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the five best entities of each channel, and whether the channels disagree on the first."""
    out = vector.union_ranking(_ranks(spark, sf_dir), (0, 1), 5)
    return out.withColumns({"score_0": F.round("score_0", 6), "score_1": F.round("score_1", 6)})


@query(f"""WITH {SQL_RANKS},
excluded AS (SELECT vec_id FROM embeddings WHERE list_inner_product(embedding::DOUBLE[], list_resize([1.0::DOUBLE], len(embedding), 0.0)) > 0.2),
cut AS (SELECT query_id, entity, max(s) AS score FROM pairs WHERE row_id NOT IN (SELECT vec_id FROM excluded) GROUP BY ALL)
SELECT query_id, entity, round(score, 6) AS score FROM cut QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) = 1""")
def vec_excluded_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest entity once references in conflict (here: first component above .2) are taken out of the gallery."""
    g = gallery(spark, sf_dir)
    conflict = g.where(F.element_at("vector", 1) > 0.2).select("row_id")
    scores = vector.entity_scores(vector_queries(spark, sf_dir), vector.unmatched(g, conflict, "row_id"))
    best = scores.groupBy("query_id", "entity").agg(F.max("score").alias("score"))
    return vector.top(best, ["query_id"], 1).select("query_id", "entity", F.round("score", 6).alias("score"))


@query("""SELECT count(*) AS n, count(*) FILTER (embedding IS NULL OR abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-4) AS n_bad,
min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim FROM embeddings""")
def vec_unit_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors are not finite or not of length 1."""
    return vector.norm_report(table(spark, sf_dir, "embeddings"), "embedding")


@query(f"""WITH {SQL_RANKS}
SELECT c.channel, count(*) AS n, count(*) FILTER (rank <= 1) AS hits_1, count(*) FILTER (rank <= 5) AS hits_5, count(*) FILTER (rank <= 20) AS hits_20, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM q CROSS JOIN (SELECT unnest([0, 1])::INT AS channel) c LEFT JOIN ranks r ON r.query_id = q.query_id AND r.entity = q.truth AND r.channel = c.channel GROUP BY c.channel""")
def vec_hits_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at 1, 5 and 20 and the mean reciprocal rank of the true entity, by channel."""
    truth = vector_queries(spark, sf_dir).select("query_id", "truth", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    ranks = _ranks(spark, sf_dir)
    own = truth.join(ranks.withColumnRenamed("entity", "truth"), ["query_id", "truth", "channel"], "left")
    return own.groupBy("channel").agg(F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in (1, 5, 20)), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""WITH {SQL_RANKS} SELECT q.query_id, r.channel, r.rank, round(r.score, 6) AS score, round(r.gap, 6) AS gap FROM q JOIN ranks r ON r.query_id = q.query_id AND r.entity = q.truth""")
def vec_truth_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, score and gap to the first of the true entity inside each full channel."""
    truth = vector_queries(spark, sf_dir).select("query_id", F.col("truth").alias("entity"))
    return truth.join(_ranks(spark, sf_dir), ["query_id", "entity"]).select("query_id", "channel", "rank", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {SQL_RANKS},
a AS (SELECT query_id, entity, rank FROM ranks WHERE channel = 0), b AS (SELECT query_id, entity, rank FROM ranks WHERE channel = 1),
f AS (SELECT query_id, entity, a.rank AS rank_first, b.rank AS rank_second,
  coalesce({RRF_LCM}::HUGEINT // (60 + a.rank), 0) + coalesce({RRF_LCM}::HUGEINT // (60 + b.rank), 0) AS units FROM a FULL JOIN b USING (query_id, entity)),
r AS (SELECT *, entity % 3 AS family, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, entity) AS rank FROM f)
SELECT query_id, entity, family::INT AS family, rank_first, rank_second, units::VARCHAR AS rrf_units, rank FROM r
WHERE rank <= 4 OR EXISTS (SELECT 1 FROM r k WHERE k.query_id = r.query_id AND k.family = r.family AND k.rank <= 4)""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the two channels with exact ties; the first four, and all of their families."""
    ranks = _ranks(spark, sf_dir)
    families = gallery(spark, sf_dir).select("entity").distinct().withColumn("family", (F.col("entity") % 3).cast("int"))
    out = retrieval.fuse(ranks.where("channel = 0"), ranks.where("channel = 1"), "query_id", "entity", families, 4)
    return out.select("query_id", "entity", "family", "rank_first", "rank_second", F.col("rrf_units").cast("string").alias("rrf_units"), "rank")


@query(f"""WITH {SQL_RANKS},
p AS (SELECT query_id, channel, entity // 2 AS product, min(rank) AS first FROM ranks GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY first, product) AS r FROM p),
v AS (SELECT query_id, product, sum({RRF_LCM}::HUGEINT // (60 + r))::VARCHAR AS units, sum({RRF_LCM}::HUGEINT // (60 + r)) AS u, count(*) AS support FROM d GROUP BY ALL)
SELECT query_id, product::INT AS product, split_part(units, '.', 1) AS units, support, row_number() OVER (PARTITION BY query_id ORDER BY u DESC, product) AS rank FROM v""")
def product_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the exact sum of reciprocal ranks over channels, each channel counting a product once."""
    ranks = _ranks(spark, sf_dir).withColumn("product", F.floor(F.col("entity") / 2).cast("int"))
    return retrieval.vote(ranks, "query_id", "product", 2).withColumn("units", F.col("units").cast("string"))


@query(f"""WITH {SQL_RANKS}
SELECT query_id, min(entity) AS entity FROM ranks WHERE rank = 1 GROUP BY query_id HAVING count(DISTINCT entity) = 1 AND count(DISTINCT channel) >= 2""")
def vec_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose channels agree on the first entity."""
    return ranking.agreed(_ranks(spark, sf_dir), "query_id", "channel", "entity")


_INDEX = f"""ix AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
qx AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({sql_tokens("text")}) AS term FROM benchmark) GROUP BY ALL)"""


@query(f"WITH ix AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM ix GROUP BY term")
def text_tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its document and total frequency."""
    index = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"""WITH ix AS (SELECT DISTINCT source, unnest({sql_tokens('text')}) AS term FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM ix)
SELECT term, count(DISTINCT source) AS owners, round(greatest(0, least(1, ln(n / count(DISTINCT source)) / ln(n))), 6) AS specificity FROM ix, n GROUP BY term, n""")
def text_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How specific a token is to few sources."""
    pairs = table(spark, sf_dir, "documents").select("source", F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return retrieval.specificity(pairs, "term", "source").withColumn("specificity", F.round("specificity", 6))


@query(f"""WITH {_INDEX},
dw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM ix JOIN df USING (term), n),
dl AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM dw GROUP BY doc_id),
qw AS (SELECT item_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM qx JOIN df USING (term), n),
ql AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY item_id),
s AS (SELECT q.item_id, d.doc_id, round(sum(q.w / ql.l * d.w / dl.l), 9) AS score FROM qw q JOIN ql USING (item_id) JOIN dw d USING (term) JOIN dl ON dl.doc_id = d.doc_id GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5""")
def text_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the five documents of largest TF-IDF cosine."""
    out = retrieval.cosine_top_long(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, "item_id")
    return out.withColumn("score", F.round("score", 6))


_GRAMS = "list_distinct(list_transform(range(1, len(z) - 1), lambda i: z[i] || z[i + 1] || z[i + 2]))"
_LETTERS = f"string_split(array_to_string({sql_tokens('text')}, ' '), '')"


@query(f"""WITH {_INDEX},
own AS (SELECT item_id, term, CASE WHEN df IS NULL THEN 1.0 ELSE ln(1 + n / (1 + df)) END AS idf FROM (SELECT DISTINCT item_id, term FROM qx) LEFT JOIN df USING (term), n),
mass AS (SELECT item_id, sum(idf) AS mass FROM own GROUP BY item_id),
o AS (SELECT item_id, doc_id, sum(idf) AS hit FROM own JOIN ix USING (term) GROUP BY ALL),
qg AS (SELECT item_id, unnest(gs) AS g, len(gs) AS nq FROM (SELECT item_id, {_GRAMS} AS gs FROM (SELECT item_id, {_LETTERS} AS z FROM benchmark))),
dg AS (SELECT doc_id, unnest(gs) AS g, len(gs) AS nd FROM (SELECT doc_id, {_GRAMS} AS gs FROM (SELECT doc_id, {_LETTERS} AS z FROM documents))),
sh AS (SELECT item_id, doc_id, count(*) AS both_, any_value(nq) AS nq, any_value(nd) AS nd FROM qg JOIN dg USING (g) GROUP BY ALL),
p AS (SELECT item_id, doc_id, coalesce(hit / greatest(mass, 1e-8), 0) AS overlap, coalesce(both_ / (nq + nd - both_), 0) AS jaccard FROM sh FULL JOIN o USING (item_id, doc_id) JOIN mass USING (item_id)),
s AS (SELECT item_id, doc_id, round(overlap, 9) AS overlap, round(jaccard, 9) AS jaccard, round(0.75 * overlap + 0.25 * jaccard, 9) AS score FROM p)
SELECT item_id, doc_id, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s
WHERE overlap > 0 OR jaccard >= 0.12 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5""")
def text_blended_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the five documents of largest blended token and trigram score."""
    out = retrieval.blended_top(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, "item_id")
    return out.withColumns({c: F.round(c, 6) for c in ("overlap", "jaccard", "score")})


@query(f"""WITH {_INDEX},
own AS (SELECT item_id, term, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM qx LEFT JOIN df USING (term), n),
mass AS (SELECT item_id, sum(idf) AS mass FROM own GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(idf) / any_value(mass), 9) AS coverage FROM own JOIN ix USING (term) JOIN mass USING (item_id) GROUP BY item_id, doc_id),
b AS (SELECT item_id, source, doc_id, coverage FROM s JOIN documents USING (doc_id) WHERE coverage >= 0.2 QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY coverage DESC, doc_id) = 1)
SELECT item_id, source, doc_id, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, source) AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY coverage DESC, source) <= 5""")
def text_inverted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the five sources whose best document covers most of its IDF mass, from an inverted index."""
    out = retrieval.inverted_candidates(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "source", 5, 0.2, "item_id")
    return out.withColumn("coverage", F.round("coverage", 6))


_FUZZY = f"""WITH w AS (SELECT DISTINCT unnest({sql_words("text")}) AS w FROM benchmark),
k AS (SELECT w, length(w) AS n, CASE WHEN length(w) < 5 THEN 0 WHEN length(w) < 9 THEN 1 ELSE 2 END AS e FROM w WHERE regexp_matches(w, '^[a-z]+$'))
SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INT AS distance FROM k a JOIN k b ON a.w < b.w WHERE least(a.e, b.e) > 0 AND levenshtein(a.w, b.w) <= least(a.e, b.e)"""


@query(f"SELECT * FROM ({_FUZZY}) WHERE a[1] = b[1] OR a[-1] = b[-1]")
def text_fuzzy_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different unmarked words of the benchmark within the edit limit, by blocks of first or last letter and length; pairs that differ at both ends are lost."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word"))
    return retrieval.fuzzy_pairs(words.where(F.col("word").rlike("^[a-z]+$")))


@query(_FUZZY)
def text_fuzzy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different unmarked words of the benchmark within the edit limit, by what is left of them without one or two letters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word"))
    return retrieval.fuzzy_pairs(words.where(F.col("word").rlike("^[a-z]+$")), unblocked=True)


@query(f"""WITH p AS (SELECT item_id, i AS k, list_slice(w, i, i + 2) AS words FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT item_id, {sql_words("text")} AS w FROM benchmark))),
d AS (SELECT doc_id, list_slice(w, i, i + 2) AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {sql_words("text")} AS w FROM documents)))
SELECT item_id, doc_id, count(DISTINCT k) AS phrases, count(*) AS places FROM p JOIN d USING (words) GROUP BY ALL""")
def text_phrase_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold three-word phrases of a benchmark item as runs: how many phrases, and in how many places."""
    w = table(spark, sf_dir, "benchmark").select("item_id", tx.words(F.col("text")).alias("w")).where("size(w) >= 3")
    phrases = w.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("k", "words")).select(F.struct("item_id", "k").alias("p"), "words")
    hits = retrieval.phrase_hits(phrases, table(spark, sf_dir, "documents"), "p", "doc_id")
    return hits.groupBy(F.col("p.item_id").alias("item_id"), "doc_id").agg(F.countDistinct("p.k").alias("phrases"), F.count("*").alias("places"))


@query("""SELECT lang, CASE WHEN lat AND cyr THEN 'MIXED' WHEN cyr THEN 'CYR' WHEN lat THEN 'LAT' WHEN regexp_matches(text, '\\p{L}') THEN 'OTHER' ELSE 'NONE' END AS script, count(*) AS n
FROM (SELECT *, regexp_matches(text, '[A-Za-zÀ-ɏ]') AS lat, regexp_matches(text, '[Ѐ-ӿ]') AS cyr FROM documents) GROUP BY ALL""")
def text_script_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and script."""
    return table(spark, sf_dir, "documents").groupBy("lang", tx.script_class(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority || ' ordered ' || strftime(o_orderdate, '%d %m %Y') AS t FROM orders), y AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '\\b((?:18|19|20)[0-9]{2})\\b', 1)) AS year FROM d)
SELECT year, count(*) AS n, count(DISTINCT o_orderkey) AS orders, CASE WHEN year >= '2000' THEN 'recent' ELSE 'old' END AS role FROM y GROUP BY year""")
def text_year_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone years in a line of text about every order, with a role by their century."""
    line = F.concat_ws(" ordered ", "o_orderpriority", F.date_format("o_orderdate", "dd MM yyyy"))
    y = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(tx.years(line)).alias("year"))
    return y.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.first(F.when(F.col("year") >= "2000", "recent").otherwise("old")).alias("role"))


#: Phrases of part names and types with their keys; longer ones take their words first.
PART_ALIASES = [("small ring", "ring:small"), ("ring", "ring"), ("red widget", "widget:red"), ("widget", "widget"), ("hot gear", "gear:hot"), ("gear", "gear"), ("bolt", "bolt"), ("economy", "type:economy"), ("small", "size:small"), ("red", "colour:red"), ("blue", "colour:blue")]


def _typed_sql() -> str:
    t, found = "' ' || replace(array_to_string(" + sql_words("p_name || ' ' || p_type") + ", ' '), ' ', '  ') || ' '", []
    for p, k in sorted(PART_ALIASES, key=lambda a: (-len(a[0]), a[0])):
        needle = "' " + p.replace(" ", "  ") + " '"
        found.append(f"CASE WHEN contains({t}, {needle}) THEN '{k}' END")
        t = f"replace({t}, {needle}, ' | ')"
    return f"SELECT p_partkey, concat_ws(',', {', '.join(found)}) AS found FROM part"


@query(_typed_sql())
def text_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed keys of every part from its name and type, longest phrase first, each taking its words."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.consumed_values(F.concat_ws(" ", "p_name", "p_type"), PART_ALIASES), ",").alias("found"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({sql_words("text")}) AS word FROM benchmark) SELECT {sql_search_key("replace(strip_accents(word), 'ß', 'ss')")} AS skeleton, count(*) AS n, min(word) AS least, max(word) AS most FROM w GROUP BY 1 HAVING count(*) > 1""")
def text_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the text search shared by two or more different benchmark words."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return w.withColumn("folded", rd.decomposed("word")["folded"]).groupBy(rd.search_key(F.col("folded")).alias("skeleton")).agg(F.count("*").alias("n"), F.min("word").alias("least"), F.max("word").alias("most")).where("n > 1")


@query()
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each Unicode form changes (no DuckDB form)."""
    return retrieval.changed(table(spark, sf_dir, "documents"), "lang", "text", {"folded_apart": tx.nfkc_casefold, "had_marks": tx.unmarked})




_CHARS = (
    "list_concat(" + ", ".join(f"list_filter(list_transform(range(1, len(p) - {n - 2}), lambda i: substring(p, i, {n})), lambda g: len(p) >= {n})" for n in (3, 4, 5)) + ")"
)


def _sql_char_index(name: str, source: str, key: str, text: str) -> str:
    """Counts of the 3-, 4- and 5-grams of tokens of three letters or more, between spaces."""
    return f"""{name}w AS (SELECT {key}, ' ' || w || ' ' AS p FROM (SELECT {key}, unnest({sql_words(text)}) AS w FROM {source}) WHERE length(w) >= 3),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_CHARS}) AS term FROM {name}w) GROUP BY ALL)"""


@query(f"""WITH {_sql_char_index("ix", "part", "p_partkey", "p_name || ' ' || p_type")}, {_sql_char_index("qx", "customer", "c_custkey", "c_name || ' ' || c_mktsegment")},
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term), n AS (SELECT count(*) AS n FROM part),
dw AS (SELECT p_partkey, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM ix JOIN df USING (term), n),
dl AS (SELECT p_partkey, sqrt(sum(w * w)) AS l FROM dw GROUP BY ALL),
qw AS (SELECT c_custkey, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM qx JOIN df USING (term), n),
ql AS (SELECT c_custkey, sqrt(sum(w * w)) AS l FROM qw GROUP BY ALL),
s AS (SELECT q.c_custkey, d.p_partkey, round(sum(q.w / ql.l * d.w / dl.l), 9) AS score FROM qw q JOIN ql USING (c_custkey) JOIN dw d USING (term) JOIN dl ON dl.p_partkey = d.p_partkey GROUP BY ALL)
SELECT c_custkey, p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, p_partkey) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, p_partkey) <= 20""")
def text_char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer's name and segment the twenty parts of largest cosine of character 3- to 5-grams."""
    grams = lambda t: F.flatten(F.transform(F.filter(tx.words(t), lambda w: F.length(w) >= 3), lambda w: tx.char_grams(w)))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return retrieval.cosine_top(names, parts, 20, "c_custkey", "p_partkey", terms=grams).withColumn("score", F.round("score", 6))
