"""Text retrieval over inverted indexes: every search is an equi-join on terms, never a comparison of all pairs.

The side of the queries comes first: documents are scanned for the terms of the queries alone, which are broadcast if they are few. Searches with a
floor join the rarest terms of a query first, one of which every document above the floor must hold, and complete the sums of those documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions.numbers import rrf_sum

from .graph import MOST_BROADCAST, checkpointed, sided, spread


def postings(docs: DataFrame, key: str, text: str, terms=tx.tokens) -> DataFrame:
    """(key, term, tf) of every text."""
    return docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame, key: str) -> DataFrame:
    """(term, df) of postings, which are distinct by key and term."""
    return index.groupBy("term").agg(F.count(key).alias("df"))


def specificity(pairs: DataFrame, term: str, owner: str) -> DataFrame:
    """(term, owners, specificity): ln(n / owners) / ln(n) within 0..1, n being the number of owners; 0 where there is only one."""
    n = pairs.agg(F.countDistinct(owner).alias("n"))
    per = pairs.groupBy(term).agg(F.countDistinct(owner).alias("owners"))
    value = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(F.col("n") / F.col("owners")) / F.log(F.col("n").cast("double"))))).otherwise(0.0)
    return per.join(F.broadcast(n)).select(term, "owners", value.alias("specificity"))  # n is one row


def changed(docs: DataFrame, by: str, text: str, forms: dict) -> DataFrame:
    """(by, n, a count for each form): texts, and those whose form is not their lower case. forms: name and function of a column, of which passages can be taken one by one.

    Texts go to Python by passages, so that a batch of rows is small however long texts are; passages of ASCII alone, whose forms are the lower case, do not go there.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row__"), by, F.filter(tx.passages(F.col(text)), lambda p: p.rlike(r"[^\x00-\x7F]")).alias("passages__"))
    apart = rows.select("row__", by, F.explode_outer("passages__").alias("passage__")).select("row__", by, *((form("passage__") != F.lower("passage__")).alias(name) for name, form in forms.items()))
    whole = apart.groupBy("row__", by).agg(*(F.bool_or(name).alias(name) for name in forms))
    return whole.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(name).alias(name) for name in forms))


def sets(docs: DataFrame, key: str, text: str, terms=tx.tokens) -> DataFrame:
    """(key, term), distinct within each row: no shuffle, as ids are those of one row each."""
    return docs.select(F.col(key), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def weights(tf: str = "tf", df: str = "df", n: str = "n_docs") -> Column:
    """(1 + ln tf) * (ln((N + 1) / (df + 1)) + 1)"""
    return (1 + F.log(tf)) * (F.log((F.col(n) + 1) / (F.col(df) + 1)) + 1)


def profiles(index: DataFrame, key: str) -> DataFrame:
    """(key, class__, terms) of postings, written: texts of equal terms and frequencies are of one class, whatever their order."""
    own = index.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    spelt = F.array_join(F.transform("terms", lambda x: F.concat(x["term"], F.lit("\x1e"), x["tf"].cast("string"))), "\x1f")
    return checkpointed(own.withColumn("class__", F.sha2(spelt, 256)))


def _classes(own: DataFrame, df: DataFrame, n_docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(class__, term, w): weights of length 1 by class, of the wanted terms alone if given; terms that are not in df count for nothing."""
    each = own.groupBy("class__").agg(F.first("terms").alias("terms")).select("class__", F.explode("terms").alias("t")).select("class__", "t.term", "t.tf")
    raw = each.join(sided(df), "term").join(F.broadcast(n_docs)).select("class__", "term", weights().alias("w"))
    lengths = raw.groupBy("class__").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    held = raw if wanted is None else raw.join(sided(wanted), "term", "left_semi")
    return held.join(lengths, "class__").select("class__", "term", (F.col("w") / F.col("len")).alias("w"))


def cosine_top(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", text: str = "text", terms=tx.tokens) -> DataFrame:
    """(query, doc, score, rank): the k documents of largest TF-IDF cosine; terms unknown to the documents count for nothing.

    terms: what a text is made of, words or character n-grams. Scores are compared at nine digits, so that equal texts tie and the smaller id comes first. Texts of equal terms are compared
    once, on both sides: pairs are of classes of texts, and only the k best classes of a query's class, of each of which the k smallest ids can count, are taken apart into documents.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts are dealt by key before they are taken apart: a small file is not one task, and their terms are counted and gathered where they lie
    docs, queries = docs.select(doc_key, text).repartition(parts, doc_key), queries.select(query_key, text).repartition(parts, query_key)
    held = profiles(postings(docs, doc_key, text, terms), doc_key)
    df = checkpointed(held.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n = docs.agg(F.countDistinct(doc_key).alias("n_docs"))
    # what is known of a query makes its class
    asked = profiles(postings(queries, query_key, text, terms).join(sided(df.select("term")), "term", "left_semi"), query_key)
    q = checkpointed(_classes(asked, df, n)).select(F.col("class__").alias("asked__"), "term", F.col("w").alias("wq"))
    d = _classes(held, df, n, q.select("term").distinct())
    scored = sided(q).join(d, "term").groupBy("asked__", "class__").agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score"))
    members = held.withColumn("r__", F.row_number().over(Window.partitionBy("class__").orderBy(doc_key))).where(F.col("r__") <= k).select("class__", doc_key)
    least = members.groupBy("class__").agg(F.min(doc_key).alias("least__"))
    first = Window.partitionBy("asked__").orderBy(F.desc("score"), "least__")
    best = scored.join(least, "class__").withColumn("r__", F.row_number().over(first)).where(F.col("r__") <= k).select("asked__", "class__", "score")
    w = Window.partitionBy("asked__").orderBy(F.desc("score"), doc_key)
    found = best.join(members, "class__").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("asked__", doc_key, "score", "rank")
    return asked.select(query_key, F.col("class__").alias("asked__")).join(found, "asked__").select(query_key, doc_key, "score", "rank")


def counted_terms(docs: DataFrame, key: str, text: str, terms=tx.tokens) -> DataFrame:
    """(key, term, tf) of every text, made in its own row from its sorted terms, so that nothing is shuffled. Keys are those of one row each."""
    rows = docs.select(key, F.sort_array(terms(F.col(text))).alias("s__"))
    starts = F.filter(F.sequence(F.lit(0), F.size("s__") - 1), lambda i: (i == 0) | (F.get("s__", i) != F.get("s__", i - 1)))
    rows = rows.withColumn("at__", F.when(F.size("s__") > 0, starts))
    runs = F.transform("at__", lambda i, j: F.struct(F.get("s__", i).alias("term"), (F.coalesce(F.get("at__", j + 1), F.size("s__")) - i).alias("tf")))
    # explode would infer a filter by which texts are taken apart again
    return rows.select(key, F.explode_outer(runs).alias("r__")).select(key, "r__.term", "r__.tf").where("term is not null")


def one_a_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): texts of one key are one, a space apart. Only keys are shuffled, and texts of those that repeat."""
    docs = docs.select(key, text)
    again = checkpointed(docs.groupBy(F.col(key).alias("k__")).agg(F.count("*").alias("n")).where("n > 1").select("k__"))
    if again.isEmpty():
        return docs
    own = docs.withColumn("r__", F.lit(1))
    same = own[key].eqNullSafe(again["k__"])
    merged = own.join(sided(again), same, "left_semi").groupBy(key).agg(F.array_join(F.collect_list(text), " ").alias(text))
    return own.join(sided(again), same, "left_anti").select(key, text).unionByName(merged)


def cosine_top_long(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", text: str = "text", terms=tx.tokens) -> DataFrame:
    """The same as cosine_top, for long texts and queries whose terms are few against theirs: no text and no list of its terms is shuffled or written, but texts are taken apart three times.

    Frequencies of the commonest terms, MOST_BROADCAST at most, and of those of the queries are broadcast, and a document sums its weights where its text lies; other terms, which few documents hold, are counted where they meet.
    From then on a document is the sum of its squares and its weights of the queries' terms. Documents of few partitions are dealt first. Null keys have no results, but count as one document of their terms.
    """
    if docs.rdd.getNumPartitions() * 2 < docs.sparkSession.sparkContext.defaultParallelism:
        docs = docs.select(doc_key, text).repartition(docs.sparkSession.sparkContext.defaultParallelism * 2, doc_key)
    whole, size = one_a_key(docs, doc_key, text), docs.count()
    # words that are no tokens go after texts are taken apart, which costs less
    pieces, valid = (tx.words, tx.is_token(F.col("term"))) if terms is tx.tokens else (terms, F.lit(True))
    n = F.lit(docs.agg(F.countDistinct(doc_key).alias("n_docs")).first()["n_docs"]).alias("n_docs")
    weigh = lambda rows: rows.withColumn("n_docs", n).withColumn("w", weights()).drop("n_docs")
    own = checkpointed(counted_terms(one_a_key(queries, query_key, text), query_key, text, terms).where(F.col(query_key).isNotNull()))
    wanted = checkpointed(own.select("term").distinct().withColumn("asked__", F.monotonically_increasing_id()))
    df = whole.select(F.explode_outer(F.array_distinct(pieces(F.col(text)))).alias("term")).where(F.col("term").isNotNull() & valid).groupBy("term").agg(F.count("*").alias("df"))
    kept = checkpointed(df.join(sided(wanted), "term", "left").where("df > 1 or asked__ is not null"))
    least, held = 1000, 0
    for r in sorted(kept.groupBy(F.least("df", F.lit(1000)).alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["d"]):
        held += r["n"]
        if held > MOST_BROADCAST:
            break
        least = r["d"]
    common = sided(kept.where((F.col("df") >= least) | F.col("asked__").isNotNull()), 2 * MOST_BROADCAST)
    raw = weigh(own.join(sided(kept.where("asked__ is not null")), "term"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(query_key).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    q = sided(checkpointed(raw.select(query_key, "asked__", (F.col("w") / length).alias("wq"))))
    each = counted_terms(whole.where(F.col(doc_key).isNotNull()), doc_key, text, pieces)
    # a row of a document carries the sum of its squares, or how often it has a term of the queries: small numbers, as rows are dealt twice
    alone = F.col("asked__").isNull()
    told = weigh(each.join(common, "term")).groupBy(doc_key, "asked__").agg(F.sum(F.when(alone, F.col("w") * F.col("w")).otherwise(F.col("tf").cast("double"))).alias("v"))
    # a null key is a document to the others
    rare = counted_terms(whole, doc_key, text, pieces).where(valid).join(common.select("term"), "term", "left_anti").withColumn("df", F.count("*").over(Window.partitionBy("term"))).where(F.col(doc_key).isNotNull())
    rest = weigh(rare).groupBy(doc_key).agg(F.sum(F.col("w") * F.col("w")).alias("v")).select(doc_key, F.lit(None).cast("long").alias("asked__"), "v")
    dealt = spread(told.unionByName(rest), doc_key, rows=16 * size).withColumnRenamed("v", "tf")
    dealt = weigh(dealt.join(sided(kept.where("asked__ is not null").select("asked__", "df")), "asked__", "left"))
    every = Window.partitionBy(doc_key).orderBy("asked__").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = dealt.withColumn("w", F.col("w") / F.sqrt(F.sum(F.when(alone, F.col("tf")).otherwise(F.col("w") * F.col("w"))).over(every))).where("asked__ is not null")
    scored = dealt.select(doc_key, "asked__", "w").join(q, "asked__").groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("w") * F.col("wq")), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select(query_key, doc_key, "score", "rank")


def held_terms(docs: DataFrame, key: str, text: str, wanted: DataFrame, terms=tx.words) -> DataFrame:
    """(key, terms), written: the terms of a text that are wanted, as structs of a term, for texts that have any. Texts are taken apart once.

    terms: may give more than the wanted terms are made by, such as words for tokens, which costs less.
    """
    each = sets(docs, key, text, terms).join(sided(wanted), "term", "left_semi")
    return checkpointed(each.groupBy(key).agg(F.collect_list(F.struct("term")).alias("terms")))


def query_terms(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str, idf: Column, terms=tx.tokens) -> tuple[DataFrame, DataFrame]:
    """(query, term, df, n_docs, idf) of the distinct terms of queries; document frequencies are counted for these terms alone. idf: of columns df and n_docs. And held_terms of the documents."""
    own = checkpointed(sets(queries, query_key, text, terms))
    n = docs.agg(F.countDistinct(doc_key).alias("n_docs"))
    held = held_terms(docs, doc_key, text, own.select("term").distinct(), tx.words if terms is tx.tokens else terms)
    return checkpointed(weighed(own, held.select(F.explode("terms.term").alias("term")), n, idf)), held


def weighed(own: DataFrame, held: DataFrame, n: DataFrame, idf: Column) -> DataFrame:
    """own (query, term) with df, n_docs and idf. held: (term), a row for each document that has it; n: (n_docs), one row."""
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    return own.join(df, "term", "left").join(F.broadcast(n)).withColumn("df", F.coalesce("df", F.lit(0))).withColumn("idf", idf)


def covering(claims: DataFrame, read: DataFrame, claim: str, packet: str, weight: str, floor: float, grade: Column | None = None) -> DataFrame:
    """(claim, packet, hit, mass, n_read) of packets that read at least `floor` of a claim's mass.

    claims: claim, term, weight (not below 0); read: packet, term, distinct, or packet, terms (as of held_terms); grade: of columns of read, in 0..1, 1 by default. Prefix filter: the terms of a claim in order
    of falling weight, as long as what is left, this term included, reaches the floor. A packet that reads none of them cannot reach it. Those that do are completed from the other terms, where the packet's row lies.
    """
    grade = F.lit(1.0) if grade is None else grade
    parts = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(claim).orderBy(F.desc(weight), "term")
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ordered = claims.select(claim, "term", F.col(weight).alias("w__"), F.sum(weight).over(Window.partitionBy(claim)).alias("mass"), before.alias("before")).where("mass > 0")
    ordered = checkpointed(ordered.withColumn("head", F.col("mass") - F.col("before") >= (floor - 1e-8) * F.col("mass")))
    if "terms" not in read.columns:
        read = checkpointed(read.groupBy(packet).agg(F.collect_list(F.struct(*(c for c in read.columns if c != packet))).alias("terms")))
    # packets are dealt once; sums are made where their rows lie
    dealt = read.select(packet, "terms").where(F.col(packet).isNotNull()).repartition(parts, packet)
    graded = lambda rows, *also: rows.select(packet, *also, F.explode("terms").alias("t__")).select(packet, *also, "t__.*").select(packet, *also, "term", grade.alias("grade"))
    heads = sided(ordered.where("head").select(claim, "term", "w__", "mass"))
    rest_mass = ordered.where("not head").groupBy(claim).agg(F.sum("w__").alias("rest"))
    begun = heads.join(graded(dealt), "term").groupBy(claim, packet).agg(F.sum(F.col("w__") * F.col("grade")).alias("hit"), F.count("*").alias("n"), F.first("mass").alias("mass"))
    may = begun.join(sided(checkpointed(rest_mass)), claim, "left").where(F.col("hit") + F.coalesce("rest", F.lit(0.0)) >= (floor - 1e-8) * F.col("mass"))
    may = checkpointed(may.select(claim, packet, "hit", "n", "mass"))
    tails = sided(ordered.where("not head").select(claim, "term", "w__"))
    asked = may.repartition(parts, packet).groupBy(packet).agg(F.collect_set(claim).alias("claims__"))
    more = graded(dealt.join(asked, packet), "claims__").join(tails, "term").where(F.array_contains("claims__", F.col(claim)))
    more = more.groupBy(claim, packet).agg(F.sum(F.col("w__") * F.col("grade")).alias("more"), F.count("*").alias("m"))
    full = may.join(more, [claim, packet], "left").select(claim, packet, (F.col("hit") + F.coalesce("more", F.lit(0.0))).alias("hit"), "mass", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n_read"))
    return full.where(F.round(F.col("hit") / F.col("mass"), 9) >= floor)


def blended_top(queries: DataFrame, docs: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", text: str = "text", floor: float = 0.12) -> DataFrame:
    """(query, doc, overlap, jaccard, score, rank): .75 of the IDF share of the query's tokens that a document has, and .25 of trigram Jaccard.

    IDF is ln(1 + N / (1 + df)), 1 for a token that no document has; trigrams are of the tokens, one space apart. Kept where a token is shared or the Jaccard similarity is at
    least `floor`; a query without tokens has no results. A document that cannot reach the k-th best share of its query, even if its trigrams were as alike as
    the numbers of trigrams allow, is not compared; documents without a shared token are found by the rarest trigrams of a query, as many as the similarity needed leaves.
    """
    idf = F.when(F.col("df") > 0, F.log(1 + F.col("n_docs") / (1 + F.col("df")))).otherwise(1.0)
    own = checkpointed(sets(queries, query_key, text))
    grams = lambda t: tx.trigrams_of(F.array_join(t, " "))
    # texts are taken apart once
    spelt = docs.select(doc_key, tx.tokens(F.col(text)).alias("ts__"))
    forms = checkpointed(spelt.select(doc_key, F.array_distinct("ts__").alias("terms"), grams(F.col("ts__")).alias("dg")).withColumn("nd", F.size("dg")))
    known = forms.select(F.explode("terms").alias("term")).join(sided(own.select("term").distinct()), "term", "left_semi")
    own = checkpointed(weighed(own, known, docs.agg(F.countDistinct(doc_key).alias("n_docs")), idf))
    mass = own.groupBy(query_key).agg(F.sum("idf").alias("mass"))
    asked = checkpointed(checkpointed(queries.select(query_key, grams(tx.tokens(F.col(text))).alias("qg"))).join(mass, query_key).withColumn("nq", F.size("qg")))
    held = forms.select(doc_key, "nd", F.explode("terms").alias("term"))
    hits = held.join(sided(own.where("df > 0").select(query_key, "term", "idf")), "term").groupBy(query_key, doc_key).agg(F.sum("idf").alias("hit"), F.first("nd").alias("nd"))
    shares = checkpointed(hits.join(sided(asked.select(query_key, "mass", "nq")), query_key).select(query_key, doc_key, "nq", "nd", (F.col("hit") / F.greatest("mass", F.lit(1e-8))).alias("overlap")))
    place = Window.partitionBy(query_key).orderBy(F.desc("overlap"), doc_key)
    kth = shares.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select(query_key, F.col("overlap").alias("kth"))
    reach = F.least("nq", "nd") / F.greatest("nq", "nd", F.lit(1))
    near = shares.join(sided(checkpointed(kth)), query_key, "left").where(0.75 * F.col("overlap") + 0.25 * reach >= 0.75 * F.coalesce("kth", F.lit(0.0)) - 1e-9)
    # without a shared token a document needs this similarity to be kept, and to come before the k-th
    needed = asked.join(kth, query_key, "left").withColumn("least", F.greatest(F.lit(floor), 3 * F.coalesce("kth", F.lit(0.0)) - 1e-8)).where("least <= 1 and nq > 0")
    strangers = checkpointed(needed.select(query_key, "nq", "least", F.explode("qg").alias("g")))
    pairs = near.select(query_key, doc_key, "overlap")
    if not strangers.isEmpty():
        wanted = sided(strangers.select("g").distinct())
        index = forms.select(doc_key, "nd", F.explode("dg").alias("g")).join(wanted, "g", "left_semi")
        df = index.groupBy("g").agg(F.count("*").alias("df"))
        rarest = Window.partitionBy(query_key).orderBy(F.coalesce("df", F.lit(0)), "g")
        prefix = strangers.join(df, "g", "left").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= F.col("nq") - F.ceil(F.col("least") * F.col("nq")) + 1)
        found = index.join(sided(checkpointed(prefix.select(query_key, "g", "nq", "least"))), "g").where(F.least("nq", "nd") >= F.col("least") * F.greatest("nq", "nd") - 1e-9)
        alone = found.select(query_key, doc_key).distinct().join(shares.select(query_key, doc_key), [query_key, doc_key], "left_anti")
        pairs = pairs.unionByName(alone.withColumn("overlap", F.lit(0.0)))
    pairs = checkpointed(pairs.join(sided(asked.select(query_key, "qg", "nq")), query_key).join(forms.select(doc_key, "dg", "nd"), doc_key).withColumn("shared", F.size(F.array_intersect("qg", "dg"))).drop("qg", "dg"))
    jaccard = F.col("shared") / F.greatest(F.col("nq") + F.col("nd") - F.col("shared"), F.lit(1))
    scored = pairs.select(query_key, doc_key, F.round("overlap", 9).alias("overlap"), F.round(jaccard, 9).alias("jaccard"), F.round(0.75 * F.col("overlap") + 0.25 * jaccard, 9).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scored.where((F.col("overlap") > 0) | (F.col("jaccard") >= floor)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def inverted_candidates(queries: DataFrame, docs: DataFrame, owner: str, k: int, cover: float = 0.5, query_key: str = "query_id", doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, owner, doc, coverage, rank): for each query the k owners whose best document covers at least `cover` of its IDF mass."""
    own, held = query_terms(queries, docs, query_key, doc_key, text, F.log((F.col("n_docs") + 1) / (F.col("df") + 1)))
    got = covering(own, held, query_key, doc_key, "idf", cover)
    seeds = got.select(query_key, doc_key, F.round(F.col("hit") / F.col("mass"), 9).alias("coverage")).join(docs.select(doc_key, owner), doc_key)
    best = seeds.withColumn("r", F.row_number().over(Window.partitionBy(query_key, owner).orderBy(F.desc("coverage"), doc_key))).where("r = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("coverage"), owner))).where(F.col("rank") <= k).select(query_key, owner, doc_key, "coverage", "rank")


def left_out(words: Column, most: Column) -> Column:
    """A word and what is left of it without up to `most` (0 to 2) of its characters, distinct."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.when(most >= 1, one(words)).otherwise(F.array().cast("array<string>"))
    twice = F.when(most >= 2, F.flatten(F.transform(once, one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(words), once, twice))


def fuzzy_pairs(words: DataFrame, word: str = "word", unblocked: bool = False) -> DataFrame:
    """(a, b, distance) of distinct words a < b within the edit limit of the shorter one.

    Blocked: only words of equal first or equal last character and of lengths at most two apart are compared. Pairs that differ at both ends are lost, whatever
    their distance; unblocked=True compares by all ways of leaving out up to two characters instead, which loses none.
    """
    distinct = words.select(F.col(word).alias("w")).where("w != ''").distinct()
    a, b = F.col("a"), F.col("b")
    limit = F.least(tx.edit_limit(F.length(a)), tx.edit_limit(F.length(b)))
    if unblocked:
        plain = distinct.where(~F.col("w").rlike("[0-9]") & (F.length("w") >= 5))
        rests = plain.select("w", F.explode(left_out(F.col("w"), tx.edit_limit(F.length("w")))).alias("rest"))
        pairs = rests.withColumnRenamed("w", "a").join(rests.withColumnRenamed("w", "b"), "rest").where(a < b).select("a", "b").distinct()
        return pairs.select("a", "b", F.levenshtein(a, b).alias("distance"), limit.alias("most")).where("distance <= most").select("a", "b", "distance")
    keyed = distinct.select("w", F.explode(F.array(F.concat(F.lit("^"), F.substring("w", 1, 1)), F.concat(F.lit("$"), F.substring(F.col("w"), F.length("w"), F.lit(1))))).alias("end"), F.length("w").alias("n"))
    left = keyed.select(F.col("w").alias("a"), F.col("end"), F.explode(F.array(*[F.col("n") + d for d in range(-2, 3)])).alias("n"))
    right = keyed.select(F.col("w").alias("b"), "end", "n")
    pairs = left.join(right, ["end", "n"]).where((a < b) & ~a.rlike("[0-9]") & ~b.rlike("[0-9]") & (limit > 0))
    return pairs.select("a", "b", F.levenshtein(a, b).alias("distance"), limit.alias("most")).where("distance <= most").select("a", "b", "distance").distinct()


def phrase_hits(phrases: DataFrame, docs: DataFrame, phrase_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """(phrase_key, doc_key, start): places where all words of a phrase stand in a row. phrases: phrase_key and words (an array).

    Runs are joined by a hash of all their words, for each length that phrases have, and compared word by word; runs that no phrase has do not leave their task.
    """
    p = checkpointed(phrases.select(phrase_key, "words", F.size("words").alias("n"), F.xxhash64("words").alias("h")).where("n > 0"))
    found = None
    for n in sorted(r["n"] for r in p.select("n").distinct().collect()):
        own = sided(p.where(F.col("n") == n).select(phrase_key, "h", F.col("words").alias("phrase")))
        run = lambda i, n=n: F.slice("w", i, n)
        long = docs.select(doc_key, tx.words(F.col(text)).alias("w")).where(F.size("w") >= n)
        at = long.select(doc_key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(i.alias("i"), run(i).alias("run")))).alias("r"))
        hit = at.select(doc_key, (F.col("r.i") - 1).alias("start"), F.col("r.run").alias("run"), F.xxhash64("r.run").alias("h")).join(own, "h").where("run = phrase").select(phrase_key, doc_key, "start")
        found = hit if found is None else found.union(hit)
    return found if found is not None else p.join(docs.select(doc_key), F.lit(False)).select(phrase_key, doc_key, F.lit(0).alias("start"))


def fuse(first: DataFrame, second: DataFrame, by: str, key: str, families: DataFrame | None = None, limit: int = 40) -> DataFrame:
    """(by, key, rank_first, rank_second, rrf_units, rank): reciprocal-rank fusion of two lists (by, key, rank), exact in ties at every rank.

    families: (key, family); the kept list is the first `limit`, and every further member of a family that is kept: rows of the lists, and members
    that are in neither list, which have no ranks and 0 units and come last.
    """
    a, b = first.select(by, key, F.col("rank").alias("rank_first")), second.select(by, key, F.col("rank").alias("rank_second"))
    summed = a.join(b, [by, key], "full").withColumn("rrf__", rrf_sum(F.array("rank_first", "rank_second"), 2))
    both = summed.select(by, key, "rank_first", "rank_second", F.col("rrf__.units").cast("decimal(38,0)").alias("rrf_units"), F.col("rrf__.exact").alias("exact__"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("exact__"), key))
    out = both.withColumn("rank", place)
    if families is None:
        return out.where(F.col("rank") <= limit).drop("exact__")
    out = out.join(families, key, "left")
    kept = out.where(F.col("rank") <= limit).select(by, "family").where("family is not null").distinct().withColumn("kept", F.lit(True))
    missing = kept.join(families, "family").select(by, key, "family").distinct().join(both.select(by, key), [by, key], "left_anti")
    added = missing.withColumns({"rrf_units": F.lit(0).cast("decimal(38,0)"), "exact__": F.lit("")})
    found = out.join(kept, [by, "family"], "left").where((F.col("rank") <= limit) | F.coalesce("kept", F.lit(False))).drop("kept")
    # members outside the lists come after all that the lists hold
    size = out.groupBy(by).agg(F.max("rank").alias("size__"))
    last = added.join(size, by).withColumn("rank", (F.col("size__") + F.row_number().over(Window.partitionBy(by).orderBy(key))).cast("int")).drop("size__")
    return found.unionByName(last, allowMissingColumns=True).drop("exact__")


def vote(ranks: DataFrame, by: str, product: str, channels: int | None = None) -> DataFrame:
    """(by, product, units, support, rank): products by the exact sum of 1 / (60 + rank) over channels, from card ranks (by, channel, product, rank).

    A channel counts a product once, at the dense rank of its best card among products. channels: the most channels there are, if known (see rrf_sum).
    """
    best = ranks.groupBy(by, "channel", product).agg(F.min("rank").alias("first"))
    dense = best.withColumn("r", F.row_number().over(Window.partitionBy(by, "channel").orderBy("first", product)))
    votes = dense.groupBy(by, product).agg(F.collect_list("r").alias("rs"), F.countDistinct("channel").alias("support")).withColumn("rrf__", rrf_sum(F.col("rs"), channels))
    placed = votes.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rrf__.exact"), product)))
    return placed.select(by, product, F.col("rrf__.units").cast("decimal(38,0)").alias("units"), "support", "rank")
