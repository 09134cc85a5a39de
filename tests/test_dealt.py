"""Figures of a pool are made where its rows lie: no side is dealt by line, token or claim."""

import math
import re

from matchloom.operators import features, pool, retrieval


def plans(spark, run):
    """Physical plans of all executions of run, as text."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [e for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())]
    before = {e.executionId() for e in listed()}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return "\n".join(e.physicalPlanDescription() for e in listed() if e.executionId() not in before)


def test_phrases_are_looked_for_inside_a_pool(spark):
    members = spark.createDataFrame([(1, 10, 10), (1, 11, 11), (2, 10, 10)], "pool int, key int, card int")
    phrases = spark.createDataFrame([(10, "name", ["red", "ring"]), (10, "producer", ["acme"]), (11, "name", ["ring", "red"]), (11, "producer", [""])], "card int, role string, claims array<string>")
    producers = spark.createDataFrame([(10, "acme"), (11, "bolt")], "card int, producer string")
    tokens = spark.createDataFrame([(1, 1, False, 0, "red", 0), (1, 1, False, 1, "ring", 0), (1, 2, True, 0, "ring", 0), (1, 2, True, 1, "acme", 0)], "pool int, line int, high boolean, pos int, word string, part int")
    known = spark.createDataFrame([("red", 0, "red", 0), ("ring", 0, "ring", 0), ("acme", 0, "acme", 0)], "word string, part int, claim string, rank int")
    keys = spark.createDataFrame([(10, "x")], "card int, name_key string")
    got = {}
    text = plans(spark, lambda: got.update({(r.pool, r.key): r for r in features.text_features(members, phrases, producers, tokens, known, keys, "pool", "key", "card").collect()}))
    assert "hashpartitioning(line__" not in text and "hashpartitioning(pool#" in text
    a, b, c = got[1, 10], got[1, 11], got[2, 10]
    assert (a.txt_name_full_any, a.txt_name_full_high, a.txt_producer_full_high, a.txt_name_cover_high) == (1.0, 0.0, 1.0, 0.5)
    assert (b.txt_name_full_any, b.txt_name_cover_any, b.txt_producer_cover_any, b.txt_producer_other_read_high) == (0.0, 1.0, 0.0, 1.0)
    assert (c.txt_name_full_any, c.txt_name_cover_any, c.txt_name_distinct_any) == (0.0, 0.0, 0.0)


CLAIMS = [(1, 1, "red"), (1, 1, "ring"), (1, 2, "ring"), (1, 3, "blue"), (2, 1, "red")]


def test_name_tokens_are_not_dealt(spark):
    claims, read = spark.createDataFrame(CLAIMS, "pool int, key int, token string"), spark.createDataFrame([(1, "red"), (1, "ring"), (1, "hot")], "pool int, token string")
    got = {}
    text = plans(spark, lambda: got.update({(r.pool, r.key): r for r in pool.name_features(claims, read, "pool", "key").collect()}))
    assert not re.search(r"hashpartitioning\([^)]*token#", text)
    assert {k: (r.n_tokens, r.n_read, r.n_distinct, r.coverage) for k, r in got.items()} == {(1, 1): (2, 2, 2, 1.0), (1, 2): (1, 1, 1, 1.0), (1, 3): (1, 0, 0, 0.0), (2, 1): (1, 0, 0, 0.0)}
    assert abs(got[1, 1].mass - (math.log(4 / 2) + math.log(4 / 3)) / math.log(4)) < 1e-12 and got[1, 3].mass == 0


def test_pairs_meet_by_pool(spark):
    claims, read = spark.createDataFrame(CLAIMS, "pool int, key int, token string"), spark.createDataFrame([(1, "red"), (1, "ring")], "pool int, token string")
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 2, 3), (1, 9, 1)], "pool int, winner int, agreed int")
    weights, got = spark.createDataFrame([("red", 2.0)], "token string, w double"), {}
    text = plans(spark, lambda: got.update({(r.winner, r.agreed): (r.n_counted, r.weight, r.relation) for r in pool.pairwise(pairs, claims, read, weights, "pool", "key").collect()}))
    assert not re.search(r"hashpartitioning\([^)]*token#", text)
    assert got == {(1, 2): (1, 2.0, "unknown"), (2, 2): (0, 0.0, "same"), (2, 3): (1, 0.0, "different"), (9, 1): (0, 0.0, "unknown")}


def test_texts_are_dealt_before_their_terms(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "ring red"), (3, "blue bolt")], "doc_id int, text string")
    asked, got = spark.createDataFrame([(7, "red"), (8, "bolt"), (9, "none")], "query_id int, text string"), []
    text = plans(spark, lambda: got.extend(retrieval.cosine_top(asked, docs, 1).select("query_id", "doc_id", "rank").collect()))
    assert not re.search(r"hashpartitioning\((doc|query)_id#\d+L?, term#", text)
    assert sorted(map(tuple, got)) == [(7, 1, 1), (8, 3, 1)]
