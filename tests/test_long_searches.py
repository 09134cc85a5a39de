"""A cosine search over long texts moves neither texts nor lists of their terms, and equals the search by classes."""

import random

from matchloom.operators import retrieval

from .test_dealt import plans


def corpus(spark, n):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i % (n - 3), " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 80)) + [f"only{i}"])) for i in range(n)] + [(n, "w1 W2 w1"), (n + 1, "w2 w1 w1"), (n + 2, None), (n + 3, "the of 12")]
    asked = [(q, " ".join(rng.choices(words, k=6))) for q in range(9)] + [(9, "unknown"), (9, "w1 unknown"), (10, None), (11, "w1 w1 w2")]
    return spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(8)


def test_long_search_equals_search_by_classes(spark, monkeypatch):
    asked, docs = corpus(spark, 120)
    rows = lambda f: sorted(map(tuple, f(asked, docs, 4).collect()))
    want = rows(retrieval.cosine_top)
    assert rows(retrieval.cosine_top_long) == want and {r[0] for r in want} == {*range(10), 11}
    # also where most terms are too many to be broadcast
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 5)
    assert rows(retrieval.cosine_top_long) == want


def test_long_search_shuffles_no_lists_of_terms(spark):
    asked, docs = corpus(spark, 400)
    text = plans(spark, lambda: retrieval.cosine_top_long(asked, docs, 4).collect())
    assert "sha2" not in text and "collect_list(struct(term" not in text and "hashpartitioning(doc_id" in text
    # what the registered search runs
    import __spark_entry__

    assert "sha2" not in plans(spark, lambda: __spark_entry__.queries()["text_tfidf_topk"](spark, "/root/testdata/sf0.001").collect())
