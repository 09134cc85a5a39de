"""Searches take a text apart once, and complete a claim's sums where the document's row lies."""

from matchloom.operators import retrieval

from .test_dealt import plans


def test_texts_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "Red ring of the north", "a"), (2, "blue bolt 17", "b"), (3, "RED bolt, north ring", "a"), (4, None, "b")], "doc_id int, body string, source string")
    asked, got = spark.createDataFrame([(7, "red north"), (8, "bolt x")], "query_id int, body string"), {}
    n = {
        "inverted": plans(spark, lambda: got.update(inverted=retrieval.inverted_candidates(asked, docs, "source", 2, text="body").collect())).count("regexp_extract_all(lower(body"),
        "blended": plans(spark, lambda: got.update(blended=retrieval.blended_top(asked, docs, 2, text="body").collect())).count("regexp_extract_all(lower(body"),
    }
    assert [(r.query_id, r.source, r.doc_id, r.coverage) for r in sorted(got["inverted"], key=lambda r: (r.query_id, r.rank))] == [(7, "a", 1, 1.0), (8, "a", 3, 1.0), (8, "b", 2, 1.0)]
    assert [(r.query_id, r.doc_id, r.overlap) for r in sorted(got["blended"], key=lambda r: (r.query_id, r.rank))] == [(7, 1, 1.0), (7, 3, 1.0), (8, 2, 1.0), (8, 3, 1.0)]
    assert n["inverted"] <= 2 and n["blended"] <= 3
