"""Scores of vectors beside nulls, other lengths, odd ids and odd entities, against plain sums."""

import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import vector


def plain(queries, gallery):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    best = {}
    for qid, q in queries:
        for rid, channel, entity, v in gallery:
            if ok(q) and ok(v) and len(q) == len(v) and not (qid is not None and qid == rid):
                score = sum(a * b for a, b in zip(q, v, strict=True))
                key = (qid, channel, entity)
                mine = (-score, rid is None, rid if rid is not None else 0)
                best[key] = min(best.get(key, mine), mine, key=lambda m: (m[0], m[1], m[2] if not m[1] else 0))
    return {k: (-m[0], None if m[1] else m[2]) for k, m in best.items()}


GALLERY = [
    ("r1", "a", "x", [0.5, 0.75]), ("r2", "a", "x", None), ("r3", "a", "y", [0.5, None]), ("r4", "b", "y", [float("nan"), 0.0]), ("r5", "b", None, [0.25, 0.25]), ("r6", "b", "None", [0.25, 0.5]), ("r7", None, "x", [1.0, 0.0]),
    ("r8", "a", "z", [0.5, 0.75]), ("r9", "a", "x", [0.5, 0.75]), ("r0", "a", "w", [1.0, 2.0, 3.0]), ("ra", "a", "w", [3.0, 2.0, 1.0, 0.0]), (None, "a", "x", [0.5, 0.75]), ("rb", "a", "v", []), ("rb", "a", "v", [float("inf"), 1.0]), ("r1", "a", "x", [0.5, 0.75]),
]
QUERIES = [("r1", [0.5, 0.75]), ("q2", None), ("q3", [1.0, -1.0]), ("q4", [1.0, 1.0, 1.0]), (None, [0.0, 1.0]), ("q5", [float("nan"), 1.0]), ("q6", [1.0] * 5)]


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("ids", ["string", "long"])
def test_scores_beside_odd_vectors(spark, parts, ids):
    number = (lambda x: x) if ids == "string" else (lambda x: None if x is None else int(x[1:], 36) * (1 if x[0] == "r" else 1000))
    gallery, queries = [(number(r[0]), *r[1:]) for r in GALLERY], [(number(r[0]), *r[1:]) for r in QUERIES]
    g = spark.createDataFrame([(*r, "clash") for r in gallery], f"row_id {ids}, channel string, entity string, vector array<double>, score string").repartition(parts)
    q = spark.createDataFrame(queries, f"query_id {ids}, vector array<double>").repartition(parts)
    got = vector.entity_scores(q, g)
    assert got.columns == ["query_id", "channel", "entity", "score", "row_id"]
    rows = got.collect()
    assert len(rows) == len({(r[0], r[1], r[2]) for r in rows})
    assert {(r[0], r[1], r[2]): (r[3], r[4]) for r in rows} == plain(queries, gallery)


def test_no_rows(spark):
    g = spark.createDataFrame(GALLERY, "row_id string, channel string, entity string, vector array<double>")
    q = spark.createDataFrame(QUERIES, "query_id string, vector array<double>")
    assert vector.entity_scores(q.where("false"), g).count() == 0 == vector.entity_scores(q, g.where("false")).count() == vector.entity_scores(q, g.where(F.col("vector").isNull())).count()
