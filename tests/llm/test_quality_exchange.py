"""All unlabelled documents take part in the exchange of the quality classifier, and rare kinds reach the fit."""

import pytest

pytest.importorskip("xxhash")

from pyspark.sql import functions as F  # noqa: E402

from matchloom.llm import quality  # noqa: E402


def test_every_unlabelled_document_is_scored(spark, monkeypatch):
    seen = []
    sure = quality._sure
    monkeypatch.setattr(quality, "_sure", lambda rest, model: seen.append(rest.count()) or sure(rest, model))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("a plain sentence of words "), "id")).otherwise(F.concat(F.lit("$$ 11 ## "), "id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(20).alias("n_chars"))
    docs = docs.union(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    labels = docs.where("doc_id < 400").select("doc_id", (1 - F.col("doc_id") % 2).alias("quality"))
    assert quality.fit(docs, labels) is not None
    assert seen == [20_005 - 400] * quality.ROUNDS


def test_rare_sources_are_given_and_weights_stand_for_all(spark):
    scores = spark.range(200_000).select(F.col("id").alias("key"), F.when(F.col("id") < 3, 7).otherwise(1).cast("int").alias("stratum"), F.when(F.col("id") % 2 == 0, 1200).otherwise(-1200).cast("int").alias("step0"), F.lit(0).alias("step1"))
    got = quality.exchange(scores, 0.5, 1, 4_000).collect()
    assert {r["taught"] for r in got} == {1} and 3_000 < len(got) < 5_000
    assert {0, 1, 2} <= {r["key"] for r in got}
    assert abs(sum(r["weight"] for r in got) - 200_000) < 20_000


def test_thresholds_hold_the_surest():
    counts = {1000: 5, 900: 5, 400: 5, 200: 50, 0: 9, -200: 50, -500: 3}
    assert quality.thresholds(counts, 6, 2) == (900, -500)
    assert quality.thresholds(counts, 100, 100) == (400, -500)
    assert quality.thresholds({0: 9}, 5, 5) == (1600, -1600)


def test_scores_against_plain_co_training(spark):
    """Co-training in one process, over all documents at once: as few documents as here are given whole, with weights of 1."""
    import numpy as np

    from matchloom.llm import words

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.select("doc_id", *quality._INPUT, F.xxhash64("doc_id", F.lit(5)).alias("known_key"), F.xxhash64("doc_id", *quality._INPUT, F.lit(5)).alias("key")).toArrow().to_pandas()
    known = {r["doc_id"]: int(r["quality"]) for r in labels.where("quality is not null").collect()}
    label = np.array([known.get(i, -1) for i in rows["doc_id"]])
    import pyarrow as pa

    (_, _, t), = words.slices(pa.array(rows["text"]), words.SPACE, False, 1 << 40)
    views = quality.content(t), quality.metadata(t, list(rows["lang"]), list(rows["source"]), np.maximum(rows["n_chars"].fillna(0).to_numpy(np.float64), 0))
    mine = np.flatnonzero(label >= 0)
    mine = mine[np.lexsort(([v.tobytes() for v in views[0][mine].astype(np.float32)], rows["known_key"].to_numpy()[mine]))]
    rest = np.flatnonzero(label < 0)
    own, y, held = tuple(v[mine] for v in views), label[mine], rows["known_key"].to_numpy()[mine] % 4 == 0
    given = (None, None)
    for k in range(quality.ROUNDS + 1):
        model = quality.trained(own, y, held, given, k == quality.ROUNDS)
        if k < quality.ROUNDS:
            steps = [np.trunc(quality._logit(model, v, views[v][rest]) * quality.STEPS).astype(int) for v in (0, 1)]
            share, positive, new = quality.SHARE * (k + 1) * len(rest), float(model["positive"]), []
            for taught in (0, 1):
                s = steps[1 - taught]
                up, down = quality.thresholds({int(a): int(n) for a, n in zip(*np.unique(s, return_counts=True), strict=True)}, max(1, int(share * positive)), max(1, int(share * (1 - positive))))
                sure = np.flatnonzero((s >= up) | (s <= down))
                sure = sure[np.argsort(rows["key"].to_numpy()[rest[sure]])]
                new.append((views[taught][rest[sure]], (s[sure] >= up).astype(int), np.ones(len(sure))))
            given = tuple(new)
    assert all(len(g[1]) > 10 for g in given)
    want = dict(zip(rows["doc_id"], quality._score(model, *views)[0], strict=True))
    got = {r["doc_id"]: r["quality_score"] for r in quality.report(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 0.02 and np.mean([abs(got[i] - want[i]) < 1e-3 for i in got]) > 0.95
