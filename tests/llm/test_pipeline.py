"""The pipeline's stages against plain versions, and what must be caught or kept."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from matchloom.llm import decontam, packing, quality, substring  # noqa: E402

SF = "/root/testdata/sf0.001"


def kept_by_all_pairs(rows):
    """(unknown id, id) of the texts that stay, by the Jaccard similarity of all pairs of sets of five-word shingles."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    return sorted(min(g) for g in groups.values())


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs, at = [], spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(k)))
        out.append((docs, spark.read.parquet(str(at / str(k)))))
        docs = out[-1][1]
    return out


def test_columns(staged):
    for _, after in staged[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS


def test_quality_keeps_the_good(spark, staged):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = staged[0]
    good = labels.where("quality = 1").join(before, "doc_id", "left_semi").count()
    assert labels.where("quality = 1").join(after, "doc_id", "left_semi").count() >= 0.97 * good


def test_one_document_of_each_group_stays(staged):
    before, after = staged[1]
    kept = kept_by_all_pairs([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == [i for _, i in kept]


def test_repeats_go(staged):
    before, after = staged[2]
    want = {i: hashlib.sha256(k).hexdigest() for i, _, g, k in substring.brute_force([(r["doc_id"], r["text"]) for r in before.collect()]) if g}
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        if r["doc_id"] in want:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == old[r["doc_id"]]
    assert after.count() == before.count()


def test_leaks_go(spark, staged):
    before, after = staged[3]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hits = decontam.brute_force({r["doc_id"]: r["text"] for r in before.collect()}, items)
    assert {r["doc_id"] for r in after.collect()} == {d for d, (_, n, _) in hits.items() if n == 0}


def test_every_document_is_packed(staged):
    before, after = staged[4]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.select("doc_id").distinct().collect()}
    assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run(spark, staged):
    assert corpus_pipeline.run(spark, SF).count() == staged[4][1].count()


ODD = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, " \n\t ", None, "s"), (None, "one", "en", "s"), (None, None, None, None),
    (5, "x" * 5000, "de", "t"), (6, " ".join(f"w{i % 977} x{i % 13}" for i in range(20_000)), "en", "s"), (7, " ".join(f"p{i}" for i in range(60)), "en", "s"), (7, " ".join(f"p{i}" for i in range(60)), "en", "s"), (8, " ".join(f"p{i}" for i in range(59)), "fr", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, a, b, None if t is None else len(t), "clash", 1, "clash", 2.0) for i, t, a, b in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, block_id string, score double").repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_none(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, odd, SF).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    if name == "quality_classifier":
        docs, labels = odd.select(corpus_pipeline.COLUMNS), spark.read.parquet(f"{SF}/labels.parquet")
        model = quality.fit(docs, labels)
        assert len(got) == quality.scored(docs, model, ["doc_id"]).where("quality_score >= 0.5").count()
    elif name == "simhash_near_dedup":
        assert ids == kept_by_all_pairs([(i, t) for i, t, *_ in ODD])
    elif name == "substring_dedup":
        want = {(i, k) if g else (i, t) for (i, _, g, k), (_, t, *_) in zip(substring.brute_force([(i, t) for i, t, *_ in ODD]), ODD, strict=True)}
        assert {(r["doc_id"], r["text"].encode() if (r["doc_id"], r["text"]) not in want and r["text"] is not None else r["text"]) for r in got} == want and len(got) == len(ODD)
    elif name == "benchmark_decontamination":
        items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        hits = decontam.brute_force({k: t for k, (_, t, *_) in enumerate(ODD)}, items)
        assert len(got) == sum(n == 0 for _, n, _ in hits.values())
    else:
        assert sum(r["length"] for r in got) == sum(t["doc_tokens"] for t in {(r["doc_id"], r["doc_tokens"]): r for r in got}.values()) + next(r["doc_tokens"] for r in got if r["doc_id"] == 7) + 0 * len(packing.PIECES)
    if k < 4:
        assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS)
    assert stage(spark, odd.where("false"), SF).count() == 0
