"""Near copies against plain Jaccard similarity of all pairs, and rows that share an id or have none."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from matchloom.llm import nearsets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_by_all_pairs(rows):
    """The texts that stay, each with its id."""
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


def staged(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(parts)
    return corpus_pipeline.one_of_near_copies(spark, docs, "").collect()


def test_near_copies_of_real_texts_against_all_pairs(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rng, rows = random.Random(5), []
    for t in texts:
        rows.append((len(rows), t))
        for changes in (1, 2, 3, 5):
            w = t.split()
            for _ in range(changes * len(w) // 100 + 1):
                w[rng.randrange(len(w))] = f"other{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in staged(spark, rows)) == kept_by_all_pairs(rows)


def test_similarity_just_above_and_below(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    near, far = base[:93], base[:83]  # 89 of 100 and 79 of 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert nearsets.LEAST == (4, 5)
    assert {r["doc_id"] for r in staged(spark, [rows[0], rows[1]])} == {1}
    assert {r["doc_id"] for r in staged(spark, [rows[0], rows[2]])} == {1, 3}
    # a chain: 79 of 89 shingles
    assert {r["doc_id"] for r in staged(spark, rows)} == {1}


def test_decisions_are_by_row(spark):
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    rows = [(1, a)] * 3 + [(None, b)] * 3 + [(2, a), (2, c), (None, a), (3, ""), (4, None), (5, "One two"), (6, "one TWO")]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in staged(spark, rows)))
    assert got == sorted([(False, 1, a), (True, 0, b), (False, 2, c), (False, 3, ""), (False, 5, "One two")])


@pytest.mark.parametrize("block_bytes", [700, 512 << 10])
def test_texts_around_one_passage_are_compared_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(nearsets, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(nearsets, "FEWER", 0)  # every group that is left in parts goes to the grid
    grids, grid = [], nearsets._grid

    def seen(split, heavy, sets):
        grids.append(heavy.count())
        return grid(split, heavy, sets)

    monkeypatch.setattr(nearsets, "_grid", seen)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(100)]
    rows = [(k, " ".join(passage + [f"x{rng.randrange(10**9)}" for _ in range(rng.choice([6, 12, 25, 40]))])) for k in range(80)]
    rows += [(100 + k, " ".join([f"y{k % 3}"] * (k % 5) + passage[k:])) for k in range(40)] + [(None, " ".join(passage)), (None, "")]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in staged(spark, rows)) == kept_by_all_pairs(rows)
    assert grids[0] > 0


def test_blocks_of_sets_against_plain_similarity():
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(2**32, 3000, replace=False)).astype(np.uint32)
    sets = [np.sort(np.concatenate([rng.choice(base, n, replace=False), rng.choice(2**32, extra).astype(np.uint32)])) for n, extra in ((3000, 0), (2900, 300), (2600, 0), (2500, 200), (2395, 0), (40, 2900), (1, 0))]
    i, j = nearsets._alike(sets, sets[1:])
    wanted = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[1:]) if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == wanted
    i, j = nearsets._alike(sets[:1], [np.array([base[0] ^ 1], np.uint32)])
    assert not len(i)
