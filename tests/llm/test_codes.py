"""Vector codes against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from matchloom.llm import codes  # noqa: E402


def plain(rows, parts, entries, rounds):
    """rows: (id, vector, label), all usable and of one length."""
    whole = [[max(-codes.LARGEST, min(codes.LARGEST, math.floor(x * 256))) for x in v] for _, v, _ in rows]
    d = len(whole[0]) // parts
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(order)):
                members = [c[p] for c, o in zip(cut, own, strict=True) if o[p] == k]
                if members:
                    books[p][k] = [sum(m) // len(members) for m in zip(*members, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(f[0] for f in fs) for fs in found]
    sums = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    fits = lambda x: x if x < 1 << 63 else None
    apart = {label for (_, _, label), e in zip(rows, error, strict=True) if e >= 1 << 63}
    return [(i, "".join(f"{f[1]:02x}" for f in fs), fits(e), None if label in apart else fits(sums[label]), sha) for (i, _, label), fs, e in zip(rows, found, error, strict=True)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


KIND = "vec_id long, embedding array<{}>, label int, id string, v int, code string, error long"
CLASH = ("x", 1, "y", 2)


@pytest.mark.parametrize(("kind", "size"), [("float", 1.0), ("double", 1.0), ("double", 1e9), ("double", 1e200)])
def test_codes_of_odd_rows(spark, kind, size):
    rng = np.random.default_rng(3)
    rows = [(i * 3 % 41, (np.round(rng.normal(size=8) * 2) / 8 * size).tolist(), [None, 1, 2][i % 3]) for i in range(60)]
    rows += [(500 + i, [0.125 * size] * 8, 1) for i in range(40)] + [(None, [-0.001 * size] * 8, None), (None, [0.0] * 8, 7)]
    dropped = [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [float("nan")] + [1.0] * 7, 2), (4, [float("inf")] * 8, 2), (5, [], 1), (6, [1.0] * 7, 1), (900, [1.0] * 12, 1)]
    given = spark.createDataFrame([(*r, *CLASH) for r in rows + dropped], KIND.format(kind)).repartition(5)
    got = codes.report(given, parts=4, entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(plain(rows, 4, 16, 2))


def test_few_rows_and_none(spark):
    rows = [(1, [0.5, 0.25], 1), (1, [0.5, 0.0], None), (1, [0.5, 0.25], 1)]
    given = spark.createDataFrame([(*r, *CLASH) for r in rows], KIND.format("float"))
    assert ordered(codes.report(given, parts=2, entries=64).collect()) == ordered(plain(rows, 2, 64, 2))
    none = codes.report(given.where("false"))
    assert none.count() == 0 and none.columns == codes.report(given, parts=2).columns


@pytest.mark.parametrize("big", [2, 40, 1 << 40, 1 << 62])
def test_tree_finds_the_nearest_of_the_lowest_index(big):
    rng = np.random.default_rng(big % 97)
    for d in (1, 3, 4):
        for k in (1, 2, 9, 64):
            entries, points = rng.integers(-big, big, (k, d)), rng.integers(-big, big, (200, d))
            entries[k // 2 :] = entries[: k - k // 2]  # every entry twice
            who, far = codes.Tree(entries).nearest(points)
            all_pairs = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
            assert who.tolist() == [min(range(k), key=lambda e, r=r: (r[e], e)) for r in all_pairs.tolist()]
            assert far.tolist() == all_pairs.min(axis=1).tolist()


def test_decoded(spark):
    rows = codes.usable(spark.createDataFrame([(i, [i / 4, -i / 8], 0) for i in range(8)], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label", 2)
    books = codes.fit(rows, parts=2, entries=8)
    assert {r.id: books.decoded(r.code) for r in codes.encoded(rows, books).collect()} == {i: [i / 4, -i / 8] for i in range(8)}
