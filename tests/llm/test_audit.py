"""Filters and their orders against documents that are filtered one after the other."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from matchloom.llm import audit  # noqa: E402

WORDS = " ".join(f"w{i}" for i in range(250))
ODD = [
    (1, WORDS, "a"), (2, WORDS, "a"), (3, None, "a"), (4, "", "b"), (5, "", None), (6, "A " * 300, "a"), (6, "A " * 300, "b"), (7, "A " * 300, None), (8, WORDS + " #", ""),
    (9, WORDS.upper(), "a"), (9, WORDS.upper() + " x", "a"), (None, WORDS, "a"), (None, WORDS, "b"), (10, " \t\x0b\n" + WORDS.replace(" ", "\f\r"), "b"), (11, "é" * 300, "b"), (12, "x y " * 210, "c"),
    (13, " ".join(f"v{i}" for i in range(40_000)), "c"), (14, "\x00&", "c"), (0, "AB" + "é" * 98 + " " + WORDS, "d"), (15, "ABC" + "é" * 20, "d"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 0, 1), (6, 1, 1), (9, 1, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1), (14, None, None), (0, 1, 0)]


def plain(rows, labels):
    """Each order applied to the rows themselves."""
    found = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows),
        }
        found.append((s or "", fails, any(i is not None and x[0] == i and x[1] == 1 for x in labels), any(i is not None and x[0] == i and x[2] == 1 for x in labels)))
    out, shares = {}, {}
    for part in {f[0] for f in found}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [f for f in found if f[0] == part], []
            for step, k in enumerate(order, 1):
                taken = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                alone = sum(1 for f in found if f[0] == part and [x for x in "ABCDE" if f[1][x]] == [k])
                out[part, order, step] = [len(left), len(taken), sum(f[1][k] for f in gone), alone, sum(f[2] for f in taken), sum(f[3] for f in taken)]
                shares[part, k] = shares.get((part, k), 0) + len(taken)
                gone += taken
    return sorted((*key, *v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def test_orders_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "clash", 2, True) for r in ODD], "doc_id long, text string, source string, n int, part string, mask int, is_first boolean").repartition(4)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, digest string")
    got = audit.report(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(ODD, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "x", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(docs.where("false"), labels).count() == 0
    assert sorted(map(tuple, audit.report(docs, labels).collect())) == plain([(1, "x", "a"), (2, "x", "a")], [])


@pytest.mark.parametrize("n", [1, 3, 6])
def test_zeta_is_the_sum_over_subsets(spark, n):
    cells = [(7 * m * m + 3) % 101 for m in range(1 << n)]
    got = spark.range(1).select(audit.zeta(F.array(*map(F.lit, cells)), n).alias("z")).first().z
    assert got == [sum(c for s, c in enumerate(cells) if s & m == s) for m in range(1 << n)]
