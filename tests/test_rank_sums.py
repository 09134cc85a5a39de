"""Fusion and votes at ranks beyond 20, and families with members outside the lists."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from matchloom.functions import numbers
from matchloom.functions.numbers import RRF_LCM
from matchloom.operators import retrieval


def test_fuse_counts_every_rank(spark):
    n = 60
    first = [(1, e, e + 1) for e in range(n)]
    second = [(1, e, (e * 37) % n + 1) for e in range(n)]
    a, b = (spark.createDataFrame(x, "q int, e int, rank int") for x in (first, second))
    got = {r["e"]: r for r in retrieval.fuse(a, b, "q", "e", limit=n).collect()}
    want = sorted(range(n), key=lambda e: (-Fraction(1, 61 + e) - Fraction(1, 61 + e * 37 % n), e))
    assert [e for e, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == want
    assert all(int(got[e]["rrf_units"]) == RRF_LCM // (61 + e) + RRF_LCM // (61 + e * 37 % n) for e in range(n))


def test_equal_sums_of_different_ranks_tie(spark):
    # 1/84 + 1/420 = 1/105 + 1/210 = 1/70
    a = spark.createDataFrame([(1, 9, 24), (1, 2, 45)], "q int, e int, rank int")
    b = spark.createDataFrame([(1, 9, 360), (1, 2, 150)], "q int, e int, rank int")
    assert [r["e"] for r in retrieval.fuse(a, b, "q", "e").orderBy("rank").collect()] == [2, 9]


def test_members_outside_the_lists_are_added(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q int, e int, rank int")
    families = spark.createDataFrame([(10, 0), (11, 0), (20, 1), (21, 1)], "e int, family int")
    got = [(r["e"], r["rank"], int(r["rrf_units"])) for r in retrieval.fuse(a, a, "q", "e", families, 1).orderBy("rank").collect()]
    assert got == [(10, 1, 2 * RRF_LCM // 61), (11, 3, 0)]


def test_vote_counts_every_rank(spark):
    rows = [(1, c, p, (p * (c + 3)) % 41 + 1) for c in range(2) for p in range(41)]
    got = retrieval.vote(spark.createDataFrame(rows, "q int, channel int, p int, rank int"), "q", "p").orderBy("rank").collect()
    total = {p: sum(Fraction(1, 60 + r) for _, _, x, r in rows if x == p) for p in range(41)}
    assert [r["p"] for r in got] == sorted(total, key=lambda p: (-total[p], p)) and all(r["support"] == 2 for r in got)


def test_sums_of_decimals_are_those_of_fractions(spark):
    rng = random.Random(2)
    rows = [[rng.choice([None, 0, -3, 1, 2, rng.randint(1, 400), rng.randint(1, 9_000_000)]) for _ in range(rng.randint(0, 4))] for _ in range(400)]
    df = spark.createDataFrame([(r,) for r in rows], "r array<int>").select("r", numbers.rrf_sum(F.col("r")).alias("a"), numbers.rrf_sum(F.col("r"), 4).alias("b"))
    for x in df.collect():
        assert x.a == x.b
        total = sum((Fraction(1, 60 + r) for r in x.r if r is not None and r > 0), Fraction(0))
        assert int(x.b.exact) == total.numerator * 10**numbers.RRF_DIGITS // total.denominator
    with pytest.raises(Exception, match="too large"):
        spark.range(1).select(numbers.rrf_sum(F.array(*[F.lit(1 << 30)] * 4), 4)).collect()
