"""Weight of what was read of a candidate: made where the lines of its pool lie, with nulls, repeats and keys without a card."""

import __spark_entry__

from matchloom.operators import pool

from .test_volumes import shuffled


def test_lines_are_dealt_once(spark):
    folder = "/root/testdata/sf0.001"
    lines, parts = (spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("lineitem", "part"))
    moved, rows = shuffled(spark, lambda: __spark_entry__.queries()["pool_exclusive_weight"](spark, folder))
    # by order alone, and not once more by token, by candidate or by product
    assert len(rows) > 5000 and moved < lines + 40 * parts


def test_exclusive_weight_of_odd_pools(spark):
    kinds = [(1, "p", [("a", 1.0), ("b", 2.0)], ["a", "b"]), (2, "q", [("b", 2.0), ("c", 4.0)], ["c"]), (3, None, [("c", 4.0)], ["c"]), (4, "q", None, None), (5, "p", [("d", 8.0)], ["d"])]
    kinds = spark.createDataFrame(kinds, "kind int, product string, weighed array<struct<token: string, w: double>>, ends array<string>")
    lines = [(1, 10, 1), (1, 10, 1), (1, 11, 2), (1, 12, 5), (1, 13, 2), (2, 20, None), (2, 21, 1), (2, 22, 1), (3, 30, 3), (3, 31, 2), (4, 40, 4), (None, 50, 1), (5, None, 1), (5, 51, 1)]
    got = pool.exclusive_weight(spark.createDataFrame(lines, "pool int, key int, kind int").repartition(4, "pool"), kinds, "pool", "key", "kind", "product").collect()
    want = {
        (1, 10): (3.0, 1.0, 6.0), (1, 11): (6.0, 4.0, 3.0), (1, 12): (0.0, 0.0, 6.0), (1, 13): (6.0, 4.0, 3.0),
        # the least key has no card: only the largest one is read
        (2, 21): (3.0, 3.0, None), (2, 22): (3.0, 3.0, None), (3, 30): (4.0, 4.0, None), (3, 31): (4.0, 4.0, None), (None, 50): (0.0, 0.0, None), (5, 51): (3.0, 3.0, None),
    }
    assert {(r.pool, r.key): (r.own, r.exclusive, r.best_rival) for r in got} == want and len(got) == len(want)
