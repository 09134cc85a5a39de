"""Searches without a bound of size or depth against all subsets and plain walks."""

import json
import random
from itertools import combinations

from pyspark.sql import functions as F

from matchloom.operators import evaluation, mining


def minimal_sets(products):
    """(product, form) by all subsets of all rows."""
    holders = {}
    for p, words in products:
        own = sorted({w for w in words or [] if w is not None})
        for n in range(1, len(own) + 1):
            for s in combinations(own, n):
                holders.setdefault(s, set()).add(p)
    alone = {s: next(iter(ps)) for s, ps in holders.items() if len(ps) == 1}
    return {(p, " ".join(s)) for s, p in alone.items() if not any(set(o) < set(s) for o in alone)}


def test_short_forms_of_any_size(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(p, rng.sample(words, rng.randint(1, 10))) for p in range(60)]
    rows += [(100, words[:8]), (101, words[:7] + ["x"]), (102, words[1:8] + ["x"]), (100, words[:8]), (103, None), (104, []), (105, ["y", None, "y"]), (106, [None])]
    given = spark.createDataFrame([(*r, "clash") for r in rows + [(None, ["z"])]], "id int, w array<string>, form string").repartition(4)
    got = mining.short_forms(given, "id", "w").collect()
    assert {(r.id, r.form) for r in got} == minimal_sets(rows) and len(got) == len({(r.id, r.form) for r in got})
    assert max(r.n_words for r in got) > 3 and all(r.n_words == len(r.form.split()) for r in got)
    # only four words together tell 0 apart: each three of them are shared
    apart = [(0, list("abcd")), *((k + 1, [x for x in "abcd" if x != y]) for k, y in enumerate("abcd"))]
    assert [tuple(r) for r in mining.short_forms(spark.createDataFrame(apart, "id int, w array<string>"), "id", "w").collect()] == [(0, "a b c d", 4)]
    assert mining.short_forms(given.where("false"), "id", "w").count() == 0


def walk(node, name, at=""):
    if isinstance(node, dict):
        for k, v in node.items():
            path = k if not at else f"{at}.{k}"
            if k == name:
                yield path, v
            yield from walk(v, name, path)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, name, f"{at}[{i}]")


def test_nested_values_of_any_depth(spark):
    deep = {"k": 0}
    for i in range(12):
        deep = {"k": deep} if i % 3 == 0 else {"a": [i, deep, {"k": f"s{i}"}]} if i % 3 == 1 else [deep, [deep]] if i == 5 else {"b": deep}
    docs = [deep, {"k": None}, {"k": [1, {"k": "x.y"}]}, [{"k": 1.5}, [[{"k": True}]]], 7, "k", {}, []]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "no json"), (91, None), (92, ""), (93, '{"k": 1, "k": 2}')]
    got = evaluation.nested_values(spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, d string, path string, pos int"), "id", "d", "k").collect()
    want = [(i, p, v) for i, d in enumerate(docs) for p, v in walk(d, "k")]
    assert sorted((r.id, r.path) for r in got) == sorted((i, p) for i, p, _ in want)
    plain = {(i, p): v for i, p, v in want}
    for r in got:
        v = plain[r.id, r.path]
        assert r.value is None if v is None else (r.value == v if isinstance(v, str) else json.loads(r.value) == v)
    assert evaluation.nested_values(spark.createDataFrame(rows, "id int, d string").where(F.lit(False)), "id", "d", "k").count() == 0
