"""Operators against hand-made rows: ties, nulls, empty tables, refusals."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import boxes, numbers
from matchloom.functions import text as tx
from matchloom.operators import evaluation, evidence, geometry, governance, graph, ranking, retrieval, vector
from matchloom.sources import readers, sinks


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_tokens_and_phrases(spark):
    assert one(spark, tx.tokens(F.col("t")), t="The Café of 1999, x é-9 12") == ["café", "1999"][:1]
    assert one(spark, tx.words(F.col("t")), t=None) == []
    assert one(spark, tx.trigrams(F.col("t")), t="abcab cab") == ["abc", "bca", "cab", "ab ", "b c", " ca"]
    assert one(spark, tx.char_grams(F.col("t")), t="ab") == [" ab", "ab ", " ab "] and one(spark, tx.char_grams(F.col("t"), (3,)), t="a") == [" a "]
    assert one(spark, tx.contains_phrase(F.col("a"), F.col("b")), a="red wine glass", b="wine glass")
    assert not one(spark, tx.contains_phrase(F.col("a"), F.col("b")), a="red wineglass", b="wine")
    assert not one(spark, tx.contains_phrase(F.col("a"), F.col("b")), a="red", b="")
    assert one(spark, tx.contains_run(F.col("a"), F.col("b")), a=["p", "q", "r"], b=["q", "r"])
    assert not one(spark, tx.contains_run(F.col("a"), F.col("b")), a=["q"], b=["q", "r"])


def test_longer_phrases_take_their_words(spark):
    aliases = [("brut", "brut"), ("extra brut", "extra"), ("sec", "sec")]
    assert one(spark, tx.consumed_values(F.col("t"), aliases), t="Extra Brut, sec") == ["extra", "sec"]
    assert one(spark, tx.consumed_values(F.col("t"), aliases), t="extra brut brut") == ["extra", "brut"]


def test_fuzzy_limits(spark):
    fuzzy = lambda a, b: one(spark, tx.fuzzy_equal(F.col("a"), F.col("b")), a=a, b=b)
    assert fuzzy("margaux", "margaus") and not fuzzy("vine", "vino") and not fuzzy("abc12x", "abc13x") and fuzzy("x1", "x1")


def test_years_scripts_forms(spark):
    assert one(spark, tx.years(F.col("t")), t="in 1984, 21999 and 2101 or 2001") == ["1984", "2001"]
    assert one(spark, tx.without_years(F.col("t")), t="Old 1984 vines") == "Old vines"
    assert [one(spark, tx.script_class(F.col("t")), t=t) for t in ("abc", "вино", "вino", "語", "12")] == ["LAT", "CYR", "MIXED", "OTHER", "NONE"]
    assert one(spark, tx.unmarked(F.col("t")), t="Château") == "chateau"
    assert one(spark, tx.nfkc_casefold(F.col("t")), t="ﬁ ß") == "fi ss"


def test_rank_units_are_exact(spark):
    for r in (1, 7, 20):
        assert int(one(spark, numbers.rrf_units(F.col("r")), r=r)) == numbers.RRF_LCM // (60 + r)
    assert int(one(spark, numbers.rrf_units(F.col("r")), r=21)) == 0


def test_boxes(spark):
    b = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 2.0, 2.0, 6.0, 6.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert b.select(boxes.iou(boxes.box("a"), boxes.box("b"))).first()[0] == pytest.approx(4 / 28)
    for turn in (0, 90, 180, 270):
        r = spark.createDataFrame([(3.0, 1.0, turn)], "x double, y double, t int").select(*boxes.rotated_back(F.col("x"), F.col("y"), F.col("t"), F.lit(10.0), F.lit(8.0))).first()
        assert 0 <= r[0] <= 10 and 0 <= r[1] <= 8


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 200)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(100)], "loops": [(1, 1), (2, 3), (3, 2)]}[kind]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert graph.components(spark.createDataFrame([(None, 1), (2, None)], "u long, v long")).count() == 0


def test_skyline_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(6), rng.randrange(6)) for g in "ab" for i in range(40)]
    got = {(r["g"], r["i"]) for r in evidence.skyline(spark.createDataFrame(rows, "g string, i int, a int, b int"), "g", F.col("a"), F.col("b"), "i").collect()}
    worse = lambda x, y: y[0] == x[0] and y[2] <= x[2] and y[3] <= x[3] and (y[2] < x[2] or y[3] < x[3])
    assert got == {x[:2] for x in rows if not any(worse(x, y) for y in rows)}


def test_suppression_and_matching(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, float(s), float(x), float(y), float(x + 6), float(y + 6)) for k, (s, x, y) in enumerate(zip(rng.random(30), rng.integers(0, 20, 30), rng.integers(0, 20, 30), strict=True))]
    df = spark.createDataFrame(rows, "image int, key int, score double, x1 double, y1 double, x2 double, y2 double")
    kept = {r["key"] for r in geometry.suppressed(df, "image", "key", "score", 0.3).collect()}
    iou = lambda a, b: (lambda i: i / (72 - i))(max(0, 6 - abs(a[3] - b[3])) * max(0, 6 - abs(a[4] - b[4])))
    want = []
    for r in sorted(rows, key=lambda r: -r[2]):
        if all(iou(r, k) <= 0.3 for k in want):
            want.append(r)
    assert kept == {r[1] for r in want}
    free, want_pairs = [r for r in rows if r[1] >= 15], set()
    for r in sorted((r for r in rows if r[1] < 15), key=lambda r: -r[2]):
        if free and iou(r, t := max(free, key=lambda t: (iou(r, t), -t[1]))) >= 0.1:
            free.remove(t)
            want_pairs.add((1, r[1], t[1]))
    assert want_pairs and {tuple(p) for p in geometry.matched(df.where("key < 15"), df.where("key >= 15"), "image", 0.1).collect()} == want_pairs


def test_fuzzy_pairs_against_all_pairs(spark):
    words = ["margaux", "margaus", "argaux", "pinot", "pinto", "noir", "noire", "chardonnay", "chardonay", "a1b2c3", "a1b2c4", ""]
    got = {(r["a"], r["b"]) for r in retrieval.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    limit = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
    want = {(a, b) for a, b in itertools.combinations(sorted(w for w in words if w), 2) if min(limit(a), limit(b)) > 0 and not any(c.isdigit() for c in a + b) and (a[0] == b[0] or a[-1] == b[-1]) and distance(a, b) <= min(limit(a), limit(b))}
    assert got == want


def test_unblocked_fuzzy_pairs_lose_none(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice((4, 5, 6, 9, 10)))) for _ in range(120)} | {"xmargauxes", "ymargauxez", "a1b2c3d4e5"})
    found = retrieval.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "word string"), unblocked=True).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    limit = lambda w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2
    want = {(a, b, d) for a, b in itertools.combinations(words, 2) if min(limit(a), limit(b)) > 0 and not any(c.isdigit() for c in a + b) and (d := distance(a, b)) <= min(limit(a), limit(b))}
    assert {tuple(r) for r in found} == want and any(a[0] != b[0] and a[-1] != b[-1] for a, b, _ in want)


def test_covering_finds_what_all_pairs_find(spark):
    rng = random.Random(7)
    claims = [(c, f"t{t}", rng.choice([0.0, 0.5, 1.0, 3.0])) for c in range(12) for t in rng.sample(range(40), 9)]
    read = [(p, f"t{t}") for p in range(60) for t in rng.sample(range(40), 12)]
    grade = F.when(F.col("term").endswith("1"), 0.5).otherwise(1.0)
    got = retrieval.covering(spark.createDataFrame(claims, "c int, term string, w double"), spark.createDataFrame(read, "p int, term string"), "c", "p", "w", 0.5, grade).collect()
    held, want = {}, set()
    for p, t in read:
        held.setdefault(p, set()).add(t)
    for c in range(12):
        own = {t: w for k, t, w in claims if k == c}
        for p, terms in held.items():
            hit = sum(w * (0.5 if t.endswith("1") else 1.0) for t, w in own.items() if t in terms)
            if sum(own.values()) and hit / sum(own.values()) >= 0.5 and any(t in terms for t in own):
                want.add((c, p, round(hit, 6), len(terms & set(own))))
    assert {(r["c"], r["p"], round(r["hit"], 6), r["n_read"]) for r in got} == want and want


def test_nearest_hash_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(governance, "HASH_BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.getrandbits(62)) for i in range(40)] + [(40, "c", 5), (41, None, 5), (42, "a", None)]
    refs = [(rng.choice("ab"), rng.getrandbits(62)) for _ in range(50)] + [("d", 1), ("a", None)]
    got = {r["i"]: r["min_bits"] for r in governance.nearest_hash(spark.createDataFrame(rows, "i int, k string, a long"), spark.createDataFrame(refs, "k string, b long"), "k", "a", "b").collect()}
    assert got == {i: min((bin(a ^ b).count("1") for kk, b in refs if kk == k and b is not None), default=None) if a is not None and k else None for i, k, a in rows}


@pytest.mark.parametrize("share", [0.1, 0.2, 0.5, 0.9])
def test_grouped_split_against_a_plain_walk(spark, share):
    import hashlib

    rng = random.Random(int(share * 10))
    sizes = {f"g{i}": rng.choice([1, 2, 3, 40, 90]) for i in range(80)}
    got = {r["g"]: r["role"] for r in governance.grouped_split(spark.createDataFrame(list(sizes.items()), "g string, n int"), "g", "n", "s", share).collect()}
    taken, want = 0, share * sum(sizes.values())
    for g in sorted(sizes, key=lambda g: hashlib.sha256(("s" + g).encode()).hexdigest()):
        ok = taken < want and taken + sizes[g] <= 1.25 * want
        taken += sizes[g] * ok
        assert got[g] == ("selection" if ok else "fit")


def test_percentiles_by_places(spark):
    import math

    rng = random.Random(2)
    rows = [(k, float(rng.choice([0, 1, 1, 2, 5, rng.random()]))) for k in ("a", "b", None) for _ in range(37)] + [("a", None), ("z", 1.0)]
    got = {r["k"]: r for r in evaluation.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for k in ("a", "b", None, "z"):
        v = sorted(x for g, x in rows if g == k and x is not None)
        n = len(v)
        r = got[k]
        assert (r["n"], r["least"], r["most"], r["zeros"]) == (n, v[0], v[-1], v.count(0.0))
        assert (r["p50_lower"], r["p95_nearest"], r["p95_floor"], r["p95_rounded"]) == (v[math.ceil(n * 0.5) - 1], v[math.ceil(n * 0.95) - 1], v[math.floor((n - 1) * 0.95)], v[math.floor((n - 1) * 0.95 + 0.5)])


def test_vectors_in_a_grid_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector, "GALLERY_BLOCK", 4)
    monkeypatch.setattr(vector, "GROUP", 1)
    rng = np.random.default_rng(0)
    g = [(i, int(rng.integers(3)), int(rng.integers(2)), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)]
    df = spark.createDataFrame(g, "row_id long, entity int, channel int, vector array<double>").repartition(4)
    got = {(r["query_id"], r["channel"], r["entity"]): (r["score"], r["row_id"]) for r in vector.entity_scores(df.where("row_id % 4 = 0").select(F.col("row_id").alias("query_id"), "vector"), df).collect()}
    want = {}
    for q, _, _, x in g[::4]:
        for i, e, c, y in g:
            if i != q:
                s = (sum(a * b for a, b in zip(x, y, strict=True)), -i)
                want[q, c, e] = max(want.get((q, c, e), (-1e9, 0)), s)
    assert got == {k: (s, -i) for k, (s, i) in want.items()}


def test_perturbation_shows_a_wrong_sign(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    got = {r["feature"]: (r["n"], r["raised"], r["violations"]) for r in ranking.perturbed(rows, {"a": 1.0, "b": -2.0}, 0.5, {"a": -1.0}).collect()}
    assert got == {"a": (2, 0, 2), "b": (2, 2, 0)}


def test_ledger_takes_a_null_key_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "n")], "id int, v string")
    assert [sinks.append_missing(df, str(tmp_path / "l"), "id") for _ in range(2)] == [2, 0]


def test_audit_lists_all_reasons(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "y")], "id int, sha string, parent string")
    pool = spark.createDataFrame([("a",), ("x",)], "k string")
    got = {r["id"]: (r["reasons"], r["allowed"]) for r in governance.audit(rows, "id", [("own", pool, "k", "sha"), ("ancestor", pool, "k", "parent")]).collect()}
    assert got == {1: ("ancestor,own", False), 2: ("", True), 3: ("", True)}


def test_grouped_split_skips_what_overshoots(spark):
    sizes = {f"g{i}": n for i, n in enumerate([50, 10, 10, 10, 10, 10])}
    got = {r["g"]: r["role"] for r in governance.grouped_split(spark.createDataFrame(list(sizes.items()), "g string, n int"), "g", "n", "s", 0.2).collect()}
    assert got["g0"] == "fit" and sum(sizes[g] for g, role in got.items() if role == "selection") == 20


def test_closure_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "parent int, child int")
    assert {r["node"] for r in governance.closure(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {1, 2, 3}


def test_resolver_keeps_control(spark):
    rows = spark.createDataFrame([(1, "a", "b", 0.2), (2, "a", "b", 0.01), (3, "a", None, 0.9), (4, "a", "b", None)], "q int, control string, proposal string, m double")
    got = {r["q"]: (r["reasons"], r["final"]) for r in ranking.resolved(rows, "control", "proposal", {"margin": F.col("m") > 0.1}).collect()}
    assert got == {1: ("", "b"), 2: ("margin", "a"), 3: ("", "a"), 4: ("margin", "a")}


def test_gradient_by_differences(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(q), int(c), float(rng.normal()), float(rng.normal()), int(c == 0)) for q in range(6) for c in range(4)], "q int, c int, a double, b double, y int")
    w = np.array([0.3, -0.2])
    _, g, n = ranking.listwise_loss_gradient(rows, "q", "y", ["a", "b"], w)
    for i in range(2):
        e = np.eye(2)[i] * 1e-5
        up, down = (ranking.listwise_loss_gradient(rows, "q", "y", ["a", "b"], w + s * e)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    assert n == 6


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    path = str(tmp_path / "once")
    assert sinks.write_once(df, path) == "written" and sinks.write_once(df, path) == "same"
    with pytest.raises(ValueError):
        sinks.write_once(df.where("id = 1"), path)
    ledger = str(tmp_path / "ledger")
    assert sinks.append_missing(df, ledger, "id") == 2 and sinks.append_missing(df.union(spark.createDataFrame([(3, "c")], df.schema)), ledger, "id") == 1
    sealed = sinks.sealed(df)
    assert sinks.broken_seals(sealed).count() == 0 and sinks.broken_seals(sealed.withColumn("v", F.lit("z"))).count() == 2
    sinks.write_json_lines(df, str(tmp_path / "lines"), "gzip")
    assert readers.json_lines(spark, str(tmp_path / "lines"), "id int, v string").count() == 2
    assert readers.filtered_lines(spark, str(tmp_path / "lines"), '"id":1', "id int, v string", F.col("id") == 1).count() == 1
    assert readers.found_in_lines(spark, str(tmp_path / "lines"), '"id":([0-9])', 1).count() == 2
    (tmp_path / "m.tsv").write_text("query_id\timage_path\nq1\ta/b.jpg\nq2\tc.jpg\n")
    assert readers.manifest(spark, str(tmp_path / "m.tsv")).count() == 2
    (tmp_path / "bad.tsv").write_text("query_id\timage_path\nq1\t../b.jpg\nq1\tc.jpg\n")
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "bad.tsv"))
    files = readers.files(spark, str(tmp_path), "*.tsv")
    pins = spark.createDataFrame([("m.tsv", files.where("name = 'm.tsv'").first()["sha256"]), ("gone.tsv", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in readers.verified(files, pins).collect()} == {"m.tsv": True, "gone.tsv": False}
    note = sinks.write_bundle(df, str(tmp_path / "bundle"), "id")
    assert note["n"] == 2
    with pytest.raises(Exception, match="not in 0..1"):
        readers.checked_scores(spark.createDataFrame([(1.5,)], "s double"), "s", 0.4).collect()
