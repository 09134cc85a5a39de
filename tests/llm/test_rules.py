"""Statistics and learnt rules against plain Python."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from matchloom.llm import rules  # noqa: E402
from matchloom.llm.session import tables  # noqa: E402

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{i}" for i in range(60))
ODD = [
    None, "", " \t\n\x0b\f\r", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "a b c x a b c a b", "A  b\tc\nA b\x0bc", PASSAGE, PASSAGE + " " + PASSAGE, (PASSAGE + "\n") * 3, "x\nx\nx \n\n \n\t\nx",
    "#*$%&|<> & # éé 日本語 \U0001f600   ", "a." * 9, "one.\ntwo! \nthree", "w " * 5000, " ".join(f"v{i % 4999} u{i % 7}" for i in range(60_000)), "<p>12 34</p>\r\n<p>12 34</p>\r\n", "\x00 \x00 \x00 \x00", PASSAGE.upper(),
]


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if windows[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = lambda kind: len(re.findall(kind, text))
    return (
        len(w), sum(map(len, w)), n(r"[#*$%&|<>]"), len(lines) - len(set(lines)), len(covered), len(lines), len(set(w)), n("[A-Z]"), n("[0-9]"), sum(len(x) == 1 for x in w),
        sum(bool(re.search(r"[.!?][ \t\n\x0b\f\r]*$", x)) for x in lines), n("[.,;!?]"),
    )


def test_statistics_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(3, "a", "clash", 7), (None, "a b", "x", 0)], "doc_id long, text string, w string, n_words int").repartition(3)
    got = rules.statistics(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert tuple(r)[1:] == counts("a b" if r.doc_id is None else ODD[r.doc_id]), r.doc_id


def test_windows_of_one_hash_prefix_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *a: F.ascii(a[0]).cast("long") % 3)  # three hashes in all
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 2, 3, 9, 40, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", rules.repeated_words(F.array_remove(F.split("text", " "), "")).alias("n"))
    assert {r.doc_id: r.n for r in rows.collect()} == {i: counts(t)[4] for i, t in enumerate(texts)}


def learnt(rows, names):
    """Sequential covering over (bad, aside, values) rows in one process."""
    left, out = list(rows), []
    holds = lambda r, rule: all(r[2][f] >= v if up else r[2][f] <= v for f, up, v in rule)
    tally = lambda some: (sum(r[0] for r in some), sum(not r[0] for r in some))
    while len(out) < rules.MOST_RULES:
        rule = []
        while len(rule) < rules.MOST_CONDITIONS:
            own = [r for r in left if not r[1] and holds(r, rule)]
            p, n = tally(own)
            top, found = 1e-9, None
            for f in range(len(names)):
                values = sorted({r[2][f] for r in own})
                for up in (True, False):
                    for a, b in zip(values, values[1:], strict=False):
                        v = (a + b + up) // 2
                        x, y = tally([r for r in own if (r[2][f] >= v if up else r[2][f] <= v)])
                        if x >= rules.LEAST_COVERED and (g := x * (math.log2(x / (x + y)) - math.log2(p / (p + n)))) > top + 1e-9:
                            top, found = g, (f, up, v)
            if found is None:
                break
            rule.append(found)
            if not tally([r for r in left if not r[1] and holds(r, rule)])[1]:
                break
        if not rule:
            break
        options = []
        for k in range(1, len(rule) + 1):
            p, n = tally([r for r in left if r[1] and holds(r, rule[:k])])
            options.append(((p - n) / max(1, p + n), -k, p, n))
        _, k, p, n = max(options)
        if not p or p < rules.PURITY * (p + n):
            break
        out.append(tuple((names[f], up, v) for f, up, v in rule[:-k]))
        left = [r for r in left if not holds(r, rule[:-k])]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rules_are_those_of_a_plain_learner(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        x = [rng.randint(0, 40), rng.randint(0, 8), rng.randint(0, 1000)]
        bad = x[0] >= 30 and x[1] <= 4 or x[2] > 900
        rows.append(((bad if rng.random() > 0.02 else not bad), rng.random() < 1 / 3, x))
    given = spark.createDataFrame([(b, a, *x) for b, a, x in rows], "bad boolean, aside boolean, p int, q int, r int").repartition(1 + seed)
    got = rules.learn(given, {"f": "p", "g": "q", "h": "r"})
    assert [tuple((c.feature, c.at_least, c.value) for c in rule) for rule in got.rules] == learnt(rows, ["f", "g", "h"])
    assert 2 <= len(got.rules) <= 6


def test_expression_takes_the_first_rule_that_holds(spark):
    c = rules.Condition
    own = rules.DecisionList([(c("words_per_line", True, 10), c("digits_of_1000", False, 5)), (c("capitals_of_1000", True, 500),)])
    zero = dict.fromkeys(rules.COUNTS, 0)
    rows = [zero | {"n_words": 100, "n_lines": 10, "word_chars": 500}, zero | {"n_words": 90, "n_lines": 10, "word_chars": 500}, zero | {"word_chars": 4, "n_upper": 2}, zero]
    got = spark.createDataFrame(rows).select(own.expression().alias("kept")).collect()
    assert [r.kept for r in got] == [False, True, False, True]
    assert str(own) == "reject if words_per_line >= 10 and digits_of_1000 <= 5\nreject if capitals_of_1000 >= 500\nelse keep"


def test_report(spark):
    docs, labels = tables(spark, SF, "documents"), tables(spark, SF, "labels")
    more = labels.union(labels.limit(5)).union(labels.sparkSession.createDataFrame([(None, 0, 0), (1, None, 0)], labels.schema)).withColumn("bad", F.lit("clash"))
    odd = docs.withColumn("aside", F.lit(1)).withColumn("kept", F.lit(2))
    odd = odd.union(odd.limit(3)).union(odd.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = rules.report(odd, more).collect()
    assert len(got) == docs.count() + 5 and list(got[0].asDict()) == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:6] == counts(texts[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    for none in (labels.where("false"), labels.where("quality = 1")):
        assert all(r.kept != r.base_failed for r in rules.report(docs, none).collect())
    assert rules.report(docs.where("false"), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    docs, labels = tables(spark, sf, "documents"), tables(spark, sf, "labels")
    counts_ = rules.statistics(docs)
    own = rules.learn(rules.labelled(counts_, labels.where(~held)))
    tested = counts_.where(~F.expr(rules.BASE_FAILED)).join(labels.where(held), "doc_id").select("quality", own.expression().alias("kept"))
    bad, wrong, good, lost = tested.agg(*(F.count_if(F.expr(x)) for x in ("quality = 0", "quality = 0 and kept", "quality = 1", "quality = 1 and not kept"))).first()
    assert bad > 50 and wrong <= 0.03 * bad and lost <= 0.003 * good
