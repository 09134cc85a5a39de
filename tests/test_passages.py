"""Unicode forms are made of passages, never of whole texts, and are those of the whole text."""

import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.functions import text as tx
from matchloom.operators import retrieval

#: Marks, sigmas and full-width letters at the place of a cut, with and without a space there; spaces that forms make; words of no end.
EDGES = ["́ x", " ́x", "Σ ΑΒ", "ΑΣ. Β", "ΑΣ7Β", "Σ", "é", " A", "´b", "①2", "²́ 1", "ﬁ", "한ᆨ ", "한", "語゙Ａ", "≠ ", "İ İ", "ß\tẞ", "\nͅΑ"]
TEXTS = [None, "", " ", "plain", "Château", "ﬁ ß", "ΟΔΟΣ ΟΔΟΣ"] + [pad * (k // len(pad)) + "a" * (k % len(pad)) + e + tail for pad in ("Ab ", "x", "語") for e in EDGES for k in (tx.PASSAGE - 2, tx.PASSAGE - 1, tx.PASSAGE, 2 * tx.PASSAGE - 1) for tail in ("", " end", "́Σ" * tx.PASSAGE)]


def test_forms_of_passages_are_those_of_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").withColumn("p", tx.passages(F.col("t")))
    apart = df.select("k", F.posexplode("p").alias("i", "p")).select("k", "i", "p", F.lower("p").alias("low"), tx.nfkc_casefold("p").alias("a"), tx.unmarked("p").alias("b"))
    got = {}
    for r in sorted(apart.collect(), key=lambda r: (r.k, r.i)):
        got.setdefault(r.k, []).append(r)
    for r in df.select("k", "t", F.lower("t").alias("low"), tx.nfkc_casefold("t").alias("a"), tx.unmarked("t").alias("b")).collect():
        own = got.get(r.k, [])
        for name, whole in (("p", r.t), ("low", r.low), ("a", r.a), ("b", r.b)):
            assert "".join(x[name] for x in own) == (whole or ""), (r.k, name)
        assert (r.a == r.low) == all(x.a == x.low for x in own) and (r.b == r.low) == all(x.b == x.low for x in own)


def test_changed_counts_texts(spark):
    rows = [(k % 7, None if k % 3 == 0 else "ab"[k % 2], t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string").repartition(3)
    low = {r.text: r.low for r in df.select("text", F.lower("text").alias("low")).collect()}
    forms = {"folded_apart": lambda t: unicodedata.normalize("NFKC", t).casefold(), "had_marks": lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()}
    expected = {(lang, sum(x[1] == lang for x in rows), *(sum(x[1] == lang and x[2] is not None and f(x[2]) != low[x[2]] for x in rows) for f in forms.values())) for lang in (None, "a", "b")}
    assert set(map(tuple, retrieval.changed(df, "lang", "text", {"folded_apart": tx.nfkc_casefold, "had_marks": tx.unmarked}).collect())) == expected


@pytest.mark.parametrize("name", ["text_normal_forms", "text_unmarked"])
def test_python_is_not_given_whole_texts(spark, tmp_path, monkeypatch, name):
    spark.createDataFrame([(1, "fr", "Château fort " * 4000), (2, "en", "plain words " * 4000), (3, "fr", None)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    most = tx.PASSAGE + 100

    @F.pandas_udf("string")
    def short(text):
        assert all(t is None or (len(t) < most and not t.isascii()) for t in text), "a whole text"
        return text.str.upper()

    monkeypatch.setattr(tx, "nfkc_casefold", short)
    monkeypatch.setattr(tx, "unmarked", short)
    found = {r.lang: (r.n, r.had_marks) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    assert found == {"fr": (2 if name == "text_normal_forms" else 1, 1), "en": (1, 0)}
