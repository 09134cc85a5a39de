"""Whole feature rows: lines are dealt to their pool once, and figures are made there."""

import __spark_entry__
from pyspark.sql import functions as F

from matchloom.operators import features

from .test_dealt import plans
from .test_volumes import shuffled


def test_lines_of_an_order_are_dealt_once(spark):
    folder = "/root/testdata/sf0.001"
    few = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_linenumber <= 4").count()
    small = spark.read.parquet(f"{folder}/part.parquet").count()
    moved, rows = shuffled(spark, lambda: __spark_entry__.queries()["pool_whole_row"](spark, folder))
    # a dealing of all lines, and steps over the parts and their words; 200 thousand rows before
    assert len(rows) > 3000 and moved < few + 60 * small


def test_a_phrase_over_two_texts_of_a_line(spark):
    texts = spark.createDataFrame([("red ring",), ("bolt acme",), ("ring 1990 red",), (None,)], "text string")
    prints = features.readings(texts, "text", spark.createDataFrame([(c,) for c in ("red", "ring", "bolt", "acme", "rinq")], "claim string"))
    lines = [(1, 10, 1, 1, "red ring", 30.0), (1, 11, 1, 2, "bolt acme", 5.0), (1, 11, 2, 2, None, 5.0), (2, 10, 1, 1, "ring 1990 red", 5.0), (2, 10, 1, 1, "ring 1990 red", 7.0), (None, 10, 1, 1, "red ring", 1.0)]
    lines = spark.createDataFrame(lines, "pool int, key int, line int, kind int, print string, score double").repartition(4, "pool")
    cards = spark.createDataFrame([(1, "acme", ["acme"], ["acme", "red"], ["red", "ring"]), (2, "bolt", ["bolt"], [], ["ring", "red"])], "kind int, producer string, producer__ array<string>, series__ array<string>, name__ array<string>")
    cards = cards.withColumns({f"{r}_want": F.col(f"{r}__") for r in features.ROLES} | {"name_keys": F.col("name__"), "typed_keys": F.array(F.lit("x"))})
    channels = {f"{a}_{k}": F.col("score") for a in ("B0", "B3") for k in ("label", "context")}
    got = {}

    def run():
        out = features.whole_rows(lines, cards, prints, "pool", "key", "line", "kind", channels, {"B0": F.col("score")}, 10.0, F.col("score") > 25, F.col("print"), {"r": (F.col("key") % 2, F.col("score") < 9)}, {"r": F.when(F.col("key") > 10, F.lit(0))}, ["r"])
        got.update({(r.pool, r.key): r for r in out.collect()})

    text = plans(spark, run)
    assert set(got) == {(1, 10), (1, 11), (2, 10)}
    a, b, c = got[1, 10], got[1, 11], got[2, 10]
    # texts stand in order of themselves, "bolt acme red ring", and the year is in no line
    assert (a.txt_series_full_any, a.txt_series_full_high, a.txt_name_full_any, b.txt_name_full_any, c.txt_name_full_any, c.txt_name_cover_any, b.txt_series_cover_any) == (1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0)
    assert (a.txt_producer_full_high, a.txt_producer_other_read_high, b.txt_producer_other_read_high, c.txt_producer_other_read_high) == (1.0, 0.0, 0.0, 0.0) and c.txt_producer_full_any == 0.0
    assert (a.vis_B0_label_rr, b.vis_B0_label_rr, b.vis_B0_label_gap, c.vis_B0_label_gap, a.vis_small_label_x_B0_label_rr, a.vis_support) == (1.0, 0.5, 25.0, 0.0, 1.0, 1.0)
    assert (a.typ_r_unknown_when_observed, b.typ_r_support_any, b.typ_r_support_high, b.typ_r_contra_any) == (1.0, 1.0, 1.0, 0.0)
    # dealt before, and not once more
    assert "hashpartitioning(key" not in text and "hashpartitioning(text__" not in text and "hashpartitioning(kind" not in text
