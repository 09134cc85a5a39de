"""Turns of a small file are counted by more than one task."""

import public_tokenizers

from matchloom.llm import packing


def test_turns_are_dealt_before_they_are_counted(spark):
    turns = spark.createDataFrame([(c, r, "one two") for c in (1, 2, None) for r in ("user", "assistant")], "conv_id long, role string, text string").coalesce(1)
    out = packing.pack_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RoundRobinPartitioning")
    assert {r.conv_id: r.n_turns for r in out.collect()} == {1: 2, 2: 2, None: 2}
