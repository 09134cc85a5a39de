"""Products of equal words are one: copies of a catalogue do not multiply the sets that are looked at."""

from matchloom.operators import mining

from .test_volumes import shuffled


def test_short_forms_of_copies(spark):
    words = [[f"a{p % 3}", f"b{p % 4}", f"c{p % 5}", "same"] for p in range(60)]
    once = [(p, w) for p, w in enumerate(words)]
    rows = lambda given: spark.createDataFrame(given, "id int, w array<string>")
    one = rows([*once, (None, ["lone"]), (70, ["x", None, "x"]), (71, None)])
    # a copy of all but product 7, and 60 copies of those
    many = rows([(p + 100 * n, w) for n in range(60) for p, w in once if n == 0 or p != 7] + [(70, ["x"]), (70, ["x", "y"])])
    few, first = shuffled(spark, lambda: mining.short_forms(one, "id", "w"))
    moved, got = shuffled(spark, lambda: mining.short_forms(many, "id", "w"))
    assert {(r.id, r.form, r.n_words) for r in first} == {(p, f"a{p % 3} b{p % 4} c{p % 5}", 3) for p in range(60)} | {(70, "x", 1)}
    assert {(r.id, r.form) for r in got} == {(7, "a1 b3 c2"), (70, "x"), (70, "y")} and moved < 4 * few
