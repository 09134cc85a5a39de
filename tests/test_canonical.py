"""Aliases by the automaton against a plain look at every place."""

import random

from matchloom.operators import canonical


def plain(words, aliases):
    best = {}
    for phrase, atom, priority in aliases:
        if phrase and atom is not None and None not in phrase:
            best[tuple(phrase)] = min(best.get(tuple(phrase), (priority, atom)), (priority, atom))
    most = max(map(len, best), default=0)
    tokens, applied, i = [], [], 0
    while i < len(words):
        n = next((n for n in range(most, 0, -1) if i + n <= len(words) and tuple(words[i : i + n]) in best), 0)
        if n:
            atom = best[tuple(words[i : i + n])][1]
            applied.append((i, " ".join(words[i : i + n]), atom))
        tokens.append(atom if n else words[i])
        i += n or 1
    return tokens, applied


def test_thousands_of_aliases(spark):
    rng = random.Random(3)
    vocabulary = ["a", "aa", "b", "ab", "ba", "é", "日本", "x y", "", *(f"w{i}" for i in range(60))]
    aliases = [([rng.choice(vocabulary) for _ in range(rng.randint(1, 5))], f"zz{i}zz", rng.randint(0, 2)) for i in range(6000)]
    aliases += [([], "none", 0), (["a"], None, 0), (["a", None], "null", 0), (["b"], "same", 1), (["b"], "again", 1)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 40))] for _ in range(300)] + [[None, "a", None], ["a\x01", "b"], ["a"] * 3000]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, "x")], "id int, w array<string>, atom string").repartition(4)
    got = canonical.canonical(rows, "w", spark.createDataFrame(aliases, "phrase array<string>, atom string, priority int"))
    assert got.columns == ["id", "w", "atom", "tokens", "applied"]
    for r in got.collect():
        if r.w is None:
            assert r.tokens is None and r.applied is None
        else:
            tokens, applied = plain(r.w, aliases)
            assert list(r.tokens) == tokens and [tuple(x) for x in r.applied] == applied, r.w


def test_no_aliases_and_no_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], "id int, w array<string>")
    none = spark.createDataFrame([], "phrase array<string>, atom string, priority int")
    assert [(r.tokens, r.applied) for r in canonical.canonical(rows, "w", none).collect()] == [(["a", "b"], [])]
    assert canonical.canonical(rows.where("false"), "w", none).count() == 0
