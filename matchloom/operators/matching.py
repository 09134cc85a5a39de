"""Graded matches of tokens and phrases, by equi-joins on forms, keys and what is left of keys without a letter or two.

Words are read once: a dictionary has a row for each distinct word, with its forms and keys, and each pair of a word and a claim is graded once, whatever the number of lines and cards that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import readings as rd
from matchloom.functions import text as tx

from .graph import checkpointed, sided
from .retrieval import left_out


def dictionary(words: DataFrame, word: str) -> DataFrame:
    """(word, part, forms, keys, script) of distinct words (see readings.pieces), written: forms are the normal form and those of look-alikes, keys their phonetic keys.

    A word whose normal form has gaps has a row for each part, from 0, and one form in each; words without a normal form have no rows.
    """
    own = words.select(F.col(word).alias("word")).where("word is not null").distinct().withColumn("d", rd.decomposed("word"))
    own = checkpointed(own.select("word", F.col("d.plain").alias("plain"), rd.latin(F.col("d.lower")).alias("norms")))
    parts = own.select("word", "plain", "norms", F.posexplode("norms").alias("part", "norm"))
    forms = F.when(F.size("norms") == 1, F.concat(F.array("norm"), rd.lookalikes(F.col("plain"), F.col("norm")))).otherwise(F.array("norm"))
    read = parts.select(F.col("word").alias(word), "part", forms.alias("forms"), rd.script(F.col("plain")).alias("script"))
    return checkpointed(read.withColumn("keys", F.transform("forms", rd.key)))


def token_matches(words: DataFrame, claims: DataFrame, word: str = "word", claim: str = "claim") -> DataFrame:
    """(word, part, claim, rank): parts of words and normal forms that match, at the best kind (see match.KINDS): the form itself, another form, one key (of three letters on), near keys.

    words: a dictionary; claims: normal forms. Near keys share a rest without the one or two letters that may differ, so that keys of one beginning are not all compared.
    """
    wanted = checkpointed(claims.select(F.col(claim).alias("claim")).where("claim != ''").distinct().withColumn("key", rd.key(F.col("claim"))))
    forms = words.select(F.col(word).alias("word"), "part", F.posexplode("forms").alias("at", "claim"))
    keys = words.select(F.col(word).alias("word"), "part", F.explode(F.array_distinct("keys")).alias("key"))
    same = forms.join(wanted.select("claim"), "claim").select("word", "part", "claim", F.when(F.col("at") == 0, 0).otherwise(1).alias("rank"))
    alike = keys.join(wanted.where(F.length("key") >= 3), "key").select("word", "part", "claim", F.lit(2).alias("rank"))
    most = F.when(F.length("key") >= 9, 2).otherwise(1)
    rests = lambda side: side.select("key").where((F.length("key") >= 5) & ~F.col("key").rlike("[0-9]")).distinct().select("key", F.explode(left_out(F.col("key"), most)).alias("rest"))
    pairs = rests(keys).join(rests(wanted).withColumnRenamed("key", "other"), "rest").where("key != other").select("key", "other").distinct().where(rd.near(F.col("key"), F.col("other")))
    close = keys.join(checkpointed(pairs), "key").join(wanted.withColumnRenamed("key", "other"), "other").select("word", "part", "claim", F.lit(3).alias("rank"))
    best = same.union(alike).union(close).groupBy("word", "part", "claim").agg(F.min("rank").alias("rank"))
    return best.withColumnsRenamed({"word": word, "claim": claim})


def line_tokens(lines: DataFrame, line: str, text: str, words: DataFrame, word: str = "word", years: bool = False) -> DataFrame:
    """(line, pos, word, part): the tokens of lines in order, from 0; years go unless they are asked for. words: a dictionary that holds the pieces of the lines."""
    placed = lines.select(line, F.posexplode(rd.pieces(F.col(text))).alias("place", word))
    own = words.select(word, "part", F.col("forms")[0].alias("norm"))
    own = own if years else own.where(~rd.is_year(F.col("norm")))
    w = Window.partitionBy(line).orderBy("place", "part")
    return placed.join(own, word).withColumn("pos", F.row_number().over(w) - 1).select(line, "pos", word, "part")


def phrase_matches(tokens: DataFrame, phrases: DataFrame, known: DataFrame, line: str, phrase: str, claims: str = "claims", word: str = "word") -> DataFrame:
    """(line, phrase, start, weakest, total): where all words of a phrase stand in a row in a line, each matched in some kind; the best place by (weakest kind, sum of kinds, start).

    tokens: see line_tokens; phrases: phrase and an array of normal forms, of which years and empty ones do not count; known: see token_matches. Places come from the word of a phrase that the
    fewest tokens match; the other words are looked up there.
    """
    own = phrases.select(F.col(phrase), F.filter(claims, lambda c: (c != "") & ~rd.is_year(c)).alias("own")).where(F.size("own") > 0)
    want = checkpointed(own.select(phrase, F.size("own").alias("n"), F.posexplode("own").alias("k", "claim")))
    held = tokens.groupBy(word, "part").agg(F.count("*").alias("n_held"))
    often = known.join(held, [word, "part"]).groupBy("claim").agg(F.sum("n_held").alias("n_held"))
    # a phrase with a word that no token matches is in no line
    rarest = want.join(often, "claim", "left").groupBy(phrase, "n").agg(F.count("n_held").alias("met"), F.min(F.struct("n_held", "k", "claim")).alias("a")).where("met = n")
    anchors = sided(checkpointed(rarest.select(phrase, "n", F.col("a.k").alias("k"), F.col("a.claim").alias("claim"))))
    at = tokens.join(known.drop("rank").join(anchors, "claim"), [word, "part"]).select(line, phrase, "n", (F.col("pos") - F.col("k")).alias("start")).where("start >= 0").distinct()
    each = checkpointed(at).select(line, phrase, "n", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("pos", F.col("start") + F.col("k"))
    graded = each.join(want.select(phrase, "k", "claim"), [phrase, "k"]).join(tokens, [line, "pos"]).join(known, [word, "part", "claim"])
    runs = graded.groupBy(line, phrase, "start", "n").agg(F.count("*").alias("found"), F.max("rank").alias("weakest"), F.sum("rank").alias("total")).where("found = n")
    best = runs.groupBy(line, phrase).agg(F.min(F.struct("weakest", "total", "start")).alias("b"))
    return best.select(line, phrase, F.col("b.start").alias("start"), F.col("b.weakest").alias("weakest"), F.col("b.total").alias("total"))


def recovered(spans: DataFrame, fields: DataFrame, key: str, span: str, field: str, text: str) -> DataFrame:
    """(key, span, field, start, weakest): of lost spans of a card, those that one of its fields holds in another script: all words of the span in a row in the field.

    spans: (key, span); fields: (key, field, text). Two words match if one is the other's form, or they have one key, in either direction; unless the forms are equal they must have no digit, and be of
    different scripts or one of both. Near keys never count. A span whose words are not single tokens is not recovered. Of several fields the least name counts, and there the first place.
    """
    said, held = spans.select(key, span).where(F.col(span).isNotNull()).distinct(), fields.select(key, field, text).distinct()
    pieces = said.select(F.explode(rd.pieces(F.col(span))).alias("word")).union(held.select(F.explode(rd.pieces(F.col(text))).alias("word")))
    words = dictionary(pieces, "word")
    norms = words.select("word", "part", "script", F.col("forms")[0].alias("claim"))
    one_way = token_matches(words, norms).where("rank < 3")
    a, b = (norms.select(F.col("word").alias(f"{x}_word"), F.col("part").alias(f"{x}_part"), F.col("script").alias(f"{x}_script"), F.col("claim").alias(f"{x}_norm")) for x in "ab")
    forth = one_way.withColumnsRenamed({"word": "a_word", "part": "a_part", "claim": "b_norm"}).join(a, ["a_word", "a_part"]).join(b, "b_norm")
    back = one_way.withColumnsRenamed({"word": "b_word", "part": "b_part", "claim": "a_norm"}).join(b, ["b_word", "b_part"]).join(a, "a_norm")
    both = forth.unionByName(back).groupBy("a_word", "a_part", "b_word", "b_part", "a_script", "b_script").agg(F.min("rank").alias("rank"))
    digits = F.concat("a_word", "b_word").rlike(r"\p{Nd}")
    other = (F.col("a_script") == "mixed") | (F.col("b_script") == "mixed") | F.array_sort(F.array("a_script", "b_script")).eqNullSafe(F.array(F.lit("cyrillic"), F.lit("latin")))
    pairs = checkpointed(both.where((F.col("rank") == 0) | (~digits & other)).select("a_word", "a_part", "b_word", "b_part", "rank"))
    numbered = lambda rows: rows.withColumn("line", F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]))
    said, held = checkpointed(numbered(said)), checkpointed(numbered(held))
    words_of = lambda rows, x, name: line_tokens(rows, "line", x, words, years=True).withColumnsRenamed({"line": f"{name}_line", "pos": f"{name}_pos", "word": f"{name}_word", "part": f"{name}_part"})
    s, f = checkpointed(words_of(said, span, "a")), words_of(held, text, "b")
    sizes = s.groupBy("a_line").agg(F.count("*").alias("n")).join(said.select(F.col("line").alias("a_line"), key, span), "a_line").where(F.col("n") == F.size(F.filter(F.split(span, r"\s+"), lambda x: x != "")))
    placed = f.join(held.select(F.col("line").alias("b_line"), key, field), "b_line")
    met = s.join(sizes, "a_line").join(pairs, ["a_word", "a_part"]).join(placed, [key, "b_word", "b_part"]).withColumn("start", F.col("b_pos") - F.col("a_pos")).where("start >= 0")
    runs = met.groupBy(key, span, field, "b_line", "start", "n").agg(F.count("*").alias("found"), F.max("rank").alias("weakest")).where("found = n")
    best = runs.groupBy(key, span).agg(F.min(F.struct(field, "start", "weakest")).alias("b"))
    return best.select(key, span, F.col(f"b.{field}").alias(field), F.col("b.start").alias("start"), F.col("b.weakest").alias("weakest"))


def lost_phrases(lines: DataFrame, before: DataFrame, after: DataFrame, key: str, words: str, field: str, least: int = 2, most: int = 4) -> DataFrame:
    """(key, phrase): runs of `least` to `most` words of a line that a field of the old card holds and none of the new card. lines, before, after: key and words or a field's normal form."""
    def runs(n: int):
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    said = lines.select(key, F.explode(F.array_distinct(F.concat(*map(runs, range(least, most + 1))))).alias("phrase")).distinct()
    held = lambda card: said.join(card.select(key, F.col(field).alias("field__")), key).where(tx.contains_phrase(F.col("field__"), F.col("phrase"))).select(key, "phrase").distinct()
    return held(before).join(held(after), [key, "phrase"], "left_anti")


def traced(observations: DataFrame, supplements: DataFrame, key: str, block: str) -> DataFrame:
    """(key, block, first, matched): supplement blocks found as the last rows of a key's observations, the last block last.

    observations: key, pos from 0, text; supplements: key, block (in order), pos from 0, text. A block is matched if its rows and those of all later blocks stand at the end, in order.
    """
    sizes = observations.groupBy(key).agg(F.count("*").alias("n"))
    lengths = supplements.groupBy(key, block).agg(F.count("*").alias("m"))
    later = F.sum("m").over(Window.partitionBy(key).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, 0))
    placed = lengths.withColumn("tail", later).join(sizes, key, "left").withColumn("first", F.coalesce("n", F.lit(0)) - F.col("tail"))
    rows = supplements.join(placed.select(key, block, "first"), [key, block]).withColumn("at", F.col("first") + F.col("pos"))
    seen = observations.select(key, F.col("pos").alias("at"), F.col("text").alias("seen"))
    ok = rows.join(seen, [key, "at"], "left").groupBy(key, block, "first").agg(F.min(F.col("seen").eqNullSafe(F.col("text"))).alias("own"))
    whole = F.min("own").over(Window.partitionBy(key).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, 0))
    return ok.select(key, block, F.when(whole, F.col("first")).alias("first"), whole.alias("matched"))
