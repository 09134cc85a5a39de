"""Aliases in running words: left to right, the longest alias at each place is replaced by its atom."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aliases that are sent to the tasks at most; more are an error.
MOST_ALIASES = 1_000_000
_SCHEMA = [
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("applied", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("atom", T.StringType())]))),
]
_EDGE = "\x01"


def _spelt(words: list[str]) -> str:
    """Words between marks of their own, so that a run of words is a run of characters that begins and ends at marks."""
    return "".join(f"{_EDGE}{w}{_EDGE}" for w in words)


def canonical(rows: DataFrame, words: str, aliases: DataFrame) -> DataFrame:
    """rows with tokens, the words with aliases replaced by atoms, and applied, the (pos, phrase, atom) of those replaced, pos counting words from 0.

    words: an array of words; aliases: (phrase, an array of words; atom; priority). At each place the longest phrase counts, of equal phrases the one of the least priority, then the least atom; its words are passed over. All phrases
    are looked for at once: a task builds one automaton of them, and reads every text once. Null words and words with the mark U+0001 match nothing; null arrays give nulls; empty phrases and
    null atoms are no aliases; other columns of rows stay.
    """
    best = Window.partitionBy("phrase").orderBy("priority", "atom")
    own = aliases.where((F.size("phrase") > 0) & ~F.exists("phrase", lambda w: w.isNull() | w.contains(_EDGE)) & F.col("atom").isNotNull())
    own = own.withColumn("r__", F.row_number().over(best)).where("r__ = 1").select("phrase", "atom")
    found = own.limit(MOST_ALIASES + 1).collect()
    if len(found) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([(list(r["phrase"]), r["atom"]) for r in found])
    kinds = rows.schema
    place = rows.columns.index(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase, atom in sent.value:
            automaton.add_word(_spelt(phrase), (len(phrase), " ".join(phrase), atom))
        if sent.value:
            automaton.make_automaton()

        def replaced(own: list | None) -> tuple[list | None, list | None]:
            if own is None or not sent.value:
                return own, None if own is None else []
            barred = {i for i, w in enumerate(own) if w is None or _EDGE in w}
            text = _spelt(["" if i in barred else w for i, w in enumerate(own)])
            starts, at = {}, 0
            for i, w in enumerate(own):
                starts[at] = i
                at += 2 + (0 if i in barred else len(w))
            longest: dict[int, tuple] = {}
            for end, (n, phrase, atom) in automaton.iter(text):
                begin = starts.get(end + 1 - len(phrase) - n - 1)  # one space fewer than words, two marks a word
                if begin is not None and n > longest.get(begin, (0,))[0] and not (barred and barred & set(range(begin, begin + n))):
                    longest[begin] = (n, phrase, atom)
            tokens, applied, i = [], [], 0
            while i < len(own):
                n, phrase, atom = longest.get(i, (0, None, None))
                if n:
                    applied.append({"pos": i, "phrase": phrase, "atom": atom})
                tokens.append(atom if n else own[i])
                i += n or 1
            return tokens, applied

        for batch in batches:
            both = [replaced(x) for x in batch.column(place).to_pylist()]
            more = [pa.array([b[0] for b in both], pa.list_(pa.string())), pa.array([b[1] for b in both], pa.list_(pa.struct([("pos", pa.int32()), ("phrase", pa.string()), ("atom", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "tokens", "applied"])

    return rows.mapInArrow(run, T.StructType([*kinds.fields, *_SCHEMA]))
