"""What the composite queries share: tables, and derived columns whose SQL is the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import readings as rd
from matchloom.functions import text as tx
from matchloom.sources.readers import table

__all__ = ["query_into", "table", "sql_key", "sql_lookalikes", "sql_norms", "sql_search_key", "sql_tokens", "sql_words", "gallery", "vector_queries"]


def query_into(queries: dict, oracles: dict):
    """A decorator that registers a query under its name, with its SQL if it has one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{tx.WORD}')"


def sql_tokens(x: str) -> str:
    return f"list_filter({sql_words(x)}, lambda w: length(w) > 1 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$'))"


def _sql_replaced(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def _sql_squeezed(x: str) -> str:
    """Runs of one letter a-z made one."""
    return f"list_reduce(string_split({x}, ''), lambda a, b: CASE WHEN right(a, 1) = b AND b BETWEEN 'a' AND 'z' THEN a ELSE a || b END)"


def _sql_latin(x: str, letters: str, values: list[str]) -> str:
    table = "MAP {" + ", ".join(f"'{c}': '{v}'" for c, v in zip(letters, values, strict=True)) + "}"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({table}[c], c)), '')"


def sql_search_key(x: str) -> str:
    """readings.search_key of a lower-case word without look-around or back-references."""
    out = _sql_replaced(_sql_latin(x, rd.SEARCH_CYRILLIC, rd.SEARCH_LATIN), [("ch", "sh"), ("c([eiy])", r"s\1"), ("ck", "k"), ("c", "k"), *rd.SEARCH_RULES])
    return f"regexp_replace({_sql_squeezed(out)}, '[^a-z0-9]', '', 'g')"


def sql_norms(x: str) -> str:
    """The parts of a word's normal form."""
    return f"regexp_extract_all({_sql_latin(f'strip_accents(lower({x}))', rd.CYRILLIC, rd.IN_LATIN)}, '[a-z0-9]+')"


def sql_key(x: str) -> str:
    """readings.key without look-around or back-references: what stands around is matched and put back."""
    first = [
        ("tsch|tch", "ch"), ("shch|sch", "sh"), ("ch", "sh"), ("ph", "f"), ("th", "t"), ("rh", "r"), ("gh", "g"), ("kh", "h"), ("dzh", "g"), ("gi([aou])", r"g\1"), ("gn", "n"), ("eaux?", "o"), ("au", "o"),
        ("x", "ks"), ("([a-z]{3}[a-su-z])s$", r"\1"), ("nc$", "n"), ("([aeiou])t$", r"\1"), ("ck", "k"), ("qu?", "k"), ("c([eiy])", r"s\1"), ("c", "k"), ("tz", "ts"), ("w", "v"), ("ou", "u"), ("j", "y"),
        ("ye", "e"), ("yo", "o"), ("y", "i"),
    ]
    out = _sql_squeezed(_sql_replaced(x, first))
    return _sql_squeezed(_sql_replaced(out, [("iu", "u"), ("ia", "a"), ("ie", "i"), ("([aeiou])h$", r"\1")]))


def _sql_converted(plain: str, native: str, keys: str, values: str) -> str:
    table = "MAP {" + ", ".join(f"'{c}': '{v}'" for c, v in zip(keys, values, strict=True)) + "}"
    chars = f"list_transform(string_split({plain}, ''), lambda c: CASE WHEN regexp_matches(c, '^[{native}]$') THEN c ELSE {table}[c] END)"
    return f"CASE WHEN NOT list_bool_or(list_transform({chars}, lambda c: c IS NULL)) THEN array_to_string({chars}, '') END"


def sql_lookalikes(plain: str, norm: str) -> str:
    """Other normal forms of a decomposed word, the first two."""
    other = dict(zip(*rd.TO_CYRILLIC, strict=True)) | dict(zip(*rd.OTHER_CYRILLIC, strict=True))
    cyrillic = [_sql_converted(plain, "Ѐ-ӿ", *rd.TO_CYRILLIC), _sql_converted(plain, "Ѐ-ӿ", "".join(other), "".join(other.values()))]
    latin = _sql_converted(plain, "A-Za-z", *rd.TO_LATIN)
    n_lat, n_cyr = (f"length(regexp_replace({plain}, '[^{kind}]', '', 'g'))" for kind in ("A-Za-z", "Ѐ-ӿ"))
    every = f"CASE WHEN {n_cyr} >= {n_lat} THEN [{', '.join(cyrillic)}, {latin}] ELSE [{latin}, {', '.join(cyrillic)}] END"
    forms = f"list_transform(list_filter({every}, lambda v: v IS NOT NULL), lambda v: {sql_norms('v')})"
    kept = f"list_transform(list_filter({forms}, lambda f: len(f) = 1 AND f[1] <> {norm}), lambda f: f[1])"
    distinct = f"list_reduce(list_transform({kept}, lambda f: [f]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END, []::VARCHAR[])"
    mixed = f"({n_lat} > 0 AND {n_cyr} > 0) OR (({n_lat} > 0 OR {n_cyr} > 0) AND regexp_matches({plain}, '[0346]'))"
    return f"CASE WHEN {mixed} THEN {distinct}[1:2] ELSE []::VARCHAR[] END"


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as rows of a gallery: entity = label, channel = parity of the id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("entity"), (F.col("vec_id") % 2).cast("int").alias("channel"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 100, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.col("embedding").alias("vector"))


#: (query_id, truth, channel, entity, score, row_id, rank, margin, gap) by channel, as common table expressions.
SQL_RANKS = """
g AS (SELECT vec_id AS row_id, label AS entity, (vec_id % 2)::INT AS channel, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label AS truth, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT q.query_id, g.channel, g.entity, g.row_id, list_inner_product(q.v, g.v) AS s FROM q JOIN g ON g.row_id <> q.query_id),
best AS (SELECT query_id, channel, entity, max(s) AS score, arg_min(row_id, (-s, row_id)) AS row_id FROM pairs GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS margin, first_value(score) OVER w - score AS gap FROM best WINDOW w AS (PARTITION BY query_id, channel ORDER BY score DESC, entity))"""
