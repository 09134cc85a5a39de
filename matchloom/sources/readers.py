"""Sources: tables, JSON, JSON lines, manifests, raw lines filtered before they are parsed, verified bundles, binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole JSON documents, gzip included; a document that does not fit the schema raises."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip included; blank lines are skipped, and a line that does not parse raises."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def filtered_lines(spark: SparkSession, path: str, pattern: str, schema: T.StructType | str, check: Column | None = None) -> DataFrame:
    """Lines that match a pattern, parsed after that; `check` is the exact condition, on the parsed columns."""
    raw = spark.read.text(path).where(F.col("value").rlike(pattern))
    out = raw.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")
    return out if check is None else out.where(check)


def found_in_lines(spark: SparkSession, path: str, pattern: str, group: int = 0) -> DataFrame:
    """(found): distinct matches in raw text, nothing parsed."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("found")).distinct()


def manifest(spark: SparkSession, path: str, id_pattern: str = r"^[A-Za-z0-9._-]+$") -> DataFrame:
    """A tab-separated manifest (query_id, image_path) with a header; CRLF is tolerated.

    Any bad row raises: an id that is missing, repeated or of another form, a path that is empty, absolute or climbs.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, image_path string", mode="FAILFAST", enforceSchema=False)
    rows = rows.select("query_id", F.regexp_replace("image_path", r"\r$", "").alias("image_path"))
    bad = F.coalesce(~F.col("query_id").rlike(id_pattern), F.lit(True)) | F.coalesce(~safe_path(F.col("image_path")), F.lit(True))
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("ids"), F.count_if(bad).alias("bad")).first()
    if seen["bad"] or seen["n"] != seen["ids"]:
        raise ValueError(f"manifest {path}: {seen['bad']} bad rows, {seen['n'] - seen['ids']} repeated or missing ids")
    return rows


def safe_path(path: Column) -> Column:
    """Relative, not empty, and without a '..' part."""
    return (path != "") & ~path.rlike(r"^[/\\]") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, name, length, sha256, modified): all files below a folder, content hashed where they lie; with `content`, the bytes too."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    cols = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified")]
    return raw.select(*cols, *(["content"] if content else []))


def verified(found: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, expected, actual, ok) for every pinned file (name, sha256); a file that is absent or occurs twice is not ok."""
    have = found.groupBy("name").agg(F.count("*").alias("n"), F.max("sha256").alias("actual"))
    return pins.select("name", F.col("sha256").alias("expected")).join(have, "name", "left").select("name", "expected", "actual", (F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.lit(1)) & F.col("actual").eqNullSafe(F.col("expected"))).alias("ok"))


def first_by_key(rows: DataFrame, key: str) -> DataFrame:
    """The row of the first file, by path, of each key; rows need a `_file` column (see with_file)."""
    from matchloom.operators.governance import first_wins

    return first_wins(rows, key, [F.col("_file")])


def with_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def checked_scores(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows of at least `least`; a score that is null, NaN or outside 0..1 raises when it is read, and is not filtered."""
    s = F.col(score)
    ok = s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s <= 1)
    return rows.withColumn(score, F.when(ok, s).otherwise(F.raise_error(F.concat(F.lit(f"{score} is not in 0..1: "), F.coalesce(s.cast("string"), F.lit("null")))).cast("double"))).where(F.col(score) >= least)


def card_or_bare(keys: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """keys with their card's columns and `known`; a well-formed key without a card gets nulls and known = false."""
    return keys.join(cards.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
