"""From raw documents to packed sequences: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontam, packing, quality, simhash, substring
from matchloom.llm.session import checkpointed, shared_folder, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Whole texts that a task hands to Python at a time, so that its memory does not hold many long ones. Each stage sets it for the session, since a stage's result is computed when it is written.
TEXTS_AT_A_TIME = 500


def _few_texts(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > TEXTS_AT_A_TIME:
        spark.conf.set(name, str(TEXTS_AT_A_TIME))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject, which are those of a score of 0.5 or more.

    Null and empty texts, null ids, languages and sources are scored like others; every copy of a repeated row gets the same score; an empty table gives
    no rows; without labels of both kinds all stay; further columns go.
    """
    _few_texts(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(COLUMNS)
    return quality.scored(docs, quality.fit(docs, labels), COLUMNS).where("quality_score >= 0.5").select(COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: chains of sets of five-word shingles that are at least 0.8 alike.

    SimHash's trie proposes links, whole sets confirm them, and bands of minima add the links that 64 bits cannot show (see simhash.near_copies).
    The row of the smallest doc_id stays, nulls last, then that of the smallest number. Decisions are by row: of two rows of one id, each is judged by its own text.
    Null, empty and wordless texts are one group; repeated rows are one text; an empty table gives no rows; further columns go.
    """
    _few_texts(spark)
    at = f"{shared_folder(spark)}/near-copies-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"
    docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS).write.parquet(at)
    rows = spark.read.parquet(at)
    gone = checkpointed(simhash.near_copies(rows).where("row != kept").select("row"))
    return without(rows, gone, "row").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the words of 13-word windows that also start in a document of a smaller id; n_chars follows the text.

    Null texts stay null, rows with a null id and rows of one id are not compared, a text that loses no word stays byte for byte, one that loses all is
    empty; no row goes; an empty table gives no rows; further columns go.
    """
    _few_texts(spark)
    return substring.cleaned(docs.select(COLUMNS), COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; ids play no part; an empty benchmark takes no row away; further columns go.
    """
    _few_texts(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.scan(docs, items, keep=tuple(COLUMNS)).where("not contaminated").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids; null and empty texts are one piece of the end id, repeated rows and rows without an id are packed each."""
    _few_texts(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_leaks),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is kept in the folder that the cluster shares."""
    at = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs.select(*(F.col(c) for c in docs.columns))
