"""The queries of the operators in this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, codes, decontam, license, packing, quality, rules, simhash, substring, tokencount, toxicity, urlfilter
from .session import tables


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: a toxicity score for every whole text, learnt from labels that are not held out."""
    return toxicity.report(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: words and items of the benchmark in every whole text."""
    return decontam.scan(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark")).drop("item_ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: all documents as token pieces in sequences of 1024."""
    return packing.pack_documents(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: fingerprints of three-word shingles and the groups that links of two bits make."""
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: the 20 nearest of every twentieth vector, over all rows."""
    return ann.nearest(tables(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: exact token counts of every whole text."""
    return tokencount.report(tables(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: a verdict for every page, by rule or through its aliases."""
    return urlfilter.judge(tables(spark, sf_dir, "pages"), urlfilter.RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: co-trained quality scores of every document."""
    return quality.report(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: licences of whole texts and of lines."""
    return license.scan(tables(spark, sf_dir, "documents"), license.known_digests(spark))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: words of every text that repeat a passage of a smaller document."""
    return substring.report(tables(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: what each order of five filters removes from every source."""
    return audit.report(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: every vector as 16 codebook indexes, with the error that is left."""
    return codes.report(tables(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: statistics of every whole text, the base rule, and the verdict of learnt rules."""
    return rules.report(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on instruction data, where its three limits differ: conversations packed under limits on tokens, turns and assistant tokens."""
    return packing.pack_conversations(tables(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


_OPERATORS = [
    op1_toxicity, op2_decontamination, op3_packing, op4_simhash, op5_nearest, op6_token_counts, op7_urlfilter, op8_quality, op9_license, op10_substring_dedup,
    op11_filter_audit, op12_vector_codes, op13_quality_rules, pack_conversations,
]
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {
    "op2_decontamination": decontam.oracle(), "op5_nearest": ann.oracle(), "op7_urlfilter": urlfilter.oracle(),
    "op9_license": license.oracle(), "op10_substring_dedup": substring.oracle(),
    "op11_filter_audit": audit.oracle(), "op12_vector_codes": codes.oracle(),
}
