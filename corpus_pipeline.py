"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Rows without an id go through like others, but never as one group. A table without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, language_id, mixing, ngram_join, secret_scan
from factloom.llm.common import cut, drop_path, fresh_path, table


def _whole(docs: DataFrame) -> DataFrame:
    """docs with each row also as one column, so that no column of a document clashes with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *[F.col(c) for c in ("doc_id", "text", "lang", "source")])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents rejected as no text in a learned language; with nothing to learn from, all stay."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    return language_id.predict(_whole(docs), model, keep=["_row"]).filter(~F.col("rejected")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays, once; where one doc_id stands on rows of
    different texts, each of these texts stays with it."""
    groups = cut(ngram_join.join(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    go = groups.filter("doc_id is not null and not kept").select("doc_id")
    if go.count() <= ngram_join.FEW:
        go = F.broadcast(go)
    rest = docs.join(go, "doc_id", "left_anti").select(*docs.columns)
    repeated = groups.filter("doc_id is not null and kept and n > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    twice = _whole(rest.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    # The least row of each text, so that reruns agree.
    twice = twice.groupBy("doc_id", F.md5("text").alias("_text")).agg(F.min("_row").alias("_row")).select("_row.*")
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the scan becomes [SECRET]; n_chars follows the text."""
    masked = secret_scan.redact(_whole(docs).select("_row", "text"))
    return masked.select(F.col("_row").withField("text", F.col("text")).withField("n_chars", F.char_length("text").cast("long")).alias("_row")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    mixed = mixing.mix(_whole(docs), keep=["_row"])
    return mixed.filter("repeats > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select("_row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, exact: the decoded ids are the text."""
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: Language models and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
