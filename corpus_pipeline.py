"""The corpus pipeline: language, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns documents with the same columns, but for
the last, which returns what the encoding says about each document. ``run`` writes each
stage's result as Parquet into the shared checkpoint folder and reads it again; a stage's
folder is removed once the next one is written.

Defined cases, for all stages: null ids, sources and languages are values like any other; an
empty table gives an empty result with the same columns; columns beyond those of documents
are dropped by the first stage. A null or empty text, or one without a letter, is rejected by
``language``; given to a later stage, ``near_duplicates`` takes all of them for one text,
``secrets`` leaves it as it is, ``mixing`` never takes it and ``encoding`` gives it no token.
Very long texts are worked through whole. Repeated rows are one document to
``near_duplicates``; the other stages treat each of them alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe_chunks, language_id, secret_scan, simhash_dedup, source_mix
from weftgraph.llm.common import table
from weftgraph.sources.folders import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of which no language explains this share of the n-grams are rejected.
LEAST_SHARE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or that no learned language explains; sets a missing ``lang``."""
    found = language_id.identify(docs, language_id.fit(docs), keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("share") >= LEAST_SHARE))
    return kept.select(*[F.coalesce("in_lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"in_{c}").alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id."""
    return simhash_dedup.one_of_each(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; copied examples keep their text."""
    return secret_scan.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops documents so that each source's words come near its target."""
    return source_mix.mixed(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless) of each document."""
    return bpe_chunks.encode_decode(docs, bpe_chunks.tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Language filters, fingerprints and byte-pair merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
