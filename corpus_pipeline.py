"""A corpus pipeline: documents in, clean and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and returns a frame; the stages before the last keep the
columns of documents as they are. Nulls, empty texts and repeated rows are handled as the operators
state; extra columns pass through, but for the last stage, which returns ids and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, decontaminate, language, secrets, simhash
from tallyloom.llm.common import cut, free_name

#: A text of at least so many distinct n-grams that is further from all profiles than this is in none of their languages.
LEAST_GRAMS, LEAST_SCORE = 60, 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, labelled with it: lang (if there is such a column) becomes the prediction.

    Documents without a letter go, and longer ones (from LEAST_GRAMS n-grams) that no profile describes (score below
    LEAST_SCORE). Profiles come from the rows' own labels; without any label nothing is known, every document
    with a letter stays and lang stays null. Ties go to the name that sorts first; repeated rows all stay or all go;
    a null or empty text has no letter; a very long text is read whole; an empty table gives no row.
    """
    pred, score, size = (free_name(docs, f"_lang_{x}") for x in ("pred", "score", "size"))
    # a name with a mark is no label "und"; without any label, one empty profile takes every text with a letter
    known = {f"={k}": v for k, v in language.profiles(docs).items()}
    marked = language.with_language(docs, known or {"=": []}, pred, score, size=size).where(F.col(pred) != "und")
    if known:
        marked = marked.where((F.col(score) >= LEAST_SCORE) | (F.col(size) < LEAST_GRAMS))
        marked = marked.withColumn("lang", F.substring(pred, 2, 1 << 30)).select(*docs.columns)
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one of the smallest id (a null id is the greatest).

    Of repeated rows one stays, of equal ids with different texts the one of the least fingerprint and hash. Null, empty and blank texts are copies
    of each other; a very long text is hashed whole; an empty table gives no row.
    """
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; repeated rows all stay or all go.

    Null and empty texts have no words and stay; a very long text is scanned whole; with an empty benchmark all stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets replaced by [SECRET] and widely copied examples by [EXAMPLE], n_chars by the new length.

    Owners are counted over the documents that reach this stage. A null text stays null, repeated rows get equal texts, overlapping
    spans become one mark, a very long text is searched whole, an empty table gives no row.
    """
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its ids, their number and digest, the digest of the decoded bytes, and its language (where there is a column lang).

    Null and empty texts have no ids; repeated rows get equal rows; a very long text is encoded whole; an empty table gives no row.
    """
    keep = ("lang",) if "lang" in docs.columns else ()
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_level_bpe", tokens),
]

#: Rank-order profiles, components and byte-pair merges have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
