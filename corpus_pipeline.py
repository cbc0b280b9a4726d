"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, writes Parquet to the shared
folder and hands on the table it reads back.

Defined results: a null or empty text is scored by the classifier's bias and, if
kept, has no copies but equal ones, no passages and no secrets, and packs as its
end token; null ids and repeated rows are rows of their own, but for exact
copies, of which one stays; an empty table packs to none; further columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdplan.llm import decontaminate, near_dup, packing, quality, secret_scan
from herdplan.llm.common import discard, materialised, table

#: Words of a benchmark item from which on it makes a document contaminated.
LEAST_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= quality.THRESHOLD).drop("score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; items of fewer than
    LEAST_WORDS words, which occur in any text, are no passage."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; a
    column ``n_chars`` follows the text."""
    out = secret_scan.without_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packing are not expressible in SQL; the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialised(stage(spark, docs, sf_dir))
        discard(before)  # of what was written here only
    return STAGES[-1][1](spark, docs, sf_dir)
