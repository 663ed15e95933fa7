"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm import decontamination, language, minhash, packing, secrets
from varigrid.llm.common import dropped, fold, new_path, table

#: Bytes, about, of the words that a worker keeps after the packing stage: workers outlive a stage, and the next run's first
#: stage needs their memory.
REMEMBERED = 24 << 20


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that it rejects go, as :func:`varigrid.llm.language.known` says.

    Rejected are null and empty texts and others without a letter, and texts of 200 letters or more that are like none
    of the learned languages. Very long texts are read whole; repeated rows and rows without an id are judged like
    others; an empty table stays empty; the other columns, whatever their names, stay as they are.
    """
    return language.known(docs, fold(F.col("doc_id"), 5) != 0)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays, the one with the smallest id.

    Rows are judged by id and text: of repeated rows one stays, and a text stays if it is like no other, whatever else
    its id holds. Rows without an id are judged like others and come last; null and empty texts are like nothing; very
    long texts are read whole; an empty table stays empty; the other columns stay as they are.
    """
    return minhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that contain a benchmark item go, repeated rows and rows without an id too.

    Null and empty texts hold no item; very long texts are read whole; without documents or items nothing changes; the
    other columns stay as they are.
    """
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the values of secrets that look live are replaced, and ``n_chars`` with them; every row stays.

    Null and empty texts stay as they are; very long texts are scanned whole; repeated rows are changed alike; a null
    source is one unknown owner; an empty table stays empty; the other columns stay as they are.
    """
    return secrets.redacted(docs, F.col("source"), secrets.owner_of(F.col("source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of every document and their places in sequences of 1024 ids.

    Null and empty texts are one id; very long texts are cut into pieces; repeated rows and rows without an id are
    packed as they come; an empty table gives no pieces; the other columns are not carried.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [("language ID", language_stage), ("MinHash near-dedup", minhash_stage), ("benchmark decontamination", decontamination_stage), ("secret scans", secrets_stage), ("best-fit packing", packing_stage)]

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            dropped(docs)
        docs = spark.read.parquet(path)
    return docs
