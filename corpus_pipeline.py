"""A training-data pipeline over ``documents``: language ID, near-duplicate removal, decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, langid, near
from ferrule.llm.queries import in_fold, table
from ferrule.llm.shelf import Shelf


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    model = langid.fit(docs.where(~in_fold("doc_id", 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model, label_as="__lang", score_as="__score").where("__lang <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are connected by similarities of 0.8 or more."""
    return near.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the bytes decoded from them.

    This is the last stage: of the documents' columns only doc_id is left.
    """
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("encoded", encoded)]

#: The near-duplicate search and the encoding have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    shelf = Shelf(spark, "pipeline")
    out = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, out = out, stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = shelf.put(out)
            if i:
                shelf.drop(before)
    return out
