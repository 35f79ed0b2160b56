"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from bendpoint.llm import decontam, langid, linededup, packing, simhash
from bendpoint.llm.common import fresh_names, scratch_folder


LEAST_SCORE = 0.5
CACHE_PIECES = 900_000  # executors that ran the stages before have less memory to spare than packing's alone

# Every stage takes rows as they are: null, empty and very long texts, null languages and repeated rows
# have the results that its operator's docstring states, an empty table gives an empty one, and a column
# of the documents that is named like a result of the operator keeps its own values.


def _apart(docs: DataFrame, *results: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns named like `results` under other names, and the columns that bring all back."""
    clashing = [c for c in docs.columns if c.lower() in results]
    held = dict(zip(clashing, fresh_names(docs, *(f"own_{c}" for c in clashing)), strict=True))
    return docs.withColumnsRenamed(held), [F.col(held.get(c, c)).alias(c) for c in docs.columns]


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a posterior of LEAST_SCORE or more.

    A text that is null or has no letter has no language and goes.
    """
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    apart, own = _apart(docs, "lang_pred", "score")
    out = langid.identify(apart, model)
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat in other documents; n_chars follows. Emptied documents stay, null texts as empty ones."""
    apart, own = _apart(docs, "n_lines", "n_dropped")
    return linededup.dedup_lines(apart).withColumn("n_chars", F.char_length("text").cast("long")).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; texts without words are copies."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; texts without words have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    apart, own = _apart(docs, "n_words", "n_hit", "n_items", "items", "contaminated")
    return decontam.decontaminate(apart, benchmark).filter(~F.col("contaminated")).select(*own)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cache_pieces=CACHE_PIECES)


STAGES = [
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", packed_sequences),
]
ORACLE_SQL = None  # language ID and the fingerprints' majority bits are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each but the last is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
