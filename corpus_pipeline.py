"""From raw documents to packed token ids: language, near-duplicates, benchmark leaks, mix, output.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all
but the last return the columns of documents. Null texts count as empty; null ids survive
every stage that drops rows by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphduo.llm import bit_packing, decontamination, language_id, probminhash, raking
from graphduo.llm.common import cut
from graphduo.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a prediction outweighs a label.
CLEAR = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, with lang the predicted language.

    A label stays where the prediction contradicts it by a score under CLEAR (a short or mixed
    text), or where the model has not learned the label's language and cannot judge it.
    """
    from pyspark.sql import functions as F

    model = language_id.learn(docs)
    told = language_id.identify(docs, model, keep=COLUMNS[1:]).where(F.col("lang_pred") != language_id.UNKNOWN)
    stays = F.col("lang").isNotNull() & ((F.col("score") < CLEAR) | ~F.col("lang").isin(model.langs))
    return told.withColumn("lang", F.when(stays, F.col("lang")).otherwise(F.col("lang_pred"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id."""
    return probminhash.keep_one(docs, least=0.8).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that meet the marginals of source, language and topic."""
    return raking.standard_mix(docs).where("mix_kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in packed files, in document order: a row per document, read back from the files."""
    return bit_packing.pack_corpus(docs, vocabulary("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("pack", pack)]

#: Learned models and tokenizers are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
