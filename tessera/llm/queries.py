"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_conversations(rows))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    model = tokenizer_path("piece_bpe_32k.model")
    return pieces.digest(pieces.decode_documents(pieces.encode_documents(table(spark, sf_dir, "documents"), model), model))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.digest(repair.repair(repair.find_faults(repair.damage(table(spark, sf_dir, "conversations")))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_near_dedup, op2_lm_scoring, op3_toxicity, op4_substring_dedup, op5_quality_classifier, op6_best_fit_packing, op7_ngram_jaccard_join, op8_chat_formatting, op9_pii_surrogates, op10_benchmark_decontamination, op11_sentencepiece, op12_spelling_variants, op13_conversation_repair, pipeline)}
