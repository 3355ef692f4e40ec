"""The thin queries: each operator applied to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_path() -> str:
    """The byte-level BPE file; QUERN_TOKENIZER names another one."""
    if own := os.environ.get("QUERN_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse_and_render

    return collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_weights

    return mix_to_weights(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_classes

    return line_classes(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}
