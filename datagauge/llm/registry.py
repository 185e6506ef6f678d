"""Queries of this subpackage, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datagauge.llm.frames import table
from datagauge.llm.oracles import ORACLES

#: The folder of tokenizer files is a parameter: the installed package's, unless the session names another.
TOKENIZERS = "spark.datagauge.tokenizers"


def tokenizer(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get(TOKENIZERS, "")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from public_tokenizers import PATTERN

    from datagauge.llm.byte_bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer(spark, "byte_bpe_multi_50k.tiktoken"), PATTERN, output=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector, by a cosine of 0.95."""
    from datagauge.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95).select("vec_id", "n_links", "component_id", "kept")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, by 2-word shingles and a similarity of 0.8."""
    from datagauge.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from datagauge.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    from datagauge.llm.toxicity import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.5, ["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, first_term, n_terms of every benchmark item found in a document."""
    from datagauge.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)


def op7_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, shard, doc_id, seq_no, n_tokens, sha256 of every sequence; the digest is of the row as read back from its shard."""
    import uuid

    from public_tokenizers import PATTERN

    from datagauge.llm.frames import shared_dir
    from datagauge.llm.shards import materialise

    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return materialise(table(spark, sf_dir, "documents"), path, tokenizer(spark, "byte_bpe_multi_50k.tiktoken"), PATTERN, 512, rows=8192)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    from datagauge.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer(spark, "piece_bpe_32k.model"), keep=["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    from datagauge.llm.quality import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3, ["doc_id"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, with strings of 200 bytes."""
    from datagauge.llm.repeats import repeated_spans, without_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_spans(repeated_spans(docs, 200), ("n_bytes", "n_removed", "n_spans", "kept_sha256"), keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_training_shards": op7_training_shards,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
}

__all__ = ["ORACLES", "QUERIES", "tokenizer"]
