"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sql import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20: ``query_id, rank, vec_id, score``."""
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the 32k piece vocabulary: ``doc_id, n_bytes, n_tokens, over_limit``."""
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``: ``doc_id, path, license_id, score, origin, license_path``."""
    from .license_scan import scan_licenses

    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = scan_licenses(docs.select(path.alias("path"), "text"))
    return found.select(F.substring_index("path", "/", -1).try_cast("long").alias("doc_id"), "path", "license_id", "score", "origin", "license_path")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards under the law ``bytes``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    from .sharding import shard_documents

    found = shard_documents(_table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text: ``doc_id, held_out, score, predicted``."""
    from .toxicity import fit, held_out, scores

    docs = _table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.9: ``doc_id, n_shingles, component_id, n_links``."""
    from .ngram_join import jaccard_components

    found = jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "n_links")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that overlap with test items: ``doc_id, item_id, doc_start, item_start, n_words, n_equal``."""
    from .decontam import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has too: ``doc_id, start_word, end_word, kept_doc_id, kept_start_word, cluster_id, text_hash``."""
    from .substring_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1, with_ids=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    from .chat_format import digests, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return digests(format_conversations(turns.unionByName(own)))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``."""
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"), least=100, first=2000)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (op1_inverted_multi_index, op2_token_counts, op3_license_scan, op4_sharding, op5_toxicity, op6_ngram_jaccard_join, op7_decontamination, op8_substring_dedup, op9_best_fit_packing, op10_chat_formatting, op11_html_extraction, op12_phrase_collocations)
}
