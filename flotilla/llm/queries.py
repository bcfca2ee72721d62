"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .oracles import ORACLE_SQL  # noqa: F401  (read by the entry module)

#: Production parameter: the SentencePiece model of the environment.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The tokenizer whose tokens are counted.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import dedup_passages
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(spark, read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import round_trip
    return round_trip(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses
    docs = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents
    return shard_documents(read(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back, with_control_case
    return read_back(format_conversations(with_control_case(spark, read(spark, sf_dir, "conversations"))))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_documents
    docs = judge_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "lost")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify
    return identify(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import mark
    docs = mark(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import rank_documents
    hits = rank_documents(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select("item_id", "rank", "doc_id", "score")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens
    return count_tokens(read(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine
    return mine(spark, read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op1_passage_dedup, op2_simhash_near_dedup, op3_token_packing, op4_sentencepiece, op5_license_scan, op6_sharding,
    op7_chat_formatting, op8_quality_rules, op9_language_id, op10_decontamination,
    op11_ranked_search, op12_token_counts, op13_hard_negatives)}
