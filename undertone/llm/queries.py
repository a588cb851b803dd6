"""Queries of the operators in this folder, and their SQL where plain SQL says the same."""

from pyspark.sql import functions as F

from undertone.llm import (
    chat_format, decontamination, language_id, lexical_rank, line_dedup, maxscore, mixing, multiset_hash, sharding,
    signature_tree, token_counts, turn_repair, warc,
)

PROBE = "\\### Assistant: </turn> ok"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard_join(spark, sf_dir):
    return signature_tree.component_report(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_top_k_search(spark, sf_dir):
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"), limit=10, least_chars=1)


def op7_decontamination(spark, sf_dir):
    return decontamination.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark, sf_dir):
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    from undertone.session import durable

    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat_format.digests(durable(chat_format.format_conversations(turns.unionByName(more)), "formatted"))


def op11_multiset_hash(spark, sf_dir):
    return multiset_hash.fingerprint_report(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark, sf_dir):
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_lexical_rank(spark, sf_dir):
    return lexical_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_top_k_search": op4_top_k_search,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_multiset_hash": op11_multiset_hash,
    "op12_turn_repair": op12_turn_repair,
    "op13_lexical_rank": op13_lexical_rank,
}
