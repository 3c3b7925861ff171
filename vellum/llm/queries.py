"""The numbered queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import alignment, bpe, decontaminate, html_text, line_dedup, maxent_lm, media, oracles, packing, prefix_trie, quality, simhash, substring_dedup, token_counts
from vellum.llm.common import table

RANKS, WORDS = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def _remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_counts.histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(hist)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent_lm.train_and_score(table(spark, sf_dir, "documents"), _remainder("doc_id", 7) != 2)
    held = (_remainder("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), derive={"kept_sha256": F.sha2("kept", 256)})


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.media_columns(table(spark, sf_dir, "documents"))
    pairs = F.concat_ws(" ", F.zip_with("fp_time", "fp_code", lambda t, c: F.concat_ws(":", t.cast("string"), F.hex(c))))
    return m.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.size("fp_code").cast("string"), F.md5(pairs.cast("binary"))).alias("feature"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voter = quality.fit(docs, table(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0))
    scored = quality.score(docs, voter)
    return scored.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), end=2)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(sequences, 20, _remainder("conv_id", 4).cast("int")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_token_counts, op3_line_dedup, op4_bpe, op5_simhash, op6_maxent_lm, op7_substring_dedup, op8_media, op9_quality, op10_decontamination, op11_packing, op12_prefix_trie, op13_alignment)
}
ORACLES = {"op7_substring_dedup": oracles.OP7, "op10_decontamination": oracles.OP10, "op12_prefix_trie": oracles.OP12}
