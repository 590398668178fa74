"""The corpus operators as named queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.audio import audio_features, encode_audio
from codeloom.llm.byte_bpe import digests, learn_lexicon, load_byte_bpe
from codeloom.llm.common import crc_bucket, materialize, read_table
from codeloom.llm.compression_bands import compression_bands
from codeloom.llm.jaccard_join import similar_groups
from codeloom.llm.line_align import dedup_lines
from codeloom.llm.mixing import domain_of, mix_sources, mix_sources_sql
from codeloom.llm.phrase_mining import collocations, collocations_sql
from codeloom.llm.piece_tokenizer import load_model, round_trips
from codeloom.llm.ppm_language import language_scores, learn
from codeloom.llm.rule_ensemble import learn_quality, score_column, text_statistics
from codeloom.llm.secret_scan import scan_secrets, scan_secrets_sql
from codeloom.llm.suffix_tree import remove_repeats
from codeloom.llm.token_alignment import align_tokens, load_pieces

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
Query = Callable[[SparkSession, str], DataFrame]


def op6_pieces(spark: SparkSession, sf_dir: str, model_file: str = PIECES) -> DataFrame:
    return round_trips(read_table(spark, sf_dir, "documents"), load_model(model_file))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read_table(spark, sf_dir, "documents"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, and the features themselves: segments, tensors and the spans of these."""
    return audio_features(encode_audio(read_table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of 0.3 is the query's; the score is the model's probability."""
    stats = materialize(text_statistics(read_table(spark, sf_dir, "documents")), "quality-statistics")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = learn_quality(stats, read_table(spark, sf_dir, "labels").where(~held_out), "doc_id", "quality")
    scored = stats.select("doc_id", held_out.alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op10_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~held_out), "doc_id", "text", "lang")
    return language_scores(docs.select("doc_id", "text", held_out.alias("held_out")), ["doc_id", "held_out"], "text", model)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source"))))


def op4_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"), F.length("kept_text").cast("bigint").alias("kept_chars"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer_file: str = BYTE_BPE) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return digests(docs, learn_lexicon(docs, load_byte_bpe(tokenizer_file)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_file: str = BYTE_BPE, b_file: str = PIECES) -> DataFrame:
    return align_tokens(read_table(spark, sf_dir, "documents"), load_byte_bpe(a_file), load_pieces(b_file))[0]


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mix_sources_sql(), "op8_secret_scan": scan_secrets_sql(), "op12_collocations": collocations_sql()}
