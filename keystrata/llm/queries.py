"""The thin queries opN_<name> over whole tables, and SQL where it exists."""

from pathlib import Path

import public_tokenizers

from keystrata.llm import bpe_codec, line_templates, media_ts, minhash_dedup, mixing, oracles, pii_context, quality_forest, substring_dedup, token_counts, url_templates


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name):
    """The JSON text of a public tokenizer; read on the driver, then sent along."""
    return Path(public_tokenizers.path(name)).read_text()


def op1_line_templates(spark, sf_dir):
    return line_templates.digests(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark, sf_dir):
    return minhash_dedup.components(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op4_media_ts(spark, sf_dir):
    return media_ts.text_features(table(spark, sf_dir, "documents"))


def op5_pii_context(spark, sf_dir):
    return pii_context.find(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op7_quality_forest(spark, sf_dir):
    return quality_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_bpe_codec(spark, sf_dir):
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_line_templates, op2_minhash_dedup, op3_substring_dedup, op4_media_ts, op5_pii_context, op6_mixing, op7_quality_forest, op8_url_templates, op9_token_counts, op10_bpe_codec)}
ORACLES = oracles.ORACLES
