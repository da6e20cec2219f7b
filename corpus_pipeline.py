"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.  Rows that a
stage defines as kept pass whole: nulls, empty texts and repeated rows follow
the operators' docstrings.
"""

from pyspark.sql import functions as F

from keystrata.llm import bpe_codec, line_templates, minhash_dedup, mixing, quality_forest
from keystrata.llm.queries import table, vocabulary
from keystrata.plans.checkpoints import forget, own_folder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: One pass over what is left, at four fifths of its tokens.
MIX = {"share": 0.8, "max_epochs": 1, "seed": "pipeline-1"}
NEAR = {"size": 5, "percent": 80}


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule and the isolation forest accept."""
    return quality_forest.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Texts without lines whose template recurs across documents."""
    out = line_templates.drop_recurring(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_representatives(docs.select(*COLUMNS), **NEAR)


def source_mixing(spark, docs, sf_dir):
    """Documents taken by the hierarchical token budget."""
    return mixing.select_documents(docs.select(*COLUMNS), **MIX)


def encoding(spark, docs, sf_dir):
    """doc_id, lang, source, token ids, their number, and the SHA-256 of the text they decode to."""
    coded = bpe_codec.encode_column(docs.select("doc_id", "lang", "source", "text"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("bpe encoding", encoding),
]

#: The forest and the encoder have no SQL form; the pipeline is tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each written, read again, and deleted after the next."""
    own_folder(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            forget(last)
        last = docs
    return docs
