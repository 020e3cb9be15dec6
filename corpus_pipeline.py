"""The corpus pipeline: STAGES, applied in order to the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import bpe, common, jaccard, mixing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts are rejected, repeated rows are judged alike."""
    return quality.quality(docs.select(*COLUMNS), keep=COLUMNS).where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity (five words, 0.8), the one with the smallest doc_id; null doc_ids come last.

    Rows equal in doc_id and text are one document.  A text without words stands alone, as a null one does.
    """
    return jaccard.one_of_each_group(docs.select(*COLUMNS), words=5, similar=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left of each text without passages that start earlier; documents of which nothing is left go."""
    cut = suffix_dedup.dedup(docs.select(*COLUMNS), keep_text=True, keep=["lang", "source"])
    cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.where("n_bytes = 0 OR n_removed < n_bytes").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and documents of small sources twice at most; a null source is a source, null texts and repeated rows take part."""
    return mixing.realise(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mixture, row by row; a null text has none."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "source"])


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the language model, the join of near duplicates' components or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written to the shared folder and read again, and all that it was made of is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark = common.made()
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"stage{k}")
            common.drop_since(mark, docs)
            common.drop(before)
    return docs
