"""The corpus pipeline: language ID, near-duplicate removal, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Scratch
from quadrille.llm.decontaminate import without_contaminated
from quadrille.llm.langid import fit, held_out, identify
from quadrille.llm.ngram_join import ngram_components
from quadrille.llm.packing import pack
from quadrille.llm.sparse_suffix import without_repeats

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = r"[^\x20\x09-\x0D]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, and those whose main language has less than 40 % of the letters.

    Null and empty texts and those without letters have none; of languages with equal scores the first by name
    counts. Very long texts are read whole, rows are judged each, null ids too. An empty table stays empty.
    """
    labelled = identify(docs, fit(docs, ~held_out()), prefix="__")
    return labelled.where("__lang_pred <> 'und' AND __score >= 0.4").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies; texts without words go too.

    Rows that repeat an id are one document if their texts are equal: one row stays. Rows of one id with different texts
    stay together if one of them does. Rows with a null id are compared with nothing and stay. Very long
    texts take part whole; an empty table stays empty.
    """
    groups = ngram_components(spark, docs, n=5, percent=80)
    kept = groups.where("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"))
    kept = Scratch(spark).result(kept)
    of = docs["doc_id"] == F.col("__kept")
    out = docs.join(kept.where("__rows = 1"), of, "left_semi").unionByName(docs.where(F.col("doc_id").isNull() & F.col("text").rlike(WORD)))
    again = kept.where("__rows > 1")
    return out if again.isEmpty() else out.unionByName(docs.join(again, of, "left_semi").dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of 50 or more words that an earlier document or place has; drop documents that this empties,
    and those without words.

    Earlier is the smaller id, then the place. Rows that repeat id and text are cut alike; of an id with different
    texts one takes part and the others stay as they are, as do rows with a null id. Very long texts take part
    whole; an empty table stays empty.
    """
    cut = without_repeats(spark, docs, least=50).where(F.col("text").rlike(WORD))
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Rows of an id go together, those with a null id too. Null and empty texts hold nothing; very long texts are
    searched whole; with an empty benchmark every document stays.
    """
    return without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 2048 tokens.

    A null text is empty and packs as its end alone; rows are packed each, repeated ones and those with null ids too; long texts are
    cut into pieces; pieces of equal length are placed in the order of their hashes. An empty table gives none.
    """
    return pack(spark, docs, tokenizer=TOKENIZER)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: No SQL expresses the language model, the latent search or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
