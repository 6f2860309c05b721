"""A corpus pipeline of five stages over the documents table: what each keeps or changes is the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Defined cases, in every stage: columns besides doc_id, text, lang and n_chars are carried along whatever their names; an
empty table gives an empty table with the stage's columns; repeated rows count as rows and are treated alike; very long
texts are worked on whole. Null and empty texts have no letter, so language identification rejects them; where a later
stage is given some, near-duplicate removal and substring removal leave them as they are and packing takes them as one
end token. A row without id is kept by near-duplicate and substring removal and is packed like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm import language_id, quality_classifier
from layerloom.llm._spark import cut, held_out
from layerloom.llm.near_dedup import near_dedup
from layerloom.llm.packing import best_fit_packing
from layerloom.llm.substring_dedup import substring_dedup

#: Of the way from chance to certainty that the words of a document must come on average, each in its own language.
SURE = 1 / 6
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose words show no language: a mix of languages is no fault."""
    model = language_id.learn_from(docs, ~held_out("doc_id"))
    found = language_id.identify(docs, model, keep_spans=False, keep_text=True, keep_certainty=True)
    chance = 1 / max(1, len(model.languages))
    least = chance + SURE * (1 - chance) if len(model.languages) > 1 else 0.0
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("certainty") >= least))
    return kept.select("row.*", "text").select(docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rule ensemble scores below its threshold."""
    model = quality_classifier.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.quality_scores(docs, model, keep_text=True)
    return scored.filter("predicted = 1").select("row.*", "text").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, 0.8 or more).

    Rows leave by id and text, so of an id with several texts only the copies go; equal rows with one id are one
    document and stay or go together.
    """
    gone = near_dedup(docs, keep_key=True).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in windows that also start in a document with a smaller id; other texts stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    out = substring_dedup(docs, carry=others)
    changed = F.col("n_removed") > 0
    columns = [F.col(f"row.`{c}`").alias(c) for c in others if c != "n_chars"]
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return out.select(*columns, text.alias("text"), size.alias("n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of 2048 tokens."""
    return best_fit_packing(docs, VOCABULARY, keep_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("quality", filter_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_substrings),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result kept in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
