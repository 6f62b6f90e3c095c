"""A corpus pipeline of five stages; each one's result is written as Parquet and read as the next one's documents.

language ID -> exact dedup -> SimHash near-dedup -> substring dedup -> packing

Every stage decides by row: rows that repeat an id are rows of their own. Null texts count as empty: language ID
rejects them, so later stages meet none in run(), but each takes them. Null ids sort as their operator says and keep
their null. An empty table passes through every stage and ends as an empty table of pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, langid, packing, simhash, substrings
from ledgerline.llm.common import documents, remove, scratch, shared_dir, written
from ledgerline.llm.units import tokenizer_path

#: Documents without letters, or whose best language scores less than this, are rejected; an even guess over four is 0.25.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised. Empty, null and letterless texts go."""
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that with the smallest id; ties go to the first in its file."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by fingerprints, that with the smallest id; ties go to the first in its file."""
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that stand in an earlier place. A text that loses words has its others joined by a space;
    every other text stays as it is; a document that loses all its words goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = substrings.remove_repeats(docs, keep=True, carry=(*rest,) or ("doc_id",))
    done = done.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.coalesce(F.col("kept"), F.col("text").cast("string"))
    cols = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"rest.{c}") for c in rest}
    if "n_chars" in rest:
        cols["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return done.select(*[cols[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("substrings", remove_repeats),
    ("packing", pack),
]

#: SQL can express neither the network, nor the 64-bit hashes, nor the tokenizer: run() is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage made on its way goes when its result is written, and so does its input."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, [before])
        before = path
    return docs
