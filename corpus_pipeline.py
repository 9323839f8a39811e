"""The training-text pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents`` for the rows it keeps.

Defined results, of all stages: a null or empty text fails the quality rules, so later stages see none of the table's; on their own
they keep such rows as they are, and the last one gives them no ids. Texts are taken whole, however long. Rows with the same id are told apart by
their texts; rows with the same id and text are near duplicates of each other. Null ids come last. An empty table stays
empty. Columns beside doc_id and text are handed on, whatever their names; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from zonetide.llm import bpe, decontaminate, jaccard, pii, quality
from zonetide.llm.stored import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that none of their names clashes with a name that a stage gives."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; these are fitted on labelled documents of the table as given."""
    trees = quality.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return _unpacked(quality.assess(_packed(docs), trees).filter("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that of the smallest id, of the smallest text hash where ids repeat."""
    return jaccard.kept_rows(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    marked = decontaminate.contamination(_packed(docs), _table(spark, sf_dir, "benchmark"))
    return _unpacked(marked.filter(~F.col("contaminated")), docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; ``n_chars`` follows the text."""
    out = pii.pseudonymised(_packed(docs), spark.conf.get("spark.zonetide.pii.key", "a key for trials"))
    return _unpacked(out, docs.columns).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    coded = bpe.tokenize(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonyms),
    ("byte-level BPE", encoded),
]

# Scores of trained trees, pseudonyms and BPE merges have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``; each result but the last is stored in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
