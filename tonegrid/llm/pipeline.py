"""A training corpus in five stages over ``documents``; each result is written and read back as the next input.

Every stage works on all rows of its predecessor. Null and repeated ids, null
and empty texts, very long texts and ties have the result that the docstring of
each stage's operator states; an empty table passes through as an empty table;
columns other than those of ``documents`` are dropped at the first stage,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, read_table, scratch, shared_dir
from .decontaminate import without_leaks
from .minhash import similar_texts, text_node
from .quality import clean
from .sentencepiece_codec import encode_and_check
from .toxicity import score_toxicity, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
FOLDS = 5


def fold(key):
    """crc32 of the key's text, modulo ``FOLDS``; fold 0 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts have the score of the bias alone; repeated rows are scored row by row.
    """
    model = train(docs, read_table(spark, sf_dir, "labels"), usable=lambda k: fold(k) != 0)
    return _documents(score_toxicity(_documents(docs), model, score="_score").where("_score < 0.5"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that the rules reject; ``n_chars`` follows the text.

    Null and empty texts are rejected; a null source is a host of its own; repeated rows share their fate.
    """
    return clean(_documents(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, then the smallest hash (null ids last).

    Groups are linked by a similarity of 0.8 or more between sets of five-word
    shingles. A row, not an id, is what stays: rows that repeat an id with the
    same text are one group's, rows that repeat an id with other texts are
    judged by their texts, and of equal rows one stays. Null and empty texts are
    one group.
    """
    rows = _documents(docs)
    node, rest = text_node(rows["text"]), F.xxhash64(*[c for c in COLUMNS if c not in ("doc_id", "text")])
    known = rows.select("doc_id", node.alias("node"), rest.alias("rest"))
    classes = known.groupBy("doc_id", "node", "rest").agg(F.count("*").alias("copies"))
    rooted = classes.join(similar_texts(rows), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "rest", "copies")).alias("first")
    heads = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"), F.col("first.rest").alias("_rest"), F.col("first.copies").alias("_copies"))
    kept = rows.join(heads, rows["doc_id"].eqNullSafe(heads["_id"]) & (node == heads["_node"]) & (rest == heads["_rest"]))
    return kept.where("_copies = 1").select(*COLUMNS).unionByName(kept.where("_copies > 1").select(*COLUMNS).dropDuplicates())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none."""
    return _documents(without_leaks(_documents(docs), read_table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    return encode_and_check(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The learned classifier and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet; only the last result stays there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
