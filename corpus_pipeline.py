"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  Every stage
works on all rows that its predecessor kept:

1. language ID: rows whose text has no letters or is too far from every
   language centroid go; the model is fitted on the labelled rows of ``docs``;
2. n-gram Jaccard join: 5-word shingles, similarity 0.8 or more; of each class
   the document with the smallest id stays;
3. benchmark decontamination: documents in which a window of 10 benchmark
   words (or a whole shorter item) occurs go;
4. mixing: sources to the weights 5, 2, 1 (in order, repeating) at 150% of all
   words; a document taken twice is two rows;
5. sharding: 40 shards of equal counts that each match the mixture.

Defined results: a null, empty or letterless text goes in stage 1; texts are
read whole, however long; a document without an id, language or source stays,
null being a source of its own and the last id; of copies and repeated rows one
stays, of equal ids the one whose values hash lowest; an empty table gives an
empty result with the same columns; further columns are carried along, and one
that clashes with a column of the last stage (shard, slot) is replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.decontaminate import find_contamination
from lexforge.llm.jaccard import one_per_class
from lexforge.llm.langid import identify
from lexforge.llm.mixing import mixed, word_count
from lexforge.llm.sharding import shard
from lexforge.session import checkpoint_dir
from lexforge.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised."""
    return identify(docs, F.lit(True)).where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_per_class(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    return found.where("n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken twice is two rows."""
    return mixed(docs, word_count("text"), weights=(5.0, 2.0, 1.0), budget_share=1.5, max_repeats=2)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return shard(docs, 40)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: stages 1 and 2 are a fitted model and an iterative closure; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
