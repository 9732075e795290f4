"""A corpus pipeline over ``documents``: language, near duplicates, benchmark
leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last keep
the columns of ``documents``.

All stages: texts are judged whole, however long; an empty table gives an empty
table; rows are documents, repeated ones included; other columns than those of
``documents`` are left out, and what they are called doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import contamination, language, mixing, near_duplicates, sharding
from gridloom.llm.storage import fresh_path, scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if its language is at least this probable.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a probable language go: null and
    empty texts with them.  A null ``lang`` isn't learned from; a null
    ``doc_id`` neither; both are judged like others."""
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    out = language.identify(docs, model)
    return out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: of those with the
    smallest id, one with the smallest MD5 of its text.  Groups are of rows, so
    repeated rows are copies of each other, and texts that share an id are
    judged each on its own; documents without id or without words all stay."""
    key = F.md5("text")
    found = near_duplicates.labelled_rows(docs, percent=80, size=5, key=key).where(F.col("root").isNotNull())
    found = found.select(F.col("id").alias("doc_id"), "key", "root")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("row")).select("row.*")
    pairs = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    marked = pairs.join(first.withColumn("first", F.lit(True)), ["doc_id", "key"], "left").where(F.col("first").isNull() | (F.col("times") > 1))
    marked = stored(marked, "near-duplicates")
    keyed = docs.select(*COLUMNS, key.alias("key"))
    out = keyed.join(marked.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select(*COLUMNS)
    repeated = marked.where("first").select("doc_id", "key")
    if repeated.isEmpty():
        return out
    again = keyed.join(repeated, ["doc_id", "key"], "left_semi").groupBy("doc_id", "key")
    return out.unionByName(again.agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  Null and empty
    texts hold none; an empty benchmark has none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination.find_contamination(docs, benchmark, window=10)
    return out.where(F.size("hit_spans") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources meet their weights.
    A null ``source`` is a source; documents without words cost nothing and are
    taken with the documents around them."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there; copies of a row are permuted
    like other rows.  Nulls are values."""
    return sharding.shard_documents(docs, shards=40)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language, near duplicates and shards have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
