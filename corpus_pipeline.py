"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage
returns to the shared checkpoint folder as Parquet and reads it again as the next
stage's documents, so a lost executor repeats one stage's tasks at most. All
stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.common import materialise, read, without
from riskgrid.llm.host_rules import host_rules
from riskgrid.llm.hyperminhash import near_duplicates
from riskgrid.llm.mixing import copies, mix_sources
from riskgrid.llm.sharding import shard_documents
from riskgrid.llm.winnowing import decontaminate

#: Rows that agree in these get the same verdict, so verdicts travel without texts.
KEYS = ["doc_id", "source", "_copy"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; those the rules reject go, soft failures by the
    verdict on their domain."""
    keyed = docs.withColumn("_copy", F.xxhash64("text"))
    judged = host_rules(keyed, carry=KEYS)
    return without(keyed, judged.where(~F.col("kept")), KEYS).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard 0.8): the one
    with the smallest id, nulls last, equal ids by the hash of id and text. A row is judged
    by that hash, so texts that share an id are judged apart, and of equal rows one stays.
    Documents without words have no copies and stay."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    judged = materialise(near_duplicates(keyed, id_col="_row").where("n_shingles > 0").groupBy("_row", "component_id").agg(F.count("*").alias("n")))
    members = judged.join(keyed.select("_row", "doc_id").distinct(), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    left = without(keyed, judged.join(first.select("first._row"), "_row", "left_anti"), ["_row"])
    again = materialise(judged.where("n > 1").select("_row"))
    if again.isEmpty():
        return left.select(docs.columns)
    equal = left.join(again, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "_row", "left_anti").select(docs.columns).unionByName(equal)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words with a benchmark item, nor hold a shorter item."""
    keyed = docs.withColumn("_copy", F.xxhash64("text"))
    judged = decontaminate(keyed, read(spark, sf_dir, "benchmark"), carry=KEYS)
    return without(keyed, judged.where("contaminated"), KEYS).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard by shard and shuffled in each: a document is repeated for every pass
    that draws it; where a quota or a shard's block ends inside a document, that copy holds
    only the words dealt there."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "source", "text", F.struct(*others).alias("_rest"))
    mixed = copies(*mix_sources(packed, carry=["text", "_rest"]), ["text", "_rest"])
    return mixed.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row of the mix."""
    return shard_documents(docs, 16, carry=["doc_id", "source"])


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Mixing and sharding order documents by hashes that DuckDB lacks; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
