"""From raw documents to token ids: quality, exact and near copies, source weights, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept."""

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palisade import ship  # noqa: E402
from palisade.llm import bpe, exact_dedup, mixing, ngram_join, quality  # noqa: E402
from palisade.llm.common import n_words, text_sha, written  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (a document is known by id and text)."""
    ship(spark)
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"), sha=True)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_sha")).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone")) & (text_sha(F.col("text")) == F.col("_sha")), "left_anti")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest id."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the smallest id
    (a group without any id stays)."""
    ship(spark)
    return ngram_join.drop_near_copies(docs, k=5, percent=80, null_ids=False)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: documents that the mix leaves out go, those that it repeats
    stand as often as it takes them."""
    ship(spark)
    mixed = mixing.mix(docs, "doc_id", n_words(F.coalesce("text", F.lit(""))), F.array("source"), key=text_sha(F.col("text")))
    key = {"_id": F.col("doc_id"), "_sha": F.col("key"), "_source": F.get("pattern", F.lit(0))}
    taken = mixed.groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.min("n_copies").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.sum("n_copies").alias("_all"))
    taken = written(taken.select(*key, "_n", (F.col("_all") - F.col("_n") * F.col("_rows")).alias("_more")), "taken")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (text_sha(F.col("text")) == F.col("_sha")) & F.col("source").eqNullSafe(F.col("_source"))
    out = docs.join(taken, same)
    if not taken.where("_more > 0").isEmpty():  # rows equal in all three, of which some are taken once more
        turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns)))
        parted = out.where("_more > 0").withColumn("_n", F.col("_n") + (turn <= F.col("_more")).cast("int"))
        out = out.where("_more = 0").unionByName(parted)
    return out.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded text."""
    ship(spark)
    spec = bpe.tokenizer_spec()
    decoded = bpe.encode(docs, spec, decoded=True)
    n = (F.octet_length("ids") / 4).cast("bigint")
    return decoded.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", unlike_documents),
    ("mixing sources to target weights", weighted_sources),
    ("BPE encoding and decoding", token_ids),
]

#: A trained classifier and set similarity: not expressible in SQL, tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
