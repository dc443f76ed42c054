"""Helpers shared by the operators of this package."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.plans.stage import delete_path, scratch_path

SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared checkpoint folder, computed once; lost executors reread it.
    `plans.stage.clear_scratch` deletes such tables."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing computed from now on reads."""
    for df in tables:
        delete_path(df.sparkSession, df._written_at)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever else the table holds."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def text_sha(text: Column) -> Column:
    """SHA-256 of the text (null: empty), binary; with doc_id it tells rows of one id apart."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256))


def bounded_sample(df: DataFrame, key: Column, most: int) -> list:
    """At most `most` distinct rows, chosen by the hash `key` (returned as _h) and in its order.

    Equal rows count once, so a row that a third of the table repeats is sent once. The cut of the
    hash follows from an estimate of the distinct keys, with room for its error; no task sends
    more than what lies under it."""
    keyed = df.withColumn("_h", key)
    n = keyed.agg(F.approx_count_distinct("_h", 0.02)).first()[0]
    share = min(1.0, 1.2 * most / n) if n else 0.0
    rows = keyed.where(F.pmod("_h", F.lit(1 << 31)) < int(share * (1 << 31))).dropDuplicates().collect()
    return sorted(rows, key=lambda r: (r["_h"] % (1 << 31), r["_h"], str(r)))[:most]


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACE)).cast("bigint")
