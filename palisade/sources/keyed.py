"""Keyed Parquet tables: save, load and remove rows by key.

Rows lie in buckets by key hash. A change writes the buckets it touches under a new commit
number and then the commit's record, which cannot be written twice: of two writers that start
from the same state the second fails and must start again. Readers follow the newest record of
each bucket, so a job that dies half-way changes nothing for them. Replaced buckets stay on
disk until `stale_paths` are deleted."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
_RECORD = "commit bigint, bucket int, rows bigint"


def _bucket(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def _records(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_RECORD).json(f"{path}/commits/*")
    except AnalysisException:
        return None


def _current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(newest commit, {bucket: commit that holds its rows}); at most one row a bucket."""
    records = _records(spark, path)
    if records is None:
        return 0, {}
    newest = records.groupBy("bucket").agg(F.max_by(F.struct("commit", "rows"), "commit").alias("r")).collect()
    return max((r["r"]["commit"] for r in newest), default=0), {r["bucket"]: r["r"]["commit"] for r in newest if r["r"]["rows"]}


def _read(spark: SparkSession, path: str, held: dict) -> DataFrame | None:
    paths = [f"{path}/data/commit={c:012d}/_b={b}" for b, c in sorted(held.items())]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows, or None before the first save."""
    commit, held = _current(spark, path)
    if held or not commit:
        return _read(spark, path, held)
    every = spark.read.option("mergeSchema", "true").parquet(f"{path}/data/*/*")
    return every.limit(0)


def stale_paths(spark: SparkSession, path: str) -> list[str]:
    """Bucket folders that no reader of the current state needs."""
    _, held = _current(spark, path)
    records = _records(spark, path)
    old = [] if records is None else records.filter("rows > 0").select("commit", "bucket").distinct().collect()
    return [f"{path}/data/commit={r['commit']:012d}/_b={r['bucket']}" for r in old if held.get(r["bucket"]) != r["commit"]]


def _commit(rows: DataFrame, path: str, commit: int, touched: list[int]) -> None:
    """Write the touched buckets and record the commit."""
    spark = rows.sparkSession
    folder = f"{path}/data/commit={commit:012d}"
    rows.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(folder)
    counted = {} if rows.isEmpty() else {r["_b"]: r["n"] for r in spark.read.parquet(folder).groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    records = spark.createDataFrame([(commit, b, counted.get(b, 0)) for b in touched], _RECORD)
    records.coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{commit:012d}")


def _replace(spark: SparkSession, path: str, key: list[str], gone: DataFrame, added: DataFrame | None) -> None:
    """Rows of the keys in `gone` leave, `added` come."""
    commit, held = _current(spark, path)
    gone = gone.select(*key).distinct().withColumn("_b", _bucket(key))
    touched = [r["_b"] for r in gone.select("_b").distinct().collect()]
    old = _read(spark, path, {b: c for b, c in held.items() if b in touched})
    rows = None if added is None else added.withColumn("_b", _bucket(key))
    if old is not None:
        kept = old.join(gone.drop("_b"), key, "left_anti").withColumn("_b", _bucket(key))
        rows = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
    if touched and rows is not None:
        _commit(rows, path, commit + 1, touched)


def upsert(rows: DataFrame, path: str, key: list[str], order=None) -> None:
    """Replace the rows of the given keys and add the new ones. With `order`, the last row of
    a key wins; without it keys must be unique."""
    if order is not None:
        newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    _replace(rows.sparkSession, path, key, rows, rows)


def remove(keys: DataFrame, path: str, key: list[str]) -> None:
    _replace(keys.sparkSession, path, key, keys, None)


def upsert_identities(identities: DataFrame, path: str, order=None) -> None:
    upsert(identities, f"{path}/identities", ["identity_id"], order)


def upsert_type_keys(type_keys: DataFrame, path: str) -> None:
    upsert(type_keys, f"{path}/type_keys", ["sig", "sdk", "model"])


def upsert_vectors(vectors: DataFrame, path: str) -> None:
    upsert(vectors, f"{path}/vectors", ["identity_id"])
