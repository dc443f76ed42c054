"""Staged expressions.

Catalyst pushes filters through projections by substituting the projected expressions.
With parse steps that build on one another (text -> head -> lines -> body -> fields)
that substitution grows exponentially. `settle` computes the columns in a one-row
generator, which keeps its outputs opaque: every step is evaluated once per row."""

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns, each evaluated once and never inlined downstream."""
    added = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    replaced = [c for c in columns if c in df.columns]
    if not replaced:
        return df.select("*", added)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in replaced], added)


def shared_folder(spark) -> str:
    """The folder every executor can reach: spark.checkpoint.dir where the session names one.
    A local session without one, as in tests, gets a temporary folder; on a cluster, where
    executors do not share such folders, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


_scopes = threading.local()


def scratch_path(spark, name: str) -> str:
    """A new path in the shared folder, known to clear_scratch or to the scope around it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = getattr(_scopes, "made", None)
    if made is None:
        made = getattr(spark.sparkContext, "_palisade_scratch", None)
    if made is None:
        made = spark.sparkContext._palisade_scratch = []
    made.append(path)
    return path


def scratch_table(spark, name: str) -> tuple:
    """(name, path) of a new table of the catalog over a scratch path; it goes with the path."""
    path = scratch_path(spark, name)
    table = f"{re.sub('[^A-Za-z0-9]', '_', name)}_{uuid.uuid4().hex}"
    made = getattr(_scopes, "made", None)
    (spark.sparkContext._palisade_scratch if made is None else made).append(f"table:{table}")
    return table, path


def delete_path(spark, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete(spark, paths: list) -> None:
    while paths:
        path = paths.pop()
        if path.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix('table:')}")
        else:
            delete_path(spark, path)


def clear_scratch(spark) -> None:
    """Delete what this session wrote under scratch paths; call it once the results that read
    them are used."""
    _delete(spark, getattr(spark.sparkContext, "_palisade_scratch", []))


@contextmanager
def scratch_scope(spark):
    """Scratch tables that this thread writes inside are deleted at the end: for jobs that run
    again and again in one session, and write their results inside."""
    outer, _scopes.made = getattr(_scopes, "made", None), []
    try:
        yield
    finally:
        made, _scopes.made = _scopes.made, outer
        _delete(spark, made)


@contextmanager
def arrow_batches(spark, most_bytes: int, most_rows: int, read_rows: int | None = None):
    """What is computed inside goes to Python tasks in batches of at most so many bytes and rows,
    or one larger row. A task holds its batch several times: as Arrow vectors, as the stream that
    leaves the JVM and in Python, all of it outside the heap. Tables are read read_rows at a time:
    the reader holds as many unpacked, whatever their size, and its buffers double as they grow."""
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": str(most_bytes), "spark.sql.execution.arrow.maxRecordsPerBatch": str(most_rows)}
    if read_rows is not None:
        names["spark.sql.parquet.columnarReaderBatchSize"] = str(read_rows)
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, known to clear_scratch.

    Lost executors read the files again. Unlike a checkpointed plan the table has the size of
    its files in the optimizer's eyes, so loops plan alike in every round."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which keeps partitions and the order of their
    rows: for seeded training, whose draws follow them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
