"""Sources: enriched events as NDJSON, raw records with fixed schemas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schemas

CORRUPT = "_corrupt"
# Record codes of a mixed capture
_KINDS = {"tls_handshake": [6], "tls_data": [7, 8], "file_access": [9], "file_data": [10]}


def read_events(spark: SparkSession, path: str, stream=False, strict=False) -> DataFrame:
    """Events, one JSON object per line; blank lines are skipped. A line that does not parse
    arrives with its text in `_corrupt` (strict=True: the read fails instead)."""
    schema = T.StructType([*schemas.EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(schema)
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_raw(spark: SparkSession, kind: str, path: str, format="parquet", stream=False, **options) -> DataFrame:
    """Raw records of one kind with their explicit schema."""
    reader = (spark.readStream if stream else spark.read).format(format).options(**options)
    return reader.schema(schemas.RAW[kind]).load(path)


def route_by_kind(raw: DataFrame, code="event_type") -> dict[str, DataFrame]:
    """Split a mixed capture: one filter per kind; whatever has no code of its own is network."""
    routed = {kind: raw.filter(F.col(code).isin(codes)) for kind, codes in _KINDS.items()}
    known = [c for codes in _KINDS.values() for c in codes]
    routed["network"] = raw.filter(~F.coalesce(F.col(code).isin(known), F.lit(False)))
    return routed
