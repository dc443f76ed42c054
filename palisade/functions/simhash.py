"""64-bit SimHash of vectors: sign bits of 64 fixed random planes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import rules

_WORD = (1 << 64) - 1


def planes(dim: int, count=rules.SIMHASH_PLANES, seed=rules.SIMHASH_SEED) -> np.ndarray:
    """Plane components in [-1, 1] from a xorshift generator (shifts 13, 7, 17)."""
    state, out = seed, np.empty(count * dim)
    for i in range(count * dim):
        state ^= (state << 13) & _WORD
        state ^= state >> 7
        state ^= (state << 17) & _WORD
        out[i] = state / _WORD * 2.0 - 1.0
    return out.astype(np.float32).astype(np.float64).reshape(count, dim)


def with_simhash(df: DataFrame, dim: int, column="embedding", out="simhash") -> DataFrame:
    """Add the fingerprint as a signed BIGINT; one matrix product per Arrow batch, no shuffle."""
    matrix = planes(dim).T
    weights = (np.uint64(1) << np.arange(rules.SIMHASH_PLANES, dtype=np.uint64)).astype(np.uint64)

    def run(batches):
        for batch in batches:
            vectors = batch.column(column)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bits = flat.reshape(len(vectors), dim) @ matrix >= 0
            prints = (bits * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, out])

    schema = df.withColumn(out, F.lit(0).cast("bigint")).schema
    return df.mapInArrow(run, schema)


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(rules.SIMHASH_PLANES))
