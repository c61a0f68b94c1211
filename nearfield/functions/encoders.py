"""Vectors from a user's model: values go through Arrow in batches bounded by rows and bytes, and token tables are pooled.

A model is set up once a worker and serves all its tasks. Nulls get no vector and are not shown to the model. What arrives in one Arrow batch is bounded by the session's
`spark.sql.execution.arrow.maxRecordsPerBatch`; set it low for large images.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
_ready: dict[str, Callable] = {}


def _set_up(key: str, make: Callable[[], Callable]) -> Callable:
    """The worker's model; one is held at a time."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = make()
    return _ready[key]


def _bytes(value) -> int:
    return len(value) if isinstance(value, bytes | str) else np.asarray(value).nbytes


def batches(values: list, rows: int, size: int):
    """Ranges of consecutive values with at most that many rows and bytes; a value beyond the bound goes alone."""
    at = held = 0
    for i, value in enumerate(values):
        own = 0 if value is None else _bytes(value)
        if i > at and (i - at >= rows or held + own > size):
            yield at, i
            at, held = i, 0
        held += own
    if at < len(values):
        yield at, len(values)


def pooled(found: np.ndarray, skip: int = 1, mean: bool = True) -> np.ndarray:
    """rows x width as it is; rows x tokens x width: the first token, followed on request by the mean of the tokens behind the first `skip` (prefix and register tokens)."""
    if found.ndim == 2:
        return found
    if found.ndim != 3 or found.shape[1] < (skip + 1 if mean else 1) or skip < 1:
        raise ValueError(f"a model must give vectors, or more tokens than are skipped: {found.shape}")
    first = found[:, 0]
    return np.concatenate([first, found[:, skip:].mean(1)], axis=1) if mean else first


def embed(df: DataFrame, column: str, make: Callable[[], Callable[[list], np.ndarray]], *, out: str = "embedding", skip: int = 1, mean: bool = True, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """All columns but `column`, and `out`. make() sets a model up: a function from a list of values to vectors or token tables, one each, all finite."""
    if rows < 1 or size < 1:
        raise ValueError("a batch needs at least one row and one byte")
    kept = [c for c in df.columns if c != column]
    if out in kept:
        raise ValueError(f"the column {out} is there already")
    key = uuid.uuid4().hex
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def vectors(values: list) -> list:
        there = [v for v in values if v is not None]
        if not there:
            return [None] * len(values)
        found = pooled(np.asarray(_set_up(key, make)(there), float), skip, mean)
        if len(found) != len(there) or not np.isfinite(found).all():
            raise ValueError(f"the model must give one finite vector for each of {len(there)} values: {found.shape}")
        each = iter(found)
        return [None if v is None else next(each) for v in values]

    def run(arriving):
        for batch in arriving:
            at = batch.schema.get_field_index(column)
            values = batch.column(at).to_pylist()
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for low, high in batches(values, rows, size):
                made = pa.array(vectors(values[low:high]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in rest), made], names=[*kept, out])

    return df.select(column, *kept).mapInArrow(run, schema)


def embed_by_model(df: DataFrame, column: str, models: dict[str, dict]) -> DataFrame:
    """The rows once for each model, with `model` and its `embedding`; each name comes with the arguments of `embed`."""
    if not models:
        raise ValueError("no models")
    found = [embed(df, column, **how).withColumn("model", F.lit(name)) for name, how in sorted(models.items())]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
