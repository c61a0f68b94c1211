"""An extension: new samples scored against a fixed reference table as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import neighbors, scoring


def score_batch(batch: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Robustness evidence of each new row among its k nearest reference rows of other groups; new rows never see each other."""
    found = neighbors.ranked(neighbors.candidates(batch, k=k, against=reference)).where(F.col("rank") <= k)
    return scoring.per_unit(scoring.at_k(scoring.evidence(found), [k]))


def start(stream: DataFrame, reference: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda batch, n: sink(score_batch(batch, reference, k), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
