"""Resampling towards a target distribution by importance weights over hashed word n-grams.

First pass: every Arrow batch is counted by np.bincount into one vector of as many numbers as there are buckets, a task yields one vector, and a tree of reductions adds
them, so the driver gets one vector whatever the size of the table. The log ratio of target and source counts is each bucket's gain. Second pass: the gains are
broadcast (10,000 numbers), and np.bincount sums them over the documents of a batch. The draw is by Gumbel noise on the weights: noise comes from a hash of seed and id,
places from histograms of score digits (`ranks`), so nothing is sorted or limited in one task.

Words are runs of letters, digits and anything beyond ASCII, after A-Z became lower case; features are the runs of one to `n` consecutive words, joined by a space,
repetitions counted. A bucket is the CRC-32 of the feature's bytes modulo their number.

Defined results: null and empty texts have no features and weight 0. A null id counts as empty in the noise and comes before all others among equal scores; repeated rows
are drawn row by row, in any order. Without target rows every bucket's gain rests on the added one alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows, stash
from .ranks import ranks

BUCKETS, WORDS = 10_000, 2
#: Fewest words of a document that can be drawn, percentage drawn, seed of the noise.
FEWEST, PERCENT, SEED = 20, 25, 7
#: Bytes to lower case, and all that separates words to spaces; bytes over 127 belong to words.
TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class _Sums(Memo):
    """CRC-32 of a word, and of the word with a space after it (at most 100,000 words, about 15 MB)."""

    def __init__(self):
        super().__init__(100_000)

    def of(self, word: bytes) -> tuple[int, int]:
        crc = crc32(word)
        return crc, crc32(b" ", crc)


def features(text: str | None, n: int, memo: _Sums) -> tuple[int, list[int]]:
    """The number of words, and the CRC-32 of every feature."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    if not words:
        return 0, []
    found, open_ = map(list, zip(*map(memo.__getitem__, words), strict=True))
    for size in range(1, n):  # the checksum goes on where that of the words before ended
        sums = [*map(crc32, words[size:], open_[: len(words) - size])]
        found += sums
        open_ = [crc32(b" ", c) for c in sums] if size + 1 < n else []
    return len(words), found


def _bucketed(found: list[int], buckets: int) -> np.ndarray:
    return np.fromiter(found, np.uint32, len(found)) % np.uint32(buckets)


def counts(docs: DataFrame, *, text_col: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The features of all documents in each bucket. One vector for each task, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = _Sums(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_bucketed(features(text.as_py(), n, memo)[1], buckets), minlength=buckets)
        memo.clear()
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["vector"])

    vectors = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "vector binary").rdd.map(lambda r: np.frombuffer(r["vector"], "<i8"))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeAggregate(np.zeros(buckets, np.int64), add, add)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For each bucket the floor of a thousand times the log ratio of its shares, each count raised by one."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((float(y) + 1) * (s + b)) / ((float(x) + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """The id, n_words, n_features and weight: the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))
    buckets = len(gain)

    def make():
        memo, table = _Sums(), shared.value

        def one(batch: dict[str, list]) -> dict[str, list]:
            words, sizes, sums = [], [], []
            for at in range(0, len(batch["text"]), 64):  # features of 64 texts at a time
                found = [features(t, n, memo) for t in batch["text"][at : at + 64]]
                size = [len(f) for _, f in found]
                of = np.repeat(np.arange(len(found)), size)
                all_of_them = np.concatenate([_bucketed(f, buckets) for _, f in found])
                sums += np.bincount(of, weights=table[all_of_them], minlength=len(found)).astype(np.int64).tolist()
                words += [w for w, _ in found]
                sizes += size
            return {"id": batch["id"], "n_words": words, "n_features": sizes, "weight": [s // k if k else 0 for s, k in zip(sums, sizes, strict=True)]}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(rows, make, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, *, id_col: str = "doc_id", fewest: int = FEWEST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """weighed: the id, n_words, n_features, weight. Adds score, and rank (from 1) of those drawn: of the documents with at least `fewest` words the stated percentage with
    the highest scores."""
    rows = stash(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)), "scores")
    able = rows.where(F.col("n_words") >= fewest)
    able = stash(able.select(F.col(f"`{id_col}`").cast("long").alias("id"), (-F.col("score")).alias("below"), F.monotonically_increasing_id().alias("tag"), F.lit("").alias("g"), *(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(rows.columns))), "able")
    placed = ranks(able, "g", ["below", "id", "tag"], out="place", total="all")
    drawn = F.when(F.col("place") < F.floor(F.col("all") * percent / 100), F.col("place") + 1)
    placed = placed.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(rows.columns)), drawn.alias("rank"))
    others = rows.where(F.col("n_words") < fewest).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, buckets: int = BUCKETS, **options) -> DataFrame:
    """One row for each document: the id, n_words, n_features, weight, score and rank (null where not drawn)."""
    gain = gains(counts(target, text_col=text_col, n=n, buckets=buckets), counts(docs, text_col=text_col, n=n, buckets=buckets))
    return draw(weigh(docs, gain, id_col=id_col, text_col=text_col, n=n), id_col=id_col, **options)
