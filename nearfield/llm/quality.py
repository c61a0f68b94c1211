"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and underscores, and runs of other visible characters. Features are tokens, pairs of neighbouring
tokens and "the same token again", hashed to 2^18 weights; the value of a feature is its share of the text's features times SCALE. A score is one sparse dot product.

Training reads at most MAX_ROWS labelled rows (those with the smallest hash of the id; a documented bound, as allowed for fitting a classifier) in
one task, PASSES times in the order of that hash. Scoring covers all rows.

Defined results: null and empty texts have no features and get the score of the intercept. Rows with a null label or id teach
nothing; of several labels of one id the largest holds, and of several rows of one id that with the greatest text teaches. Repeated rows are scored row by row. Without any
labelled row every score is 0.5.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc_mod, map_rows

BITS = 18
SCALE = 30.0
MAX_ROWS = 8_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
MEMO_TOKENS = 120_000
TOKENS = re.compile(r"\w+|[^\w\s]+")


#: Every pair of equal tokens counts as this one feature too, so that repetition shows for words never seen in training.
AGAIN = np.uint64(0xA0761D6478BD642F)


class _Hashes(Memo):
    def of(self, token: str) -> int:
        return xxhash.xxh64_intdigest(token)


@cache
def _hashes() -> _Hashes:
    return _Hashes(MEMO_TOKENS)


def features(text: str | None) -> np.ndarray:
    """Feature numbers with repetitions."""
    tokens = TOKENS.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    h = np.array([*map(_hashes().__getitem__, tokens)], np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    again = np.full(int((h[1:] == h[:-1]).sum()), AGAIN, np.uint64)
    return (np.concatenate((h * np.uint64(0x9FB21C651E98DF25), pairs, again)) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(found: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-Proximal; the last coordinate is the intercept, free of penalties."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w = np.where(np.abs(z[at]) <= L1, 0.0, w)
        w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
        return w

    for _ in range(PASSES):
        for at, x, label in found:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """docs: doc_id, text. labels: doc_id and the target. The model has a fixed size, 2^18 weights."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(max_rows)

    def make():
        def run(batch):
            sparse = [np.unique(features(t), return_counts=True) for t in batch["text"]]
            return {"turn": batch["turn"], "doc_id": batch["doc_id"], "label": batch["label"], "at": [a for a, _ in sparse], "x": [(SCALE * c / max(c.sum(), 1)).astype(np.float32) for _, c in sparse]}

        return run

    # chosen has max_rows rows at most, so its broadcast is bounded
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("turn", "doc_id", "label").agg(F.max("text").alias("text"))  # one row an id, so max_rows bounds the training task
    rows = map_rows(rows, make, "turn long, doc_id long, label int, at array<int>, x array<float>")

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["turn", "doc_id"], kind="stable")
        w, b = fit([(np.asarray(a, np.int64), np.asarray(x, float), int(y)) for a, x, y in zip(pdf["at"], pdf["x"], pdf["label"], strict=True)])
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "b": [b]})

    model = rows.groupBy(F.lit("all").alias("part")).applyInPandas(learn, "w binary, b double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model[0]["w"], np.float32), model[0]["b"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `score`."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w, b = shared.value

        def run(batch):
            out = []
            for text in batch["text"]:
                found = features(text)
                margin = b + (SCALE * float(w[found].astype(float).sum()) / len(found) if len(found) else 0.0)
                out.append(1 / (1 + float(np.exp(-np.clip(margin, -35, 35)))))
            return {"id": batch["id"], "score": out}

        return run

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def held_out_split() -> F.Column:
    """The fixed fold of this operator: rows whose crc32 of the id modulo 5 is 0 teach nothing."""
    return crc_mod("doc_id", 5) == 0
